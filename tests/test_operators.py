"""Golden values, edge cases and invariants of operators and functions."""

import io
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quotelake.functions import money, parse, similarity
from quotelake.functions import text as tx
from quotelake.operators import documents, filters, joins, matching, pricing, sinks
from quotelake.sources import files
from quotelake.streaming import flows


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def lit2(a, b):
    return F.lit(a), F.lit(b)


@pytest.mark.parametrize(("a", "b", "n"), [("kitten", "sitting", 3), ("saturday", "sunday", 3), ("", "hello", 5), ("KITTEN", "sitting", 3)])
def test_distance(spark, a, b, n):
    assert one(spark, similarity.distance(*lit2(a, b))) == n


def test_similarity(spark):
    assert one(spark, similarity.similarity(*lit2("same", "same"))) == 1 and one(spark, similarity.similarity(*lit2("", "x"))) == 0
    rows = spark.createDataFrame([("red widget", "new widget", 0.8041667), ("red widget", "large gear", 0.5666667), ("a", None, 0.0)], "a string, b string, want double")
    assert all(abs(r.got - r.want) < 1e-6 for r in rows.select("want", similarity.jaro_winkler("a", "b").alias("got")).collect())
    assert [one(spark, similarity.soundex(F.lit(x))) for x in ("Robert", "Pfister", "Tymczak", "", "1a")] == ["R163", "P236", "T520", "", "A000"]
    assert one(spark, similarity.jaccard(similarity.grams(F.lit("a")), similarity.grams(F.lit("a b")))) == 0
    assert one(spark, similarity.jaccard(similarity.grams(F.lit("")), similarity.grams(F.lit("a")))) == 1


def test_agreement_prices(spark):
    rows = [(1, "BASE_PRICE", "AMOUNT", 1000.0), (2, "BASE_PRICE", "AMOUNT", 1000.0), (2, "DISCOUNT", "PERCENT", 10.0), (2, "SURCHARGE", "AMOUNT", 50.0), (3, "BASE_PRICE", "AMOUNT", 1000.0), (3, "DISCOUNT", "PERCENT", 10.0), (3, "TAX", "PERCENT", 6.0), (3, "LME", "AMOUNT", 50.0)]
    out = {r.k: r for r in pricing.evaluate(spark.createDataFrame(rows, "k int, condition_type string, rate_type string, rate double"), ["k"]).collect()}
    assert out[1].net == 1000 and (out[2].discount, out[2].surcharge, out[2].net) == (100, 50, 950) and (out[3].tax, out[3].net) == (54, 1004)


def test_tiers(spark):
    tiers = spark.createDataFrame([("a", 0.0, 10.0, 1000), ("a", 10.0, 50.0, 900), ("a", 50.0, None, 800)], "s string, f double, t double, rate int")
    q = spark.createDataFrame([("a", float(x)) for x in (5, 10, 20, 50, 80)] + [("b", 1.0)], "s string, q double")
    got = {(r.s, r.q): r.rate for r in joins.interval(q, tiers, ["s"], "q", "f", "t").collect()}
    assert got == {("a", 5.0): 1000, ("a", 10.0): 900, ("a", 20.0): 900, ("a", 50.0): 800, ("a", 80.0): 800, ("b", 1.0): None}


def test_overlapping_tiers(spark):
    tiers = spark.createDataFrame([("a", 0.0, 10.0, 1), ("a", 5.0, 20.0, 2), ("a", 8.0, 9.0, 3), ("a", 15.0, None, 4), ("a", 30.0, 40.0, 5)], "s string, f double, t double, rate int")
    q = spark.createDataFrame([("a", x) for x in (-1.0, 0.0, 5.0, 9.5, 10.0, 19.0, 20.0, 35.0)], "s string, q double")
    got = {r.q: r.rate for r in joins.interval(q, tiers, ["s"], "q", "f", "t").collect()}
    assert got == {-1.0: None, 0.0: 1, 5.0: 1, 9.5: 1, 10.0: 2, 19.0: 2, 20.0: 4, 35.0: 4}


def test_most_specific_rule(spark):
    rules = spark.createDataFrame([(None, None, 1), ("c", None, 2), (None, "o", 3), ("c", "o", 4), ("c", "o", 5)], "client string, origin string, rule int")
    items = spark.createDataFrame([("c", "o"), ("c", "x"), ("y", "o"), ("y", "x"), (None, None)], "client string, origin string")
    got = {tuple(r)[:2]: r.rule for r in pricing.most_specific(items, rules, ["client", "origin"], [F.desc("rule")]).collect()}
    assert got == {("c", "o"): 5, ("c", "x"): 2, ("y", "o"): 3, ("y", "x"): 1, (None, None): 1}


def test_cascade_takes_the_first_level_whole(spark):
    items = spark.createDataFrame([(1, "m", "g"), (2, "m2", "g"), (3, "x", "y")], "id int, m string, g string")
    by_m = spark.createDataFrame([("m", 1), ("m", 2)], "m string, v int")
    by_g = spark.createDataFrame([("g", 3)], "g string, v int")
    out = joins.cascade(items, [(by_m, ["m"]), (by_g, ["g"])], ["id"]).select("id", "level", "v").collect()
    assert sorted(map(tuple, out)) == [(1, 1, 1), (1, 1, 2), (2, 2, 3)]


def test_as_of(spark):
    q = spark.createDataFrame([(1, 5, "x"), (1, 1, "y"), (2, 9, "z")], "k int, t int, tag string")
    s = spark.createDataFrame([(1, 1, 10.0), (1, 5, 50.0), (1, 3, 30.0), (1, 3, 31.0)], "k int, t int, v double")
    at = lambda strict: {r.tag: r.v0 for r in joins.as_of(q, s, "k", "t", "t", "v", "v0", strict).collect()}
    assert at(True) == {"x": 31.0, "y": None, "z": None} and at(False) == {"x": 50.0, "y": 10.0, "z": None}


def test_risk(spark):
    m = [one(spark, pricing.item_margin_pct(F.lit(p), F.lit(c).cast("double"))) for p, c in ((120.0, 100.0), (80.0, 100.0), (1.0, 0.0), (1.0, None))]
    assert m == [20, -20, 0, 0]
    for parts, level, score in (((10, 15, 5, 0), "LOW", 8.5), ((40, 35, 30, 10), "MEDIUM", 32.25), ((80, 70, 90, 50), "HIGH", 78)):
        s = pricing.overall_risk(*[F.lit(float(x)) for x in parts])
        assert abs(one(spark, s) - score) < 1e-9 and one(spark, pricing.risk_level(s)) == level
    items = spark.createDataFrame([(1, 120.0, 0.0, 120.0), (2, 120.0, 100.0, 120.0), (2, 180.0, 100.0, 180.0)], "run int, price double, cost double, total double")
    assert {r.run: r.anomaly for r in pricing.anomaly(items, "run", "price", "cost", "total").collect()} == {1: 50.0, 2: 40.0}
    assert one(spark, pricing.deviation_score(F.lit(1.0), F.lit(9.0), F.lit(2))) == 40


def test_money(spark):
    assert [one(spark, money.nearest(F.lit(x), 10.0)) for x in (125.0, -125.0)] == [130.0, -120.0]
    assert one(spark, money.safe_div(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, pricing.tax(F.lit(100.0), F.lit(0.06))) == 6.0 and one(spark, pricing.tax(F.lit(100.0), F.lit(None))) == 0.0


def test_chunks_and_quantities(spark):
    got = [[tuple(c) for c in one(spark, documents.chunks(F.lit(n)))] for n in (3, 7)]
    assert got == [[(1, 3)], [(1, 4), (4, 7), (7, 7)]] and one(spark, documents.chunks(F.lit(201))) is None
    assert [one(spark, tx.quantity(F.lit(x))) for x in ("1,234", "1.234,5", "1,5", "12.5", "", None, "no")] == [1234, 1235, 2, 13, None, None, None]
    assert [one(spark, tx.unit(F.lit(x))) for x in ("Kgs.", "mtr", "what", None)] == ["KG", "M", "EA", "EA"]


def test_table_scores(spark):
    empty = F.array().cast("array<array<string>>")
    score = lambda *h: one(spark, documents.table_score(F.array(*map(F.lit, h)), empty))
    assert score("Item", "Description", "Qty", "Unit") == 130
    assert score("Item", "Vendor", "Qty") == -100 and score("123", "45", "Item") == -100


def test_parsers(spark):
    b = one(spark, parse.beam(F.lit("beam W24x104")))
    assert b.family == "W" and abs(b.depth_mm - 609.6) < 1e-9 and abs(b.weight_kg_m - 154.752) < 1e-9
    assert one(spark, parse.beam(F.lit("HEB 300"))).family == "HEB" and one(spark, parse.beam(F.lit(None))).family is None
    t = one(spark, parse.tubular(F.lit("1828.8×44.5")))
    assert (t.od_mm, t.wall_mm, t.id_mm) == (1828.8, 44.5, 1828.8 - 89)
    assert one(spark, parse.reducer_size(F.lit("1828.8->1371.6x38"))) == "1828_8_1371_6_T38"
    code = parse.material_code(F.lit("CS"), F.lit("PIPE"), F.concat(F.lit("OD"), parse.size_code(F.lit(406.4)), F.lit("_WT"), parse.size_code(F.lit(25.4))), F.lit("SEAM"), F.lit("A106"))
    assert one(spark, code) == "M-CS-PIPE-OD406_4_WT25_4-SEAM-A106"
    assert one(spark, parse.pipe(F.lit("PIPE DN50 SCH 80 A106 GR B seamless"))).nps == 2.0


def test_matches_find_themselves(spark):
    texts = ["W24x104 beam", "Tubular 700x20", "Plate PL12 EN 10025 S275", 'Pipe 6" SCH 40 A106 GR B SMLS CS', "nothing", None]
    cat = spark.createDataFrame(list(enumerate(texts)), "m long, d string")
    every = matching.best_matches(cat.select(F.col("m").alias("line"), "d"), cat, "d", "line", "m")
    assert {r.line for r in every.filter("strategy = 'none' AND m IS NULL AND NOT auto").collect()} == {4, 5}
    out = every.filter("rank = 1").collect()
    assert {r.line: r.m for r in out} == {0: 0, 1: 1, 3: 3, 2: 2} and all(r.score >= 90 for r in out)


def test_sinks(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (2, "y"), (3, "z")], "k int, v string")
    assert sorted(map(tuple, sinks.upsert(t, new, ["k"], [F.desc("v")]).collect())) == [(1, "a"), (2, "y"), (3, "z")]
    assert sorted(map(tuple, sinks.insert_absent(t, new, ["k"], [F.asc("v")]).collect())) == [(1, "a"), (2, "b"), (3, "z")]
    assert sorted(map(tuple, sinks.backfill(spark.createDataFrame([(1, None), (2, "k")], "k int, v string"), t, ["k"], "v").collect())) == [(1, "a"), (2, "k")]
    assert sinks.next_code(spark.createDataFrame([("RFQ-0009",), ("RFQ-0010",), ("X-1",)], "c string"), "c", "RFQ").first().code == "RFQ-0011"
    assert sinks.next_code(t.limit(0), "v", "RFQ").first().code == "RFQ-0001"
    n = sinks.numbered(spark.createDataFrame([("r", 5, "a"), ("r", None, "b"), ("r", None, "c")], "r string, n int, v string"), "n", ["r"], F.lit(2), [F.asc("v")])
    assert {r.v: r.n for r in n.collect()} == {"a": 5, "b": 6, "c": 7}
    gone = sinks.delete_cascade({"t": (t, "k")}, new, "k")["t"]
    assert [r.k for r in gone.collect()] == [1]
    assert sinks.flat(spark.range(1).select(F.struct(F.lit(1).alias("b"), F.array(F.lit(2)).alias("c")).alias("a"))).collect()[0].asDict() == {"a_b": 1, "a_c": "[2]"}


def test_tenants_see_their_rows_only(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "tenant_id string, v int")
    c = filters.TenantCatalog({"own": t, "all": t}, "a", frozenset({"all"}))
    assert [r.v for r in c.table("own").collect()] == [1] and sorted(r.v for r in c.table("all").collect()) == [1, 3]
    with pytest.raises(ValueError):
        filters.TenantCatalog({}, None)


def test_ranges():
    assert filters.default_range(None, None, "2024-04-01") == ("2024-01-02", "2024-04-01")
    assert filters.default_range("bad", "2024-03-31", "2024-04-01") == ("2024-01-01", "2024-03-31")


def test_islands_chain(spark):
    rows = spark.createDataFrame([("k", c) for c in (1, 2, 3, 5, 9, 9)], "k string, chunk int")
    assert sorted((r.chunk, r.island) for r in documents.islands(rows, ["k"], "chunk").collect()) == [(1, 1), (2, 1), (3, 1), (5, 2), (9, 3), (9, 3)]


def test_price_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text("material_code,base_cost,notes\n A1 , 12.5 ,x\nA2,bad,\n,,\n")
    rows = files.read_prices(spark, str(tmp_path / "p.csv")).orderBy("material_code").collect()
    assert [(r.material_code, r.base_cost, r.notes) for r in rows] == [("A1", 12.5, "x"), ("A2", None, None)]
    (tmp_path / "q.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        files.read_prices(spark, str(tmp_path / "q.csv"))


def test_page_ranges(spark):
    t = F.lit("--- PAGE 1 ---\none\n--- PAGE 2 ---\ntwo\n")
    assert one(spark, files.page_range(t, F.lit(2), F.lit(2), F.lit(2))) == "two\n"
    assert one(spark, files.page_range(F.lit("abcdefgh"), F.lit(2), F.lit(2), F.lit(2))) == "efgh"


def test_history_is_strictly_before(spark):
    rows = spark.createDataFrame([("c", datetime(2024, 1, 1), 1), ("c", datetime(2024, 1, 1), 2), ("c", datetime(2024, 1, 2), 3)], "c string, t timestamp, v int")
    h = joins.history(rows, "c", F.unix_micros("t"), {"n": F.count(F.lit(1))})
    assert {r.v: r.n for r in h.collect()} == {1: 0, 2: 0, 3: 2}


def test_close_names_equal_all_pairs(spark):
    from quotelake.plans.materials import close_names, s11, s12

    d = "/root/testdata/sf0.1"
    own = [r.p_name for r in spark.read.parquet(f"{d}/part.parquet").select("p_name").distinct().collect()]
    odd = ["", "a", "A", "é", "É", "ab", "abc", "abd", "a b", "x  y z", "x  y w", "日本語", "日本", "-", "--", "small  ring", "RING small", "ring"]
    names = spark.createDataFrame([(x,) for x in {*own, *odd}], "name string").cache()
    a, b = names.select(F.col("name").alias("a")), names.select(F.col("name").alias("b"))
    score = F.round(similarity.weighted(F.col("a"), F.col("b"), similarity.jaro_winkler("a", "b")), 9)
    every = {(r.a, r.b): r.score for r in a.crossJoin(b).filter("a <> b").withColumn("score", score).collect()}
    assert {(r.a, r.b): r.score for r in close_names(names, 0.6).collect()} == {k: v for k, v in every.items() if v >= 0.6}
    mine = {x: sorted((-v, b) for (a, b), v in every.items() if a == x and b in own and v >= 0.6) for x in own}
    assert {r.a: r.b for r in s11(spark, d).collect()} == {x: v[0][1] for x, v in mine.items() if v and -v[0][0] > 0.6}
    assert {r.a: r.matches for r in s12(spark, d).collect()} == {x: "|".join(b for _, b in v) for x, v in mine.items() if v}


def test_flows_do_not_depend_on_the_number_of_files(spark, tmp_path):
    from quotelake.plans.streams import t06
    from quotelake.plans.workflows import t08

    d = "/root/testdata/sf0.001"
    e = spark.read.parquet(f"{d}/events.parquet")
    e.repartitionByRange(130, F.desc("ts")).write.option("maxRecordsPerFile", 100_000).parquet(f"{tmp_path}/events.parquet")
    assert len(list((tmp_path / "events.parquet").glob("*.parquet"))) > 100
    for query in (t06, t08):
        assert sorted(map(tuple, query(spark, str(tmp_path)).collect())) == sorted(map(tuple, query(spark, d).collect()))


def test_chunks_reach_the_last_page(spark):
    got = one(spark, documents.chunks(F.lit(200)))
    assert {p for c in got for p in range(c["first"], c["last"] + 1)} == set(range(1, 201))


def test_every_run_has_keyed_rows(spark):
    from quotelake.plans.headers_and_codes import d05c

    d = "/root/testdata/sf0.001"
    runs = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert d05c(spark, d).count() == runs


def test_takeoff_codes_and_specifications(spark):
    from quotelake.functions import sku

    code = lambda t, s: one(spark, sku.takeoff_code(F.lit(t), F.lit(None).cast("string"), F.lit(s)))
    assert code("W36X194", "ASTM A992") == "M-CS-BEAM-W36X194-ROLL-A992"
    assert code("Pipe 406.4×25.4", "ASTM A106") == "M-CS-PIPE-OD406_4_WT25_4-SEAM-A106"
    assert code("1828.8->1371.6x38", "A36") == "M-CS-CONE-1828_8_1371_6_T38-FABR-A36"
    assert code("1828.8x44.5", "") == "M-CS-TUBROLLED-OD1828_8_WT44_5-ROLL" and code("PL60", None) == "M-CS-PLATE-T60-PLAT" and code("bolt", "A36") is None
    spec = lambda t: one(spark, sku.specification(F.lit(t)))
    assert tuple(spec("457 x 39.61 x 11800"))[:4] == ("TUBULAR", 457.0, 39.61, 11800.0) and spec("W14x38").first == 14.0
    assert spec("EN10210 S355 K2H").kind == "STANDARD" and spec(None).confidence == 0.0 and spec("unknown").confidence == 0.3
    assert one(spark, sku.category_code(F.lit("Gasket"))) == "GASK" and one(spark, sku.category_code(F.lit("Weld neck flanges"))) == "FLNG"


def test_line_items_without_columns(spark):
    from quotelake.operators import extraction

    rows = [("d", 0, ["1", "Pipe 6 inch", "", "12 EA"]), ("d", 1, ["", "short", "x", "n/a"]), ("d", 2, ["XX", "", "", ""]), ("d", 3, ["", "FLANGES", "", ""]), ("d", 4, ["", "Flange blind", "", "1,200 pcs"]), ("d", 5, [None, None, None, None])]
    df = spark.createDataFrame(rows, "doc string, row int, cells array<string>")
    out = sorted(extraction.line_items(df, "doc", "row", "cells", {"item": 0}, ["Item", "A b", "C", "D"]).collect(), key=lambda r: r.row)
    assert [(r.row, r.line_number, r.section) for r in out] == [(0, 1, None), (4, 10004, "FLANGES")]
    out = extraction.line_items(df, "doc", "row", "cells", {"item": 0, "description": 1}, ["Item", "A b", "C", "D"]).filter("row = 0").collect()
    assert out[0].quantity == 12.0 and out[0].unit == "EA" and out[0].extras == {"d": "12 EA"}


def test_next_versions_and_expiries(spark):
    from quotelake.operators import filters

    v = spark.createDataFrame([("a", 1), ("a", 3), ("b", None)], "k string, v int")
    assert {r.k: r.next_version for r in sinks.next_versions(v, ["k"], "v").collect()} == {"a": 4, "b": 1}
    e = spark.createDataFrame([("2020-01-01",), ("2020-01-10",), ("2020-02-10",), (None,)], "u string").withColumn("u", F.to_date("u"))
    assert [r.days_left for r in filters.expiring(e, "u", "2020-01-05", 30).collect()] == [5]
