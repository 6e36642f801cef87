"""As-of joins cut by time, total orders, closed tiers; tables and their columns, against plain loops."""

import itertools
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quotelake.operators import dimensions, items, joins, tables

T0 = datetime(2020, 1, 1)


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("every", [None, "month", "year"])
def test_as_of_pieces_equal_a_loop(spark, strict, every):
    rng = random.Random(2)
    day = lambda: T0 + timedelta(days=rng.randrange(900))
    series = [(rng.choice("aab"), day(), rng.choice([None, float(rng.randrange(9))])) for _ in range(60)]
    left = [(i, rng.choice("aabc"), day()) for i in range(200)] + [(900, None, T0)]
    best = {}
    for k, t, v in series:
        if v is not None:
            best[k, t] = max(v, best.get((k, t), v))
    want = []
    for i, k, t in left:
        seen = [(u, v) for (key, u), v in best.items() if key == k and (u < t if strict else u <= t)]
        want.append((i, max(seen)[1] if seen else None))
    q = spark.createDataFrame(left, "i int, k string, t timestamp")
    s = spark.createDataFrame(series, "k string, since timestamp, v double")
    out = joins.as_of(q, s, "k", "t", "since", "v", "was", strict, every)
    assert out.columns == ["i", "k", "t", "was"] and sorted((r.i, r.was) for r in out.collect()) == sorted(want)


def test_pieces_of_a_frequent_key_lie_apart(spark):
    """One key for all rows: with pieces no partition of the sequence has all of it."""
    q = spark.range(4000).select(F.expr("if(id < 0, 'x', 'k')").alias("k"), F.expr("timestamp '2020-01-01' + make_dt_interval(int(id))").alias("t"))
    s = q.select("k", F.col("t").alias("since"), F.dayofyear("t").cast("double").alias("v"))
    name = "spark.sql.adaptive.enabled"
    spark.conf.set(name, "false")
    try:
        counts = [joins.as_of(q, s, "k", "t", "since", "v", "was", every=e).select("was").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() for e in (None, "quarter")]
        most = [max(c) for c in counts]
    finally:
        spark.conf.unset(name)
    assert most[0] == 4000 and most[1] < 2000


def test_total_order(spark, tmp_path):
    rows = [(i * 7919 % 1000 // 3, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(5)
    out = joins.in_total_order(df, [F.desc("a"), F.asc("b")], "n", str(tmp_path), 4)
    assert [(r.a, r.b) for r in out.orderBy("n").collect()] == sorted(rows, key=lambda r: (-r[0], r[1]))
    assert sorted(r.n for r in out.collect()) == list(range(1, 1001))
    assert joins.in_total_order(df.limit(0), [F.asc("a")], "n", str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("closed", [True, False])
def test_tiers_equal_a_loop(spark, closed):
    rng = random.Random(3)
    tiers = [(rng.choice("xy"), float(a), rng.choice([None, a, a + 1, a + 5, a + 20]) if i else 3.0, i) for i, a in enumerate(rng.choices(range(0, 40, 3), k=14))]
    tiers = [(k, a, None if b is None else float(b), i) for k, a, b, i in tiers]
    values = [(k, v / 2) for k in "xyz" for v in range(-2, 120)]
    want = []
    for k, v in values:
        fit = sorted((a, float("inf") if b is None else b, i) for key, a, b, i in tiers if key == k and a <= v and (b is None or (v <= b if closed else v < b)))
        want.append((k, v, fit[0][2] if fit else None))
    got = joins.interval(spark.createDataFrame(values, "k string, v double"), spark.createDataFrame(tiers, "k string, a double, b double, i int"), ["k"], "v", "a", "b", closed)
    assert sorted(map(repr, ((r.k, r.v, r.i) for r in got.collect()))) == sorted(map(repr, want))


def test_best_assignment_equals_all_permutations(spark):
    rng = random.Random(7)
    roles = list(tables.KEYWORDS)
    grids = [[[rng.choice([0.0, 0.6, 0.75, 0.8, 1.0]) for _ in roles] for _ in range(rng.randrange(0, 7))] for _ in range(60)]
    df = spark.createDataFrame([(i, [tuple(f) for f in g]) for i, g in enumerate(grids)], "i int, fitted array<struct<" + ",".join(f"{r}:double" for r in roles) + ">>")
    got = {r.i: tuple(r.assigned) for r in tables.best_assignment(df, "fitted").collect()}
    for i, g in enumerate(grids):
        best = max((round(sum(g[c][r] for r, c in enumerate(p) if c is not None), 9) for p in itertools.product([*range(len(g)), None], repeat=len(roles))
            if len([c for c in p if c is not None]) == len({c for c in p if c is not None}) and all(c is None or g[c][r] >= 0.6 for r, c in enumerate(p))), default=0.0)
        *at, total = got[i]
        used = [c for c in at if c is not None]
        assert abs(total - best) < 1e-9 and len(used) == len(set(used)) and abs(sum(g[c][r] for r, c in enumerate(at) if c is not None) - best) < 1e-9


def scores(spark, headers, rows=()):
    df = spark.createDataFrame([(list(headers), [list(r) for r in rows])], "h array<string>, r array<array<string>>")
    return df.select(tables.score(F.col("h"), F.col("r")).alias("s"), tables.looks_like_data(F.col("h")).alias("d")).first()


def test_table_scores(spark):
    assert scores(spark, ["Item", "Description", "Qty", "Unit"], [["1", "x", "2", "m"]]).s == 140
    assert scores(spark, ["Item", "Detail", "Pipe Spec", "Qty", "Size1", "Size2", "Notes", "Rev"]).s == 40 + 30 + 30 + 8 + 8 - 35 + 15 + 50
    assert scores(spark, ["Item", "Vendor"]).s == -100
    assert scores(spark, ["12 jan 24", "Rev"]).s == -100
    assert scores(spark, ["John Smith", "117", "x", "y"]).d and not scores(spark, ["John Smith", "x", "y"]).d
    assert scores(spark, ["a", "b"]).s == -20
    assert scores(spark, ["Qty", "x", "y"], [["1", "", ""], [None, " ", "2"], ["1", "2", "3"]]).s == 30 - 20
    assert scores(spark, []).d and scores(spark, [None, " "]).d


def test_repaired_diameters(spark):
    texts = {"30000X25": "3000X25", "5080x15.9 and 4060*12": "508x15.9 and 406*12", "3000X5": "3000X5", "30500X25": "305X25", "45080X10": "4508X10", "130000×7": "13000×7", "5080": "5080", "5085x1": "5085x1", "9990x1": "999x1", "00990x2": "00990x2"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.x for r in df.select("t", items.corrected_text(F.col("t")).alias("x")).collect()} == texts


def test_dimensions_need_agreement(spark):
    """Two columns that stand in no ratio, and a table without numbers, have no roles; a hint in some rows isn't enough."""
    rows = [("a", [str(i), str(3 * i + 1)]) for i in range(1, 9)] + [("b", ["x", "y"])] + [("c", [str(i * 25.4), str(i), "STD"]) for i in range(1, 5)] + [("c", ["7", "100", "40"])] * 4
    out = {r.t: r for r in dimensions.columns_of(spark.createDataFrame(rows, "t string, cells array<string>"), "t").collect()}
    assert not {"a", "b", "c"} & {t for t, r in out.items() if r.od_mm is not None}


def test_cells_of_dimension_tables_are_read_once_for_all_votes(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def cells(k):
        made.add(1)
        return [str(o) for o in (k % 3 + 1.0, [25, 50, 80][k % 3], "40", "-")]

    grid = spark.range(200).select((F.col("id") % 2).alias("t"), "id", cells("id").alias("cells"))
    out = dimensions.dimensions(grid, "t").select("t", "id", "nps", "dn", "schedule").collect()
    assert sorted((r.id, r.t, r.nps, r.dn, r.schedule) for r in out) == [(k, k % 2, k % 3 + 1.0, [25.0, 50.0, 80.0][k % 3], "40") for k in range(200)]
    assert made.value <= 600  # for numbers and for names of schedules, and to read them


def test_related_tables_equal_a_loop_without_a_join(spark, capsys):
    rng = random.Random(4)
    pools = [["a", "b", "c"], [" A", "b ", "C", "d"], ["x", None], [], [None], ["x", "y", "z"]]
    rows = [(doc, i, rng.choice([1, 2, 3, 5, 9, None]), rng.choice(pools)) for doc in (1, 2, 3, None) for i in range(12)] + [(1, 3, 2, ["a", "b"])]
    out = items.related_tables(spark.createDataFrame(rows, "doc long, i long, page int, headers array<string>"), "doc", "i", "page", "headers")
    own = [(d, i, p, {h.lower().strip() for h in hs if h is not None}) for d, i, p, hs in rows]
    near = lambda a, b: None not in (a[0], a[2], b[2]) and a[0] == b[0] and a[1] < b[1] and 0 <= b[2] - a[2] <= 2 and len(a[3] & b[3]) >= 0.6 * len(a[3] | b[3]) > 0
    follows = {(b[0], b[1]) for a in own for b in own if near(a, b)}
    want = sorted(((d, i, sum((o[0], o[1]) not in follows for o in own if o[0] == d and o[1] <= i)) for d, i, _, _ in own if (d, i) != (1, 3)), key=repr)
    assert sorted(((r.doc, r.i, r.group) for r in out.collect() if (r.doc, r.i) != (1, 3)), key=repr) == want and follows
    out.explain()
    assert "Join" not in capsys.readouterr().out
