"""Queries of headers, tables, titles, notes, material codes, snapshots and reference lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelake.functions import parse
from quotelake.functions import text as tx
from quotelake.functions.json_repair import recovered_json
from quotelake.operators import documents, filters, joins, sinks
from quotelake.operators.items import document_kind
from quotelake.plans.materials import DESCRIBED, described, tables
from quotelake.plans.pricing import literal, values
from quotelake.registry import register
from quotelake.sources import domain
from quotelake.sources.domain import sql

HEADS = "SELECT material_id, CASE material_id % 6 WHEN 0 THEN ' Item No.' WHEN 1 THEN 'DESCRIPTION of goods' WHEN 2 THEN 'Qty' WHEN 3 THEN 'Unit (UOM)' WHEN 4 THEN 'Total Weight' ELSE 'Colour' END AS head FROM materials"


def heads(spark, d):
    n = F.col("material_id") % 6
    names = [" Item No.", "DESCRIPTION of goods", "Qty", "Unit (UOM)", "Total Weight"]
    head = F
    for i, x in enumerate(names):
        head = head.when(n == i, x)
    return domain.materials(spark, d).select("material_id", head.otherwise("Colour").alias("head"))


@register("s15_header_roles", sql("SELECT material_id, CASE material_id % 6 WHEN 0 THEN 'item_number' WHEN 1 THEN 'description' WHEN 2 THEN 'quantity' WHEN 3 THEN 'unit' WHEN 4 THEN 'weight' END AS role, CASE material_id % 6 WHEN 2 THEN 0.8 ELSE 0.0 END AS quantity_score FROM heads", heads=HEADS))
def s15(spark, d):
    """What a column is for, and how well its header fits one word."""
    h = heads(spark, d)
    score = F.when(F.col("material_id") % 6 == 2, tx.keyword_score(F.lit("quant"), "quantity")).otherwise(F.round(tx.keyword_score(F.lit("zzzz"), "quantity"), 6))
    return h.select("material_id", tx.role(F.col("head")).alias("role"), score.alias("quantity_score"))


@register("s14_column_map", sql("SELECT run_id, min(CASE WHEN run_id % 3 <> 1 THEN CASE run_id % 3 WHEN 0 THEN 0 ELSE 2 END END) AS item_number, min(CASE WHEN run_id % 3 = 0 THEN 2 END) AS quantity FROM items GROUP BY run_id"))
def s14(spark, d):
    """The first column of each role in a table's headers."""
    t = tables(spark, d).select("run_id", F.posexplode("headers").alias("i", "h")).withColumn("role", tx.role(F.col("h")))
    first = lambda r: F.min(F.when(F.col("role") == r, F.col("i")))
    return t.groupBy("run_id").agg(first("item_number").alias("item_number"), first("quantity").alias("quantity"))


@register("s18_best_table", sql("SELECT run_id % 100 AS doc, min(run_id) AS run_id FROM (SELECT DISTINCT run_id FROM items WHERE run_id % 3 = 0) GROUP BY ALL"))
def s18(spark, d):
    """Tables by document (a hundred of them): the best that is accepted, the first of equal ones."""
    t = documents.scored_tables(tables(spark, d), "headers", "rows").withColumn("doc", F.col("run_id") % 100)
    return documents.best_table(t, "doc", "run_id", "score").select("doc", "run_id")


@register("d05c_all_keyed_rows", sql("SELECT run_id, CASE run_id % 3 WHEN 0 THEN 'Qty' WHEN 1 THEN 'Remarks' ELSE 'Item' END AS header, count(*) AS n, (3 * count(*))::BIGINT AS cells, min(quantity)::VARCHAR AS least FROM items GROUP BY run_id"))
def d05c(spark, d):
    """Cells by their headers, for the tables of all runs: how many there are, and the least under the third header."""
    t = tables(spark, d).select("run_id", F.get("headers", F.lit(2)).alias("header"), documents.keyed_rows(F.col("headers"), F.col("rows")).alias("k"))
    cells = F.aggregate("k", F.lit(0).cast("long"), lambda n, m: n + F.size(m))
    least = F.array_min(F.transform("k", lambda m: F.element_at(m, F.col("header")).cast("double")))
    return t.select("run_id", "header", F.size("k").cast("long").alias("n"), cells.alias("cells"), least.cast("string").alias("least"))


@register("d09_row_estimate", sql("SELECT run_id, count(*) FILTER (quantity > 10) AS n FROM items GROUP BY run_id"))
def d09(spark, d):
    """Rows that look like items: a number first, and a quantity over ten."""
    return tables(spark, d).select("run_id", F.size(F.filter("rows", lambda r: F.get(r, 0).rlike("^[0-9]+$") & (F.get(r, 2).cast("double") > 10))).cast("long").alias("n"))


@register("d12_confidence", sql("SELECT material_id, round(0.4 + CASE WHEN material_id % 2 = 0 THEN 0.35 ELSE 0 END + CASE WHEN trim(category) <> '' THEN 0.25 ELSE 0 END, 6) AS confidence FROM materials"))
def d12(spark, d):
    m = domain.materials(spark, d).withColumn("grade", F.when(F.col("material_id") % 2 == 0, "x").otherwise(" "))
    return m.select("material_id", F.round(documents.confidence({"name": 0.4, "grade": 0.35, "category": 0.25}), 6).alias("confidence"))


@register("w14_dense_pages", "WITH p AS (SELECT doc_id % 40 AS doc, doc_id // 40 + 1 AS page, n_chars FROM documents), h AS (SELECT doc, min(page) AS a, max(page) AS b FROM p WHERE page % 5 = 1 AND n_chars >= 500 GROUP BY doc) SELECT doc, page FROM p JOIN h USING (doc) WHERE page BETWEEN a AND b")
def w14(spark, d):
    """Every fifth page is looked at, all between the hits are kept."""
    p = domain.read(spark, d, "documents").select((F.col("doc_id") % 40).alias("doc"), (F.floor(F.col("doc_id") / 40) + 1).alias("page"), "n_chars")
    return documents.sampled_then_dense(p, "doc", "page", "n_chars", 5, 500).select("doc", "page")


@register("s25_signatures", sql("SELECT run_id, 'table::' || CASE run_id % 3 WHEN 0 THEN 'item|description|qty|unit' WHEN 1 THEN 'revision|date|remarks' ELSE 'vendor|document no|item' END || '::first' AS signature FROM (SELECT DISTINCT run_id FROM items)"))
def s25(spark, d):
    return tables(spark, d).select("run_id", tx.layout_signature(F.lit("table"), F.col("headers"), F.lit("first")).alias("signature"))


@register("s26_titles", sql("SELECT material_id, 'Rfq ' || material_id || ' ' || upper(name[1]) || split_part(name, ' ', 1)[2:] || ' ' || upper(split_part(name, ' ', 2)[1]) || split_part(name, ' ', 2)[2:] AS title, CASE WHEN material_id % 2 = 0 THEN 'RFQ' ELSE 'OTHER' END AS kind FROM materials"))
def s26(spark, d):
    """Titles and kinds from file names."""
    name = F.concat(F.lit("/in/rfq_"), F.col("material_id").cast("string"), F.lit("-"), F.replace("name", F.lit(" "), F.lit("__")), F.lit(".pdf"))
    kind = F.when(F.col("material_id") % 2 == 0, F.lit("new rfq.pdf")).otherwise(F.lit("photo.jpg"))
    return domain.materials(spark, d).select("material_id", tx.title_of(name).alias("title"), document_kind(kind).alias("kind"))


@register("s27_embedded_metadata", sql("SELECT material_id, base_cost AS price, 'note ' || name AS notes FROM materials"))
def s27(spark, d):
    """A JSON object in notes, read and taken out."""
    notes = F.concat(F.lit("note [pricing:{\"price\": "), F.col("base_cost").cast("string"), F.lit(", \"x\": 1}] "), F.col("name"))
    m = domain.materials(spark, d).select("material_id", notes.alias("n"))
    return m.select("material_id", tx.embedded(F.col("n"), "pricing", "price double")["price"].alias("price"), F.regexp_replace(tx.without_embedded(F.col("n"), "pricing"), " +", " ").alias("notes"))


@register("s28_json_repair", sql("SELECT material_id, base_cost AS price FROM materials"))
def s28(spark, d):
    """Objects with fences, loose commas or no end, read again."""
    cost = F.col("base_cost").cast("string")
    n = F.col("material_id") % 3
    broken = F.when(n == 0, F.concat(F.lit('```json\n{"price": '), cost, F.lit(",}\n```"))).when(n == 1, F.concat(F.lit('Here: {"price": '), cost, F.lit(', "rest": "cut of'))).otherwise(F.concat(F.lit("{'price': "), cost, F.lit("}")))
    return domain.materials(spark, d).select("material_id", F.from_json(recovered_json(broken)["json"], "price double")["price"].alias("price"))


@register("w06_line_numbers", sql("SELECT run_id, material_id, quantity, item_price, CASE WHEN flag <> 'R' THEN line_number::BIGINT ELSE most + rn END AS line FROM (SELECT *, coalesce(max(CASE WHEN flag <> 'R' THEN line_number END) OVER (PARTITION BY run_id), 0) AS most, row_number() OVER (PARTITION BY run_id, flag = 'R' ORDER BY material_id, quantity, item_price) AS rn FROM items)"))
def w06(spark, d):
    """Given line numbers stay, the others go on from the largest."""
    i = domain.items(spark, d).withColumn("line", F.when(F.col("flag") != "R", F.col("line_number")))
    out = sinks.numbered(i, "line", ["run_id"], F.lit(0), [F.asc("material_id"), F.asc("quantity"), F.asc("item_price")])
    return out.select("run_id", "material_id", "quantity", "item_price", F.col("line").cast("long").alias("line"))


@register("m20_material_codes", sql("SELECT material_id, CASE material_id % 5 WHEN 0 THEN 'M-CS-BEAM-W' || size || 'X' || (material_id % 300 + 10) || '-ROLL-A992' WHEN 2 THEN 'M-CS-PIPE-OD' || (600 + material_id % 900) || '_WT' || (size + 5) || '-SEAM-A106' END AS code FROM described JOIN materials USING (material_id)", described=DESCRIBED.replace("material_id, name, category,", "material_id,")))
def m20(spark, d):
    """Codes from parsed descriptions; what doesn't parse has none."""
    t = described(spark, d).withColumns({"b": parse.beam(F.col("description")), "t": parse.tubular(F.col("description")), "k": parse.kind(F.col("description"))})
    beam = F.concat(F.lit("W"), parse.size_code(F.round(F.col("b.depth_mm") / 25.4, 6)), F.lit("X"), parse.size_code(F.round(F.col("b.weight_kg_m") / 1.488, 6)))
    tube = F.concat(F.lit("OD"), parse.size_code(F.col("t.od_mm")), F.lit("_WT"), parse.size_code(F.col("t.wall_mm")))
    cs = F.lit("CS")
    code = F.when((F.col("k") == "BEAM") & (F.col("b.family") == "W"), parse.material_code(cs, F.lit("BEAM"), beam, F.lit("ROLL"), F.lit("A992")))
    return t.select("material_id", code.when(F.col("k") == "TUBULAR", parse.material_code(cs, F.lit("PIPE"), tube, F.lit("SEAM"), F.lit("A106"))).alias("code"))


@register("p23_snapshots", sql("SELECT run_id, count(*) AS n, round(sum(item_price), 2) AS total FROM items GROUP BY run_id"))
def p23(spark, d):
    """A version's items as one JSON text, and read again."""
    s = domain.items(spark, d).groupBy("run_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("line_number", "material_id", "item_price")))).alias("snapshot"))
    back = F.from_json("snapshot", "array<struct<line_number: int, material_id: long, item_price: double>>")
    return s.select("run_id", F.explode(back).alias("x")).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x.item_price"), 2).alias("total"))


PRICES = [("click", 0.002), ("view", 0.001), ("purchase", 0.05), ("signup", 0.01)]
PRICE_COLUMNS = "service string, per_unit double"


@register("p39_call_costs", sql("SELECT service, round(sum(tokens * coalesce(per_unit, 0)), 6) AS cost, count(*) FILTER (per_unit IS NULL) AS unpriced FROM usage LEFT JOIN prices USING (service) GROUP BY service", prices=values(PRICE_COLUMNS, PRICES)))
def p39(spark, d):
    u = domain.usage(spark, d).join(literal(spark, PRICE_COLUMNS, PRICES), "service", "left")
    return u.groupBy("service").agg(F.round(F.sum(F.col("tokens") * F.coalesce("per_unit", F.lit(0.0))), 6).alias("cost"), F.count(F.when(F.col("per_unit").isNull(), 1)).alias("unpriced"))


DUTIES = [("PROMO", 1, 5.0, "1995-01-01", "1997-12-31"), ("PROMO", 1, 7.5, "1998-01-01", None), ("ECONOMY", None, 2.0, "1995-01-01", None)]
DUTY_COLUMNS = "category string, nation_id int, rate double, valid_from string, valid_to string"


@register("p42_duty_rates", sql("SELECT i.run_id, i.line_number, i.material_id, i.quantity, i.item_price, CASE WHEN category = 'PROMO' AND nation_id = 1 THEN CASE WHEN created_at < TIMESTAMP '1998-01-01' THEN 5.0 ELSE 7.5 END WHEN category = 'ECONOMY' THEN 2.0 END AS rate FROM items i JOIN materials USING (material_id) JOIN runs USING (run_id) JOIN clients USING (client_id)"))
def p42(spark, d):
    """Rates by category, destination (null: any) and day."""
    duties = literal(spark, DUTY_COLUMNS, DUTIES).withColumns({c: F.to_date(c) for c in ("valid_from", "valid_to")}).withColumnRenamed("nation_id", "to_nation")
    rows = domain.items(spark, d).join(domain.materials(spark, d).select("material_id", "category"), "material_id").join(domain.runs(spark, d).select("run_id", "client_id", "created_at"), "run_id")
    rows = rows.join(domain.clients(spark, d).select("client_id", "nation_id"), "client_id")
    r = duties.withColumnRenamed("category", "_c")
    fits = (F.col("category") == F.col("_c")) & filters.wildcard("to_nation", F.col("nation_id"), None) & filters.valid_on(F.to_date("created_at"), "valid_from", "valid_to")
    return rows.join(r, fits, "left").select("run_id", "line_number", "material_id", "quantity", "item_price", "rate")


@register("io15_backfilled_tenants", sql("SELECT run_id, coalesce(outcome, segment) AS filled FROM runs JOIN clients USING (client_id)"))
def io15(spark, d):
    r = domain.runs(spark, d).join(domain.clients(spark, d).select("client_id", "segment"), "client_id")
    return sinks.backfill(r.select("run_id", F.col("outcome").alias("filled")), r.select("run_id", F.col("segment").alias("filled")), ["run_id"], "filled")


@register("io17_cascade_delete", sql("SELECT run_id, line_number, material_id, quantity FROM items WHERE run_id NOT IN (SELECT run_id FROM runs WHERE status = 'rejected')"))
def io17(spark, d):
    gone = domain.runs(spark, d).filter("status = 'rejected'")
    kept = sinks.delete_cascade({"items": (domain.items(spark, d), "run_id")}, gone, "run_id")["items"]
    return kept.select("run_id", "line_number", "material_id", "quantity")


@register("j09_as_of_inclusive", sql("SELECT material_id, round(price, 6) AS price FROM (SELECT DISTINCT material_id FROM materials) LEFT JOIN (SELECT material_id, max(unit_price) AS price FROM (SELECT *, rank() OVER (PARTITION BY material_id ORDER BY effective_at DESC) AS k FROM items WHERE effective_at <= TIMESTAMP '1999-06-30') WHERE k = 1 GROUP BY material_id) USING (material_id)"))
def j09(spark, d):
    """Each material's price on a day."""
    m = domain.materials(spark, d).select("material_id").distinct().withColumn("at", F.to_timestamp_ntz(F.lit("1999-06-30 00:00:00")))
    return joins.as_of(m, domain.items(spark, d), "material_id", "at", "effective_at", "unit_price", "price", strict=False).select("material_id", F.round("price", 6).alias("price"))
