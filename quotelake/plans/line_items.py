"""Queries of line items, classification, weights, compliance and tables by page, over derived frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelake.operators import items as it
from quotelake.operators import sinks
from quotelake.plans.materials import DESCRIBED, described
from quotelake.plans.pricing import literal, values
from quotelake.registry import register
from quotelake.sources import domain
from quotelake.sources.domain import sql

RULES = [("beam", "structural", 2), ("hea", "structural", 3), ("pipe", "piping", 1), ("plate", "plates", 4), ("a106", "carbon", 9)]
RULE_COLUMNS = "keyword string, label string, rank int"


@register("m24_classified", sql("SELECT material_id, label FROM described LEFT JOIN rules ON contains(lower(description), keyword) QUALIFY row_number() OVER (PARTITION BY material_id ORDER BY rank) = 1", described=DESCRIBED, rules=values(RULE_COLUMNS, RULES)))
def m24(spark, d):
    """The first rule in order that fits."""
    return it.classified(described(spark, d), "description", literal(spark, RULE_COLUMNS, RULES), ["material_id"], "label").select("material_id", "label")


@register("s22_domain_relevance", sql("SELECT material_id, CASE WHEN regexp_matches(low, '\\bpipe\\b') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(low, '\\ba106\\b') THEN 8 ELSE 0 END - CASE WHEN regexp_matches(low, '\\bbeam\\b') THEN 30 ELSE 0 END AS points FROM (SELECT *, lower(description) AS low FROM described)", described=DESCRIBED))
def s22(spark, d):
    return described(spark, d).select("material_id", it.domain_relevance(F.col("description"), {"pipe": 10, "a106": 8, "beam": -30}).alias("points"))


PIPES = [(50, 2.0, "40", 5.44, True), (50, 2.0, "80", 7.48, False), (100, 4.0, "40", 16.07, True), (100, 4.0, "40", 16.2, False), (150, 6.0, "40", 28.26, True), (None, 8.0, "40", 42.55, True)]
PIPE_COLUMNS = "dn int, nps double, schedule string, kg_per_m double, is_preferred boolean"


@register("m27_pipe_weights", sql("SELECT material_id, CASE WHEN size * 25 IN (50, 100, 150) AND material_id % 2 = 0 THEN CASE size WHEN 2 THEN 5.44 WHEN 4 THEN 16.07 ELSE 28.26 END WHEN size IN (2, 4, 6, 8) THEN CASE size WHEN 2 THEN 5.44 WHEN 4 THEN 16.07 WHEN 6 THEN 28.26 ELSE 42.55 END END::DOUBLE AS kg_per_m FROM materials"))
def m27(spark, d):
    """By DN where it is known, else by inches."""
    m = domain.materials(spark, d).select("material_id", F.when(F.col("material_id") % 2 == 0, F.col("size") * 25).alias("dn"), F.col("size").cast("double").alias("nps"), F.lit("40").alias("schedule"))
    return it.pipe_weights(m, literal(spark, PIPE_COLUMNS, PIPES)).select("material_id", "kg_per_m")


@register("m28_compliance", sql("SELECT material_id, CASE WHEN origin = 'Brand#11' THEN 'origin Brand#11' ELSE '' END || CASE WHEN origin = 'Brand#11' AND material_id % 3 <> 0 THEN ',' ELSE '' END || CASE WHEN material_id % 3 <> 0 THEN 'certificate 3.2' ELSE '' END AS blocking, material_id % 5 <> 0 AS advised FROM materials"))
def m28(spark, d):
    """Origins that are banned, certificates that are missing, vendors that aren't listed."""
    rules = spark.createDataFrame([("op", ["Brand#11"], ["3.1", "3.2"], ["v0"])], "operator string, banned_origins array<string>, needed_certificates array<string>, approved_vendors array<string>")
    m = F.col("material_id")
    given = F.when(m % 3 == 0, F.array(F.lit("3.1"), F.lit("3.2"))).otherwise(F.array(F.lit("3.1")))
    rows = domain.materials(spark, d).select("material_id", "origin", F.lit("op").alias("operator"), given.alias("certificates"), F.concat(F.lit("v"), (m % 5).cast("string")).alias("vendor"))
    out = it.compliance(rows, rules)
    return out.select("material_id", F.array_join("blocking", ",").alias("blocking"), (F.size("advisory") > 0).alias("advised"))


@register("m26_pipe_skus", sql("SELECT material_id, 'PIPE-' || size || '-S40-A106-B' AS sku, size::DOUBLE AS back FROM materials"))
def m26(spark, d):
    """Built and read back."""
    s = domain.materials(spark, d).select("material_id", it.pipe_sku(F.col("size").cast("double"), F.lit("40"), F.lit("A106"), F.lit("B")).alias("sku"))
    return s.select("material_id", "sku", it.sku_fields(F.col("sku"))["size"].alias("back"))


@register("d02_item_keys", sql("SELECT material_id, material_id || '|' || category || '|' || CASE WHEN material_id % 5 = 0 THEN size || 'X' || (material_id % 300 + 10) WHEN material_id % 5 = 2 THEN (600 + material_id % 900) || 'X' || (size + 5) || 'X6000' ELSE upper(description[1:50]) END || '|' AS key FROM (SELECT d.*, size FROM described d JOIN materials USING (material_id))", described=DESCRIBED))
def d02(spark, d):
    return described(spark, d).select("material_id", it.item_key(F.col("material_id"), F.col("category"), F.col("description")).alias("key"))


@register("d08_flattened", sql("SELECT run_id, flag AS section_id, line_number AS subsection_id, material_id, quantity, item_price FROM items"))
def d08(spark, d):
    """Items nested in subsections in sections, and flat again."""
    i = domain.items(spark, d)
    subs = i.groupBy("run_id", "flag", "line_number").agg(F.collect_list(F.struct("material_id", "quantity", "item_price")).alias("items"))
    sections = subs.groupBy("run_id", "flag").agg(F.collect_list(F.struct(F.col("line_number").alias("subsection_id"), "items")).alias("subsections"))
    tree = sections.groupBy("run_id").agg(F.collect_list(F.struct(F.col("flag").alias("section_id"), "subsections")).alias("sections"))
    return it.flattened(tree, "sections", ["run_id"])


@register("d14_backfill", sql("SELECT run_id, coalesce(outcome, CASE WHEN run_id % 2 = 0 THEN 'raw' END) AS outcome FROM runs"))
def d14(spark, d):
    r = domain.runs(spark, d).select("run_id", "outcome")
    raw = r.filter("run_id % 2 = 0").select("run_id", F.lit("raw").alias("outcome"))
    return sinks.backfill(r, raw, ["run_id"], "outcome")


@register("d15_document_checks", sql("SELECT run_id, count(*) AS n_items, count(*) FILTER (quantity > 45) AS critical, round(count(*) / 12.0, 6) AS coverage, count(*) FILTER (quantity > 45) > 0 OR count(*) / 12.0 < 0.8 AS review FROM items GROUP BY run_id"))
def d15(spark, d):
    """Large quantities stand for missing ones; twelve rows were on the page."""
    i = domain.items(spark, d).select("run_id", F.when(F.col("quantity") <= 45, F.col("quantity")).alias("q"), F.lit(12).alias("rows"), F.lit("x").alias("text"))
    out = it.document_checks(i, "run_id", "rows", "q", "text")
    return out.withColumn("coverage", F.round("coverage", 6))


@register("d18_tables_in_range", sql("SELECT run_id, line_number, material_id, quantity FROM items WHERE line_number BETWEEN 1 AND 4"))
def d18(spark, d):
    """Line numbers as pages: a chunk of page 2 with two pages around it."""
    t = domain.items(spark, d).select("run_id", "line_number", "material_id", "quantity")
    ranges = domain.runs(spark, d).select("run_id", F.lit(2).alias("first"), F.lit(2).alias("last"))
    return it.tables_in_range(t, ranges, "run_id", "line_number", "first", "last").select("run_id", "line_number", "material_id", "quantity")


@register("d19_reindexed", sql("SELECT run_id, line_number, material_id, quantity, row_number() OVER (PARTITION BY run_id ORDER BY flag, material_id, quantity, item_price) - 1 AS n FROM items"))
def d19(spark, d):
    i = domain.items(spark, d).withColumn("o", F.struct("material_id", "quantity", "item_price"))
    return it.reindexed(i, "run_id", "flag", "o", "n").select("run_id", "line_number", "material_id", "quantity", F.col("n").cast("long").alias("n"))


@register("d10_related_tables", sql("SELECT run_id, line_number, CAST(sum(CASE WHEN line_number = 1 OR (line_number - 1) % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY line_number) AS BIGINT) AS \"group\" FROM (SELECT DISTINCT run_id, unnest(range(1, 8)) AS line_number FROM items)"))
def d10(spark, d):
    """Seven tables a document, on pages of their own; headers change after every third one."""
    runs = domain.items(spark, d).select("run_id").distinct().withColumn("line_number", F.explode(F.sequence(F.lit(1), F.lit(7))))
    heads = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat(F.lit("h"), i.cast("string"), F.lit("_"), F.floor((F.col("line_number") - 1) / 3).cast("string")))
    t = runs.withColumn("page", F.col("line_number")).withColumn("headers", heads)
    return it.related_tables(t, "run_id", "line_number", "page", "headers")


@register("d17_order_items", sql("SELECT run_id, material_id % 9999 + 1 AS item, 'part ' || material_id || ' on two lines' AS description, quantity, 'EA' AS unit FROM items"))
def d17(spark, d):
    """Items written as a purchase order of numbered lines and read again."""
    line = F.concat((F.col("material_id") % 9999 + 1).cast("string"), F.lit(". part "), F.col("material_id").cast("string"), F.lit(" "), F.col("quantity").cast("int").cast("string"), F.lit(" EA\n on two lines\n\n"))
    text = domain.items(spark, d).select("run_id", F.concat(F.lit("ORDER\n"), line).alias("text"))
    out = it.order_items(text, "run_id", "text")
    return out.withColumn("description", F.regexp_replace("description", " +", " "))


@register("w07_next_code", sql("SELECT 'RFQ-' || lpad((max(run_id) % 9000 + 1)::VARCHAR, 4, '0') AS code FROM (SELECT run_id % 9000 AS run_id FROM runs)"))
def w07(spark, d):
    codes = domain.runs(spark, d).select(F.concat(F.lit("RFQ-"), F.lpad((F.col("run_id") % 9000).cast("string"), 4, "0")).alias("code"))
    return sinks.next_code(codes, "code", "RFQ")


@register("s32_corrected_dimensions", sql("SELECT material_id, CASE WHEN d BETWEEN 10000 AND 99999 AND d % 10 = 0 THEN floor(d / 10) WHEN d BETWEEN 3001 AND 9999 THEN floor(d / 10) ELSE d END AS d FROM (SELECT material_id, (material_id * 10 % 20000)::DOUBLE AS d FROM materials)"))
def s32(spark, d):
    return domain.materials(spark, d).select("material_id", it.corrected_dimensions((F.col("material_id") * 10 % 20000).cast("double")).alias("d"))
