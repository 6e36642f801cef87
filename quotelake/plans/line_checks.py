"""Line items with faults by key, checked, with SQL that restates the rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelake.operators import line_checks as lc
from quotelake.registry import register
from quotelake.sources import domain
from quotelake.sources.domain import sql

#: Fields of an item as texts; the same in Spark and DuckDB (S: the name of the text type).
FIELDS = {
    "line_number": "CASE material_id % 9 WHEN 0 THEN '' WHEN 1 THEN ' ' || CAST(line_number AS S) || 'a' WHEN 2 THEN '-' || CAST(line_number AS S) WHEN 3 THEN 'x' ELSE CAST(line_number AS S) END",
    "description": "CASE (material_id + run_id) % 7 WHEN 0 THEN '' WHEN 1 THEN 'pipe' WHEN 2 THEN 'TUBE ' || CAST(material_id % 4000 + 500 AS S) || '0X' || CAST(line_number + 9 AS S) WHEN 3 THEN 'Tubular 45080 x 12' WHEN 4 THEN NULL ELSE 'Flange WN ' || CAST(material_id AS S) END",
    "unit": "CASE run_id % 5 WHEN 0 THEN 'm' WHEN 1 THEN ' Meter ' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE 'EA' END",
    "spec": "CASE WHEN run_id % 3 = 0 THEN 'A106' END", "size1": "CASE run_id % 4 WHEN 0 THEN '5080x15' WHEN 1 THEN '4\"' END", "size2": "CASE WHEN material_id % 2 = 0 THEN '2' END",
    "notes": "CASE material_id % 6 WHEN 0 THEN 'Qty (pcs): ' || CAST(line_number AS S) WHEN 1 THEN 'PCS 12' WHEN 2 THEN 'see drawing' END", "revision": "CASE WHEN run_id % 2 = 0 THEN 'B' END",
}
QUANTITY = "CASE material_id % 10 WHEN 0 THEN NULL WHEN 1 THEN 0.0 WHEN 2 THEN quantity * 7 WHEN 3 THEN quantity + 0.5 ELSE quantity END"


def extracted(spark, d):
    i = domain.items(spark, d)
    return i.select("run_id", "material_id", F.col("line_number").alias("place"), F.col("quantity").alias("given"), *[F.expr(x.replace("AS S)", "AS STRING)")).alias(n) for n, x in FIELDS.items()], F.expr(QUANTITY).cast("double").alias("quantity"))


RAW = "SELECT run_id, material_id, line_number AS place, quantity AS given, " + ", ".join(f"{x.replace('AS S)', 'AS VARCHAR)')} AS {n}" for n, x in FIELDS.items()) + f", CAST({QUANTITY} AS DOUBLE) AS quantity FROM items"
PLAIN = " + ".join(f"CASE WHEN coalesce({n}, '') <> '' THEN {lc.GIVEN[n]} ELSE {lc.ABSENT[n]} END * {lc.WEIGHTS[n]}" for n in lc.GIVEN)
PIECES = r"(?i)(?:pcs|pieces|quantity\s*\(pcs\)|qty\s*\(pcs\))[\s:]*([0-9]+)"
STEP1 = f"""SELECT *, TRY_CAST(nullif(regexp_extract(trim(line_number), '^([+-]?[0-9]+)', 1), '') AS BIGINT) AS n, coalesce(description, '') AS ds, lower(trim(coalesce(unit, ''))) IN ('m', 'meter', 'meters') AND (quantity <> floor(quantity) OR quantity > 100) AS long,
  TRY_CAST(nullif(regexp_extract(coalesce(notes, ''), '{PIECES}', 1), '') AS DOUBLE) AS noted, nullif(regexp_extract(coalesce(description, ''), '{lc.LARGE}', 1), '') AS large FROM raw"""
STEP2 = f"""SELECT *, CASE WHEN ds = '' THEN 0.3 WHEN length(ds) > 10 THEN 0.85 ELSE 0.6 END AS c_d, CASE WHEN coalesce(quantity, 0) = 0 THEN 0.3 WHEN quantity > 0 THEN 0.9 ELSE 0.5 END AS c_q, coalesce(long, false) AND noted IS NOT NULL AS taken,
  quantity > 10 AND quantity < 100 AND quantity % 11 = 0 AS twice, coalesce(length(large) = 5 AND large LIKE '%0', false) AS lost, CASE WHEN material_id % 4000 + 500 <= 4000 AND (material_id + run_id) % 7 = 2 AND material_id % 4000 + 500 >= 1000 THEN true
    WHEN (material_id + run_id) % 7 = 2 AND material_id % 4000 + 500 < 1000 AND material_id % 4000 + 500 > 300 THEN true WHEN (material_id + run_id) % 7 = 2 AND (material_id % 4000 + 500) % 1000 * 10 > 3000 THEN true ELSE false END AS repaired FROM step1"""
CHECKED = f"""SELECT *, n > 0 AS ok, {PLAIN} + c_d * 0.25 + c_q * 0.25 AS confidence, (ds = '')::INT + (coalesce(quantity, 0) = 0)::INT * 2 + (coalesce(unit, '') = '' AND coalesce(quantity, 1) <> 0 AND quantity IS NOT NULL)::INT
  + (ds <> '' AND length(ds) < 5)::INT + coalesce(twice, false)::INT + taken::INT + (coalesce(long, false) AND NOT taken)::INT + lost::INT + repaired::INT + coalesce(run_id % 4 = 0, false)::INT AS warned FROM step2"""
STEPS = {"raw": RAW, "step1": STEP1, "step2": STEP2, "checked": CHECKED}


@register("d13_checked_lines", sql("SELECT run_id, material_id, place, given, CASE WHEN ok THEN n END AS number, round(CASE WHEN ok THEN confidence END, 6) AS confidence, CASE WHEN ok THEN least(c_q, CASE WHEN twice THEN 0.6 ELSE 1 END, CASE WHEN long AND NOT taken THEN 0.5 ELSE 1 END) END::DOUBLE AS quantity_confidence, CASE WHEN ok THEN warned ELSE 0 END::INTEGER AS warned, CASE WHEN taken THEN noted ELSE quantity END AS quantity, CASE WHEN taken THEN quantity END AS total_length FROM checked", **STEPS))
def d13_checked(spark, d):
    """Items with how sure they are, how many things look wrong, and their repaired quantities."""
    c = lc.checked(extracted(spark, d))
    return c.select("run_id", "material_id", "place", "given", "number", F.round("confidence", 6).alias("confidence"), F.col("fields.quantity").alias("quantity_confidence"), F.size("warnings").alias("warned"), "quantity", "total_length")


@register("d12_document_confidence", sql("""SELECT run_id, count(*) FILTER (ok) AS items, count(*) FILTER (ok IS NOT TRUE) AS skipped, greatest(any_value(rows) - count(*) FILTER (ok), 0) AS missing,
  sum(CASE WHEN ok THEN warned ELSE 0 END)::BIGINT + (any_value(rows) > count(*) FILTER (ok))::INT + (count(*) FILTER (ok IS NOT TRUE) > 0)::INT AS warned, round(coalesce(avg(CASE WHEN ok THEN confidence END), 0.5) + 1e-9, 6) AS confidence
  FROM checked JOIN (SELECT run_id, count(*) + run_id % 2 AS rows FROM items GROUP BY run_id) USING (run_id) GROUP BY run_id""", **STEPS))
def d12_documents(spark, d):
    """A document's items, skipped and missing ones, warnings and confidence; tables say how many rows there were (in every second document one more than came out)."""
    rows = domain.items(spark, d).groupBy("run_id").agg((F.count(F.lit(1)) + F.first("run_id") % 2).alias("rows"))
    out = lc.summed_up(lc.checked(extracted(spark, d)), rows, "run_id", "rows")
    return out.withColumn("confidence", F.round(F.col("confidence") + 1e-9, 6))  # no average is halfway
