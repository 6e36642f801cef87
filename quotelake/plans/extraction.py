"""Queries of line items in table rows, chosen tables and columns, page scores and quantities. Cells vary by keys that no rule knows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelake.operators import extraction as ex
from quotelake.registry import register
from quotelake.sources import domain
from quotelake.sources.domain import sql

K = "material_id * 13 + supplier_id * 7 + line_number"
#: The same text in Spark and DuckDB; k: K.
CELLS = {
    "item": "CASE k % 9 WHEN 0 THEN 'XX' WHEN 1 THEN '' WHEN 2 THEN 'a' || line_number WHEN 3 THEN ' ' ELSE CAST(line_number AS STRING) END",
    "description": "CASE k % 11 WHEN 0 THEN 'Flanges, sorted' WHEN 1 THEN '' WHEN 2 THEN 'abc' WHEN 3 THEN 'optional extras' ELSE ' Part no ' || material_id END",
    "quantity": "CASE k % 5 WHEN 0 THEN '1,' || (100 + k % 900) || ' pcs' WHEN 1 THEN CAST(quantity AS INT) || '.5 m' WHEN 2 THEN 'n/a' ELSE CAST(CAST(quantity AS INT) AS STRING) END",
    "unit": "CASE k % 3 WHEN 0 THEN 'EA' WHEN 1 THEN ' kg ' ELSE '' END",
    "group": "CASE k % 10 WHEN 0 THEN 'G' || (k % 4) ELSE '' END",
    "size1": "CASE k % 4 WHEN 0 THEN '' ELSE (k % 4) || '\"' END",
    "size2": "CASE k % 6 WHEN 0 THEN '4\"' ELSE '' END",
    "Heat No.": "CASE k % 8 WHEN 0 THEN 'H' || k ELSE '' END",
}
ORDER = ["line_number", "material_id", "supplier_id", "item_price", "quantity"]
ROWS = f"SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY {', '.join(ORDER)}) - 1 AS row, {', '.join(f'{v} AS c{i}' for i, v in enumerate(CELLS.values()))} FROM (SELECT *, {K} AS k FROM items)"


def rows(spark, d):
    i = domain.items(spark, d).withColumn("k", F.expr(K)).withColumn("row", F.row_number().over(Window.partitionBy("run_id").orderBy(*ORDER)) - 1)
    return i.select("run_id", "row", F.array(*[F.expr(c) for c in CELLS.values()]).alias("cells"))


NUMBER = r"TRY_CAST(nullif(regexp_extract(replace({}, ',', ''), '^\s*([0-9]+(?:\.[0-9]*)?|\.[0-9]+)', 1), '') AS DOUBLE)"


@register("d10b_line_items", sql(r"""SELECT run_id, CAST(row AS BIGINT) AS row, CASE WHEN n > 0 THEN n ELSE row + 10000 END::BIGINT AS line_number, section, item_group, nullif(c1, '') AS description, q AS quantity, unit, size, CASE WHEN c7 <> '' THEN 'heat_no=' || c7 ELSE '' END AS extras FROM (
 SELECT *, last_value(CASE WHEN heading AND NOT separator THEN upper(c1) END IGNORE NULLS) OVER w AS section, last_value(nullif(c4, '') IGNORE NULLS) OVER w AS item_group FROM (
 SELECT run_id, row, trim(c1) AS c1, trim(c4) AS c4, c7, TRY_CAST(nullif(regexp_extract(trim(c0), '^([+-]?[0-9]+)', 1), '') AS BIGINT) AS n, upper(trim(c0)) = 'XX' AS separator, trim(c0) = '' AND regexp_matches(upper(c1), 'FLANGES|SP ITEMS|OTHERS|OPTIONAL') AS heading, """ + NUMBER.format("c2") + r""" AS q,
 coalesce(nullif(regexp_extract(c2, '^[0-9.,]+\s*(.*)$', 1), ''), nullif(trim(c3), '')) AS unit, CASE WHEN c6 <> '' THEN c5 || ' × ' || c6 ELSE nullif(c5, '') END AS size FROM cells)
 WINDOW w AS (PARTITION BY run_id ORDER BY row ROWS UNBOUNDED PRECEDING)) WHERE NOT separator AND NOT heading AND (coalesce(n > 0, false) OR (length(c1) > 3 AND q IS NOT NULL))""", cells=ROWS))  # fmt: skip
def d10b(spark, d):
    """Items of table rows, with sections and groups above them."""
    columns = {n: i for i, n in enumerate(CELLS) if n != "Heat No."}
    out = ex.line_items(rows(spark, d), "run_id", "row", "cells", columns, list(CELLS))
    return out.withColumn("row", F.col("row").cast("long")).withColumn("extras", F.array_join(F.transform(F.map_entries("extras"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ","))


POOL = ["Item", "Item No.", "Description", "Material  description", "Qty", "Purchased Quantity", "Unit", "Unit Weight", "Vendor", "Document No", "Rev.", "Approved by", "Prepared by", "Size", "Total weight", "Remarks", "Data Requirement", "Checked", "Revision", "Spec", "Material type", "UOM"]
PICKED = f"SELECT run_id, [{', '.join(f'''list_value({', '.join(f"'{x}'" for x in POOL)})[1 + (run_id * {m} + {i}) % {len(POOL)}]''' for i, m in enumerate((7, 11, 3, 5)))}] AS h FROM runs"


def headed(spark, d):
    pool = F.array(*map(F.lit, POOL))
    return domain.runs(spark, d).select("run_id", F.array(*[F.get(pool, ((F.col("run_id") * m + i) % len(POOL)).cast("int")) for i, m in enumerate((7, 11, 3, 5))]).alias("h"))


NORMAL = r"[trim(regexp_replace(regexp_replace(lower(x), '[^a-z0-9/ ]', ' ', 'g'), ' +', ' ', 'g')) FOR x IN h]"


@register("d11_item_tables", sql(f"SELECT run_id, array_to_string(h, '|') AS headers FROM (SELECT run_id, h, {NORMAL} AS n FROM picked) WHERE NOT (len([x FOR x IN n IF regexp_matches(x, '{'|'.join(ex.DOCUMENT_LIST)}')]) > 0 OR (len([x FOR x IN n IF regexp_matches(x, '{'|'.join(ex.REVISION)}')]) > 0 AND len([x FOR x IN n IF regexp_matches(x, '{'|'.join(ex.APPROVAL)}')]) > 0))", picked=PICKED))
def d11(spark, d):
    """Tables that don't list documents or revisions."""
    return headed(spark, d).filter(~ex.administrative(F.col("h"))).select("run_id", F.array_join("h", "|").alias("headers"))


def _position(role: str) -> str:
    tests = [p.replace(r"^(?!.*material\s+description).*(description|detail|specification)", "description|detail|specification") for p in ex.SHEET_COLUMNS[role]]
    bar = lambda i: " AND NOT contains(x, 'material description')" if role == "description" and i == 1 else ""
    return f"coalesce({', '.join(f"nullif(list_position([regexp_matches(x, '{p}'){bar(i)} FOR x IN n], true), 0)" for i, p in enumerate(tests))}, 0) - 1 AS {role}"


@register("d16_sheet_columns", sql(f"SELECT run_id, {', '.join(map(_position, ex.SHEET_COLUMNS))} FROM (SELECT run_id, [trim(regexp_replace(lower(x), '\\s+', ' ', 'g')) FOR x IN h] AS n FROM picked)", picked=PICKED))
def d16(spark, d):
    """Which column of a sheet holds what."""
    return headed(spark, d).select("run_id", *[c.cast("long").alias(n) for n, c in ex.sheet_columns(F.col("h")).items()])


AMOUNTS = f"SELECT run_id, line_number, material_id, supplier_id, CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(quantity AS INT) * (1 + k % 40) * 1.0 + CASE WHEN k % 4 = 0 THEN 0.25 ELSE 0 END END::DOUBLE AS q, CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN 7.5 ELSE (k % 600) * 1.0 END::DOUBLE AS l, CASE k % 7 WHEN 0 THEN 'm' WHEN 1 THEN 'Mtr' WHEN 2 THEN NULL ELSE 'EA' END AS u FROM (SELECT *, {K} AS k FROM items)"


@register("d06_length_for_quantity", sql("""SELECT run_id, line_number, material_id, supplier_id, CASE WHEN fixed THEN l ELSE q END AS quantity, CASE WHEN fixed THEN q ELSE l END AS length, CASE WHEN fixed THEN 'EA' ELSE u END AS unit, reason FROM (
 SELECT *, coalesce(reason IS NOT NULL AND l > 0 AND l < 500 AND l = floor(l), false) AS fixed FROM (SELECT *, CASE WHEN q IS NULL THEN NULL WHEN upper(u) IN ('M', 'MTR', 'METER', 'METERS') THEN 'unit_is_meters' WHEN q > 500 AND q <> floor(q) THEN 'large_decimal_value' WHEN l <> 0 AND q > 50 AND q > l * 5 THEN 'quantity_larger_than_length' END AS reason FROM amounts))""", amounts=AMOUNTS))  # fmt: skip
def d06(spark, d):
    i = domain.items(spark, d).withColumn("k", F.expr(K))
    q = F.expr("CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(CAST(quantity AS INT) * (1 + k % 40) + CASE WHEN k % 4 = 0 THEN 0.25 ELSE 0 END AS DOUBLE) END")
    l, u = F.expr("CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN 7.5D ELSE CAST(k % 600 AS DOUBLE) END"), F.expr("CASE k % 7 WHEN 0 THEN 'm' WHEN 1 THEN 'Mtr' WHEN 2 THEN NULL ELSE 'EA' END")
    r = ex.length_for_quantity(F.col("q"), F.col("l"), F.col("u"))
    out = i.select("run_id", "line_number", "material_id", "supplier_id", q.alias("q"), l.alias("l"), u.alias("u")).withColumn("r", r)
    return out.select("run_id", "line_number", "material_id", "supplier_id", "r.quantity", "r.length", "r.unit", "r.reason")


WORDS = ["price", "total", "item", "quantity", "unit", "delivery", "material", "weight", "license", "rights", "amount", "order", "tax", "size", "page", "code"]


@register("s19_page_scores", r"""SELECT doc_id, round(0.4 * least((""" + " + ".join(f"contains(low, '{w}')::INT" for w in WORDS) + r""") / 15.0, 1.0) + 0.3 * coalesce(least(length(regexp_replace(solid, '[^0-9]', '', 'g')) / nullif(length(solid), 0) / 0.2, 1.0), 0) + 0.3 * CASE WHEN n < 3 THEN 0 ELSE least(0.4 * aligned / n + 0.3 * len([x FOR x IN lines IF abs(length(x) - mean) < mean * 0.3]) / n + 0.3 * parted / n, 1.0) END, 6)::DOUBLE AS score,
 CASE WHEN pages <= 5 THEN 0.8 WHEN page <= 2 THEN 0.2 WHEN page <= floor(pages * 0.7) THEN 0.5 ELSE 0.9 END::DOUBLE AS position FROM (
 SELECT *, CAST(len(lines) AS DOUBLE) AS n, len([x FOR x IN lines IF regexp_matches(x, '\t|\s{3,}')]) AS aligned, len([x FOR x IN lines IF contains(x, '|') OR regexp_matches(x, '\s{4,}|\t.*\t')]) AS parted, list_sum([length(x) FOR x IN lines]) / CAST(len(lines) AS DOUBLE) AS mean FROM (
 SELECT doc_id, lower(coalesce(text, '')) AS low, regexp_replace(coalesce(text, ''), '\s', '', 'g') AS solid, [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF trim(regexp_replace(x, '\s', ' ', 'g')) <> ''] AS lines, 1 + n_chars // 500 AS pages, 1 + doc_id % (1 + n_chars // 500) AS page FROM documents))""")  # fmt: skip
def s19(spark, d):
    """Pages by keywords, digits and looks; and by their place."""
    t = domain.read(spark, d, "documents").withColumn("pages", 1 + F.floor(F.col("n_chars") / 500))
    return t.select("doc_id", F.round(ex.page_score(F.col("text"), WORDS), 6).alias("score"), ex.page_position(1 + F.col("doc_id") % F.col("pages"), F.col("pages")).alias("position"))
