"""Queries of extracted tables whose headers have faults that no rule knows of, with SQL that restates the rules."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quotelake.functions.json_repair import recovered_items
from quotelake.functions.text import once
from quotelake.operators import tables
from quotelake.registry import register
from quotelake.sources import domain
from quotelake.sources.domain import sql

#: Headers as they come out of scans, and cells that are taken for headers; a table has six of them, by its number.
POOL = ["Item No.", "Description", "Qty", "Unit", "Total Weight (kg)", "Size 1", "Material Grade", "Remarks", "Rev", "Pos", "Specification", "UOM", "Pcs", "Inspection", "Delivery", "Amount", "Notes", "", "Line", "Detail", "Quant",
    "12 jan 24", "2024-01-05", "John Smith", "117", "42", "Document Title", "5/11/23", "Item", "Descr.", "Quantity", "Unit of measure", "Date"]
#: A header h with a fault by k; the same text in Spark and DuckDB.
FAULT = "CASE k % 5 WHEN 1 THEN substr(h, 1, length(h) - 2) WHEN 2 THEN substr(h, 1, 3) || ' ' || substr(h, 4) WHEN 3 THEN replace(h, 'i', '1') WHEN 4 THEN upper(h) ELSE h END"
PLACE = "(run_id * 7 + p * (11 + run_id % 4) + run_id % 3 * p) % {n} + 1"
CELLS = ["CASE WHEN (run_id + line_number) % 4 = 0 THEN '' ELSE CAST(line_number AS VARCHAR) END", "CASE WHEN run_id % 5 = 0 THEN '' ELSE 'M-' || CAST(material_id AS VARCHAR) END", "CASE WHEN run_id % 5 < 2 THEN ' ' ELSE CAST(quantity AS VARCHAR) END", "'x'"]


def extracted(spark, d):
    """run_id, headers, rows."""
    pool = F.array(*map(F.lit, POOL))
    i = domain.items(spark, d)
    text = F.array(*[F.expr(c.replace("VARCHAR", "STRING")) for c in CELLS])
    rows = i.groupBy("run_id").agg(F.collect_list(text).alias("rows"))
    named = rows.withColumn("pool", pool)
    heads = F.expr(f"transform(sequence(0, 5), p -> element_at(pool, int({PLACE.format(n=len(POOL))})))")
    faulty = F.expr("transform(heads, (h, p) -> " + FAULT.replace("k %", "(run_id + p) %") + ")")
    return named.withColumn("heads", heads).select("run_id", faulty.alias("headers"), "rows")


def quoted(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def has(column: str, words) -> str:
    return f"len(list_filter({column}, lambda x: " + " OR ".join(f"contains(x, '{w}')" for w in words) + ")) > 0"


TABLES = f"""SELECT run_id, list_transform(range(0, 6), lambda p: list_transform([{quoted(POOL)}[{PLACE.format(n=len(POOL))}]], lambda h: {FAULT.replace("k %", "(run_id + p) %")})[1]) AS headers, rows
  FROM (SELECT run_id, list([{", ".join(CELLS)}]) AS rows FROM items GROUP BY run_id)"""
NORMAL = f"""SELECT *, list_transform(headers, lambda h: trim(regexp_replace(regexp_replace(lower(trim(h)), '[.,;:!?''"()\\[\\]{{}}]', '', 'g'), '\\s+', ' ', 'g'))) AS n,
  list_filter(list_transform(headers, lambda h: trim(h)), lambda h: h <> '') AS c FROM tables"""
COUNTED = f"""SELECT *, len(list_filter(c, lambda x: regexp_matches(lower(x), '{tables.DATE}'))) AS dates, len(list_filter(c, lambda x: regexp_matches(x, '^[0-9]{{2,}}$'))) AS numbers,
  len(list_filter(c, lambda x: regexp_matches(x, '{tables.NAME}') AND NOT regexp_matches(lower(x), '{tables.DATE}'))) AS names,
  list_position(list_transform(n, lambda x: {" OR ".join(f"contains(x, '{w}')" for w in tables.GROUPS["item"])}), true) AS place, {", ".join(f"{has('n', w)} AS has_{g}" for g, w in tables.GROUPS.items() if g != "item")}, {has("n", tables.REJECTED)} AS rejected FROM normal"""
ITEMED = f"""SELECT *, coalesce(place, 0) > 0 AND NOT (regexp_matches(trim(headers[place]), '^[0-9]+$') OR regexp_matches(lower(trim(headers[place])), '{tables.DATE}')) AS has_item,
  len(c) = 0 OR dates > 0.3 * len(c) OR numbers > 0.5 * len(c) OR (names > 0 AND dates + numbers > 0) AS is_data FROM counted"""
SCORED = f"""SELECT run_id, is_data, CASE WHEN is_data OR rejected THEN -100 ELSE {" + ".join(f"CASE WHEN has_{g} THEN {tables.POINTS[g]} ELSE 0 END" for g in tables.GROUPS)}
  + CASE WHEN has_item::INT + has_description::INT + has_quantity::INT + has_unit::INT >= 2 THEN 15 ELSE 0 END
  - CASE WHEN 2 * len(list_filter(rows, lambda r: len(list_filter(r, lambda x: trim(x) <> '')) <= 1)) > len(rows) THEN 20 ELSE 0 END
  + CASE WHEN has_item AND len(list_filter(rows, lambda r: coalesce(regexp_matches(r[place], '^\\s*\\+?0*[1-9]'), false))) > 0 THEN 10 ELSE 0 END
  + CASE WHEN has_item AND has_quantity AND has_revision AND (has_description OR has_material OR has_dimension) THEN 50 ELSE 0 END END AS score FROM itemed"""
STEPS = {"tables": TABLES, "normal": NORMAL, "counted": COUNTED, "itemed": ITEMED, "scored": SCORED}


@register("s16_scored_tables", sql("SELECT run_id, score::INTEGER AS score, is_data, score >= 45 AS accepted FROM scored", **STEPS))
def s16_scored(spark, d):
    """Points of each table, and whether its headers are data."""
    t = tables.scored(extracted(spark, d), "headers", "rows")
    return t.select("run_id", "score", "is_data").withColumn("accepted", F.col("score") >= tables.ACCEPT)


@register("s18_best_scored", sql("SELECT run_id % 50 AS doc, arg_max(run_id, (score, -run_id)) AS run_id, max(score)::INTEGER AS score FROM scored WHERE score >= 45 GROUP BY ALL", **STEPS))
def s18_best(spark, d):
    """The best table of each document (fifty of them)."""
    t = tables.scored(extracted(spark, d), "headers", "rows").select((F.col("run_id") % 50).alias("doc"), "run_id", "score")
    return tables.best_tables(t, "doc", "run_id", "score")


def _fit(role: str) -> str:
    k = tables.KEYWORDS[role]
    alike = "greatest(" + ", ".join(f"1 - levenshtein(t, '{w}') / greatest(length(t), {len(w)})::DOUBLE" for w in k) + ")"
    begins = "len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: " + " OR ".join(f"starts_with(w, '{p}')" for p in tables.starts(k)) + ")) > 0"
    return f"CASE WHEN t = '' THEN 0 WHEN {' OR '.join(f"contains(t, '{w}')" for w in k)} THEN 1 ELSE greatest(CASE WHEN {begins} THEN 0.8 ELSE 0 END, CASE WHEN {alike} >= 0.6 THEN {alike} ELSE 0 END) END"


FITTED = f"""SELECT run_id, i, {", ".join(f"{_fit(r)} AS {r}" for r in tables.KEYWORDS)} FROM (SELECT run_id, lower(trim(headers[i + 1])) AS t, i FROM (SELECT run_id, headers, unnest(range(0, 6)) AS i FROM tables))"""


@register("s14_rebuilt_columns", sql(f"""SELECT run_id, {", ".join(f"min(CASE WHEN {r} >= 0.6 THEN i END)::INTEGER AS {r}" for r in tables.KEYWORDS)},
  (4 * (max(description) >= 0.6)::INT + 4 * (max(quantity) >= 0.6)::INT + (max(item) >= 0.6)::INT + (max(unit) >= 0.6)::INT) / 10 AS confidence FROM fitted GROUP BY run_id""", tables=TABLES, fitted=FITTED))
def s14_rebuilt(spark, d):
    """What the columns of tables with broken headers are for, and how sure that is."""
    made = lambda e: e.withColumn("c", once(tables.fits(F.col("headers")), tables.first_fits))
    return tables.by_layout(extracted(spark, d).select("run_id", "headers"), "headers", made).select("run_id", "c.*")


CHOICES = f"""SELECT run_id, i, role, fit FROM (UNPIVOT fitted ON {", ".join(tables.KEYWORDS)} INTO NAME role VALUE fit) WHERE fit >= 0.6"""


@register("s14_assigned_columns", sql(f"""SELECT run_id, item, description, quantity, unit, round(total, 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY round(total, 9) DESC, item NULLS LAST, description NULLS LAST, quantity NULLS LAST, unit NULLS LAST) AS k FROM (
  SELECT r.run_id, a.i::INTEGER AS item, b.i::INTEGER AS description, c.i::INTEGER AS quantity, d.i::INTEGER AS unit, coalesce(a.fit, 0) + coalesce(b.fit, 0) + coalesce(c.fit, 0) + coalesce(d.fit, 0) AS total
  FROM (SELECT DISTINCT run_id FROM fitted) r {" ".join(f"JOIN (SELECT * FROM choices WHERE role = '{role}' UNION ALL SELECT DISTINCT run_id, NULL, '{role}', NULL FROM fitted) {x} ON {x}.run_id = r.run_id" for x, role in zip("abcd", tables.KEYWORDS))}
  WHERE len(list_filter([a.i, b.i, c.i, d.i], lambda v: v IS NOT NULL)) = len(list_distinct([a.i, b.i, c.i, d.i])))) WHERE k = 1""", tables=TABLES, fitted=FITTED, choices=CHOICES))
def s14_assigned(spark, d):
    """The same with each column for one role at most, by the best total; the SQL tries all assignments."""
    made = lambda e: tables.best_assignment(e.withColumn("fitted", tables.fits(F.col("headers"))), "fitted").drop("fitted")
    return tables.by_layout(extracted(spark, d).select("run_id", "headers"), "headers", made).select("run_id", *[f"assigned.{r}" for r in tables.KEYWORDS], F.round("assigned.total", 6).alias("total"))


#: An item of an answer, with brackets and quotes inside its texts; the same text in Spark and DuckDB. In every third answer the second item is mangled.
ANSWERED = """concat('{"line_number": ', CAST(line_number AS STRING), ', "description": "part {', CAST(material_id AS STRING), '} [', CASE WHEN line_number % 2 = 0 THEN concat('a, ', chr(92), '"b', chr(92), '"') ELSE '}' END, ']", "size": {"qty": ', CAST(CAST(floor(quantity) AS BIGINT) AS STRING), '}}')"""
HEAD = '{"document": {"pages": 2}, "line_items": ['
CUT = "length(answer) * (25 + run_id % 90) // 100"


@register("s28_recovered_items", sql(f"""SELECT run_id, count(*) FILTER (kept) AS items, coalesce(sum(material_id) FILTER (kept), 0)::BIGINT AS materials FROM (
  SELECT *, ends <= least(length(answer), {CUT}) AND NOT (run_id % 3 = 0 AND k = 2) AS kept FROM (
    SELECT *, '{HEAD}' || string_agg(item, ', ') OVER (PARTITION BY run_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) || ']}}' AS answer,
      {len(HEAD)} + sum(length(item) + 2) OVER (PARTITION BY run_id ORDER BY k) - 2 AS ends FROM (
        SELECT *, CASE WHEN run_id % 3 = 0 AND k = 2 THEN replace(plain, '"size": ', '"size":: ') ELSE plain END AS item FROM (
          SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY line_number, material_id, quantity) AS k, {ANSWERED.replace("STRING", "VARCHAR")} AS plain FROM items)))) GROUP BY run_id"""))
def s28_items(spark, d):
    """Answers that break off somewhere, some with a mangled item: the items that stand whole in them."""
    own = F.array_sort(F.collect_list(F.struct("line_number", "material_id", "quantity")))
    rows = domain.items(spark, d).groupBy("run_id").agg(own.alias("own"))
    plain = re.sub(r'\b(line_number|material_id|quantity)\b(?!")', r"x.\1", ANSWERED)
    item = f"""transform(own, (x, k) -> CASE WHEN run_id % 3 = 0 AND k = 1 THEN replace({plain}, '"size": ', '"size":: ') ELSE {plain} END)"""
    a = rows.select("run_id", F.concat(F.lit(HEAD), F.array_join(F.expr(item), ", "), F.lit("]}")).alias("answer"))
    cut = a.select("run_id", F.expr(f"substr(answer, 1, int({CUT.replace('//', 'div')}))").alias("answer"))
    got = cut.select("run_id", recovered_items("answer").alias("items"))
    parsed = F.transform("items", lambda x: F.from_json(x, "line_number int, description string, size struct<qty: int>"))
    whole = F.filter(parsed, lambda x: x["size"]["qty"].isNotNull())
    number = lambda x: F.coalesce(F.regexp_extract(x["description"], r"\{([0-9]+)\}", 1).cast("long"), F.lit(0))
    told = once(whole, lambda xs: F.struct(F.size(xs).cast("long").alias("items"), F.aggregate(xs, F.lit(0).cast("long"), lambda n, x: n + number(x)).alias("materials")))
    return got.select("run_id", told.alias("told")).select("run_id", "told.*")
