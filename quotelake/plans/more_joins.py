"""Queries of joins and orders that others contain only in part: total order, one-row joins, closed intervals, distinct joins; dimensions repaired in texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelake.functions.text import once
from quotelake.operators import dimensions, joins
from quotelake.operators import items as it
from quotelake.plans.pricing import literal, values
from quotelake.registry import register
from quotelake.sources import domain
from quotelake.sources.domain import sql
from quotelake.streaming.flows import scratch


@register("w10_ordered_history", sql("SELECT call_id, tenant_id, service, row_number() OVER (ORDER BY created_at DESC, call_id) AS place FROM usage"))
def w10(spark, d):
    """The whole history, newest first, numbered and stored in this order."""
    u = domain.usage(spark, d).select("call_id", "tenant_id", "service", "created_at")
    return joins.in_total_order(u, [F.desc("created_at"), F.asc("call_id")], "place", scratch(spark), 8).drop("created_at")


@register("j05_one_row_join", sql("SELECT status, count(*) AS n, round(sum(total_price) / any_value(total), 6) AS share, any_value(won) AS won FROM runs LEFT JOIN (SELECT sum(total_price) AS total, count(*) FILTER (outcome = 'won') AS won FROM runs) ON true GROUP BY status"))
def j05(spark, d):
    """Runs beside totals of all runs, which are one row."""
    r = domain.runs(spark, d)
    one = r.agg(F.sum("total_price").alias("total"), F.count_if(F.col("outcome") == "won").alias("won"))
    both = r.select("status", "total_price").join(F.broadcast(one), F.lit(True), "left")
    return both.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("total_price") / F.first("total"), 6).alias("share"), F.first("won").alias("won"))


#: Tiers of one kind may overlap and touch; the first by start counts.
TIERS = [("PROMO", 1.0, 10.0, 2.0), ("PROMO", 10.0, 25.0, 5.0), ("PROMO", 20.0, None, 9.0), ("ECONOMY", 0.0, 30.0, 1.0), ("ECONOMY", 15.0, 20.0, 4.0), ("ECONOMY", 31.0, 31.0, 6.0), ("SMALL", 49.0, None, 7.0)]
TIER_COLUMNS = "category string, least double, most double, pct double"


@register("j11_closed_interval", sql("SELECT run_id, line_number, i.material_id, quantity, item_price, pct FROM costed i LEFT JOIN LATERAL (SELECT pct FROM tiers t WHERE t.category = i.category AND i.quantity >= t.least AND (t.most IS NULL OR i.quantity <= t.most) ORDER BY t.least, t.most NULLS LAST LIMIT 1) ON true", tiers=values(TIER_COLUMNS, TIERS)))
def j11(spark, d):
    """Tiers with both ends inside, open ends null."""
    i = domain.costed_items(spark, d).select("run_id", "line_number", "material_id", "quantity", "item_price", "category")
    return joins.interval(i, literal(spark, TIER_COLUMNS, TIERS), ["category"], "quantity", "least", "most", closed=True).select("run_id", "line_number", "material_id", "quantity", "item_price", "pct")


@register("j21_distinct_join", sql("SELECT DISTINCT c.client_id, c.client, c.segment, c.nation_id FROM clients c JOIN runs r ON r.client_id = c.client_id JOIN items i ON i.run_id = r.run_id WHERE i.discount >= 0.1 AND r.status = 'approved'"))
def j21(spark, d):
    """Clients that a join finds, each once: a semi join, which multiplies nothing."""
    found = domain.runs(spark, d).filter("status = 'approved'").join(domain.items(spark, d).filter("discount >= 0.1"), "run_id", "left_semi")
    return domain.clients(spark, d).join(found, "client_id", "left_semi").select("client_id", "client", "segment", "nation_id")


DIAMETERS = ["material_id * 37 % 60000 + 100", "material_id * 110 % 48000 + 3000", "material_id * 10 % 9000 + 900"]
TUBES = "concat('TUBE ', CAST({0} AS {s}), 'x', CAST(size AS {s}), ' MM; sleeve ', CAST({1} AS {s}), 'X', CAST(size + 3 AS {s}), '.5 and ', CAST({2} AS {s}), '×', CAST(size AS {s}), ' no ', CAST(material_id AS {s}), '0')"
FIXED = "CASE WHEN {d} > 9999 AND {d} <= 40000 AND {d} % 10 = 0 THEN CASE WHEN {d} // 10 > 3000 AND {d} % 100 = 0 THEN {d} // 100 ELSE {d} // 10 END WHEN {d} > 3000 AND {d} % 10 = 0 AND {d} % 10000 > 3000 THEN {d} // 10 ELSE {d} END"


@register("s32_repaired_texts", sql(f"SELECT material_id, {TUBES.format(*DIAMETERS, s='VARCHAR')} <> text AS fixed, text FROM (SELECT *, {TUBES.format(*[FIXED.format(d=f'({x})') for x in DIAMETERS], s='VARCHAR')} AS text FROM materials)"))
def s32_texts(spark, d):
    """Descriptions with three diameters each, some of which lost a decimal point."""
    m = domain.materials(spark, d).withColumn("given", F.expr(TUBES.format(*DIAMETERS, s="STRING"))).withColumn("text", it.corrected_text(F.col("given")))
    return m.select("material_id", (F.col("given") != F.col("text")).alias("fixed"), "text")


#: A catalogue row by its number k; columns of a table t stand in an order that its number decides, and cells are left out by key.
NPS = [0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 10.0, 12.0, 16.0, 20.0, 24.0]
SIZES = [15, 20, 25, 40, 50, 80, 100, 150, 200, 250, 300, 400, 500, 600]
SCHEDULES = ["40", "80", "STD", "XS", "160", "10S"]
ROW = {
    "nps": "nps", "dn": "dn", "od_in": "round(nps + 0.375, 3)", "od_mm": "round((nps + 0.375) * 25.4, 1)", "wall_in": "round(0.1 + k % 9 * 0.03, 3)", "wall_mm": "round((0.1 + k % 9 * 0.03) * 25.4, 2)",
    "weight_lb_ft": "round(10.69 * (nps + 0.275 - k % 9 * 0.03) * (0.1 + k % 9 * 0.03), 3)", "weight_kg_m": "round(10.69 * (nps + 0.275 - k % 9 * 0.03) * (0.1 + k % 9 * 0.03) * 1.488, 3)",
}
MISSING = "(k + {j} * 3) % 11 = 0"


def _at(pool: list, by: str) -> str:
    return f"[{', '.join(map(repr, pool))}][{by} % {len(pool)} + 1]"


CATALOGUE = f"SELECT material_id AS k, material_id % 20 AS t, CAST({_at(NPS, 'material_id')} AS DOUBLE) AS nps, CAST({_at(SIZES, 'material_id')} AS DOUBLE) AS dn, {_at(SCHEDULES, 'material_id // 7')} AS schedule FROM materials"
CELLS = ", ".join(f"CASE WHEN {MISSING.format(j=j)} THEN NULL ELSE {f'CAST({x} AS DOUBLE)'} END AS {n}" for j, (n, x) in enumerate(ROW.items()))


@register("io09_dimension_tables", sql(f"SELECT k, t, {CELLS}, schedule, CASE schedule WHEN 'STD' THEN 'STD' WHEN '40' THEN 'STD' WHEN 'XS' THEN 'XS' WHEN '80' THEN 'XS' END AS pressure_series FROM catalogue WHERE NOT ({MISSING.format(j=0)})", catalogue=CATALOGUE))
def io09(spark, d):
    """Dimension tables whose columns stand in other places in each, under headers that say nothing, typed by what their rows say."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # the table is small, what is made of it isn't
    m = domain.materials(spark, d).select(F.col("material_id").alias("k")).repartition(parts, "k").withColumn("t", F.col("k") % 20)
    pick = lambda pool, by: F.get(F.array(*map(F.lit, pool)), (by % len(pool)).cast("int"))
    c = m.withColumns({"nps": pick(NPS, F.col("k")), "dn": pick(SIZES, F.col("k")).cast("double"), "schedule": pick(SCHEDULES, F.floor(F.col("k") / 7))})
    each = [F.when(F.expr(MISSING.format(j=j)), F.lit("-")).otherwise(F.expr(f"CAST({x} AS STRING)")) for j, x in enumerate(ROW.values())]
    own = F.array(*each, F.concat(F.lit(" "), "schedule"))
    step = F.get(F.array(*map(F.lit, [1, 2, 4, 5, 7, 8])), (F.col("t") % 6).cast("int"))
    place = lambda i: ((i * step + F.col("t")) % len(dimensions.ROLES)).cast("int")
    placed = lambda cells: F.transform(F.sequence(F.lit(0), F.lit(len(dimensions.ROLES) - 1)), lambda i: F.get(cells, place(i)))
    never_null = F.coalesce(once(own, placed), F.array().cast("array<string>"))  # else the optimiser makes it in front of the shuffle too, to ask for nulls
    grid = c.select("k", "t", never_null.alias("cells"))
    heads = grid.groupBy("t").agg(F.lit(-1).cast("long").alias("k")).select("k", "t", F.array(*[F.lit(f"col {i}") for i in range(9)]).alias("cells"))
    return dimensions.dimensions(grid.unionByName(heads), "t")
