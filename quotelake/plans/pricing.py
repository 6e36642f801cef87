"""Pricing, logistics, tax, risk and approval queries. Rate tables are small synthetic frames, the same in the oracle."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelake.functions.money import bucket, nearest, safe_div
from quotelake.operators import joins, pricing, sinks
from quotelake.plans.dashboards import PRICE_STEPS, price_steps
from quotelake.registry import register
from quotelake.sources import domain
from quotelake.sources.domain import sql

PRICED = "SELECT i.*, m.category, m.origin, m.base_cost, m.size, r.client_id, r.created_at FROM items i JOIN materials m USING (material_id) JOIN runs r USING (run_id)"
KEY = ["run_id", "line_number", "material_id", "quantity", "item_price", "supplier_id", "effective_at"]


def priced(spark: SparkSession, d: str) -> DataFrame:
    """Items with their material and run."""
    r = domain.runs(spark, d).select("run_id", "client_id", "created_at")
    return domain.items(spark, d).join(domain.materials(spark, d).drop("name"), "material_id").join(r, "run_id")


def once_priced(spark: SparkSession, d: str) -> DataFrame:
    """One row of `priced` for each KEY. All of it lies by run, in one sort by KEY, from which runs are joined too; no row is held for more than its KEY and what is asked of it."""
    i = domain.items(spark, d).select(*KEY).join(domain.materials(spark, d).drop("name"), "material_id").repartition("run_id")
    r = joins.latest(domain.runs(spark, d).select("run_id", "client_id", "created_at"), ["run_id"], [F.asc("run_id")])
    return joins.latest(i, KEY, [F.asc("run_id")]).join(r, "run_id")


def literal(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, columns)


def values(columns: str, rows: list[tuple]) -> str:
    show = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else repr(v)
    names = ", ".join(c.split()[0] for c in columns.split(", "))
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS t({names})"


TIERS = [("a", 0.0, 10.0, 1000.0), ("a", 10.0, 40.0, 900.0), ("a", 40.0, None, 800.0)]
TIER_COLUMNS = "scale string, scale_from double, scale_to double, tier_rate double"


@register("j10_scale_tier", sql("SELECT run_id, line_number, material_id, quantity, tier_rate FROM priced JOIN tiers ON quantity >= scale_from AND (scale_to IS NULL OR quantity < scale_to)", priced=PRICED, tiers=values(TIER_COLUMNS, TIERS)))
def j10(spark, d):
    """from <= quantity < to; the last tier is open."""
    rows = priced(spark, d).withColumn("scale", F.lit("a"))
    return joins.interval(rows, literal(spark, TIER_COLUMNS, TIERS), ["scale"], "quantity", "scale_from", "scale_to").select("run_id", "line_number", "material_id", "quantity", "tier_rate")


CONDITIONS = [
    (1, 0, 0, None, "BASE_PRICE", "AMOUNT", 1000.0), (1, 0, 0, None, "DISCOUNT", "PERCENT", 10.0), (2, 1, None, "ECONOMY", "BASE_PRICE", "AMOUNT", 1100.0), (2, 1, None, "ECONOMY", "TAX", "PERCENT", 6.0),
    (3, None, None, "PROMO", "BASE_PRICE", "AMOUNT", 1200.0), (3, None, None, "PROMO", "SURCHARGE", "AMOUNT", 50.0), (3, None, None, "PROMO", "LME", "AMOUNT", 5.0), (4, None, 3, None, "BASE_PRICE", "AMOUNT", 1300.0),
]
CONDITION_COLUMNS = "lvl int, c5 long, m5 long, category string, condition_type string, rate_type string, rate double"
LEVELS = {1: ["c5", "m5"], 2: ["c5", "category"], 3: ["category"], 4: ["m5"]}
CASCADE = "SELECT l.*, lvl, condition_type, rate_type, rate FROM (SELECT *, client_id % 5 AS c5, material_id % 5 AS m5 FROM priced) l JOIN conditions k ON CASE lvl WHEN 1 THEN l.c5 = k.c5 AND l.m5 = k.m5 WHEN 2 THEN l.c5 = k.c5 AND l.category = k.category WHEN 3 THEN l.category = k.category ELSE l.m5 = k.m5 AND condition_type = 'BASE_PRICE' END"


@register("p01_agreement_prices", sql(f"""SELECT run_id, line_number, material_id, quantity, item_price, supplier_id, effective_at, lvl AS level, round(base, 4) AS base, round(taxed * t / 100, 4) AS tax, round(taxed * (1 + t / 100) + lme, 4) AS net FROM (
 SELECT *, base * (1 - disc / 100) + sur AS taxed FROM (SELECT run_id, line_number, material_id, quantity, item_price, supplier_id, effective_at, min(lvl) AS lvl, sum(rate) FILTER (condition_type = 'BASE_PRICE') AS base, coalesce(sum(rate) FILTER (condition_type = 'DISCOUNT'), 0) AS disc,
 coalesce(sum(rate) FILTER (condition_type = 'SURCHARGE'), 0) AS sur, coalesce(sum(rate) FILTER (condition_type = 'TAX'), 0) AS t, coalesce(sum(rate) FILTER (condition_type = 'LME'), 0) AS lme
 FROM (SELECT *, min(lvl) OVER (PARTITION BY run_id, line_number, material_id, quantity, item_price, supplier_id, effective_at) AS best FROM ({CASCADE})) WHERE lvl = best GROUP BY run_id, line_number, material_id, quantity, item_price, supplier_id, effective_at))""", priced=PRICED, conditions=values(CONDITION_COLUMNS, CONDITIONS)))
def p01(spark, d):
    """The first access level with a condition gives all conditions; they are evaluated in order of dependence."""
    return agreed(spark, once_priced(spark, d)).select(*KEY, "level", "base", "tax", "net")


def agreed(spark: SparkSession, items: DataFrame, outer: bool = False) -> DataFrame:
    """`items` with level, base, tax and net of their agreement. A level's conditions are evaluated once for each of its keys, so that items are neither multiplied nor grouped."""
    kinds = literal(spark, CONDITION_COLUMNS, CONDITIONS)
    levels = []
    for n, on in LEVELS.items():
        own = kinds.filter(F.col("lvl") == n)
        own = own.filter(F.col("condition_type") == "BASE_PRICE") if n == 4 else own
        levels.append((pricing.evaluate(own, on).select(*on, "base", "tax", "net"), on))
    return joins.cascade(items.withColumns({"c5": F.col("client_id") % 5, "m5": F.col("material_id") % 5}), levels, KEY, outer).drop("c5", "m5")


RULES = [(None, None, None, 0.20, 0.05, 0.02, 1), ("ECONOMY", None, None, 0.25, 0.05, 0.02, 2), ("ECONOMY", "Brand#11", None, 0.15, 0.04, 0.01, 3), (None, "Brand#11", None, 0.30, 0.05, 0.03, 4), (None, None, 3, 0.22, 0.05, 0.02, 5)]
RULE_COLUMNS = "category string, origin string, client_id long, markup double, logistics double, risk double, rule int"
RULED = """SELECT l.*, k.markup, k.logistics, k.risk, k.rule FROM priced l JOIN rules k ON (k.category IS NULL OR k.category = l.category) AND (k.origin IS NULL OR k.origin = l.origin) AND (k.client_id IS NULL OR k.client_id = l.client_id)
 QUALIFY row_number() OVER (PARTITION BY l.run_id, l.line_number, l.material_id, l.quantity, l.item_price, l.supplier_id, l.effective_at ORDER BY k.client_id IS NOT NULL DESC, k.origin IS NOT NULL DESC, k.category IS NOT NULL DESC, k.rule DESC) = 1"""
PRICE = "floor(base_cost * (1 + (CASE WHEN quantity > 40 THEN -10.0 WHEN quantity > 20 THEN -5.0 ELSE 0.0 END) / 100) * (1 + greatest(markup, CASE WHEN category = 'PROMO' THEN 0.22 ELSE 0.18 END) + logistics + risk) * 1.02 / 10 + 0.5) * 10"


def ruled(spark: SparkSession, d: str) -> DataFrame:
    dims = ["client_id", "origin", "category"]
    return pricing.most_specific(once_priced(spark, d), literal(spark, RULE_COLUMNS, RULES), dims, [F.desc("rule")])


def rule_price():
    pct = bucket(-F.col("quantity"), [(-40.0, "-10"), (-20.0, "-5")], "0").cast("double")
    floor = F.when(F.col("category") == "PROMO", 0.22).otherwise(0.18)
    return pricing.unit_price(F.col("base_cost"), pct, F.col("markup"), F.col("logistics"), F.col("risk"), floor, F.lit(0.02), F.lit(0.0))


@register("p04_rule_resolution", sql("SELECT run_id, line_number, material_id, quantity, rule FROM ruled", priced=PRICED, rules=values(RULE_COLUMNS, RULES), ruled=RULED))
def p04(spark, d):
    return ruled(spark, d).select("run_id", "line_number", "material_id", "quantity", "rule")


@register("p10_unit_prices", sql(f"SELECT run_id, line_number, material_id, quantity, {PRICE} AS price, round(100 * ({PRICE} - base_cost) / nullif({PRICE}, 0), 8) AS margin_on_price_pct, round(100 * ({PRICE} - base_cost) / nullif({PRICE}, 0), 8) < 18 AS needs_approval FROM ruled", priced=PRICED, rules=values(RULE_COLUMNS, RULES), ruled=RULED))
def p10(spark, d):
    """Quantity break, rule, margin floor, regional adjustment, rounding; the margin here is on price, not on cost."""
    out = ruled(spark, d).withColumn("price", rule_price())
    m = F.round(100 * safe_div(F.col("price") - F.col("base_cost"), F.col("price")), 8)
    return out.select("run_id", "line_number", "material_id", "quantity", "price", m.alias("margin_on_price_pct"), (m < 18).alias("needs_approval"))


@register("p08_rounding", sql("SELECT material_id, floor(base_cost / 10 + 0.5) * 10 AS by_ten, floor(-base_cost + 0.5) AS by_one FROM materials"))
def p08(spark, d):
    return domain.materials(spark, d).select("material_id", nearest(F.col("base_cost"), 10.0).alias("by_ten"), nearest(-F.col("base_cost"), 1.0).alias("by_one"))


RATES = [("ECONOMY", "weight", 0.5, 20.0), ("PROMO", "value", 0.01, 15.0), ("STANDARD", "volume", 80.0, 25.0), ("SMALL", "flat", 40.0, 10.0)]
RATE_COLUMNS = "category string, method string, rate double, least double"
LANDED = "SELECT *, greatest(CASE method WHEN 'weight' THEN quantity * size * rate WHEN 'value' THEN item_price * rate WHEN 'volume' THEN quantity * size / 500.0 * rate ELSE coalesce(rate, 30.0) END, coalesce(least, 5.0)) AS freight, 12.0 + 150.0 / count(*) OVER (PARTITION BY run_id) AS handling FROM priced LEFT JOIN rates USING (category)"
LANDED2 = "SELECT *, greatest((item_price + freight) * 0.004 * 1.1, 5.0) AS insurance, coalesce(CASE WHEN material_id % 7 = 0 THEN 25.0 END, item_price * CASE WHEN material_id % 5 = 0 THEN 4.0 END / 100, item_price * 2.5 / 100) AS duty FROM landed"


def landed(spark: SparkSession, d: str) -> DataFrame:
    rows = priced(spark, d).join(literal(spark, RATE_COLUMNS, RATES), "category", "left")
    weight = F.col("quantity") * F.col("size")
    value, m = F.col("item_price"), F.col("material_id")
    rows = rows.withColumn("freight", pricing.freight(weight, value, weight / 500.0, F.col("method"), F.coalesce("rate", F.lit(30.0)), F.coalesce("least", F.lit(5.0))))
    rows = rows.withColumn("handling", pricing.shared_cost(F.lit(12.0), F.lit(150.0), "run_id"))
    rows = rows.withColumn("insurance", pricing.insurance(value, F.col("freight"), F.lit(0.004), F.lit(1.1), F.lit(1.0), F.lit(5.0)))
    return rows.withColumn("duty", pricing.duty(F.when(m % 7 == 0, 25.0), F.when(m % 5 == 0, 4.0), F.lit(2.5), value))


@register("p21_landed_cost", sql("SELECT run_id, line_number, material_id, quantity, round(freight, 6) AS freight, round(insurance, 6) AS insurance, round(handling, 6) AS handling, round(duty, 6) AS duty, round(item_price + duty + freight + insurance + handling, 6) AS landed FROM landed2", priced=PRICED, rates=values(RATE_COLUMNS, RATES), landed=LANDED, landed2=LANDED2))
def p21(spark, d):
    """Freight by method with a minimum, insurance, handling with a share of fixed costs, duty by precedence."""
    parts = ["freight", "insurance", "handling", "duty"]
    whole = F.round(F.col("item_price") + F.col("duty") + F.col("freight") + F.col("insurance") + F.col("handling"), 6)
    return landed(spark, d).select("run_id", "line_number", "material_id", "quantity", *[F.round(c, 6).alias(c) for c in parts], whole.alias("landed"))


@register("q51_rollups", sql("SELECT run_id, round(sum(duty), 6) AS duty, round(sum(freight + insurance + handling), 6) AS logistics, round(sum(item_price + duty + freight + insurance + handling), 6) AS landed, count(*) AS n FROM landed2 GROUP BY run_id", priced=PRICED, rates=values(RATE_COLUMNS, RATES), landed=LANDED, landed2=LANDED2))
def q51(spark, d):
    log = F.col("freight") + F.col("insurance") + F.col("handling")
    return landed(spark, d).groupBy("run_id").agg(F.round(F.sum("duty"), 6).alias("duty"), F.round(F.sum(log), 6).alias("logistics"), F.round(F.sum(F.col("item_price") + F.col("duty") + log), 6).alias("landed"), F.count(F.lit(1)).alias("n"))


TAX = [(1, 0.06, "1995-01-01", None), (1, 0.10, "1998-01-01", None), (2, 0.20, "1995-01-01", "1999-12-31"), (3, 0.19, "1990-01-01", None)]
TAX_COLUMNS = "nation_id int, tax_rate double, valid_from string, valid_to string"
TAXED = "SELECT r.run_id, r.total_price, r.created_at, t.tax_rate FROM runs r JOIN clients USING (client_id) LEFT JOIN taxes t ON t.nation_id = clients.nation_id AND CAST(valid_from AS DATE) <= CAST(r.created_at AS DATE) AND (valid_to IS NULL OR CAST(valid_to AS DATE) >= CAST(r.created_at AS DATE)) QUALIFY row_number() OVER (PARTITION BY r.run_id ORDER BY valid_from DESC NULLS LAST) = 1"


@register("p18_tax", sql("SELECT run_id, floor(total_price * coalesce(tax_rate, 0.0) * 100 + 0.5) / 100 AS tax, round(total_price + floor(total_price * coalesce(tax_rate, 0.0) * 100 + 0.5) / 100, 2) AS total, CASE WHEN tax_rate IS NULL THEN 'none' ELSE format('VAT {:.1f}%', tax_rate * 100) END AS label FROM taxed", taxes=values(TAX_COLUMNS, TAX), taxed=TAXED))
def p18(spark, d):
    """The newest rule that is valid on the day; none: no tax."""
    rules = literal(spark, TAX_COLUMNS, TAX).withColumns({c: F.to_date(c) for c in ("valid_from", "valid_to")})
    day = F.to_date("created_at")
    rows = domain.runs(spark, d).join(domain.clients(spark, d).select("client_id", "nation_id"), "client_id")
    valid = (F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") >= day))
    found = rows.alias("r").join(rules.alias("t"), (F.col("r.nation_id") == F.col("t.nation_id")) & valid, "left").drop(F.col("t.nation_id"))
    one = joins.latest(found, ["run_id"], [F.desc_nulls_last("valid_from")])
    amount = pricing.tax(F.col("total_price"), F.col("tax_rate"))
    label = F.when(F.col("tax_rate").isNull(), "none").otherwise(F.format_string("VAT %.1f%%", F.col("tax_rate") * 100))
    return one.select("run_id", amount.alias("tax"), F.round(F.col("total_price") + amount, 2).alias("total"), label.alias("label"))


@register("p22_version_diff", sql("SELECT coalesce(a.material_id, b.material_id) AS material_id, round(a.price, 4) AS old_price, round(b.price, 4) AS new_price, CASE WHEN a.material_id IS NULL THEN 'added' WHEN b.material_id IS NULL THEN 'removed' WHEN a.price = b.price THEN 'unchanged' ELSE 'modified' END AS status FROM (SELECT material_id, max(item_price) AS price FROM items WHERE run_id % 2 = 0 GROUP BY material_id) a FULL JOIN (SELECT material_id, max(item_price) AS price FROM items WHERE run_id % 2 = 1 GROUP BY material_id) b ON a.material_id = b.material_id"))
def p22(spark, d):
    """Two versions of a price list, by material."""
    version = lambda odd: domain.items(spark, d).filter(F.col("run_id") % 2 == odd).groupBy("material_id").agg(F.max("item_price").alias("price"))
    out = joins.difference(version(0), version(1), ["material_id"], ["price"])
    return out.select("material_id", F.round("old_price", 4).alias("old_price"), F.round("new_price", 4).alias("new_price"), "status")


IMPORT = "SELECT material_id + 100 AS material_id, CASE WHEN material_id % 11 = 0 THEN NULL WHEN material_id % 3 = 0 THEN base_cost + 1 ELSE base_cost END AS price FROM materials"


@register("p24_price_import", sql("SELECT i.material_id, CASE WHEN price IS NULL THEN 'error' WHEN base_cost IS NULL THEN 'missing' WHEN price = base_cost THEN 'unchanged' ELSE 'changed' END AS status, round(100 * (price - base_cost) / nullif(base_cost, 0), 2) AS change_pct FROM import i LEFT JOIN materials USING (material_id)", **{"import": IMPORT}))
def p24(spark, d):
    """What an import of prices would do to each row."""
    m = domain.materials(spark, d)
    price = F.when(F.col("material_id") % 11 == 0, None).when(F.col("material_id") % 3 == 0, F.col("base_cost") + 1).otherwise(F.col("base_cost"))
    given = m.select((F.col("material_id") + 100).alias("material_id"), price.alias("price"))
    both = given.join(m.select("material_id", "base_cost"), "material_id", "left")
    status = F.when(F.col("price").isNull(), "error").when(F.col("base_cost").isNull(), "missing").when(F.col("price") == F.col("base_cost"), "unchanged").otherwise("changed")
    return both.select("material_id", status.alias("status"), F.round(100 * safe_div(F.col("price") - F.col("base_cost"), F.col("base_cost")), 2).alias("change_pct"))


@register("p25_price_upsert", sql("SELECT coalesce(i.material_id, m.material_id) AS material_id, coalesce(i.price, m.base_cost) AS price FROM materials m FULL JOIN (SELECT * FROM import WHERE price IS NOT NULL) i ON i.material_id = m.material_id", **{"import": IMPORT}))
def p25(spark, d):
    """The catalogue after the import: changed and new prices replace or join the old ones."""
    m = domain.materials(spark, d).select("material_id", F.col("base_cost").alias("price"))
    price = F.when(F.col("material_id") % 11 == 0, None).when(F.col("material_id") % 3 == 0, F.col("price") + 1).otherwise(F.col("price"))
    given = m.select((F.col("material_id") + 100).alias("material_id"), price.alias("price")).filter("price IS NOT NULL")
    return sinks.upsert(m, given, ["material_id"], [F.desc("price")])


@register("p26_price_change", sql(f"SELECT material_id, effective_at, round(unit_price, 6) AS unit_price, round(pct, 4) AS pct FROM ({PRICE_STEPS})"))
def p26(spark, d):
    return price_steps(spark, d).select("material_id", "effective_at", F.round("unit_price", 6).alias("unit_price"), F.round("pct", 4).alias("pct"))


@register("p27_price_as_of", sql("SELECT run_id, line_number, i.material_id, round(coalesce(h.price, m.base_cost), 6) AS previous_price FROM items i JOIN materials m USING (material_id) LEFT JOIN LATERAL (SELECT max(unit_price) AS price FROM items x WHERE x.material_id = i.material_id AND x.effective_at = (SELECT max(effective_at) FROM items y WHERE y.material_id = i.material_id AND y.effective_at < i.effective_at)) h ON true"))
def p27(spark, d):
    """The last price strictly before each item's date, else the catalogue's."""
    items = domain.items(spark, d)
    found = joins.as_of(items.select("run_id", "line_number", "material_id", "effective_at"), items, "material_id", "effective_at", "effective_at", "unit_price", "before", every="year")
    m = domain.materials(spark, d).select("material_id", "base_cost")
    return found.join(m, "material_id").select("run_id", "line_number", "material_id", F.round(F.coalesce("before", "base_cost"), 6).alias("previous_price"))


ANOMALY = """SELECT run_id, least(p + CASE WHEN t > 500000 THEN 15 WHEN t < 1000 THEN 10 ELSE 0 END + CASE WHEN sd > 15 THEN 10 ELSE 0 END, 100)::DOUBLE AS anomaly FROM (SELECT run_id, sum(CASE WHEN m < 0 THEN 30 WHEN m < 5 THEN 15 WHEN m > 50 THEN 20 ELSE 0 END + CASE WHEN unit_price > 50000 THEN 10 ELSE 0 END + CASE WHEN coalesce(unit_cost, 0) = 0 THEN 25 ELSE 0 END) AS p, stddev_pop(m) AS sd, sum(item_price) AS t
 FROM (SELECT *, coalesce(100 * (unit_price - unit_cost) / nullif(unit_cost, 0), 0) AS m FROM costed) GROUP BY run_id)"""
RISK = f"""SELECT r.run_id, CASE WHEN coalesce(q, 0) < 3 THEN 40.0 ELSE least(abs(m - um) * 10, 100.0) END AS deviation, 100 - greatest(0, least(70 + 10 + CASE WHEN lifetime_value > 100000 THEN 15 WHEN lifetime_value < 10000 THEN -10 ELSE 0 END + CASE WHEN q >= 5 AND w > 0.8 THEN 10 WHEN q >= 5 AND w < 0.5 THEN -15 ELSE 0 END, 100))::DOUBLE AS credit, anomaly
 FROM runs r JOIN clients c USING (client_id) JOIN (SELECT run_id, avg(100 * (unit_price - unit_cost) / nullif(unit_cost, 0)) AS m FROM costed GROUP BY run_id) x USING (run_id) JOIN ({ANOMALY}) a USING (run_id)
 LEFT JOIN (SELECT client_id, count(*) AS q, avg(m) AS um, count(*) FILTER (outcome = 'won') / nullif(count(outcome), 0) AS w FROM runs JOIN (SELECT run_id, avg(100 * (unit_price - unit_cost) / nullif(unit_cost, 0)) AS m FROM costed GROUP BY run_id) USING (run_id) GROUP BY client_id) u USING (client_id)"""


@register("p34_risk", sql(f"SELECT run_id, round(deviation, 6) AS deviation, credit, anomaly, round(0.30 * deviation + 0.25 * credit + 0.35 * anomaly, 6) AS risk, CASE WHEN 0.30 * deviation + 0.25 * credit + 0.35 * anomaly < 30 THEN 'LOW' WHEN 0.30 * deviation + 0.25 * credit + 0.35 * anomaly < 60 THEN 'MEDIUM' ELSE 'HIGH' END AS level FROM ({RISK})"))
def p34(spark, d):
    """Margin deviation, credit, anomalies (and availability, here none missing), weighted into a level."""
    items = domain.costed_items(spark, d)
    margins = items.groupBy("run_id").agg(F.avg(100 * safe_div(F.col("unit_price") - F.col("unit_cost"), F.col("unit_cost"))).alias("m"))
    runs = domain.runs(spark, d).join(margins, "run_id")
    won = F.count(F.when(F.col("outcome") == "won", 1)).cast("double")
    usual = runs.groupBy("client_id").agg(F.count(F.lit(1)).alias("q"), F.avg("m").alias("um"), safe_div(won, F.count("outcome").cast("double")).alias("w"))
    anomalies = pricing.anomaly(items, "run_id", "unit_price", "unit_cost", "item_price")
    all_ = runs.join(domain.clients(spark, d), "client_id").join(anomalies, "run_id").join(usual, "client_id", "left")
    all_ = all_.withColumn("deviation", pricing.deviation_score(F.col("m"), F.col("um"), F.col("q"))).withColumn("credit", pricing.credit_risk(F.lit(24), F.col("lifetime_value"), F.col("q"), F.col("w"), F.lit("NET30")))
    risk = pricing.overall_risk(F.col("deviation"), F.col("credit"), F.col("anomaly"), F.lit(0.0))
    return all_.select("run_id", F.round("deviation", 6).alias("deviation"), "credit", "anomaly", F.round(risk, 6).alias("risk"), pricing.risk_level(risk).alias("level"))


@register("p35_approval_level", sql("SELECT run_id, CASE WHEN total_price > 300000 THEN 'management' WHEN total_price > 150000 THEN 'procurement' WHEN total_price > 50000 THEN 'sales' ELSE 'none' END AS level FROM runs"))
def p35(spark, d):
    return domain.runs(spark, d).select("run_id", bucket(-F.col("total_price"), [(-300000.0, "management"), (-150000.0, "procurement"), (-50000.0, "sales")], "none").alias("level"))


@register("p37_sla_sweep", sql("SELECT run_id, CASE WHEN deadline < TIMESTAMP '1998-06-01' THEN 'expired' WHEN idle >= 24 THEN 'backup' ELSE 'waiting' END AS action FROM (SELECT run_id, created_at + INTERVAL 1 HOUR * (24 + run_id % 72) AS deadline, date_diff('second', created_at, TIMESTAMP '1998-06-01') / 3600.0 AS idle FROM runs WHERE status = 'pending_approval' AND created_at < TIMESTAMP '1998-06-01')"))
def p37(spark, d):
    """Pending runs at a point in time: past their deadline, idle long enough for a deputy, or waiting."""
    now = F.to_timestamp_ntz(F.lit("1998-06-01 00:00:00"))
    p = domain.runs(spark, d).filter((F.col("status") == "pending_approval") & (F.col("created_at") < now))
    deadline = F.col("created_at") + F.make_dt_interval(F.lit(0), (24 + F.col("run_id") % 72).cast("int"))
    idle = F.timestamp_diff("SECOND", F.col("created_at"), now) / 3600.0
    return p.select("run_id", F.when(deadline < now, "expired").when(idle >= 24, "backup").otherwise("waiting").alias("action"))


@register("p38_quote_candidates", sql("SELECT run_id, round(total_price, 2) AS value FROM runs WHERE status = 'approved'"))
def p38(spark, d):
    """A candidate for each approved run; those that are there already are not made twice."""
    approved = domain.runs(spark, d).filter("status = 'approved'").select("run_id", F.round("total_price", 2).alias("value"))
    return sinks.insert_absent(approved.filter("run_id % 2 = 0"), approved, ["run_id"], [F.asc("value")])


HS = [("widget", "7301", 2), ("gear", "8483", 1), ("bolt", "7318", 1), ("red", "3204", 3), ("large", "9999", None)]
HS_COLUMNS = "keyword string, hs_code string, priority int"


@register("p41_hs_mapping", sql("SELECT m.material_id, hs_code FROM materials m LEFT JOIN hs ON keyword = split_part(name, ' ', 1) OR keyword = split_part(name, ' ', 2) OR keyword = lower(category) QUALIFY row_number() OVER (PARTITION BY m.material_id ORDER BY priority NULLS LAST, hs_code) = 1", hs=values(HS_COLUMNS, HS)))
def p41(spark, d):
    """A material's keywords, each looked up by equality; the best priority counts."""
    m = domain.materials(spark, d).select("material_id", "name", "category")
    keys = [F.split_part("name", F.lit(" "), F.lit(1)), F.split_part("name", F.lit(" "), F.lit(2)), F.lower("category")]
    found = joins.any_key(m, keys, literal(spark, HS_COLUMNS, HS), "keyword", ["material_id"])
    return joins.latest(found, ["material_id"], [F.asc_nulls_last("priority"), F.asc_nulls_last("hs_code")]).select("material_id", "hs_code")


@register("p43_price_adjustment", sql("SELECT category, month, round(100 * (p - before) / nullif(before, 0) * 0.6, 6) AS adjustment_pct FROM (SELECT *, lag(p) OVER (PARTITION BY category ORDER BY month) AS before FROM (SELECT category, strftime(effective_at, '%Y-%m') AS month, avg(unit_price) AS p FROM costed GROUP BY ALL))"))
def p43(spark, d, sensitivity: float = 0.6):
    """Movement of the monthly price of each category, times a sensitivity."""
    p = domain.costed_items(spark, d).groupBy("category", F.date_format("effective_at", "yyyy-MM").alias("month")).agg(F.avg("unit_price").alias("p"))
    before = F.lag("p").over(Window.partitionBy("category").orderBy("month"))
    return p.withColumn("b", before).select("category", "month", F.round(100 * safe_div(F.col("p") - F.col("b"), F.col("b")) * sensitivity, 6).alias("adjustment_pct"))


@register("p28_quick_estimate", sql("SELECT term, n, CASE WHEN n = 0 THEN 'none' WHEN n = 1 THEN 'one' ELSE 'many' END AS outcome, round(a * 1.2, 4) AS estimate FROM (SELECT term, count(material_id) AS n, avg(base_cost) AS a FROM (VALUES ('red widget'), ('gear'), ('nothing like it')) t(term) LEFT JOIN materials ON contains(lower(name), term) GROUP BY term)"))
def p28(spark, d):
    """Search terms (a stated few) against the catalogue: how many fit, and a price with the usual surcharge."""
    terms = F.broadcast(literal(spark, "term string", [("red widget",), ("gear",), ("nothing like it",)]))
    hits = domain.materials(spark, d).join(terms, F.contains(F.lower("name"), F.col("term"))).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.avg("base_cost").alias("a"))
    out = terms.join(hits, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("term", "n", F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "one").otherwise("many").alias("outcome"), F.round(F.col("a") * 1.2, 4).alias("estimate"))




@register("p19_tax_labels", sql("""SELECT run_id, '$' || format('{:,.2f}', total_price) AS subtotal, name || ' (' || format('{:,.2f}', rate * 100) || '%)' AS label, '$' || format('{:,.2f}', tax) AS tax, '$' || format('{:,.2f}', total_price + tax) AS total FROM (
 SELECT run_id, total_price, coalesce(tax_rate, 0.0) AS rate, floor(total_price * coalesce(tax_rate, 0.0) * 100 + 0.5) / 100 AS tax, CASE WHEN tax_rate IS NULL THEN 'Tax' WHEN tax_rate < 0.15 THEN 'SST' ELSE 'VAT' END AS name FROM taxed)""", taxes=values(TAX_COLUMNS, TAX), taxed=TAXED))
def p19(spark, d):
    """Subtotal, tax and total as they are shown."""
    day = F.to_date("created_at")
    rules = literal(spark, TAX_COLUMNS, TAX).withColumns({c: F.to_date(c) for c in ("valid_from", "valid_to")})
    rows = domain.runs(spark, d).join(domain.clients(spark, d).select("client_id", "nation_id"), "client_id")
    valid = (F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") >= day))
    found = rows.alias("r").join(rules.alias("t"), (F.col("r.nation_id") == F.col("t.nation_id")) & valid, "left").drop(F.col("t.nation_id"))
    one = joins.latest(found, ["run_id"], [F.desc_nulls_last("valid_from")]).withColumn("tax", pricing.tax(F.col("total_price"), F.col("tax_rate")))
    name = F.when(F.col("tax_rate").isNull(), "Tax").when(F.col("tax_rate") < 0.15, "SST").otherwise("VAT")
    b = pricing.tax_breakdown(F.col("total_price"), F.col("tax"), F.col("tax_rate"), name)
    return one.select("run_id", b[0]["formatted"].alias("subtotal"), b[1]["label"].alias("label"), b[1]["formatted"].alias("tax"), b[2]["formatted"].alias("total"))


LOCAL = "floor((10.0 + (60.0 + 25.0) / count(*) OVER (PARTITION BY run_id) + item_price * 0.002) * 100 + 0.5) / 100"


def with_local(rows: DataFrame) -> DataFrame:
    return rows.withColumn("local", pricing.local_charges(F.col("item_price"), "run_id", 10.0, None, 60.0, 25.0, 0.002))


@register("p15_local_charges", sql(f"SELECT run_id, line_number, material_id, quantity, {LOCAL} AS local FROM items"))
def p15(spark, d):
    """Flat rate, shares of documents and bank, miscellaneous by value."""
    return with_local(domain.items(spark, d)).select("run_id", "line_number", "material_id", "quantity", "local")


CODED = "SELECT *, CASE WHEN (material_id + run_id) % 4 = 0 THEN NULL WHEN (material_id + run_id) % 9 = 0 THEN ' ' ELSE 'M-' || material_id END AS code FROM items"


def coded(spark: SparkSession, d: str) -> DataFrame:
    """Items, some without a material code."""
    k = F.col("material_id") + F.col("run_id")
    return domain.items(spark, d).withColumn("code", F.when(k % 4 == 0, None).when(k % 9 == 0, " ").otherwise(F.concat(F.lit("M-"), F.col("material_id").cast("string"))))


@register("p33_availability", sql("SELECT run_id, least(100, 15 * count(*) FILTER (coalesce(trim(code), '') = ''))::DOUBLE AS availability, count(*) FILTER (coalesce(trim(code), '') = '') AS n_issues FROM coded GROUP BY run_id", coded=CODED))
def p33(spark, d):
    """15 points for each item without a material code."""
    return pricing.availability(coded(spark, d), "run_id", "code")


@register("p34_risk_with_availability", sql(f"SELECT run_id, availability, round(risk, 6) AS risk, CASE WHEN risk < 30 THEN 'LOW' WHEN risk < 60 THEN 'MEDIUM' ELSE 'HIGH' END AS level FROM (SELECT run_id, coalesce(availability, 0.0) AS availability, round(0.30 * deviation + 0.25 * credit + 0.35 * anomaly, 6) + 0.10 * coalesce(availability, 0.0) AS risk FROM ({RISK}) LEFT JOIN (SELECT run_id, least(100, 15 * count(*) FILTER (coalesce(trim(code), '') = ''))::DOUBLE AS availability FROM coded GROUP BY run_id) USING (run_id))", coded=CODED))
def p34_available(spark, d):
    """The level of risk with what items without a material code add to it."""
    missing = pricing.availability(coded(spark, d), "run_id", "code").select("run_id", "availability")
    both = p34(spark, d).select("run_id", F.col("risk").alias("known")).join(missing, "run_id", "left").withColumn("availability", F.coalesce("availability", F.lit(0.0)))
    risk = F.col("known") + 0.10 * F.col("availability")
    return both.select("run_id", "availability", F.round(risk, 6).alias("risk"), pricing.risk_level(risk).alias("level"))


@register("p11_price_run", sql(f"""SELECT run_id, count(*) AS n_items, count(*) FILTER (method = 'agreement') AS by_agreement, round(sum(unit_price * quantity), 6) AS subtotal, round(sum(duty), 6) AS duty, round(sum(freight + insurance + handling + local), 6) AS logistics,
 round(sum(unit_price * quantity + duty + freight + insurance + handling + local), 6) AS landed, round(sum(weight), 6) AS weight_kg FROM (
 SELECT *, {LOCAL} AS local FROM (SELECT *, greatest((item_price + freight) * 0.004 * 1.1, 5.0) AS insurance, item_price * 2.5 / 100 AS duty FROM (
 SELECT *, greatest(CASE rate_method WHEN 'weight' THEN weight * rate WHEN 'value' THEN item_price * rate WHEN 'volume' THEN weight / 500.0 * rate ELSE coalesce(rate, 30.0) END, coalesce(least, 5.0)) AS freight, 12.0 + 150.0 / count(*) OVER (PARTITION BY run_id) AS handling FROM (
 SELECT r.run_id, r.quantity, r.quantity * coalesce(p.kg, size) AS weight, coalesce(a.net, {PRICE}) AS unit_price, coalesce(a.net, {PRICE}) * r.quantity AS item_price, CASE WHEN a.net IS NULL THEN 'rules' ELSE 'agreement' END AS method, rates.method AS rate_method, rates.rate, rates.least
 FROM ruled r LEFT JOIN agreed a USING ({', '.join(KEY)}) LEFT JOIN (SELECT nps, max(kg_per_m) FILTER (is_preferred) AS kg FROM pipes GROUP BY nps) p ON p.nps = r.size LEFT JOIN rates USING (category))))) GROUP BY run_id""",
 priced=f"SELECT DISTINCT * FROM ({PRICED})", rules=values(RULE_COLUMNS, RULES), ruled=RULED.replace("FROM priced l", "FROM (SELECT * FROM priced QUALIFY row_number() OVER (PARTITION BY " + ", ".join(KEY) + ") = 1) l"), rates=values(RATE_COLUMNS, RATES),
 pipes=values("dn int, nps double, schedule string, kg_per_m double, is_preferred boolean", [(50, 2.0, "40", 5.44, True), (100, 4.0, "40", 16.07, True), (150, 6.0, "40", 28.26, True), (None, 8.0, "40", 42.55, True)]),
 conditions=values(CONDITION_COLUMNS, CONDITIONS), cascade=CASCADE.replace("FROM priced)", "FROM (SELECT * FROM priced QUALIFY row_number() OVER (PARTITION BY " + ", ".join(KEY) + ") = 1))"),
 agreed=f"SELECT {', '.join(KEY)}, round((base * (1 - disc / 100) + sur) * (1 + t / 100) + lme, 4) AS net FROM (SELECT {', '.join(KEY)}, sum(rate) FILTER (condition_type = 'BASE_PRICE') AS base, coalesce(sum(rate) FILTER (condition_type = 'DISCOUNT'), 0) AS disc, coalesce(sum(rate) FILTER (condition_type = 'SURCHARGE'), 0) AS sur, coalesce(sum(rate) FILTER (condition_type = 'TAX'), 0) AS t, coalesce(sum(rate) FILTER (condition_type = 'LME'), 0) AS lme FROM (SELECT *, min(lvl) OVER (PARTITION BY {', '.join(KEY)}) AS best FROM cascade) WHERE lvl = best GROUP BY {', '.join(KEY)})"))
def p11(spark, d):
    """A whole price run: material and pipe weight, agreement price or else rules, freight, insurance, handling, local charges and duty on the price, totals by run."""
    items = ruled(spark, d).withColumn("by_rules", rule_price())
    known = reduce(and_, [F.col(c).isNotNull() for c in KEY])  # as in the SQL, which joins agreements by KEY
    pipes = [(2.0, 5.44), (4.0, 16.07), (6.0, 28.26), (8.0, 42.55)]
    rows = agreed(spark, items, outer=True).withColumn("net", F.when(known, F.col("net"))).join(literal(spark, "nps double, kg double", pipes), F.col("size") == F.col("nps"), "left").join(literal(spark, RATE_COLUMNS, RATES), "category", "left")
    rows = rows.withColumns({"unit_price": F.coalesce("net", "by_rules"), "weight": F.col("quantity") * F.coalesce("kg", F.col("size").cast("double"))}).withColumn("item_price", F.col("unit_price") * F.col("quantity"))
    weight, value = F.col("weight"), F.col("item_price")
    rows = rows.withColumn("freight", pricing.freight(weight, value, weight / 500.0, F.col("method"), F.coalesce("rate", F.lit(30.0)), F.coalesce("least", F.lit(5.0))))
    rows = rows.withColumn("handling", pricing.shared_cost(F.lit(12.0), F.lit(150.0), "run_id"))
    rows = with_local(rows.withColumn("insurance", pricing.insurance(value, F.col("freight"), F.lit(0.004), F.lit(1.1), F.lit(1.0), F.lit(5.0))))
    rows = rows.withColumn("duty", pricing.duty(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(2.5), value))
    logistics = F.col("freight") + F.col("insurance") + F.col("handling") + F.col("local")
    total = lambda c: F.round(F.sum(c), 6)
    return rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.count("net").alias("by_agreement"), total(value).alias("subtotal"), total("duty").alias("duty"), total(logistics).alias("logistics"),
        total(value + F.col("duty") + logistics).alias("landed"), total("weight").alias("weight_kg"),
    )


@register("p40_validator", sql("""SELECT 'tenant' AS check, CASE WHEN count(*) FILTER (lifetime_value < -900) = 0 THEN 'pass' ELSE 'fail' END AS result, count(*) FILTER (lifetime_value < -900) AS n FROM clients
 UNION ALL SELECT 'status', CASE WHEN count(*) FILTER (status IS NULL) = 0 THEN 'pass' ELSE 'fail' END, count(*) FILTER (status IS NULL) FROM runs
 UNION ALL SELECT 'items', CASE WHEN count(*) = 0 THEN 'pass' ELSE 'warn' END, count(*) FROM runs WHERE run_id NOT IN (SELECT run_id FROM items)
 UNION ALL SELECT 'quantity', CASE WHEN count(*) FILTER (quantity IS NULL OR quantity <= 0) = 0 THEN 'pass' ELSE 'fail' END, count(*) FILTER (quantity IS NULL OR quantity <= 0) FROM items
 UNION ALL SELECT 'code', CASE WHEN count(*) FILTER (coalesce(trim(code), '') = '') = 0 THEN 'pass' ELSE 'warn' END, count(*) FILTER (coalesce(trim(code), '') = '') FROM coded
 UNION ALL SELECT 'client', CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END, count(*) FROM runs WHERE client_id NOT IN (SELECT client_id FROM clients)
 UNION ALL SELECT 'duplicates', CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END, count(*) FROM (SELECT run_id, line_number FROM items GROUP BY ALL HAVING count(*) > 1)
 UNION ALL SELECT 'materials', CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END, count(*) FROM items WHERE material_id NOT IN (SELECT material_id FROM materials)
 UNION ALL SELECT 'pricing rules', CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END, count(*) FROM materials WHERE category NOT IN ('ECONOMY', 'PROMO', 'STANDARD', 'SMALL')
 UNION ALL SELECT 'logistics rates', CASE WHEN count(*) = 0 THEN 'pass' ELSE 'warn' END, count(*) FROM materials WHERE category NOT IN (SELECT category FROM rates)
 UNION ALL SELECT 'tax rules', CASE WHEN count(*) FILTER (tax_rate IS NULL) = 0 THEN 'pass' ELSE 'warn' END, count(*) FILTER (tax_rate IS NULL) FROM taxed
 UNION ALL SELECT 'cost', CASE WHEN count(*) FILTER (base_cost IS NULL OR base_cost <= 0) = 0 THEN 'pass' ELSE 'fail' END, count(*) FILTER (base_cost IS NULL OR base_cost <= 0) FROM materials""", coded=CODED, rates=values(RATE_COLUMNS, RATES), taxes=values(TAX_COLUMNS, TAX), taxed=TAXED))  # fmt: skip
def p40(spark, d):
    """The twelve checks of the workflow's data, each one row: the tenant's standing, states, items, quantities, codes, clients, duplicates, materials, rules, rates, taxes, costs."""
    items, runs, clients, materials = domain.items(spark, d), domain.runs(spark, d), domain.clients(spark, d), domain.materials(spark, d)
    every, rates = F.lit(True), [r[0] for r in RATES]
    blank = F.coalesce(F.trim("code"), F.lit("")) == ""
    return pricing.failed_checks({
        "tenant": (clients, F.col("lifetime_value") < -900, "fail"), "status": (runs, F.col("status").isNull(), "fail"), "items": (runs.join(items, "run_id", "left_anti"), every, "warn"),
        "quantity": (items, F.coalesce(F.col("quantity") <= 0, F.lit(True)), "fail"), "code": (coded(spark, d), blank, "warn"), "client": (runs.join(clients, "client_id", "left_anti"), every, "fail"),
        "duplicates": (items.groupBy("run_id", "line_number").count(), F.col("count") > 1, "fail"), "materials": (items.join(materials, "material_id", "left_anti"), every, "fail"),
        "pricing rules": (materials, ~F.col("category").isin(*rates), "fail"), "logistics rates": (materials, ~F.col("category").isin(*rates), "warn"),
        "tax rules": (p18(spark, d), F.col("label") == "none", "warn"), "cost": (materials, F.coalesce(F.col("base_cost") <= 0, F.lit(True)), "fail"),
    })
