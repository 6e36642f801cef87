"""Dashboard, win/loss and margin queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelake.functions.money import bucket, count_if, margin_on_cost, percent_change, safe_div, sum_if
from quotelake.operators import filters
from quotelake.registry import register
from quotelake.sources import domain
from quotelake.sources.domain import sql

START, END = "1998-01-01", "2000-12-31"
BEFORE = "1995-01-01"
IN_RANGE = f"CAST(created_at AS DATE) BETWEEN DATE '{START}' AND DATE '{END}'"
#: Upper bounds of the margin histogram; null margins fall in the last bucket, negative ones in the first.
MARGIN_BUCKETS = [(0.10, "0-10%"), (0.15, "10-15%"), (0.20, "15-20%"), (0.25, "20-25%"), (0.30, "25-30%")]
SQL_BUCKET = "CASE " + " ".join(f"WHEN margin < {b} THEN '{x}'" for b, x in MARGIN_BUCKETS) + " ELSE '30%+' END"
COSTS = "SELECT run_id, sum(quantity * unit_cost) AS total_cost FROM costed GROUP BY run_id"
QUOTED = "SELECT c.*, r.client_id, r.created_at, r.status, r.outcome, (unit_price - unit_cost) / nullif(unit_cost, 0) AS margin FROM costed c JOIN runs r USING (run_id)"


def in_range(df: DataFrame) -> DataFrame:
    return df.filter(filters.day_range(F.col("created_at"), START, END))


def run_costs(spark: SparkSession, d: str) -> DataFrame:
    """Runs with the cost of their items; runs without items have none."""
    cost = domain.costed_items(spark, d).groupBy("run_id").agg(F.sum(F.col("quantity") * F.col("unit_cost")).alias("total_cost"))
    return domain.runs(spark, d).join(cost, "run_id", "left")


def quoted(spark: SparkSession, d: str) -> DataFrame:
    """Items with their run and margin on cost."""
    r = domain.runs(spark, d).select("run_id", "client_id", "created_at", "status", "outcome")
    return domain.costed_items(spark, d).join(r, "run_id").withColumn("margin", margin_on_cost(F.col("unit_price"), F.col("unit_cost")))


STATS = f"""SELECT count(DISTINCT run_id) AS quotes, count(*) FILTER (status = 'pending_approval') AS pending, count(*) FILTER (status = 'approved') AS approved,
 count(*) FILTER (status = 'rejected') AS rejected, round(sum(total_price), 2) AS value, round(avg(total_price), 4) AS average FROM runs WHERE {IN_RANGE}"""


@register("q01_quote_stats", sql(STATS))
def q01(spark, d):
    return in_range(domain.runs(spark, d)).agg(*quote_stats())


def quote_stats() -> list:
    s = F.col("status")
    return [
        F.countDistinct("run_id").alias("quotes"), count_if(s == "pending_approval").alias("pending"), count_if(s == "approved").alias("approved"),
        count_if(s == "rejected").alias("rejected"), F.round(F.sum("total_price"), 2).alias("value"), F.round(F.avg("total_price"), 4).alias("average"),
    ]


@register("q02_margins", sql(f"SELECT round(avg(m), 6) AS average, round(min(m), 6) AS lowest, round(max(m), 6) AS highest FROM (SELECT (total_price - total_cost) / nullif(total_cost, 0) AS m FROM runs JOIN costs USING (run_id) WHERE {IN_RANGE})", costs=COSTS))
def q02(spark, d):
    m = margin_on_cost(F.col("total_price"), F.col("total_cost"))
    return in_range(run_costs(spark, d)).agg(F.round(F.avg(m), 6).alias("average"), F.round(F.min(m), 6).alias("lowest"), F.round(F.max(m), 6).alias("highest"))


@register("q03_active_agreements", sql("SELECT count(*) AS active FROM (SELECT DATE '1995-01-01' + CAST(client_id AS INTEGER) AS f, CASE WHEN client_id % 3 = 0 THEN NULL ELSE DATE '1995-01-01' + CAST(client_id * 2 AS INTEGER) END AS u FROM clients) WHERE f <= DATE '1998-06-01' AND (u IS NULL OR u >= DATE '1998-06-01')"))
def q03(spark, d):
    """Agreements (one for each client, of derived validity) that are in force on a day."""
    first = F.to_date(F.lit(BEFORE))
    terms = domain.clients(spark, d).select(
        F.date_add(first, F.col("client_id").cast("int")).alias("valid_from"),
        F.when(F.col("client_id") % 3 != 0, F.date_add(first, (F.col("client_id") * 2).cast("int"))).alias("valid_to"),
    )
    return terms.filter(filters.valid_on(F.to_date(F.lit("1998-06-01")), "valid_from", "valid_to")).agg(F.count(F.lit(1)).alias("active"))


@register("q04_trend", sql(f"""SELECT n, before, CASE WHEN before = 0 THEN 0.0 ELSE round(100.0 * (n - before) / before, 1) END AS change_pct,
 CASE WHEN old = 0 THEN 0.0 ELSE round(100.0 * (value - old) / old, 1) END AS value_change_pct FROM
 (SELECT count(DISTINCT run_id) AS n, sum(total_price) AS value FROM runs WHERE {IN_RANGE}),
 (SELECT count(*) AS before, sum(total_price) AS old FROM runs WHERE created_at >= TIMESTAMP '{BEFORE}' AND created_at < TIMESTAMP '{START}')"""))
def q04(spark, d):
    """This period against the one before: a heuristic, as distinct runs now are compared with all runs then."""
    now, then = filters.day_range(F.col("created_at"), START, END), filters.half_open(F.col("created_at"), BEFORE, START)
    both = domain.runs(spark, d).agg(
        F.countDistinct(F.when(now, F.col("run_id"))).alias("n"), F.sum(F.when(now, F.col("total_price"))).alias("value"), count_if(then).alias("before"), F.sum(F.when(then, F.col("total_price"))).alias("old")
    )
    change = percent_change(F.col("n").cast("double"), F.col("before").cast("double"))
    return both.select("n", "before", change.alias("change_pct"), percent_change(F.col("value"), F.col("old")).alias("value_change_pct"))


@register("q05_revenue_by_month", sql("SELECT strftime(created_at, '%b') AS month, strftime(created_at, '%Y-%m') AS period, round(sum(total_price), 2) AS revenue FROM runs WHERE created_at >= TIMESTAMP '2000-07-01' AND created_at < TIMESTAMP '2001-01-01' GROUP BY ALL"))
def q05(spark, d):
    """Six months back from the end of the range."""
    six = domain.runs(spark, d).filter(filters.half_open(F.col("created_at"), "2000-07-01", "2001-01-01"))
    return six.groupBy(F.date_format("created_at", "MMM").alias("month"), F.date_format("created_at", "yyyy-MM").alias("period")).agg(F.round(F.sum("total_price"), 2).alias("revenue"))


@register("q06_dashboard", sql(f"SELECT s.*, m.average_margin FROM ({STATS}) s, (SELECT round(avg((total_price - total_cost) / nullif(total_cost, 0)), 6) AS average_margin FROM runs JOIN costs USING (run_id) WHERE {IN_RANGE}) m", costs=COSTS))
def q06(spark, d):
    """The dashboard's figures in one row and one pass."""
    m = margin_on_cost(F.col("total_price"), F.col("total_cost"))
    return in_range(run_costs(spark, d)).agg(*quote_stats(), F.round(F.avg(m), 6).alias("average_margin"))


def win_loss() -> list:
    won, lost = F.col("outcome") == "won", F.col("outcome") == "lost"
    return [
        count_if(won).alias("won"), count_if(lost).alias("lost"), F.round(sum_if(won, F.col("total_price")), 2).alias("won_value"),
        F.round(sum_if(lost, F.col("total_price")), 2).alias("lost_value"), F.round(safe_div(100.0 * count_if(won), F.count("outcome").cast("double")), 2).alias("win_rate"),
    ]


WIN_LOSS = """count(*) FILTER (outcome = 'won') AS won, count(*) FILTER (outcome = 'lost') AS lost, round(coalesce(sum(total_price) FILTER (outcome = 'won'), 0.0), 2) AS won_value,
 round(coalesce(sum(total_price) FILTER (outcome = 'lost'), 0.0), 2) AS lost_value, round(100.0 * count(*) FILTER (outcome = 'won') / nullif(count(outcome), 0), 2) AS win_rate"""


@register("q07_win_loss", sql(f"SELECT {WIN_LOSS} FROM runs WHERE outcome IS NOT NULL AND {IN_RANGE}"))
def q07(spark, d):
    return in_range(domain.runs(spark, d)).filter("outcome IS NOT NULL").agg(*win_loss())


@register("q08_win_loss_by_quarter", sql(f"SELECT year(created_at)::VARCHAR || '-' || quarter(created_at)::VARCHAR AS period, {WIN_LOSS} FROM runs WHERE outcome IS NOT NULL AND {IN_RANGE} GROUP BY ALL"))
def q08(spark, d, pattern: str = "yyyy-Q"):
    """By quarter (or with yyyy-MM by month)."""
    return in_range(domain.runs(spark, d)).filter("outcome IS NOT NULL").groupBy(F.date_format("created_at", pattern).alias("period")).agg(*win_loss())


@register("q08_win_loss_by_month", sql(f"SELECT strftime(created_at, '%Y-%m') AS period, {WIN_LOSS} FROM runs WHERE outcome IS NOT NULL AND {IN_RANGE} GROUP BY ALL"))
def q08_month(spark, d):
    return q08(spark, d, "yyyy-MM")


@register("q09_win_loss_by_client", sql(f"SELECT client, {WIN_LOSS} FROM runs JOIN clients USING (client_id) WHERE outcome IS NOT NULL AND {IN_RANGE} GROUP BY ALL"))
def q09(spark, d):
    return in_range(domain.runs(spark, d)).filter("outcome IS NOT NULL").join(domain.clients(spark, d), "client_id").groupBy("client").agg(*win_loss()).orderBy(F.desc("won"), "client")


@register("q10_loss_reasons", sql(f"SELECT reason, n, round(100.0 * n / (SELECT count(*) FROM runs WHERE outcome = 'lost' AND {IN_RANGE}), 2) AS share_pct FROM (SELECT reason, count(*) AS n FROM runs WHERE outcome = 'lost' AND {IN_RANGE} GROUP BY reason ORDER BY n DESC, reason LIMIT 10)"))
def q10(spark, d):
    """Ten commonest reasons, with their share of all losses."""
    n = in_range(domain.runs(spark, d)).filter(F.col("outcome") == "lost").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    share = F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 2)  # one row for each reason
    return n.withColumn("share_pct", share).orderBy(F.desc("n"), "reason").limit(10)


@register("q11_overall_margin", sql(f"SELECT round(avg(margin), 6) AS average FROM quoted WHERE {IN_RANGE}", quoted=QUOTED))
def q11(spark, d):
    return in_range(quoted(spark, d)).agg(F.round(F.avg("margin"), 6).alias("average"))


@register("q12_margin_by_material", sql(f"SELECT name, round(avg(margin), 6) AS average, count(DISTINCT run_id) AS quotes, round(sum(item_price), 2) AS value FROM quoted WHERE {IN_RANGE} GROUP BY name ORDER BY quotes DESC, name LIMIT 20", quoted=QUOTED))
def q12(spark, d):
    each = in_range(quoted(spark, d)).groupBy("name").agg(F.round(F.avg("margin"), 6).alias("average"), F.countDistinct("run_id").alias("quotes"), F.round(F.sum("item_price"), 2).alias("value"))
    return each.orderBy(F.desc("quotes"), "name").limit(20)


@register("q13_margin_by_category", sql(f"SELECT category, round(avg(margin), 6) AS average, count(DISTINCT run_id) AS quotes FROM quoted WHERE {IN_RANGE} GROUP BY category", quoted=QUOTED))
def q13(spark, d):
    return in_range(quoted(spark, d)).groupBy("category").agg(F.round(F.avg("margin"), 6).alias("average"), F.countDistinct("run_id").alias("quotes"))


@register("q14_margin_by_client", sql(f"SELECT client, round(avg(margin), 6) AS average, round(sum(item_price), 2) AS value FROM quoted JOIN clients USING (client_id) WHERE {IN_RANGE} GROUP BY client", quoted=QUOTED))
def q14(spark, d):
    each = in_range(quoted(spark, d)).join(domain.clients(spark, d), "client_id").groupBy("client")
    return each.agg(F.round(F.avg("margin"), 6).alias("average"), F.round(F.sum("item_price"), 2).alias("value")).orderBy(F.desc("value"), "client")


@register("q15_margin_histogram", sql(f"SELECT {SQL_BUCKET} AS margin_range, count(*) AS n FROM quoted WHERE created_at >= TIMESTAMP '{START}' AND created_at <= TIMESTAMP '{END}' GROUP BY ALL", quoted=QUOTED))
def q15(spark, d):
    """The last day counts at midnight only, unlike in the other margin queries."""
    rows = quoted(spark, d).filter(filters.until_midnight(F.col("created_at"), START, END))
    return rows.groupBy(bucket(F.col("margin"), MARGIN_BUCKETS, "30%+").alias("margin_range")).agg(F.count(F.lit(1)).alias("n"))


@register("q16_margin_range_outcome", sql(f"SELECT {SQL_BUCKET} AS margin_range, count(*) FILTER (outcome = 'won') AS won, count(*) FILTER (outcome = 'lost') AS lost, count(*) AS n, round(avg(item_price) FILTER (outcome = 'won'), 4) AS won_average FROM quoted GROUP BY ALL", quoted=QUOTED))
def q16(spark, d):
    won = F.col("outcome") == "won"
    return quoted(spark, d).groupBy(bucket(F.col("margin"), MARGIN_BUCKETS, "30%+").alias("margin_range")).agg(
        count_if(won).alias("won"), count_if(F.col("outcome") == "lost").alias("lost"), F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(won, F.col("item_price"))), 4).alias("won_average")
    )


@register("q17_optimal_markup", sql("SELECT category, origin, round(avg(margin) FILTER (outcome = 'won'), 6) AS won_markup, count(*) AS n, round(count(*) FILTER (outcome = 'won') / nullif(count(outcome), 0), 6) AS win_ratio FROM quoted GROUP BY category, origin", quoted=QUOTED))
def q17(spark, d):
    won = F.col("outcome") == "won"
    each = quoted(spark, d).groupBy("category", "origin").agg(
        F.round(F.avg(F.when(won, F.col("margin"))), 6).alias("won_markup"), F.count(F.lit(1)).alias("n"), F.round(safe_div(count_if(won).cast("double"), F.count("outcome").cast("double")), 6).alias("win_ratio")
    )
    return each.orderBy(F.desc_nulls_last("win_ratio"), "category", "origin")


LEARNED = """SELECT client_id, count(DISTINCT run_id) AS quotes, round(count(DISTINCT run_id) FILTER (outcome = 'won') / count(DISTINCT run_id), 6) AS win_rate,
 avg(margin) FILTER (outcome = 'won') AS won_margin, avg(margin) AS margin FROM quoted WHERE created_at >= TIMESTAMP '2000-01-01' AND outcome IS NOT NULL GROUP BY client_id HAVING count(DISTINCT run_id) >= 3"""


@register("q18_client_learning", sql(f"SELECT client_id, quotes, win_rate, round(least(quotes / 50.0, 1.0), 6) AS confidence, round(margin * f, 6) AS recommended FROM (SELECT *, CASE WHEN win_rate > 0.7 THEN 1.05 WHEN win_rate < 0.3 THEN 0.95 ELSE 1.0 END AS f FROM ({LEARNED})) WHERE abs(f - 1) BETWEEN 0.02 AND 0.2", quoted=QUOTED))
def q18(spark, d, least: int = 3):
    """Clients with enough quotes: margin to recommend, 5 % up or down by win rate; changes under 2 % or over 20 % are left out."""
    rows = quoted(spark, d).filter((F.col("created_at") >= F.to_timestamp_ntz(F.lit("2000-01-01 00:00:00"))) & F.col("outcome").isNotNull())
    won = F.col("outcome") == "won"
    each = rows.groupBy("client_id").agg(
        F.countDistinct("run_id").alias("quotes"), F.countDistinct(F.when(won, F.col("run_id"))).alias("wins"), F.avg("margin").alias("margin")
    ).filter(F.col("quotes") >= least)
    rate = F.round(F.col("wins") / F.col("quotes"), 6)
    f = F.when(rate > 0.7, 1.05).when(rate < 0.3, 0.95).otherwise(1.0)
    out = each.withColumn("win_rate", rate).withColumn("f", f).filter(F.abs(F.col("f") - 1).between(0.02, 0.2))
    return out.select("client_id", "quotes", "win_rate", F.round(F.least(F.col("quotes") / 50.0, F.lit(1.0)), 6).alias("confidence"), F.round(F.col("margin") * F.col("f"), 6).alias("recommended"))


@register("q19_prediction_error", sql("SELECT count(*) AS n, round(avg(abs(p - won)), 6) AS mae, round(avg((p - won) * (p - won)), 6) AS brier FROM (SELECT (run_id % 101) / 100.0 AS p, CASE WHEN outcome = 'won' THEN 1.0 ELSE 0.0 END AS won FROM runs WHERE outcome IS NOT NULL)"))
def q19(spark, d):
    """Error of win probabilities (derived from the run's number): mean absolute error and Brier score."""
    e = (F.col("run_id") % 101) / 100.0 - F.when(F.col("outcome") == "won", 1.0).otherwise(0.0)
    return domain.runs(spark, d).filter("outcome IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.avg(e * e), 6).alias("brier"))


PRICE_STEPS = "SELECT *, 100 * (unit_price - previous) / nullif(previous, 0) AS pct FROM (SELECT material_id, effective_at, unit_price, lag(unit_price) OVER (PARTITION BY material_id ORDER BY effective_at, unit_price) AS previous FROM items)"


def price_steps(spark: SparkSession, d: str) -> DataFrame:
    """Each price of a material with the one before it, in order of time and then price."""
    w = Window.partitionBy("material_id").orderBy("effective_at", "unit_price")
    rows = domain.items(spark, d).select("material_id", "effective_at", "unit_price", F.lag("unit_price").over(w).alias("previous"))
    return rows.withColumn("pct", 100 * safe_div(F.col("unit_price") - F.col("previous"), F.col("previous")))


@register("q20_price_changes", sql(f"SELECT count(*) FILTER (pct > 0) AS up, count(*) FILTER (pct < 0) AS down, count(*) FILTER (pct = 0) AS flat, round(avg(pct), 6) AS average, round(max(pct), 6) AS highest, round(min(pct), 6) AS lowest FROM ({PRICE_STEPS}) WHERE effective_at >= TIMESTAMP '2001-08-01' AND effective_at < TIMESTAMP '2001-11-30'"))
def q20(spark, d):
    """Changes in a trailing window before the fixed present."""
    p = F.col("pct")
    rows = price_steps(spark, d).filter(filters.trailing(F.col("effective_at"), domain.AS_OF, 121))
    return rows.agg(count_if(p > 0).alias("up"), count_if(p < 0).alias("down"), count_if(p == 0).alias("flat"), F.round(F.avg(p), 6).alias("average"), F.round(F.max(p), 6).alias("highest"), F.round(F.min(p), 6).alias("lowest"))


@register("q21_client_history", sql("SELECT client_id, round(avg(margin) * 100, 6) AS average_margin_pct, count(DISTINCT run_id) AS quotes FROM quoted WHERE created_at >= TIMESTAMP '2000-11-30' AND status IN ('approved', 'rejected') GROUP BY client_id", quoted=QUOTED))
def q21(spark, d):
    """What margin deviation compares with: twelve months of settled quotes of each client."""
    since = F.to_timestamp_ntz(F.lit(domain.AS_OF)) - F.expr("INTERVAL 12 MONTHS")
    rows = quoted(spark, d).filter((F.col("created_at") >= since) & F.col("status").isin("approved", "rejected"))
    return rows.groupBy("client_id").agg(F.round(F.avg("margin") * 100, 6).alias("average_margin_pct"), F.countDistinct("run_id").alias("quotes"))


APPROVALS = "SELECT *, created_at + INTERVAL 1 HOUR * (run_id % 48) AS submitted_at, CASE WHEN status = 'approved' THEN created_at + INTERVAL 1 HOUR * (run_id % 48 + run_id % 30) END AS approved_at FROM runs"


def approvals(spark: SparkSession, d: str) -> DataFrame:
    """Runs with derived times of submission and approval."""
    hours = lambda n: F.make_dt_interval(F.lit(0), n.cast("int"))
    at = F.col("created_at") + hours(F.col("run_id") % 48)
    return domain.runs(spark, d).withColumn("submitted_at", at).withColumn("approved_at", F.when(F.col("status") == "approved", at + hours(F.col("run_id") % 30)))


@register("q22_approval_stats", sql("SELECT count(*) AS n, count(*) FILTER (status = 'pending_approval') AS pending, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'rejected') AS rejected, round(avg(date_diff('second', submitted_at, approved_at) / 3600.0), 6) AS average_hours FROM approvals", approvals=APPROVALS))
def q22(spark, d):
    s = F.col("status")
    hours = F.timestamp_diff("SECOND", F.col("submitted_at"), F.col("approved_at")) / 3600.0
    return approvals(spark, d).agg(F.count(F.lit(1)).alias("n"), count_if(s == "pending_approval").alias("pending"), count_if(s == "approved").alias("approved"), count_if(s == "rejected").alias("rejected"), F.round(F.avg(hours), 6).alias("average_hours"))
