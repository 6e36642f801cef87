"""Work queues, usage costs, views, catalogue profiles, data quality and training features."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelake.functions.money import bucket, count_if, safe_div
from quotelake.operators import filters, joins
from quotelake.plans.dashboards import APPROVALS, COSTS, QUOTED, approvals, quoted, run_costs
from quotelake.registry import register
from quotelake.sources import domain
from quotelake.sources.domain import sql

def n_rows():
    return F.count(F.lit(1))


@register("q23_rfq_count", sql("SELECT count(*) AS n FROM runs"))
def q23(spark, d):
    return domain.runs(spark, d).agg(n_rows().alias("n"))


@register("q24_needs_attention", sql("SELECT run_id, client_id, status FROM runs WHERE status = 'pending_approval' AND created_at < TIMESTAMP '1996-01-01'"))
def q24(spark, d):
    return domain.runs(spark, d).filter((F.col("status") == "pending_approval") & (F.col("created_at") < F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00")))).select("run_id", "client_id", "status")


@register("q25_recent_runs", sql("SELECT run_id, client_id, round(total_price, 2) AS total_price FROM runs ORDER BY created_at DESC, run_id LIMIT 25"))
def q25(spark, d):
    return domain.runs(spark, d).orderBy(F.desc("created_at"), "run_id").limit(25).select("run_id", "client_id", F.round("total_price", 2).alias("total_price"))


@register("q26_material_search", sql("SELECT material_id, name, category FROM materials WHERE contains(lower(name), 'gear') OR contains(lower(origin), 'gear') OR contains(lower(category), 'gear')"))
def q26(spark, d):
    return domain.materials(spark, d).filter(filters.any_contains(["name", "origin", "category"], "Gear")).select("material_id", "name", "category")


@register("f07b_catalogue_filter", sql("SELECT material_id, name FROM materials WHERE (contains(lower(name), 'red') OR contains(lower(category), 'red')) AND origin = 'Brand#11'"))
def f07b(spark, d):
    return filters.catalogue_search(domain.materials(spark, d), "RED", ["name", "category"], {"origin": "Brand#11", "category": "all"}).select("material_id", "name")


@register("q28_approval_queue", sql("""SELECT a.run_id, client, n_items, n_materials, round(items_value, 2) AS items_value, CAST(floor(date_diff('second', submitted_at, TIMESTAMP '2001-11-30') / 86400.0) AS BIGINT) AS days_pending
 FROM approvals a JOIN clients USING (client_id) LEFT JOIN (SELECT run_id, count(*) AS n_items, count(DISTINCT material_id) AS n_materials, sum(item_price) AS items_value FROM items GROUP BY run_id) s ON s.run_id = a.run_id
 WHERE status = 'pending_approval' ORDER BY submitted_at, a.run_id LIMIT 50""", approvals=APPROVALS))
def q28(spark, d, oldest_first: bool = True, limit: int = 50):
    """Pending runs with statistics of their items, aggregated before the join."""
    stats = domain.items(spark, d).groupBy("run_id").agg(n_rows().alias("n_items"), F.countDistinct("material_id").alias("n_materials"), F.sum("item_price").alias("items_value"))
    pending = approvals(spark, d).filter(F.col("status") == "pending_approval").join(domain.clients(spark, d), "client_id").join(stats, "run_id", "left")
    days = F.floor(F.timestamp_diff("SECOND", F.col("submitted_at"), F.to_timestamp_ntz(F.lit(f"{domain.AS_OF} 00:00:00"))) / 86400.0)
    order = F.asc("submitted_at") if oldest_first else F.desc("submitted_at")
    return pending.orderBy(order, "run_id").limit(limit).select("run_id", "client", "n_items", "n_materials", F.round("items_value", 2).alias("items_value"), days.alias("days_pending"))


@register("q27_pending_approvals", sql("SELECT run_id, client_id, round(total_price, 2) AS total_price FROM runs WHERE status = 'pending_approval' ORDER BY total_price DESC, run_id LIMIT 20"))
def q27(spark, d):
    return domain.runs(spark, d).filter("status = 'pending_approval'").orderBy(F.desc("total_price"), "run_id").limit(20).select("run_id", "client_id", F.round("total_price", 2).alias("total_price"))


@register("q29_usage_by_service", sql("SELECT service, count(*) AS calls, sum(tokens)::BIGINT AS tokens, round(sum(cost), 4) AS cost, round(avg(tokens), 6) AS average_tokens, max(tokens) AS most_tokens, count(*) FILTER (NOT success) AS failed FROM usage GROUP BY service"))
def q29(spark, d):
    return domain.usage(spark, d).groupBy("service").agg(
        n_rows().alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 4).alias("cost"), F.round(F.avg("tokens"), 6).alias("average_tokens"), F.max("tokens").alias("most_tokens"), count_if(~F.col("success")).alias("failed")
    )


@register("q30_usage_daily", sql("SELECT CAST(created_at AS DATE) AS day, tenant_id, service, count(*) AS calls, round(sum(cost), 4) AS cost FROM usage GROUP BY ALL"))
def q30(spark, d):
    return domain.usage(spark, d).groupBy(F.to_date("created_at").alias("day"), "tenant_id", "service").agg(n_rows().alias("calls"), F.round(F.sum("cost"), 4).alias("cost"))


@register("q31_budget", sql("SELECT tenant_id, round(used, 4) AS used, round(100 * used / 2000.0, 4) AS used_pct, CASE WHEN 100 * used / 2000.0 > 90 THEN 'critical' WHEN 100 * used / 2000.0 > 75 THEN 'warning' ELSE 'ok' END AS alert FROM (SELECT tenant_id, sum(cost) AS used FROM usage WHERE created_at >= TIMESTAMP '2024-01-02' AND created_at < TIMESTAMP '2024-02-01' GROUP BY tenant_id)"))
def q31(spark, d, budget: float = 2000.0):
    """What each tenant used of its budget in 30 days."""
    used = domain.usage(spark, d).filter(filters.trailing(F.col("created_at"), domain.USAGE_AS_OF, 30)).groupBy("tenant_id").agg(F.sum("cost").alias("u"))
    pct = 100 * F.col("u") / budget
    return used.select("tenant_id", F.round("u", 4).alias("used"), F.round(pct, 4).alias("used_pct"), F.when(pct > 90, "critical").when(pct > 75, "warning").otherwise("ok").alias("alert"))


@register("q32_event_stats", sql("SELECT service AS event_type, count(*) AS n, count(DISTINCT tenant_id) AS actors, min(created_at) AS first_at, max(created_at) AS last_at FROM usage GROUP BY service"))
def q32(spark, d):
    return domain.usage(spark, d).groupBy(F.col("service").alias("event_type")).agg(n_rows().alias("n"), F.countDistinct("tenant_id").alias("actors"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


@register("q33_extraction_stats", "WITH x AS (SELECT lang, (n_chars % 100) / 100.0 AS c FROM documents) SELECT lang, count(*) AS n, round(avg(c), 6) AS confidence, count(*) FILTER (c >= 0.9) AS high, count(*) FILTER (c >= 0.7 AND c < 0.9) AS medium, count(*) FILTER (c < 0.7) AS low, round(100.0 * count(*) FILTER (c < 0.7) / count(*), 4) AS review_rate FROM x GROUP BY lang")
def q33(spark, d):
    """Confidence bands of extracted documents (confidence derived from their length)."""
    c = F.col("c")
    x = domain.read(spark, d, "documents").select("lang", ((F.col("n_chars") % 100) / 100.0).alias("c"))
    return x.groupBy("lang").agg(
        n_rows().alias("n"), F.round(F.avg(c), 6).alias("confidence"), count_if(c >= 0.9).alias("high"), count_if((c >= 0.7) & (c < 0.9)).alias("medium"), count_if(c < 0.7).alias("low"),
        F.round(100.0 * count_if(c < 0.7) / n_rows(), 4).alias("review_rate"),
    )


@register("q34_conversation_structure", "SELECT count(*) AS n, round(avg(turns), 6) AS average_turns, count(*) FILTER (answers > 0) AS answered FROM (SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'assistant') AS answers FROM conversations GROUP BY conv_id)")
def q34(spark, d):
    """Nested documents: sizes of parts, from an array of structs for each parent."""
    nested = domain.read(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("t"))
    answers = F.size(F.filter("t", lambda x: x["role"] == "assistant"))
    return nested.agg(n_rows().alias("n"), F.round(F.avg(F.size("t")), 6).alias("average_turns"), count_if(answers > 0).alias("answered"))


@register("q35_run_totals", sql("SELECT r.run_id, coalesce(n, 0) AS n_items, round(v, 2) AS items_total FROM runs r LEFT JOIN (SELECT run_id, count(*) AS n, sum(item_price) AS v FROM items GROUP BY run_id) USING (run_id)"))
def q35(spark, d):
    s = domain.items(spark, d).groupBy("run_id").agg(n_rows().alias("n"), F.sum("item_price").alias("v"))
    return domain.runs(spark, d).join(s, "run_id", "left").select("run_id", F.coalesce("n", F.lit(0)).alias("n_items"), F.round("v", 2).alias("items_total"))


@register("q36_daily", sql("SELECT CAST(created_at AS DATE) AS day, count(DISTINCT run_id) AS n_runs, count(DISTINCT client_id) AS n_clients, count(DISTINCT reason) AS n_reasons, count(DISTINCT status) AS n_statuses, round(sum(total_price), 2) AS value FROM runs GROUP BY ALL"))
def q36(spark, d):
    distinct = [F.countDistinct(c).alias(n) for c, n in (("run_id", "n_runs"), ("client_id", "n_clients"), ("reason", "n_reasons"), ("status", "n_statuses"))]
    return domain.runs(spark, d).groupBy(F.to_date("created_at").alias("day")).agg(*distinct, F.round(F.sum("total_price"), 2).alias("value"))


@register("q37_margin_view_compat", sql("SELECT CAST(created_at AS DATE) AS day, count(*) AS n, count(*) FILTER (status = 'pending') AS pending, round(sum(total_price), 2) AS value FROM runs LEFT JOIN items USING (run_id) GROUP BY ALL"))
def q37_compat(spark, d):
    """Run totals summed once for each item, and a status that never occurs: as the view was written."""
    rows = domain.runs(spark, d).join(domain.items(spark, d).select("run_id"), "run_id", "left")
    return rows.groupBy(F.to_date("created_at").alias("day")).agg(n_rows().alias("n"), count_if(F.col("status") == "pending").alias("pending"), F.round(F.sum("total_price"), 2).alias("value"))


@register("q37_margin_view_fixed", sql("SELECT CAST(created_at AS DATE) AS day, count(*) AS n, count(*) FILTER (status IN ('pending', 'pending_approval')) AS pending, round(sum(total_price), 2) AS value, round(avg((total_price - total_cost) / nullif(total_cost, 0)), 6) AS margin FROM runs LEFT JOIN costs USING (run_id) GROUP BY ALL", costs=COSTS))
def q37_fixed(spark, d):
    """As meant: each run once, both names of the status."""
    m = safe_div(F.col("total_price") - F.col("total_cost"), F.col("total_cost"))
    return run_costs(spark, d).groupBy(F.to_date("created_at").alias("day")).agg(n_rows().alias("n"), count_if(F.col("status").isin("pending", "pending_approval")).alias("pending"), F.round(F.sum("total_price"), 2).alias("value"), F.round(F.avg(m), 6).alias("margin"))


@register("q38_runs_with_items", sql("SELECT r.run_id, status, line_number, material_id, round(item_price, 2) AS item_price FROM runs r LEFT JOIN items USING (run_id) WHERE r.created_at >= TIMESTAMP '2000-12-01'"))
def q38(spark, d):
    r = domain.runs(spark, d).filter(F.col("created_at") >= F.to_timestamp_ntz(F.lit("2000-12-01 00:00:00")))
    return r.join(domain.items(spark, d), "run_id", "left").select("run_id", "status", "line_number", "material_id", F.round("item_price", 2).alias("item_price"))


PROFILE = "count(*) AS n, round(avg(base_cost), 6) AS average, min(base_cost) AS lowest, max(base_cost) AS highest"


@register("q39_catalogue_profile", sql(f"SELECT 'category' AS by, category AS value, {PROFILE} FROM materials GROUP BY category UNION ALL SELECT 'origin', origin, {PROFILE} FROM materials GROUP BY origin"))
def q39(spark, d):
    def profile(by):
        return domain.materials(spark, d).groupBy(F.lit(by).alias("by"), F.col(by).alias("value")).agg(n_rows().alias("n"), F.round(F.avg("base_cost"), 6).alias("average"), F.min("base_cost").alias("lowest"), F.max("base_cost").alias("highest"))

    return profile("category").unionByName(profile("origin"))


@register("q40_codes_per_category", sql("SELECT category, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT category, name FROM materials) GROUP BY category"))
def q40(spark, d):
    return domain.materials(spark, d).groupBy("category").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


@register("q41_price_bands", sql("SELECT CASE WHEN base_cost < 920 THEN 'low' WHEN base_cost < 960 THEN 'middle' ELSE 'high' END AS band, count(*) AS n, min(base_cost) AS lowest FROM materials GROUP BY ALL"))
def q41(spark, d):
    return domain.materials(spark, d).groupBy(bucket(F.col("base_cost"), [(920, "low"), (960, "middle")], "high").alias("band")).agg(n_rows().alias("n"), F.min("base_cost").alias("lowest")).orderBy("lowest")


@register("q42_cheapest", sql("SELECT category, material_id, base_cost FROM materials QUALIFY row_number() OVER (PARTITION BY category ORDER BY base_cost, material_id) <= 3"))
def q42(spark, d):
    return joins.latest(domain.materials(spark, d), ["category"], [F.asc("base_cost"), F.asc("material_id")], 3).select("category", "material_id", "base_cost")


@register("q43_extremes", sql("(SELECT 'top' AS side, material_id, base_cost FROM materials ORDER BY base_cost DESC, material_id LIMIT 10) UNION ALL (SELECT 'bottom', material_id, base_cost FROM materials ORDER BY base_cost, material_id LIMIT 10)"))
def q43(spark, d):
    m = domain.materials(spark, d)
    side = lambda name, order: m.orderBy(order, "material_id").limit(10).select(F.lit(name).alias("side"), "material_id", "base_cost")
    return side("top", F.desc("base_cost")).unionByName(side("bottom", F.asc("base_cost")))


@register("q44_nested_detail", sql("SELECT run_id, string_agg(line_number || ':' || material_id, ',' ORDER BY line_number, material_id, quantity, item_price) AS lines FROM items GROUP BY run_id"))
def q44(spark, d):
    """A parent with its items as an array of structs, here written as a line."""
    nested = domain.items(spark, d).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("line_number", "material_id", "quantity", "item_price"))).alias("items"))
    return nested.select("run_id", F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["line_number"].cast("string"), x["material_id"].cast("string"))), ",").alias("lines"))


@register("q45_duplicates", sql("SELECT run_id, line_number, count(*) AS n, string_agg(material_id, ',' ORDER BY material_id) AS ids FROM items GROUP BY ALL HAVING count(*) > 1"))
def q45(spark, d):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("material_id")), lambda x: x.cast("string")), ",")
    return domain.items(spark, d).groupBy("run_id", "line_number").agg(n_rows().alias("n"), ids.alias("ids")).filter("n > 1")


@register("j08_runs_without_items", sql("SELECT run_id FROM runs WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.run_id = runs.run_id)"))
def j08(spark, d):
    """Orphan check: an anti join."""
    return domain.runs(spark, d).join(domain.items(spark, d), "run_id", "left_anti").select("run_id")


@register("q46_training_features", sql("""SELECT run_id, count(*) AS n_items, round(avg(margin), 6) AS average_margin, round(stddev_samp(margin), 6) AS margin_sd, count(DISTINCT category) AS n_categories,
 string_agg(DISTINCT category, ',' ORDER BY category) AS categories, count(*) FILTER (flag = 'R') AS returned FROM quoted GROUP BY run_id""", quoted=QUOTED))
def q46(spark, d):
    return quoted(spark, d).groupBy("run_id").agg(
        n_rows().alias("n_items"), F.round(F.avg("margin"), 6).alias("average_margin"), F.round(F.stddev_samp("margin"), 6).alias("margin_sd"), F.countDistinct("category").alias("n_categories"),
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"), count_if(F.col("flag") == "R").alias("returned"),
    )


@register("q47_training_history", sql("""SELECT run_id, earlier, coalesce(round(wins / nullif(settled, 0), 6), 0.5) AS win_rate, date_diff('day', CAST(last_win AS DATE), CAST(created_at AS DATE)) AS days_since_win,
 month(created_at) AS month, quarter(created_at) AS quarter, CAST(dayofweek(created_at) AS INTEGER) AS weekday FROM (SELECT *, count(*) OVER w AS earlier, count(*) FILTER (outcome = 'won') OVER w AS wins, count(outcome) OVER w AS settled,
 max(CASE WHEN outcome = 'won' THEN created_at END) OVER w AS last_win FROM runs WINDOW w AS (PARTITION BY client_id ORDER BY epoch_us(created_at) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""))
def q47(spark, d):
    """What was known of a client strictly before each run."""
    won = F.col("outcome") == "won"
    rows = domain.runs(spark, d)
    h = joins.history(rows, "client_id", F.unix_micros(F.col("created_at").cast("timestamp")), {"earlier": n_rows(), "wins": count_if(won), "settled": F.count("outcome"), "last_win": F.max(F.when(won, F.col("created_at")))})
    rate = F.coalesce(F.round(safe_div(F.col("wins").cast("double"), F.col("settled").cast("double")), 6), F.lit(0.5))
    return h.select(
        "run_id", "earlier", rate.alias("win_rate"), F.datediff(F.to_date("created_at"), F.to_date("last_win")).cast("long").alias("days_since_win"),
        F.month("created_at").alias("month"), F.quarter("created_at").alias("quarter"), (F.dayofweek("created_at") - 1).alias("weekday"),
    )


@register("q48_versions", sql("SELECT client_id, run_id, version, version = max(version) OVER (PARTITION BY client_id) AS is_current, coalesce(n, 0) AS n_items FROM (SELECT client_id, run_id, row_number() OVER (PARTITION BY client_id ORDER BY created_at, run_id) AS version FROM runs) LEFT JOIN (SELECT run_id, count(*) AS n FROM items GROUP BY run_id) USING (run_id)"))
def q48(spark, d):
    """Runs of a client as numbered versions; the last is current."""
    w = Window.partitionBy("client_id")
    v = domain.runs(spark, d).select("client_id", "run_id", F.row_number().over(w.orderBy("created_at", "run_id")).cast("long").alias("version"))
    n = domain.items(spark, d).groupBy("run_id").agg(n_rows().alias("n"))
    return v.withColumn("is_current", F.col("version") == F.max("version").over(w)).join(n, "run_id", "left").select("client_id", "run_id", "version", "is_current", F.coalesce("n", F.lit(0)).alias("n_items"))


@register("q49_preflight", sql("SELECT run_id, sum(CASE WHEN quantity > 45 THEN 1 ELSE 0 END)::BIGINT AS needs_review, sum(CASE WHEN supplier_id IS NULL THEN 1 ELSE 0 END)::BIGINT AS no_supplier FROM items GROUP BY run_id"))
def q49(spark, d):
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return domain.items(spark, d).groupBy("run_id").agg(one(F.col("quantity") > 45).alias("needs_review"), one(F.col("supplier_id").isNull()).alias("no_supplier"))


@register("q50_backfill_audit", sql("SELECT count(*) AS n, count(outcome) AS filled, count(*) - count(outcome) AS missing FROM runs"))
def q50(spark, d):
    return domain.runs(spark, d).agg(n_rows().alias("n"), F.count("outcome").alias("filled"), (n_rows() - F.count("outcome")).alias("missing"))


@register("q52_margin_spread", sql("SELECT run_id, round(stddev_pop(margin * 100), 6) AS spread FROM quoted GROUP BY run_id", quoted=QUOTED))
def q52(spark, d):
    """The population's deviation, as the risk score takes it."""
    return quoted(spark, d).groupBy("run_id").agg(F.round(F.stddev_pop(F.col("margin") * 100), 6).alias("spread"))


@register("w05_current_run", sql("SELECT client_id, run_id FROM runs QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY created_at DESC, run_id DESC) = 1"))
def w05(spark, d):
    return joins.latest(domain.runs(spark, d), ["client_id"], [F.desc("created_at"), F.desc("run_id")]).select("client_id", "run_id")


@register("j17_latest_with_ties", sql("SELECT material_id, run_id, round(unit_price, 6) AS unit_price FROM items QUALIFY rank() OVER (PARTITION BY material_id ORDER BY effective_at DESC) = 1"))
def j17(spark, d):
    return joins.latest(domain.items(spark, d), ["material_id"], [F.desc("effective_at")], ties=True).select("material_id", "run_id", F.round("unit_price", 6).alias("unit_price"))


@register("w11_page", sql("SELECT run_id FROM runs ORDER BY created_at, run_id LIMIT 100 OFFSET 200"))
def w11(spark, d):
    return domain.runs(spark, d).orderBy("created_at", "run_id").offset(200).limit(100).select("run_id")


@register("j07_semi", sql("SELECT material_id, name FROM materials WHERE material_id IN (SELECT material_id FROM items WHERE flag = 'R')"))
def j07(spark, d):
    return domain.materials(spark, d).join(domain.items(spark, d).filter("flag = 'R'"), "material_id", "left_semi").select("material_id", "name")
