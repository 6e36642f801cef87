"""Streaming flows over the event table, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelake.registry import register
from quotelake.streaming import flows


@register("t01_event_log", "SELECT event_id, event_type, user_id FROM events")
def t01(spark, d):
    return flows.run(flows.append_log(flows.source(spark, d, "events"), "event_id", ["event_type", "user_id"], "ts"))


@register("t03_daily_cost", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS calls, round(sum(value), 4) AS cost FROM events GROUP BY ALL")
def t03(spark, d):
    out = flows.run(flows.windowed_cost(flows.source(spark, d, "events"), "ts", ["event_type"], "value"), "update", ["start", "event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "calls", F.round("cost", 4).alias("cost"))


@register("t04_rolling_cost", "SELECT date_trunc('day', ts) - INTERVAL 1 DAY * k AS start, count(*) AS calls, round(sum(value), 4) AS cost FROM events, (SELECT unnest(range(0, 7)) AS k) GROUP BY ALL")
def t04(spark, d):
    """Seven days, a new window each day."""
    out = flows.run(flows.windowed_cost(flows.source(spark, d, "events"), "ts", [], "value", "7 days", "1 day"), "update", ["start"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "calls", F.round("cost", 4).alias("cost"))


@register("t05_jobs_once", "SELECT DISTINCT event_id FROM events")
def t05(spark, d):
    """Every job delivered twice, done once."""
    events = flows.source(spark, d, "events")
    twice = events.withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2))))
    return flows.run(flows.jobs_once(twice, "event_id", "ts", "400 days")).select("event_id")


@register("t06_elapsed", "SELECT a.user_id, ((epoch_us(b.ts) - epoch_us(a.ts)) // 1000000)::BIGINT AS seconds FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def t06(spark, d):
    """From each click to the purchases of the same user within an hour."""
    of = lambda t: flows.source(spark, d, "events").filter(F.col("event_type") == t)
    return flows.run(flows.elapsed(of("click"), of("purchase"), "user_id", "ts")).select("user_id", "seconds")
