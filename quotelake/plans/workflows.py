"""Workflows over event streams with keyed state and timers: approvals, deadlines, price history; and tables in versions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from quotelake.operators import sinks
from quotelake.registry import register
from quotelake.sources import domain
from quotelake.sources.domain import USAGE_AS_OF, sql
from quotelake.sources.versions import Versions
from quotelake.streaming import approvals, ordered, views
from quotelake.streaming.flows import scratch

#: Micro-batches of a replayed table here; results do not depend on their number.
BATCHES = 3
EVENTS = {"signup": "submit", "click": "approve", "error": "reject", "purchase": "send"}
APPROVALS = f"""SELECT user_id, event_id, ts, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENTS.items())} END AS event,
  CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 10 = 0 THEN 'manager' ELSE 'sales_rep' END AS role, value >= 10 AS procurement, value >= 25 AS management FROM events WHERE event_type <> 'view'"""
#: The machine stated as one CASE over (status, level, path) and the next event, applied event by event.
MACHINE = f"""WITH RECURSIVE a AS ({APPROVALS}), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event, role, procurement, management) AS i FROM a),
r AS (
  SELECT user_id, 0::BIGINT AS i, NULL::TIMESTAMP AS ts, NULL::VARCHAR AS event, NULL::VARCHAR AS role, 'draft' AS status, 0 AS level, false AS p, false AS m, true AS accepted FROM (SELECT DISTINCT user_id FROM a)
  UNION ALL
  SELECT n.user_id, n.i, n.ts, n.event, n.role,
    CASE WHEN submits THEN 'pending' WHEN approves AND to_level = 4 THEN 'approved' WHEN rejects THEN 'rejected' WHEN sends THEN 'sent' ELSE status END,
    CASE WHEN submits THEN 1 WHEN approves THEN to_level ELSE level END, CASE WHEN submits THEN n.procurement ELSE p END, CASE WHEN submits THEN n.management ELSE m END,
    submits OR approves OR rejects OR sends OR (n.event = 'approve' AND status = 'approved')
  FROM (SELECT r.user_id AS u, r.i AS before, r.status, r.level, r.p, r.m, n.*, n.event = 'submit' AND r.status IN ('draft', 'rejected', 'sent') AS submits, n.event = 'approve' AND r.status = 'pending' AS approves,
          n.event = 'reject' AND r.status = 'pending' AS rejects, n.event = 'send' AND r.status = 'approved' AS sends,
          CASE WHEN r.level = 1 AND n.role = 'manager' THEN 4 WHEN r.level < 2 AND r.p THEN 2 WHEN r.level < 3 AND r.m THEN 3 ELSE 4 END AS to_level
        FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1) AS n)
"""


def approval_events(spark, d):
    """user_id (a user's events stand for those of one run), ts, event, role, procurement, management."""
    e = domain.read(spark, d, "events")
    kind = domain.mapped("event_type", EVENTS)
    role = F.when(F.get_json_object("props", "$.k").cast("long") % 10 == 0, "manager").otherwise("sales_rep")
    return e.select("user_id", "ts", kind.alias("event"), role.alias("role"), (F.col("value") >= 10).alias("procurement"), (F.col("value") >= 25).alias("management")).filter("event IS NOT NULL")


def transitions(spark, d, batches: int = BATCHES):
    stream = ordered.replay(approval_events(spark, d), "ts", batches, datetime(2030, 1, 1))
    fold = ordered.ordered_fold(stream, ["user_id"], "ts", ["event", "role", "procurement", "management"], approvals.transition, approvals.START, approvals.STATE, approvals.OUT, "1 day", "1 hour", "400 days")
    return ordered.finished(fold)


@register("p36_approval_transitions", MACHINE + "SELECT user_id, ts, event, role, status, level, accepted FROM r WHERE i > 0")
def p36(spark, d):
    """Every event of a run with what became of it: levels, roles, path, refusals."""
    out = transitions(spark, d)
    return out.select("user_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), "event", "role", "status", "level", "accepted")


@register("t08_approval_states", MACHINE + "SELECT user_id, arg_max(status, i) AS status, arg_max(level, i) AS level, count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted) AS refused FROM r WHERE i > 0 GROUP BY user_id")
def t08(spark, d):
    """The state of each run after all of its events."""
    order = F.struct("us", "event", "role")
    out = transitions(spark, d).groupBy("user_id")
    return out.agg(F.max_by("status", order).alias("status"), F.max_by("level", order).alias("level"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("refused"))


SWEPT = f"""WITH e AS (SELECT user_id, 't' || (user_id % 5) AS tenant, date_trunc('milliseconds', ts) AS ms, ts, event_type = 'signup' AS opens, lead(date_trunc('milliseconds', ts)) OVER (PARTITION BY user_id ORDER BY ts) AS later
  FROM events WHERE event_type IN ('signup', 'click', 'error')),
d AS (SELECT *, ms + INTERVAL 1 HOUR * (24 + user_id % 72) AS due FROM e WHERE opens)
SELECT tenant, user_id, ts AS submitted_at, due AS due_at, 'expired' AS action FROM d WHERE (later IS NULL OR later >= due) AND due < TIMESTAMP '{USAGE_AS_OF}'
UNION ALL SELECT tenant, user_id, ts, due + INTERVAL 24 HOUR, 'backup' FROM d WHERE (later IS NULL OR later >= due + INTERVAL 24 HOUR) AND due + INTERVAL 24 HOUR < TIMESTAMP '{USAGE_AS_OF}'"""


@register("t02_sla_sweep", SWEPT)
def t02(spark, d, batches: int = BATCHES):
    """Submissions of each tenant whose time ran out, and those that then lay idle for a day, at their deadlines, up to a point in time."""
    e = domain.read(spark, d, "events").filter("event_type IN ('signup', 'click', 'error')")
    e = e.select(F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string")).alias("tenant"), "user_id", "ts", (F.col("event_type") == "signup").alias("opens"))
    stream = ordered.replay(e, "ts", batches, datetime.fromisoformat(f"{USAGE_AS_OF} 01:00:00"))  # the watermark is an hour behind
    out = ordered.finished(ordered.deadlines(stream, ["tenant", "user_id"], "ts", F.col("opens"), 24 + F.col("user_id") % 72, 96))
    return out.select("tenant", "user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("submitted_at", "due_at")], "action")


PRICES = "SELECT material_id, effective_at, round(unit_price, 6) AS unit_price, round(previous, 6) AS previous, round(100 * (unit_price - previous) / nullif(previous, 0), 4) AS pct FROM (SELECT material_id, effective_at, unit_price, lag(unit_price) OVER (PARTITION BY material_id ORDER BY effective_at, unit_price) AS previous FROM items)"


@register("t09_price_history", sql(PRICES))
def t09(spark, d, batches: int = BATCHES):
    """Prices as they come in, each with the one before it of the same material."""
    items = domain.items(spark, d).select("material_id", "effective_at", "unit_price")
    stream = ordered.replay(items, "effective_at", batches, datetime(2030, 1, 1))
    out = ordered.finished(ordered.ordered_fold(stream, ["material_id"], "effective_at", ["unit_price"], approvals.price_step, (None,), "price double", "us long, price double, previous double, pct double", "400 days", "1 day"))
    return out.select("material_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("effective_at"), F.round("price", 6).alias("unit_price"), F.round("previous", 6).alias("previous"), F.round("pct", 4).alias("pct"))


#: A run is entered on its day; every thirteenth is withdrawn 400 days later.
CHANGES = "run_id long, day date, at timestamp, pending long, price decimal(18,2), sign int"
VIEW = "SELECT CAST(created_at AS DATE) AS day, count(*) AS n, sum(CAST(status = 'pending_approval' AS BIGINT))::BIGINT AS pending, sum(CAST(total_price AS DECIMAL(18,2)))::DOUBLE AS price, max(total_price) AS highest FROM runs WHERE run_id % 13 <> 0 GROUP BY ALL"


def changes(spark, d):
    r = domain.runs(spark, d)
    rows = r.select("run_id", F.to_date("created_at").alias("day"), F.col("created_at").cast("timestamp").alias("at"), (F.col("status") == "pending_approval").cast("long").alias("pending"), F.col("total_price").cast("decimal(18,2)").alias("price"), F.lit(1).alias("sign"))
    return rows.unionByName(rows.filter("run_id % 13 = 0").withColumns({"at": F.expr("at + INTERVAL 400 DAYS"), "sign": F.lit(-1)}))


@register("t07_margin_view", sql(VIEW))
def t07(spark, d, batches: int = BATCHES):
    """The daily view, kept by deltas over several batches of runs that come and go."""
    path = scratch(spark)
    # rows are sorted by the key: the run first, which tells them apart where a day has thousands
    base = Versions(spark, f"{path}/base", "day date, run_id long, pending long, price decimal(18,2)", ["run_id", "day"], ["day"], 16)
    table = Versions(spark, f"{path}/view", "day date, n long, pending long, price decimal(38,2), highest decimal(18,2)", ["day"], buckets=16)
    view = views.View(table, base, {"pending": "pending", "price": "price"}, {"highest": "price"}, "at")
    out = views.maintained(ordered.replay(changes(spark, d), "at", batches), view, f"{path}/checkpoint")
    return out.select("day", "n", "pending", F.col("price").cast("double").alias("price"), F.col("highest").cast("double").alias("highest"))


REPRICED, WITHDRAWN = "created_at >= TIMESTAMP '1998-01-01' AND created_at < TIMESTAMP '1998-02-01'", "created_at >= TIMESTAMP '1997-01-01' AND created_at < TIMESTAMP '1997-01-15' AND status = 'rejected'"


@register("p23_revision_diff", sql(f"""SELECT run_id, 'modified' AS status, round(total_price, 2) AS old_price, round(total_price + 1000, 2) AS new_price FROM runs WHERE {REPRICED}
  UNION ALL SELECT run_id, 'removed', round(total_price, 2), NULL FROM runs WHERE {WITHDRAWN}
  UNION ALL SELECT run_id + 1000000000, 'added', NULL, round(total_price, 2) FROM runs WHERE {WITHDRAWN}"""))
def p23_revision(spark, d):
    """A table of runs, copied as a new version, in which some are priced anew, some go and some come; and what differs between first and last version."""
    r = domain.runs(spark, d).select("run_id", F.to_date("created_at").alias("day"), "status", "created_at", F.round("total_price", 2).alias("price"))
    t = Versions(spark, scratch(spark), "run_id long, day date, price double", ["day", "run_id"], ["day"], 256)
    first = t.commit(r)
    t.copy(first, "revision")
    t.commit(r.filter(F.expr(REPRICED)).withColumn("price", F.round(F.col("price") + 1000, 2)), reason="new prices")
    gone = r.filter(F.expr(WITHDRAWN))
    last = t.commit(gone.withColumn("run_id", F.col("run_id") + 1_000_000_000), gone, "withdrawn and entered again")
    return t.diff(first, last, ["price"]).select("run_id", "status", "old_price", "new_price")


@register("io16_revisions", sql("""SELECT concat(run_id, '-r', v) AS run, run_id AS parent, v + 1 AS version, 'draft' AS status, n, total FROM runs
  JOIN (SELECT run_id, count(*) AS n, round(sum(item_price), 2) AS total FROM items GROUP BY run_id) USING (run_id), (SELECT unnest([1, 2]) AS v) WHERE status = 'rejected' AND (v = 1 OR run_id % 2 = 0)"""))
def io16(spark, d):
    """Rejected runs revised, and every second of them once more: a draft of the next version each, with copies of the items and their total."""
    r = domain.runs(spark, d).select(F.col("run_id").cast("string").alias("run"), F.lit(None).cast("string").alias("parent"), F.lit(1).alias("version"), "status")
    i = domain.items(spark, d).select(F.col("run_id").cast("string").alias("run"), "line_number", "item_price")
    first, copies = sinks.revised(r, i, r.filter("status = 'rejected'").select("run"), "run", "parent", "version", "status")
    second, more = sinks.revised(r.unionByName(first), i.unionByName(copies), first.filter(F.col("parent").cast("long") % 2 == 0).select("run"), "run", "parent", "version", "status")
    totals = copies.unionByName(more).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("item_price"), 2).alias("total"))
    out = first.unionByName(second).join(totals, "run")
    return out.select("run", F.col("parent").cast("long").alias("parent"), F.col("version").cast("int").alias("version"), "status", "n", "total")
