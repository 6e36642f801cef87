"""Keyed state in event time: results are those of a plain loop, however many files and batches the events come in."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotelake.streaming import approvals, ordered

T0 = datetime(2024, 1, 1)


def events(n=300, keys=5, seed=1):
    rng = random.Random(seed)
    rows = [(rng.randrange(keys), T0 + timedelta(microseconds=rng.randrange(20 * 86_400_000_000)), rng.choice(["submit", "approve", "approve", "reject", "send"]), rng.choice(["admin", "sales_rep", None]), rng.random() < 0.5, rng.random() < 0.5) for _ in range(n)]
    return [*rows, *rows[:5], (None, T0, "submit", None, True, True), (1, None, "submit", None, True, True)]


SCHEMA = "k long, ts timestamp, event string, role string, procurement boolean, management boolean"
END = datetime(2030, 1, 1)


def in_order(rows):
    return sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[1], *((x is not None, x) for x in r[2:])))


@pytest.mark.parametrize("batches", [1, 7])
def test_approvals_equal_a_loop(spark, batches):
    rows = events()
    want, states = [], {}
    for k, ts, *e in in_order(rows):
        states[k], out = approvals.transition(states.get(k, approvals.START), (0, *e))
        want += [(k, ts, *o[1:]) for o in out]
    df = spark.createDataFrame(rows, SCHEMA)
    fold = ordered.ordered_fold(ordered.replay(df, "ts", batches, END), ["k"], "ts", ["event", "role", "procurement", "management"], approvals.transition, approvals.START, approvals.STATE, approvals.OUT, "6 hours", "2 hours")
    got = [(r.k, r.ts, *list(r)[2:7]) for r in ordered.finished(fold).withColumn("ts", F.timestamp_micros("us")).select("k", "ts", "event", "role", "status", "level", "accepted").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_levels_and_roles():
    def ends(*steps, path=(True, True)):
        s = approvals.START
        for kind, role in steps:
            s, out = approvals.transition(s, (0, kind, role, *path))
        return s[0], s[1], out[0][5]

    submit, approve = ("submit", None), ("approve", "sales_rep")
    assert ends(submit, approve) == ("pending", 2, True)
    assert ends(submit, approve, approve) == ("pending", 3, True)
    assert ends(submit, approve, approve, approve) == ("approved", 4, True)
    assert ends(submit, approve, path=(False, True)) == ("pending", 3, True)
    assert ends(submit, approve, path=(False, False)) == ("approved", 4, True)
    assert ends(submit, ("approve", "admin")) == ("approved", 4, True)
    assert ends(submit, approve, ("approve", "manager")) == ("pending", 3, True)  # past all levels from the first one only
    assert ends(submit, submit) == ("pending", 1, False)
    assert ends(submit, ("reject", None), submit) == ("pending", 1, True)
    assert ends(approve) == ("draft", 0, False)
    assert ends(submit, ("send", None)) == ("pending", 1, False)
    assert ends(submit, ("approve", "admin"), approve) == ("approved", 4, True)
    assert ends(submit, ("approve", "admin"), ("send", None), ("reject", None)) == ("sent", 4, False)


@pytest.mark.parametrize("batches", [1, 7])
def test_deadlines_equal_a_loop(spark, batches):
    rows = in_order(events(120, 6, 3))
    now = T0 + timedelta(days=21)
    floor = lambda t: t.replace(microsecond=t.microsecond // 1000 * 1000)
    want = []
    for k in {r[0] for r in rows}:
        own = sorted({r[1]: r for r in rows if r[0] == k}.values(), key=lambda r: r[1])
        for r, later in zip(own, [*own[1:], None]):
            for hours, action in ((20 + k, "expired"), (20 + k + 24, "backup")):
                due = floor(r[1]) + timedelta(hours=hours)
                if r[2] == "submit" and due < now and (later is None or floor(later[1]) >= due):
                    want.append((k, r[1], due, action))
    kinds = spark.createDataFrame([r[:3] for r in sorted({(r[0], r[1]): r for r in rows}.values())], "k long, ts timestamp, event string")
    stream = ordered.replay(kinds, "ts", batches, now + timedelta(hours=1))
    got = ordered.finished(ordered.deadlines(stream, ["k"], "ts", F.col("event") == "submit", 20 + F.col("k"), 40)).collect()
    assert sorted((r.k, r.submitted_at, r.due_at, r.action) for r in got) == sorted(want) and want


def test_late_events_within_the_watermark_are_put_in_order(spark, tmp_path):
    """Two files whose events overlap in time: the fold still sees them in order."""
    first = spark.createDataFrame([(1, T0 + timedelta(hours=h), float(h)) for h in (0, 2, 4, 6)], "k long, ts timestamp, price double")
    second = spark.createDataFrame([(1, T0 + timedelta(hours=h), float(h)) for h in (5, 3, 7)], first.schema)
    for part in (first, second, spark.createDataFrame([(None, END, None)], first.schema)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    fold = ordered.ordered_fold(stream, ["k"], "ts", ["price"], approvals.price_step, (None,), "price double", "us long, price double, previous double, pct double", "1 hour", "5 hours")
    assert [(r.price, r.previous) for r in ordered.finished(fold).orderBy("us").collect()] == [(0.0, None), (2.0, 0.0), (3.0, 2.0), (4.0, 3.0), (5.0, 4.0), (6.0, 5.0), (7.0, 6.0)]


def test_idle_keys_are_forgotten(spark):
    rows = [(1, T0, 1.0), (1, T0 + timedelta(days=1), 2.0), (1, T0 + timedelta(days=30), 3.0), (2, T0 + timedelta(days=15), 4.0)]
    stream = ordered.replay(spark.createDataFrame(rows, "k long, ts timestamp, price double"), "ts", 4, END)
    fold = ordered.ordered_fold(stream, ["k"], "ts", ["price"], approvals.price_step, (None,), "price double", "us long, price double, previous double, pct double", "1 hour", "1 hour", "5 days")
    assert sorted((r.k, r.price, r.previous) for r in ordered.finished(fold).collect() if r.k == 1)[:2] == [(1, 1.0, None), (1, 2.0, 1.0)]
    assert {r.price: r.previous for r in ordered.finished(fold).collect()}[3.0] is None


def test_replayed_batches_lie_in_many_files(spark):
    """A micro-batch is read by as many tasks as there are cores, not by one; batches follow each other in time."""
    df = spark.range(3000).select("id", F.timestamp_seconds(F.hash("id").cast("long")).alias("ts"))
    seen = []

    def put(batch, n):
        seen.append(batch.agg(F.count_distinct("file").alias("files"), F.count("id").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")).first())

    ordered.replay(df, "ts", 3).withColumn("file", F.input_file_name()).writeStream.foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    assert [b.files for b in seen] == [spark.sparkContext.defaultParallelism] * 3
    assert sum(b.n for b in seen) == 3000 and min(b.n for b in seen) > 500
    assert all(a.last <= b.first for a, b in zip(seen, seen[1:]))


@pytest.mark.parametrize("times", [0, 1, 2, 5])
def test_replay_of_few_times_is_whole(spark, times):
    """Ranges without rows have no file: the batches are fewer or larger, and the row with the end comes with them or after."""
    df = spark.range(40 if times else 0).select("id", F.timestamp_seconds(F.col("id") % max(times, 1)).alias("ts"))
    seen = []
    ordered.replay(df, "ts", 3, END).writeStream.foreachBatch(lambda b, n: seen.append([(r.id, r.ts) for r in b.collect()])).trigger(availableNow=True).start().awaitTermination()
    full = [b for b in seen if b]
    assert sorted(i for b in full for i, _ in b if i is not None) == list(range(40 if times else 0))
    assert [r for b in full for r in b if r[0] is None] == [(None, END)] and (None, END) in full[-1]
    assert all(max(t for _, t in a) <= min(t for _, t in b) for a, b in zip(full, full[1:]))


class Store:
    """State of one bucket that counts what is asked of it."""

    def __init__(self):
        self.calls, self.timers, self.values = 0, set(), {}

    def getMapState(self, name, *_):
        return self.of(name, {})

    getValueState = getMapState

    def of(self, name, kept):
        store = self

        class State:
            def __getattr__(_, call):
                store.calls += 1
                return {
                    "exists": lambda: "" in kept, "get": lambda: kept[""], "update": lambda v: kept.update({"": v}), "clear": kept.clear, "updateValue": kept.__setitem__, "getValue": kept.__getitem__,
                    "keys": lambda: iter(list(kept)), "removeKey": kept.pop,
                }[call]

        return State()

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class Now:
    def __init__(self, at, timer=None):
        self.getCurrentWatermarkInMs, self.getExpiryTimeInMs = lambda: at, lambda: timer


def test_state_is_asked_by_slice_not_by_key(spark):
    row = T._parse_datatype_string("k long, _us long, price double")
    fold = ordered.OrderedFold(row, 1, approvals.price_step, (None,), T._parse_datatype_string("price double"), ["k", "us", "price", "previous", "pct"], 3_600_000, None)
    store = Store()
    fold.init(store)
    made = Row("k", "_us", "price")
    rows = [made(k, us, float(k + us)) for us in (5, 1, 3) for k in range(500)]
    list(fold.handleInputRows((0,), iter(rows), Now(0)))
    out = [r for t in sorted(store.timers) for r in fold.handleExpiredTimer((0,), Now(10**9), Now(0, t))]
    assert sorted((r.k, r.us, r.previous) for r in out) == sorted((k, us, b) for k in range(500) for us, b in ((1, None), (3, k + 1.0), (5, k + 3.0)))
    assert store.calls < 30
