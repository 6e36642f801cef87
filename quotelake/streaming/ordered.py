"""Keyed state in order of event time: tables replayed as streams, folds over out-of-order events, deadlines by timers.

Events wait in slices of time until the watermark has passed a slice, and are then folded in order, so that results depend neither on the
files that events come in nor on their order within the watermark. State lives in RocksDB, by bucket of keys: a call to the store takes far longer than
an event, and a bucket's calls are a few for each batch and slice. A worker holds one slice of one bucket and the states of its keys; more buckets make that smaller.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quotelake.streaming.flows import run, scratch

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Events that are gathered before they are put into the state.
GATHERED = 10_000
BUCKETS = 1024


def replay(df: DataFrame, ts: str, batches: int = 1, until: datetime | None = None) -> DataFrame:
    """A table as a stream in order of time: `batches` micro-batches of about equal size, of as many files each as there are cores to read them; then one row with nothing but the time `until`.

    That last row moves the watermark, so that all that is due before it comes out. Files are ordered by the time of their change, which is
    set here: a store has to allow that.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.repartitionByRange(batches * spark.sparkContext.defaultParallelism, ts).sortWithinPartitions(ts).write.parquet(f"{path}/rows")
    if until:
        at = F.to_timestamp(F.lit(until.isoformat(" "))).cast(df.schema[ts].dataType)
        spark.range(1).select(*[at.alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]).write.parquet(f"{path}/rows-end")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows*/part-*"))
    files = sorted((x.getPath().getParent().getName(), x.getPath().getName(), x) for x in found)  # parts are numbered by range
    last = max((x.getModificationTime() for *_, x in files), default=0)
    for i, (*_, x) in enumerate(files, 1):
        fs.setTimes(x.getPath(), last - 1000 * (len(files) - i), -1)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
    own = sum(folder == "rows" for folder, *_ in files)  # ranges without rows have no file
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max(-(-own // batches), 1)).parquet(f"{path}/rows*")


def finished(stream: DataFrame, mode: str = "append", key: list[str] | None = None) -> DataFrame:
    """flows.run with state in RocksDB, which timers need."""
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKS)
    try:
        return run(stream, mode, key)
    finally:
        conf.unset(PROVIDER) if before is None else conf.set(PROVIDER, before)


def timed(stream: DataFrame, key: list[str], ts: str, late: str) -> DataFrame:
    """Rows with a key, behind a watermark that rows without one move too: the condition names the time, else the optimiser would take it before the watermark."""
    marked = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return marked.filter(F.when(F.col(ts).isNotNull(), F.col(key[0]).isNotNull()))


def ms_of(us: int) -> int:
    return us // 1000


def in_buckets(df: DataFrame, key: list[str], buckets: int) -> DataFrame:
    """`df` with _bucket: keys that share one share their state's reads and writes, a few for each batch however many keys there are."""
    return df.withColumn("_bucket", F.pmod(F.hash(*key), F.lit(buckets)))


def ordered(events: list[tuple], first: int) -> list[tuple]:
    """Events in order of their fields from `first` on, nulls first."""
    try:
        return sorted(events, key=lambda e: e[first:])
    except TypeError:  # a null met a value
        return sorted(events, key=lambda e: tuple((x is not None, x) for x in e[first:]))


class Bucket(StatefulProcessor):
    """Rows of a bucket's keys wait by slice of time, in parts that are written once; one timer, at the first time that something is due.

    `row`: a waiting row, the key's fields first. `keys`: how many those are. `state`: what a key holds. `out`: names of what is put out.
    """

    def __init__(self, row: T.StructType, keys: int, state: list[T.StructField], out: list[str]):
        self.row, self.keys, self.state, self.out = row, keys, state, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slice long, part long", T.StructType([T.StructField("rows", T.ArrayType(self.row))]))
        own = T.StructType([*self.row.fields[: self.keys], *self.state])
        self.held = handle.getValueState("held", T.StructType([T.StructField("keys", T.ArrayType(own))]))
        self.marks = handle.getValueState("marks", "parts long, timer long")

    def slice_of(self, row: tuple) -> int:
        raise NotImplementedError

    def due(self, row: tuple) -> int:
        """The time at which a waiting row asks for a timer."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        parts, timer = self.marks.get() if self.marks.exists() else (0, None)
        names, first = self.row.fieldNames(), timer
        gathered: dict[int, list[tuple]] = {}
        n = 0

        def put() -> None:
            nonlocal parts
            for at, some in gathered.items():
                self.waiting.updateValue((at, parts), (some,))
                parts += 1
            gathered.clear()

        of = None
        for r in rows:
            of = of or itemgetter(*map(r.__fields__.index, names))  # a name costs a search in each row
            e = of(r)
            gathered.setdefault(self.slice_of(e), []).append(e)
            at = self.due(e)
            first = at if first is None or at < first else first
            n += 1
            if n % GATHERED == 0:
                put()
        put()
        if first != timer:
            self.handle.registerTimer(first)
        self.marks.update((parts, first))
        return iter(())

    def holding(self) -> dict[tuple, tuple]:
        n = self.keys
        return {tuple(x[:n]): tuple(x[n:]) for x in self.held.get()[0]} if self.held.exists() else {}

    def hold(self, held: dict[tuple, tuple]) -> None:
        if held:
            self.held.update(([(*k, *v) for k, v in held.items()],))
        else:
            self.held.clear()

    def set_timer(self, at: int | None) -> None:
        parts = self.marks.get()[0]
        if at is not None:
            self.handle.registerTimer(at)
        self.marks.update((parts, at))

    def close(self) -> None:
        pass


class OrderedFold(Bucket):
    """step(state, event) -> (state, rows) over the events of each key in order: event and state are tuples, `start` the first state; see ordered_fold."""

    def __init__(self, row: T.StructType, keys: int, step: Callable, start: tuple, state: T.StructType, out: list[str], slice_ms: int, idle_ms: int | None):
        super().__init__(row, keys, [*state.fields, T.StructField("_until", T.LongType())], out)
        self.step, self.start, self.slice_ms, self.idle_ms = step, start, slice_ms, idle_ms

    def slice_of(self, row: tuple) -> int:
        return ms_of(row[self.keys]) // self.slice_ms

    def due(self, row: tuple) -> int:
        return (self.slice_of(row) + 1) * self.slice_ms

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.marks.exists() or self.marks.get()[1] != expiredTimerInfo.getExpiryTimeInMs():  # another took its place
            return
        now, n, made = timerValues.getCurrentWatermarkInMs(), self.keys, Row(*self.out)
        places: dict[int, list[tuple]] = {}
        for k in self.waiting.keys():
            places.setdefault(k[0], []).append(tuple(k))
        held = self.holding()
        for at in sorted(places):
            end = (at + 1) * self.slice_ms
            if end > now:
                break
            events = [tuple(e) for k in places[at] for e in self.waiting.getValue(k)[0]]
            for e in ordered(events, n):
                own = held.get(e[:n])
                state = self.start if own is None or (own[-1] is not None and own[-1] < end) else own[:-1]
                state, rows = self.step(state, e[n:])
                for r in rows:
                    yield made(*e[:n], *r)
                until = None if self.idle_ms is None else -(-(ms_of(e[n]) + self.idle_ms) // self.slice_ms) * self.slice_ms + 1  # off the ends of slices
                held[e[:n]] = (*state, until)
            for k in places.pop(at):
                self.waiting.removeKey(k)
        held = {k: v for k, v in held.items() if v[-1] is None or v[-1] >= now}
        self.hold(held)
        left = [(at + 1) * self.slice_ms for at in places]
        idle = [v[-1] for v in held.values() if v[-1] is not None]
        # the last one to be forgotten: those before it go with slices that are folded until then
        self.set_timer(min(left) if left else max(idle) if idle else None)


def ordered_fold(
    stream: DataFrame, key: list[str], ts: str, fields: list[str], step: Callable, start: tuple, state: str, out: str, slice_: str = "1 hour", late: str = "1 hour", idle: str | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """The rows that `step` puts out: the key and `out`.

    step((state), (us, *fields)) -> (state, list of rows) sees a key's events in order of time (microseconds), then of the other fields, nulls first.
    Events later than `late` are left out. A key's state is dropped when it had no event for `idle` (None: it is kept). Rows without a key are left out.
    """
    spark = stream.sparkSession
    read = in_buckets(timed(stream, key, ts, late), key, buckets).select("_bucket", ts, *key, F.unix_micros(ts).alias("_us"), *fields)
    row = T.StructType([T.StructField(f.name, f.dataType) for f in read.select(*key, "_us", *fields).schema.fields])
    schema = T._parse_datatype_string(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in row.fields[: len(key)])}, {out}")
    made = OrderedFold(row, len(key), step, start, T._parse_datatype_string(state), schema.fieldNames(), millis(spark, slice_), None if idle is None else millis(spark, idle))
    return read.groupBy("_bucket").transformWithState(made, schema, "Append", "EventTime")


def millis(spark: SparkSession, length: str) -> int:
    """Milliseconds of an interval of days, hours, minutes or seconds."""
    n, unit = length.split()
    return int(n) * {"second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]


class Deadlines(Bucket):
    """Submissions of a bucket's keys wait for their deadline, and for that of their deputy; see deadlines."""

    def __init__(self, row: T.StructType, keys: int, out: list[str], idle_ms: int, longest_ms: int):
        super().__init__(row, keys, [T.StructField(f, T.LongType()) for f in ("_at", "_due", "_told")], out)
        self.idle_ms, self.longest_ms = idle_ms, longest_ms

    def slice_of(self, row: tuple) -> int:
        return 0

    def due(self, row: tuple) -> int:
        us, opens, wait = row[self.keys :]
        return ms_of(us) + (wait if opens else self.longest_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.marks.exists() or self.marks.get()[1] != expiredTimerInfo.getExpiryTimeInMs():  # another took its place
            return
        now, n, made = timerValues.getCurrentWatermarkInMs(), self.keys, Row(*self.out)
        places = [tuple(k) for k in self.waiting.keys()]
        known = [tuple(e) for k in places for e in self.waiting.getValue(k)[0]]
        held, left = self.holding(), []

        def tell(k: tuple, own: tuple, until: int, closed: bool) -> Iterator[tuple]:
            """What is due of an open submission up to `until`, or before it where the key may still answer."""
            us, due, told = own
            for i, at in enumerate((due, due + self.idle_ms)):
                if i >= told and (at <= until if closed else at < until):
                    told = i + 1
                    yield made(*k, us, at, ("expired", "backup")[i])
            held[k] = (us, due, told)

        for e in sorted(known, key=lambda e: e[n : n + 2]):
            k, (us, opens, wait) = e[:n], e[n:]
            if ms_of(us) >= now:
                left.append(e)
                continue
            if k in held:
                yield from tell(k, held.pop(k), ms_of(us), True)
                del held[k]
            if opens:
                held[k] = (us, ms_of(us) + wait, 0)
        for k, own in list(held.items()):
            yield from tell(k, own, now, False)
        held = {k: v for k, v in held.items() if v[2] < 2}
        for k in places:
            self.waiting.removeKey(k)
        for i in range(0, len(left), GATHERED):
            self.waiting.updateValue((0, i), (left[i : i + GATHERED],))
        self.marks.update((len(left), None))
        self.hold(held)
        times = [due + (self.idle_ms if told else 0) for _, due, told in held.values()] + [self.due(e) for e in left]
        self.set_timer(min(times) if times else None)


def deadlines(stream: DataFrame, key: list[str], ts: str, opens: Column, wait_hours: Column, longest_hours: int, idle: str = "24 hours", late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """key, submitted_at, due_at, action: 'expired' when a submission's time is up and no later event of the key has come, 'backup' when `idle` more has passed.

    Every row of `stream` is an event of its key (one for each microsecond); those that are `opens` begin to wait for `wait_hours` (at most `longest_hours`), and the next event, a new
    submission too, ends it. Timers fire when the watermark has passed them, so that the order in which events come in plays no part. Of the events
    that the watermark has passed, a key holds its last submission, until both of its deadlines are over or another event has come.
    """
    spark = stream.sparkSession
    wait = F.least(wait_hours, F.lit(longest_hours)).cast("long") * 3_600_000
    read = in_buckets(timed(stream, key, ts, late), key, buckets).select("_bucket", ts, *key, F.unix_micros(ts).alias("_us"), F.coalesce(opens, F.lit(False)).alias("_opens"), wait.alias("_wait"))
    row = T.StructType([T.StructField(f.name, f.dataType) for f in read.select(*key, "_us", "_opens", "_wait").schema.fields])
    schema = T._parse_datatype_string(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in row.fields[: len(key)])}, us long, due long, action string")
    out = read.groupBy("_bucket").transformWithState(Deadlines(row, len(key), schema.fieldNames(), millis(spark, idle), longest_hours * 3_600_000), schema, "Append", "EventTime")
    return out.select(*key, F.timestamp_micros("us").alias("submitted_at"), F.timestamp_millis("due").alias("due_at"), "action")
