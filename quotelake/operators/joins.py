"""Joins beyond equality: as-of, interval, cascade, several keys, latest, point-in-time history, full difference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(left: DataFrame, series: DataFrame, key: str, at: str, since: str, value: str, out: str, strict: bool = True, every: str | None = None) -> DataFrame:
    """`left` with the `value` that stood in `series` before (or at, if not strict) its time.

    Both are put in one sequence for each key and the last value is carried forward: one shuffle and one sort,
    no pairs. Of several values at one time the largest counts. Columns of `left` are kept. With `every` ('month', 'quarter', ...) a key's sequence is cut there and
    its pieces are sorted apart, so that no task gets all of a frequent key; the value that a piece begins with comes from one row for each piece before it.
    """
    points = series.groupBy(key, since).agg(F.max(value).alias("_v"))
    piece = lambda t: F.date_trunc(every, F.col(t)) if every else F.lit(0)
    kind = 0 if strict else 2  # at the same time queries come before the value, or after it
    no_value, bare = F.lit(None).cast(series.schema[value].dataType), F.struct(*left.columns)
    q = left.select(F.col(key).alias("_key"), piece(at).alias("_p"), F.col(at).alias("_t"), F.lit(kind).alias("_o"), no_value.alias("_v"), bare.alias("_row"))
    empty = F.lit(None).cast(q.schema["_row"].dataType).alias("_row")
    p = points.select(F.col(key).alias("_key"), piece(since).alias("_p"), F.col(since).alias("_t"), F.lit(1).alias("_o"), "_v", empty)
    rows = q.unionByName(p)
    if every:
        last = p.filter("_v IS NOT NULL").groupBy("_key", "_p").agg(F.max_by("_v", "_t").alias("_v")).unionByName(q.select("_key", "_p", no_value.alias("_v")).distinct())
        pieces = last.groupBy("_key", "_p").agg(F.max("_v").alias("_v"))  # one row has a value at most
        before = F.last("_v", ignorenulls=True).over(Window.partitionBy("_key").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
        carried = pieces.select("_key", "_p", before.alias("_v")).filter("_v IS NOT NULL")
        rows = rows.unionByName(carried.select("_key", "_p", F.lit(None).cast(q.schema["_t"].dataType).alias("_t"), F.lit(-1).alias("_o"), "_v", empty))
    carry = F.last("_v", ignorenulls=True).over(Window.partitionBy("_key", "_p").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0))  # nulls first
    return rows.withColumn(out, carry).filter(F.col("_o") == kind).select("_row.*", out)


def interval(left: DataFrame, tiers: DataFrame, on: list[str], value: str, start: str, end: str, closed: bool = False) -> DataFrame:
    """start <= value < end (closed: <= end; open end: null), the first tier by start; rows without a tier stay.

    Overlaps are cut out of the tiers, so that a row meets one tier at most and the rows themselves need no shuffle
    where the optimiser broadcasts the tiers. `start` of the result is the tier's start after cutting.
    """
    before = F.max(F.coalesce(F.col(end), F.lit(float("inf")))).over(Window.partitionBy(*on).orderBy(start, F.asc_nulls_last(end)).rowsBetween(Window.unboundedPreceding, -1))
    t = tiers.withColumn("_t_before", before).filter(F.col("_t_before").isNull() | (F.col("_t_before") < float("inf")))
    t = t.filter(F.col(end).isNull() | F.col("_t_before").isNull() | (F.col("_t_before") < F.col(end)))
    t = t.select("_t_before", *[F.col(c).alias(f"_t_{c}") if c in on else F.greatest(start, "_t_before").alias(c) if c == start else F.col(c) for c in tiers.columns])
    v, cut = F.col(value), F.col("_t_before")
    if closed:
        cond = (v >= F.col(start)) & (cut.isNull() | (v > cut) | (F.col(start) > cut)) & (F.col(end).isNull() | (v <= F.col(end)))
    else:
        cond = (v >= F.col(start)) & (F.col(end).isNull() | ((v < F.col(end)) & (F.col(start) < F.col(end))))
    for c in on:
        cond = cond & (F.col(c) == F.col(f"_t_{c}"))
    return left.join(t, cond, "left").drop("_t_before", *[f"_t_{c}" for c in on])


def cascade(items: DataFrame, levels: list[tuple[DataFrame, list[str]]], key: list[str], outer: bool = False) -> DataFrame:
    """Rows of the first level that has any for an item: levels are (conditions, columns they share with the items), with equal other columns.

    The conditions of a level are gathered by their key and looked up by an equality join, which is a broadcast where they are small; an item takes
    the first that is there, and is then multiplied once. Items are neither united nor ranked; those without any condition stay where `outer` is set.
    """
    values = [c for c in levels[0][0].columns if c not in levels[0][1]]
    out, found = items, []
    for n, (conditions, on) in enumerate(levels, 1):
        gathered = conditions.groupBy(*on).agg(F.collect_list(F.struct(*values)).alias(f"_level{n}"))
        out = out.join(gathered, on, "left")
        found.append(F.when(F.col(f"_level{n}").isNotNull(), F.struct(F.lit(n).alias("level"), F.col(f"_level{n}").alias("rows"))))
    first = out.select(*items.columns, F.coalesce(*found).alias("_first"))
    explode = F.explode_outer if outer else F.explode
    return first.select(*items.columns, F.col("_first.level").alias("level"), explode("_first.rows").alias("_row")).select(*items.columns, "level", "_row.*")


def any_key(left: DataFrame, keys: list[Column], right: DataFrame, right_key: str, row: list[str]) -> DataFrame:
    """left outer join where any of several keys equals the right key: candidates are exploded, then joined by equality, once each."""
    cands = left.select(*row, F.explode(F.array_distinct(F.array_compact(F.array(*keys)))).alias("_k"))
    found = cands.join(right, F.col("_k") == F.col(right_key)).drop("_k").distinct()
    return left.join(found, row, "left")


def latest(df: DataFrame, key: list[str], order: list[Column], n: int = 1, ties: bool = False) -> DataFrame:
    """The first n rows of each key; with ties, all rows of equal rank."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.rank().over(w) if ties else F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def history(df: DataFrame, key: str, micros: Column, aggs: dict[str, Column]) -> DataFrame:
    """Aggregates over the rows of a key strictly before each row's time, without a self join."""
    w = Window.partitionBy(key).orderBy("_us").rangeBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_us", micros)
    return out.select(*df.columns, *[a.over(w).alias(n) for n, a in aggs.items()])


def difference(old: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Full outer by key: status added, removed, modified or unchanged, with old_ and new_ values."""
    a = old.select(*key, *[F.col(v).alias(f"old_{v}") for v in values], F.lit(True).alias("_old"))
    b = new.select(*key, *[F.col(v).alias(f"new_{v}") for v in values], F.lit(True).alias("_new"))
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"old_{v}").eqNullSafe(F.col(f"new_{v}"))
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(same, "unchanged").otherwise("modified")
    return a.join(b, key, "full").withColumn("status", status).drop("_old", "_new")


def in_total_order(df: DataFrame, order: list[Column], number: str, path: str, files: int | None = None) -> DataFrame:
    """`df` with the `number` of each row in a total order, from 1, stored at `path` in files that follow each other in this order.

    Rows are dealt by ranges of the order and sorted in each; a row's number is its place in its range and the rows of the ranges before, which
    are one count each. No task sees more than a range.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()).write.parquet(f"{path}/ranges")
    stored = spark.read.parquet(f"{path}/ranges")
    counts = stored.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_offset"))  # as many rows as ranges
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return stored.join(F.broadcast(offsets), "_range").withColumn(number, F.col("_offset") + own).drop("_range", "_offset")
