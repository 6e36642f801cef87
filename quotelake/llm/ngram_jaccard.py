"""Operator 3: exact Jaccard join over sets of word shingles, with set-relation skipping.

Documents with one set are one class, so copies cost one set. Each class puts the shingles of its prefix
(size - ceil(threshold * size) + 1 of them, common ones last) into an inverted index of (shingle, class,
size, position). Two relations between sets save work:

* Index lists fall into blocks of equal size and position. Sets share nothing before their first common
  shingle, so at positions i and j of it they share min(size - i, other size - j) at most. Blocks that this
  bound rules out are skipped whole, before any member of them is paired; so a passage that many texts
  share, which stands behind each text's own shingles, costs nothing where it can't link them. Where a pair's first
  common shingles end bounds its overlap once more, and only then are sets compared.
* In each range of sizes of a list the most central set leads. Members are compared with their leader first, and those
  that are linked to it take over its answers: pairs inside a component need no comparison, and lists that
  hold one component only are skipped. A member x of leader p and a set y that was compared with p give
  |x & y| <= |p & y| + |x - p|, from which the answer for (x, y) is derived where that is too small. Of what is
  left, bitmaps of the sets (a 32nd to an 8th of their size) rule out most pairs before whole sets meet; the others are compared, exactly.

Long lists are split. Lists of a shingle that alone would fill a partition (the sketch of frequencies tells which) are dealt over
all partitions by class; blocks meet in a square of cells whose side grows with the list, so no task gets a whole long list.

The result has no pairs: each document gets the component of its class, so that no group of copies is
expanded. Shingles and sets are told apart by 64-bit hashes (n sets meet by chance with probability
n^2 / 2^65). The order of shingles only decides how much work there is: every order is exact.

Null and empty texts, and texts without words, have the empty set: n_shingles 0, linked with nothing, in
a component of their own. Rows that repeat an id and text get equal results. A null id is passed over
where the smallest id is taken, and is null only for components without any id. Ties in size go by hash.
An empty table gives an empty one. Columns beyond the named ones play no part. Long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from quotelake.llm.common import bound_batches, discard, row_key, shared_table, slices, table, without
from quotelake.llm.hashing import HASHED_BYTES, MIX, Words, mixed, utf8

SIZE = 5
#: Linked: DEN * overlap >= NUM * (one size + other size), which is a Jaccard similarity of 0.75 or more.
NUM, DEN = 3, 7
#: Counters of a task's shingle sketch; the most counters that are broadcast.
SKETCH_BITS, HEAVY_KEPT = 20, 65_536
#: The most classes, or pairs of them, that are broadcast (under 100 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 500_000
#: Classes whose copies a task passes over; members of a block and entries of a list, about, that meet in one cell.
KEYS_SEEN, BLOCK, CELL = 200_000, 128, 8192


class Shingles(Words):
    """Sorted distinct shingle hashes of texts, computed for all texts of a slice at once: mixed sums of the words' hashes times odd numbers."""

    def __init__(self, size: int = SIZE):
        import xxhash

        super().__init__()
        self.size, self.digest = size, xxhash.xxh3_64_intdigest
        self.mix = mixed(np.arange(1, size + 1, dtype=np.uint64) * MIX[2]) | np.uint64(1)

    def of(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        w, ends = self.words(raw, offsets)
        k, n = self.size, len(w) - self.size + 1
        rolled = np.full(max(n, 0), k, np.uint64)
        for i in range(k if n > 0 else 0):
            rolled += w[i : i + n] * self.mix[i]
        rolled = mixed(rolled)
        out = []
        for a, b in pairwise(ends.tolist()):
            if b - a >= k:
                h = np.sort(rolled[a : b - k + 1])
                out.append(h[np.concatenate(([True], h[1:] != h[:-1]))])
            elif b > a:  # the whole sequence as one
                out.append(mixed((w[a:b] * self.mix[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
            else:
                out.append(w[:0])
        return out

    def key(self, shingles: np.ndarray) -> int:
        return self.digest(shingles.tobytes())


def signed(x) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def by_rows(rows: DataFrame, size: int, kernel, schema: str) -> DataFrame:
    """mapInArrow over (id, row, text): kernel() is made once in a task and gets batches, sets and keys of slices of bounded size; then, with None, its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, shingles = kernel(), Shingles(size)
        for batch in batches:
            for part in slices(batch, 2, HASHED_BYTES):
                sets = shingles.of(*utf8(part.column(2)))
                yield from work(part, sets, np.array([shingles.key(s) for s in sets], np.uint64))
        yield from work(None, [], None)

    return rows.select("id", "row", "text").mapInArrow(run, schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keys_and_counts(docs: DataFrame, size: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """A stored table id, row, key, n of all rows; the sketch counters that stand out, as hash buckets in order of frequency; and those among
    them that count more than a partition's even share of the index.

    A task reports those of its 2 ** SKETCH_BITS counters that chance alone would not fill so much.
    """
    id_type = docs.schema["id"].dataType
    arrow_id = to_arrow_type(id_type)

    def kernel():
        counts, names = np.zeros(1 << SKETCH_BITS, np.int64), ["id", "row", "key", "n", "bucket", "seen"]

        def work(part, sets, keys):
            if part is None:
                mean = counts.mean()
                at = np.flatnonzero(counts > 2 * mean + 8 * np.sqrt(mean) + 4)
                none = pa.nulls(len(at), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.nulls(len(at), arrow_id), none, none, none, pa.array(at, pa.int64()), pa.array(counts[at])], names=names)
                return
            np.add(counts, np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts)), out=counts)
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), signed(keys), pa.array([len(s) for s in sets], pa.int64()), none, none], names=names)

        return work

    out = shared_table(by_rows(docs, size, kernel, f"id {id_type.simpleString()}, row long, key long, n long, bucket long, seen long"))
    heavy = out.filter(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.sum("seen").alias("seen"))
    top = heavy.orderBy(F.desc("seen"), "bucket").limit(HEAVY_KEPT).toPandas()  # bounded by HEAVY_KEPT
    rows = out.filter(F.col("bucket").isNull()).select("id", "row", "key", "n")
    share = (rows.agg(F.sum(prefix(F.col("n")))).first()[0] or 0) / partitions(docs.sparkSession)
    return rows, top["bucket"].to_numpy()[::-1].copy(), top["bucket"].to_numpy()[top["seen"].to_numpy() > share]


def in_order(shingles: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """By frequency as far as the sketch knows it, then by hash."""
    return shingles[np.argsort(rank[(shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")]


def postings(docs: DataFrame, heavy: np.ndarray, split: np.ndarray, size: int) -> DataFrame:
    """shingle, part, key, np (n << 32 | pos): the prefixes of all sets. A task passes over the copies of sets it has seen lately; others repeat.

    part is 0, or from 1 on a share of the classes where the list is split.
    """
    spark = docs.sparkSession
    shared, parts = spark.sparkContext.broadcast((heavy, split)), partitions(spark)

    def kernel():
        rank, dealt, seen = np.zeros(1 << SKETCH_BITS, np.int32), np.zeros(1 << SKETCH_BITS, bool), set()
        rank[shared.value[0]] = np.arange(1, len(shared.value[0]) + 1)
        dealt[shared.value[1]] = True

        def work(part, sets, keys):
            if len(seen) > KEYS_SEEN:
                seen.clear()
            fresh = []
            for i, k in enumerate(() if keys is None else keys.tolist()):
                if len(sets[i]) and k not in seen:
                    seen.add(k)
                    fresh.append(i)
            if not fresh:
                return
            sets, keys = [sets[i] for i in fresh], keys[fresh]
            n = np.array([len(s) for s in sets], np.int64)
            p = n - (NUM * n + (DEN - NUM) - 1) // (DEN - NUM) + 1
            firsts = np.concatenate([in_order(s, rank)[:k] for s, k in zip(sets, p.tolist())])
            keys = np.repeat(keys, p)
            own = np.where(dealt[(firsts >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], (keys % np.uint64(parts)).astype(np.int32) + 1, 0)
            pos = np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)
            yield pa.RecordBatch.from_arrays([signed(firsts), pa.array(own, pa.int32()), signed(keys), pa.array(np.repeat(n, p) << 32 | pos)], names=["shingle", "part", "key", "np"])

        return work

    return by_rows(docs, size, kernel, "shingle long, part int, key long, np long")


def index(docs: DataFrame, heavy: np.ndarray, split: np.ndarray, size: int) -> DataFrame:
    """A stored table shingle, part, key, n, pos, others: the lists with two classes or more, each class once, and how many share the list with it.

    One shuffle, by shingle and part; of split lists, others is an estimate.
    """
    own = Window.partitionBy("shingle", "part")
    parts = F.when(F.col("part") > 0, partitions(docs.sparkSession)).otherwise(1)
    lists = postings(docs, heavy, split, size).select(
        "*", F.min("key").over(own).alias("least"), F.max("key").over(own).alias("most"), F.lag("key").over(own.orderBy("np", "key")).alias("before")
    )
    kept = lists.filter(((F.col("part") > 0) | (F.col("least") < F.col("most"))) & ~F.col("before").eqNullSafe(F.col("key"))).withColumn("others", F.count(F.lit(1)).over(own) * parts - 1)
    return shared_table(kept.select("shingle", "part", "key", F.shiftright("np", 32).cast("int").alias("n"), F.col("np").bitwiseAND(0xFFFFFFFF).cast("int").alias("pos"), "others"))


def sent(df: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if it is small."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def long_ones(lists: DataFrame, entries: int, by: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates of the split lists that have an eighth of a partition's even share of all entries or more, so a bounded number: combined before the shuffle, broadcast after it."""
    share = entries / (8 * partitions(lists.sparkSession))
    counted = lists.filter("part > 0").groupBy(*by).agg(F.count(F.lit(1)).alias("_size"), *aggregates)
    return F.broadcast(counted.filter(F.col("_size") >= share).drop("_size"))


def leaders(lists: DataFrame) -> DataFrame:
    """A stored table key, n, lead_key, lead_n, shared: for each set the leaders of the lists' ranges of size that it may be linked with.

    Ranges have sizes within the threshold's ratio. The member leads that shares most with others over its whole
    prefix: in a group of near copies that is the one that the others were made from, if it is there.
    """
    central = shared_table(lists.groupBy("key", "n").agg((F.sum("others") / prefix(F.first("n"))).alias("weight")).select("key", "weight"))
    weighed = lists.join(sent(central), "key").withColumn("range", F.floor(F.log(F.col("n").cast("double")) / float(np.log((DEN - NUM) / NUM))))
    own = Window.partitionBy("shingle", "part", "range").orderBy(F.desc("weight"), "key")
    led = weighed.select("shingle", "range", "key", "n", F.first(F.struct("key", "n")).over(own).alias("lead"))
    over_all = long_ones(weighed, lists.count(), ["shingle", "range"], F.max(F.struct("weight", "key", "n")).alias("top"))
    led = led.join(over_all, ["shingle", "range"], "left")
    led = led.select("key", "n", F.coalesce("top.key", "lead.key").alias("lead_key"), F.coalesce("top.n", "lead.n").alias("lead_n"))
    pairs = led.filter(F.col("lead_key") != F.col("key")).groupBy("key", "n", "lead_key", "lead_n").agg(F.count(F.lit(1)).alias("shared"))
    a, b = F.col("n"), F.col("lead_n")
    out = shared_table(pairs.filter(enough(F.col("shared") + behind(a, b), a, b) & enough(F.least(a, b), a, b)))
    discard(central)
    return out


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """One bit for each shingle, at a place that its hash says, in 64 * 4**k bits: two to eight for a shingle."""
    n = 64
    while n < 2 * len(shingles):
        n *= 4
    held = np.zeros(n, bool)
    held[(shingles & np.uint64(n - 1)).astype(np.int64)] = True
    return np.packbits(held, bitorder="little").view(np.int64)


def sets_of(docs: DataFrame, rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """A stored table key, shingles, bits (see bitmap) of the wanted keys (a stored table), read again from one document of each class."""
    one = shared_table(rows.join(sent(wanted), "key", "left_semi").groupBy("key").agg(F.min(F.struct("id", "row")).alias("o")).select(F.col("o.id").alias("_id"), F.col("o.row").alias("_row")))
    some = docs.join(sent(one), F.col("id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left_semi")

    def kernel():
        def work(part, sets, keys):
            some = [(k, s) for k, s in zip(keys.tolist(), sets) if len(s)] if part is not None else []
            if some:
                ends = np.cumsum([0, *(len(s) for _, s in some)])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), signed(np.concatenate([s for _, s in some])))
                maps = [bitmap(s) for _, s in some]
                marks = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, maps)]).astype(np.int32)), pa.array(np.concatenate(maps)))
                yield pa.RecordBatch.from_arrays([signed([k for k, _ in some]), lists, marks], names=["key", "shingles", "bits"])

        return work

    out = shared_table(by_rows(some, size, kernel, "key long, shingles array<long>, bits array<long>"))
    twice = out.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")  # rows that repeat an id and text
    return out if twice.isEmpty() else shared_table(out.dropDuplicates(["key"]))


def enough(overlap: Column, n: Column, m: Column) -> Column:
    return DEN * overlap >= NUM * (n + m)


def possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """A stored table of the `pairs` (a, b, n_a, n_b), a stored table, that their bitmaps allow to be linked: a bit that only one set has is a shingle that the other lacks.

    Sets whose bitmaps differ in length aren't judged.
    """
    of = lambda x: sets.select(F.col("key").alias(x), F.col("bits").alias(f"bits_{x}"))
    both = sent(pairs).join(of("b"), "b").join(of("a"), "a")
    alone = lambda x, y: F.aggregate(F.zip_with(f"bits_{x}", f"bits_{y}", lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda n, k: n + k)
    most = F.least(F.col("n_a") - alone("a", "b"), F.col("n_b") - alone("b", "a"))
    alike = F.size("bits_a") == F.size("bits_b")
    return shared_table(both.filter(F.when(alike, enough(most, F.col("n_a"), F.col("n_b"))).otherwise(True)).select("a", "b", "n_a", "n_b"))


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """A stored table of `pairs` (a, b, n_a, n_b), a stored table, with their overlap. A bounded number of pairs is sent to the sets of b; then the sets meet by a."""
    leading = shared_table(pairs.select(F.col("a").alias("key")).distinct())
    left = sent(pairs).join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("s_b")), "b")
    both = left.join(sets.join(sent(leading), "key", "left_semi").select(F.col("key").alias("a"), F.col("shingles").alias("s_a")), "a")
    return shared_table(both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("s_a", "s_b")).alias("overlap")))


def components(links: DataFrame) -> DataFrame:
    """A stored table key, label of all ends of `links` (a, b): the smallest key that is reachable.

    Each round takes the least label of the neighbours and then the label of the label.
    """
    edges = shared_table(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = shared_table(edges.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    small = labels.count() <= MOST_BROADCAST
    mark = F.broadcast if small else (lambda df: df)
    while True:
        near = edges.join(mark(labels.withColumnRenamed("key", "b")), "b").groupBy(F.col("a").alias("key")).agg(F.min("label").alias("near"))
        step = near.join(mark(labels), "key").select("key", "label", F.least("label", "near").alias("new"))
        up = step.select(F.col("key").alias("new"), F.col("new").alias("top"))
        after = shared_table(step.join(mark(up), "new").select("key", "label", F.least("new", "top").alias("new")))
        labels = after.select("key", F.col("new").alias("label"))
        if after.filter(F.col("new") != F.col("label")).isEmpty():
            return labels


def open_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """A stored table shingle, part, key, n, pos, others, team (the component so far; 0: of its own): lists that hold two components or more; and leads, whether
    some set of the list can be the smaller one of a pair at its position."""
    own = Window.partitionBy("shingle", "part")
    out = lists.join(sent(labels), "key", "left").withColumn("team", F.coalesce("label", F.lit(0))).withColumn("label", F.coalesce("label", "key"))
    closed = long_ones(out, lists.count(), ["shingle"], F.min("label").alias("_a"), F.max("label").alias("_b")).filter("_a = _b").select("shingle")
    out = out.join(closed, "shingle", "left_anti")
    leads = enough(F.col("n") - F.col("pos"), F.col("n"), F.col("n"))
    out = out.select("*", F.min("label").over(own).alias("_least"), F.max("label").over(own).alias("_most"), F.max(leads).over(own).alias("_leads"))
    two = (F.col("part") > 0) | (F.col("_least") < F.col("_most"))
    return shared_table(out.filter(two).select("shingle", "part", "key", "n", "pos", "others", "team", ((F.col("part") > 0) | F.col("_leads")).alias("leads")))


def prefix(n: Column) -> Column:
    return n - F.ceil(NUM * n / (DEN - NUM)) + 1


def behind(a: Column, b: Column) -> Column:
    """The most that two sets can share outside the part of their prefixes that is compared in the lists."""
    return F.greatest(a - prefix(a), b - prefix(b))


def best_leaders(pairs: DataFrame) -> DataFrame:
    """A stored table a (leader), b, n_a, n_b: for each set the leader that it shares most lists with."""
    best = pairs.groupBy("key", "n").agg(F.max(F.struct("shared", "lead_key", "lead_n")).alias("best"))
    return shared_table(best.select(F.col("best.lead_key").alias("a"), F.col("key").alias("b"), F.col("best.lead_n").alias("n_a"), F.col("n").alias("n_b")))


def blocks(lists: DataFrame) -> DataFrame:
    """shingle, cells, n, pos, team, chunk, members array<struct<key, open>>: the lists cut by size, position and team, and in chunks where they are long."""
    count = shared_table(lists.groupBy("key").agg(F.count(F.lit(1)).alias("open")))  # a pair shares no more lists than either has
    parts, split, length = partitions(lists.sparkSession), F.col("part") > 0, F.col("others") + 1
    cells = F.when(split, int(np.ceil(np.sqrt(parts)))).otherwise(F.ceil(length / CELL)).cast("int")
    chunk = F.pmod("key", F.when(split, parts).otherwise(F.ceil(length / BLOCK)))
    cut = lists.filter("leads").join(sent(count), "key").select("shingle", cells.alias("cells"), "n", "pos", "team", chunk.alias("chunk"), F.struct("key", "open").alias("member"))
    return cut.groupBy("shingle", "cells", "n", "pos", "team", "chunk").agg(F.collect_list("member").alias("members"))


def left_over(lists: DataFrame) -> DataFrame:
    """a, b, n_a, n_b: the pairs of different components that their prefixes allow to be linked, the smaller set first."""
    cut = blocks(lists).withColumn("own", F.pmod(F.xxhash64("n", "pos", "team", "chunk"), "cells")).withColumn("all", F.sequence(F.lit(0).cast("long"), F.col("cells").cast("long") - 1))
    cols = ["n", "pos", "team", "chunk", "members"]
    a, b, i, j = F.col("n_a"), F.col("n_b"), F.col("pos_a"), F.col("pos_b")
    x = cut.filter(enough(F.col("n") - F.col("pos"), F.col("n"), F.col("n"))).select("shingle", F.col("own").alias("row"), F.explode("all").alias("column"), *[F.col(c).alias(f"{c}_a") for c in cols])
    y = cut.select("shingle", F.explode("all").alias("row"), F.col("own").alias("column"), *[F.col(c).alias(f"{c}_b") for c in cols])
    place = lambda s: F.struct(f"n_{s}", f"pos_{s}", f"team_{s}", f"chunk_{s}")
    apart = (F.col("team_a") != F.col("team_b")) | (F.col("team_a") == 0)
    met = x.join(y, ["shingle", "row", "column"]).filter((place("a") <= place("b")) & apart & enough(F.least(a - i, b - j), a, b))
    met = met.select("n_a", "n_b", "pos_a", "pos_b", (place("a") == place("b")).alias("same"), F.explode("members_a").alias("p"), "members_b").select("*", F.explode("members_b").alias("q"))
    met = met.filter((~F.col("same") | (F.col("p.key") < F.col("q.key"))) & enough(F.least("p.open", "q.open") + behind(a, b), a, b))
    turn = (a == b) & (F.col("p.key") > F.col("q.key"))  # of sets of one size the smaller key is first, in whatever blocks they stand
    pick = lambda x, y: F.when(turn, F.col(y)).otherwise(F.col(x))
    pairs = met.select("n_a", "n_b", pick("p.key", "q.key").alias("a"), pick("q.key", "p.key").alias("b"), pick("pos_a", "pos_b").alias("pos_a"), pick("pos_b", "pos_a").alias("pos_b"))
    each = pairs.groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("shared"), F.max("pos_a").alias("end_a"), F.max("pos_b").alias("end_b"))
    # behind the last common shingle that was met, and at positions where a first one would not do
    rest = F.least(a - 1 - F.col("end_a"), b - 1 - F.col("end_b"), F.ceil(NUM * (a + b) / DEN) - 1)
    return each.filter(enough(F.col("shared") + rest, a, b)).select("a", "b", "n_a", "n_b")


def underived(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    """`pairs` without those whose answer follows from what both were found to share with one leader."""
    seen = tried.select(F.col("a").alias("p"), F.col("b").alias("x"), "overlap")
    at_a = seen.select("p", F.col("x").alias("a"), F.col("overlap").alias("o_a"))
    at_b = seen.select("p", F.col("x").alias("b"), F.col("overlap").alias("o_b"))
    bound = F.least(F.col("o_b") + F.col("n_a") - F.col("o_a"), F.col("o_a") + F.col("n_b") - F.col("o_b"))
    no = pairs.join(at_a, "a").join(at_b, ["b", "p"]).filter(~enough(bound, F.col("n_a"), F.col("n_b"))).select("a", "b").distinct()
    return pairs.join(no, ["a", "b"], "left_anti")


def spread(rows: DataFrame, by_key: DataFrame, key: str) -> DataFrame:
    """`rows` with the columns of `by_key`, both stored, whose `many` says how many rows a key has. The keys that have more than a partition's even share,
    no more than there are partitions, are broadcast; the others are shuffled."""
    share = rows.count() / partitions(rows.sparkSession)
    large = F.broadcast(by_key.filter(F.col("many") > share))
    some = rows.join(large, key).select(*rows.columns, *[c for c in by_key.columns if c != key])
    return some.unionByName(rows.join(large.select(key), key, "left_anti").join(by_key.filter(F.col("many") <= share), key).select(*some.columns))


def grouped(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """`docs` (id, row, text) as id, row, n, least (struct<id, row>): the first row by id of each row's component; null where none has an id."""
    rows, heavy, split = keys_and_counts(docs, size)
    lists = index(docs, heavy, split, size)
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    linked = enough(F.col("overlap"), F.col("n_a"), F.col("n_b"))
    led = leaders(lists)
    first = best_leaders(led)
    sets = sets_of(docs, rows, shared_table(ends(first)), size)
    tried = compared(first, sets)
    links = tried.filter(linked)
    opened = open_lists(lists, components(links))
    discard(led, lists)
    left = shared_table(left_over(opened))
    rest = shared_table(underived(left, tried))
    discard(opened, left)
    more = sets_of(docs, rows, shared_table(ends(rest).join(sets, "key", "left_anti")), size)
    known = sets.unionByName(more)
    found = compared(possible(rest, known), known)
    discard(sets, more, rest)
    labels = components(links.unionByName(found.filter(linked)))
    own = F.when(F.col("id").isNotNull(), F.struct("id", "row"))
    full = rows.filter(F.col("n") > 0).drop("n")
    classes = shared_table(rows.filter(F.col("n") > 0).groupBy("key").agg(F.first("n").alias("n"), F.min(own).alias("least"), F.count(F.lit(1)).alias("many")))
    members = shared_table(classes.withColumnRenamed("least", "own").join(sent(labels), "key"))
    by_label = shared_table(members.groupBy("label").agg(F.min("own").alias("least"), F.count(F.lit(1)).alias("many")))
    together = spread(members.select("key", "n", "label", F.col("many").alias("copies")), by_label, "label").select("key", "n", "least", F.col("copies").alias("many"))
    by_key = shared_table(together.unionByName(classes.join(sent(labels), "key", "left_anti")))
    return spread(full, by_key, "key").select("id", "row", "n", "least").unionByName(rows.filter(F.col("n") == 0).select("id", "row", "n", own.alias("least")))


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), row_key(F.col(text_col)).alias("row"), F.col(text_col).alias("text"))


def joined(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of `docs`: the id, n_shingles and component_id (the smallest id that is reachable by links)."""
    out = grouped(rows_of(docs, id_col, text_col), size)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("least.id").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with its columns, of each component one row, with the smallest id (of different texts under it the one of least hash, of repeated
    rows any); rows without words stay unless they repeat an id and text, and rows without an id stay."""
    out = shared_table(grouped(rows_of(docs, id_col, text_col), size).filter(F.col("id").isNotNull()))
    first = (F.col("id") == F.col("least.id")) & (F.col("row") == F.col("least.row"))
    twice = out.filter(first).groupBy("id", "row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", "row")
    return without(docs, out.filter(~first).select("id", "row").distinct(), id_col, text_col, twice)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return joined(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, w[i:i + {SIZE - 1}] AS shingle FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {SIZE - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
o AS (SELECT x.r AS a, y.r AS b, count(*) AS overlap FROM s AS x JOIN s AS y USING (shingle) WHERE x.r < y.r GROUP BY x.r, y.r),
l AS (SELECT a, b FROM o JOIN n AS x ON x.r = a JOIN n AS y ON y.r = b WHERE 100 * overlap >= 75 * (x.n + y.n - overlap)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT r AS a, r AS b FROM d UNION SELECT c.a, e.b FROM c JOIN e ON e.a = c.b),
m AS (SELECT c.a AS r, min(d.doc_id) AS component_id FROM c JOIN d ON d.r = c.b GROUP BY c.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""
