"""Operator 7: stupid-backoff scores, computed relationally.

Words are numbered by frequency. The model knows the `vocabulary` most frequent words (a parameter of the
model, like its order); all others are one unknown word. An n-gram is the number that its words' numbers
make side by side, so that keys are exact and parts of an n-gram are parts of its key.

A word after its context scores log10(c(context word) / c(context)) where the n-gram was counted at least
`least` times in the corpus, else log10(alpha) plus its score after the context less its first word; alone
it scores log10(c(word) / all words). With c of order 0 as the number of all words, an n-gram that counts
changes the score of its last word by

    gain = log10 c(all of it) - log10 c(all but the last) - log10 alpha - log10 c(all but the first) + log10 c(the middle)

against the next shorter one, whatever document it stands in. So a document's sum is that of its words alone,
plus the gains of its n-grams: a join of exploded n-grams with a table of gains, summed per document. The
count tables are aggregated and joined by hash of the key. The HOT_KEPT most frequent n-grams would skew the
join: their gains are broadcast and added while n-grams are exploded; the others are shuffled.

That is `score`, for another corpus or a chosen vocabulary. The query is `score_whole`: by the documents' own counts
of all words and n-grams of order 3, under 64-bit hashes, with no limit on their number. There every n-gram of a document
was counted, so none backs off, and exploded n-grams are shuffled once, by hash: the count table comes about
in the partitions where they lie, and each meets its count there. N-grams are dealt over PASSES jobs by hash, so that a share of
them only is on disk at a time. Of the n-grams that could skew a shuffle, HOT_KEPT at most,
tasks send counts only, and add their logarithms when the counts are known.

Null and empty texts have n_words 0, total 0 and a null score. Rows that repeat an id and text get equal
results, and each counts in the corpus. Ties in frequency go by word. An empty table gives an empty one.
Columns beyond the named ones play no part. Texts of any length are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelake.llm.common import bound_batches, first_rows, row_key, shared_table, slices, table
from quotelake.llm.hashing import HASHED_BYTES, MIX, Words, mixed, utf8

#: Bits of a word's number in a key: orders up to 3 fit.
BITS = 21
#: Of the query's model, which has neither a vocabulary nor a least count; those of `score`.
ORDER = 3
VOCABULARY, ALPHA, LEAST = 65_536, 0.4, 2
#: N-grams whose gains or logarithms are broadcast; distinct words and n-grams that a task counts before it passes them on.
HOT_KEPT, WORDS_HELD, KEYS_HELD = 262_144, 1_000_000, 4_000_000
#: Jobs that n-grams are dealt over.
PASSES = 3
#: An n-gram may be hot from one in so many of those that a task counts at a time.
SHARE = 1 << 18


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # A-Z and ASCII white space only


def each_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, batch.num_columns - 1, HASHED_BYTES)


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """A stored table word binary, n."""

    def rows(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def count(batches):
        held: Counter = Counter()
        for part in each_slice(batches):
            for text in part.column(0).to_pylist():
                held.update(words(text))
            if len(held) > WORDS_HELD:
                yield rows(held)
                held.clear()
        yield rows(held)

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word binary, n long")
    return shared_table(counted.groupBy("word").agg(F.sum("n").alias("n")))


class Numbers(Words):
    """The numbers of known words, from 1 by frequency; unknown words share the next one. Words are told apart by 64-bit hashes."""

    def __init__(self, known: list[bytes]):
        super().__init__()
        hashes = self.words(*utf8(pa.array(known, pa.binary()).cast(pa.string())))[0] if known else np.empty(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ranks, self.unknown = hashes[order], order + 1, len(known) + 1

    def encoded(self, texts: pa.Array) -> list[np.ndarray]:
        """The numbers of each text's words."""
        hashes, ends = self.words(*utf8(texts))
        at, there = found(self.hashes, hashes)
        numbers = np.where(there, self.ranks[at], self.unknown) if len(self.ranks) else np.full(len(hashes), self.unknown)
        return [numbers[a:b] for a, b in pairwise(ends.tolist())]


def keys(numbers: np.ndarray, order: int) -> np.ndarray:
    """Of all n-grams of one order; a key of a higher order is larger, as numbers begin at 1."""
    n = max(len(numbers) - order + 1, 0)
    return reduce(lambda key, i: key << BITS | numbers[i : i + n], range(1, order), numbers[:n])


def ngram_counts(docs: DataFrame, known, order: int, text_col: str) -> DataFrame:
    """key, n for orders 2 to `order`; each task counts before the shuffle."""

    def rows(held: list[np.ndarray]) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], names=["key", "n"])

    def count(batches):
        numbers, held, size = Numbers(known.value), [np.empty(0, np.int64)], 0
        for part in each_slice(batches):
            for own in numbers.encoded(part.column(0)):
                held += [keys(own, k) for k in range(2, order + 1)]
                size += len(own) * (order - 1)
            if size > KEYS_HELD:
                yield rows(held)
                held, size = [np.empty(0, np.int64)], 0
        yield rows(held)

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "key long, n long")
    return counted.groupBy("key").agg(F.sum("n").alias("n"))


def gains(counts: DataFrame, known: DataFrame, total: int, order: int, alpha: float) -> DataFrame:
    """A stored table key, n, gain: what each n-gram of `counts` adds. `known` has the key and n of single words, a bounded table."""
    out = None
    log = lambda c: F.log10(c.cast("double"))
    for k in range(2, order + 1):
        shorter = F.broadcast(known) if k == 2 else counts.filter(F.col("key") < 1 << BITS * (k - 1))
        own = counts.filter((F.col("key") >= 1 << BITS * (k - 1)) & (F.col("key") < F.lit(2**63 - 1 if k == 3 else 1 << BITS * k)))
        last = (1 << BITS * (k - 1)) - 1
        parts = own.select("key", "n", F.shiftright("key", BITS).alias("before"), F.col("key").bitwiseAND(last).alias("after"))
        parts = parts.join(shorter.select(F.col("key").alias("before"), F.col("n").alias("n_before")), "before")
        parts = parts.join(shorter.select(F.col("key").alias("after"), F.col("n").alias("n_after")), "after")
        if k == 2:
            parts = parts.withColumn("n_middle", F.lit(total))
        else:
            middle = F.broadcast(known).select(F.col("key").alias("middle"), F.col("n").alias("n_middle"))
            parts = parts.withColumn("middle", F.shiftright("after", BITS)).join(middle, "middle")
        gain = log(F.col("n")) - log(F.col("n_before")) - float(np.log10(alpha)) - log(F.col("n_after")) + log(F.col("n_middle"))
        made = parts.select("key", "n", gain.alias("gain"))
        out = made if out is None else out.unionByName(made)
    return shared_table(out)


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of largest n, at most `most` of them, cut at one of 32 steps for each doubling of n."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 32)
    sizes = counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()  # a row for each step
    sums = np.cumsum([r["count"] for r in sizes])
    kept = [r["step"] for r, s in zip(sizes, sums) if s <= most]
    return counts.filter(step >= kept[-1]) if kept else counts.filter(F.lit(False))


def exploded(docs: DataFrame, known, hot, order: int) -> DataFrame:
    """row, key: every n-gram of orders 2 to `order` whose gain isn't in `hot`. docs: id, row, text."""

    def run(batches):
        numbers, (hot_keys, _) = Numbers(known.value), hot.value
        for part in each_slice(batches):
            rows, made = [], []
            for row, own in zip(part.column(0).to_pylist(), numbers.encoded(part.column(1))):
                for k in range(2, order + 1):
                    key = keys(own, k)
                    key = key[~found(hot_keys, key)[1]]
                    made.append(key)
                    rows.append(np.full(len(key), row))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(made))], names=["row", "key"])

    return docs.select("row", "text").mapInArrow(run, "row long, key long")


def found(sorted_keys: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in `sorted_keys`, and whether the keys are there."""
    if not len(sorted_keys):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(sorted_keys, key), len(sorted_keys) - 1)
    return at, sorted_keys[at] == key


def alone(docs: DataFrame, known, logs, hot, order: int, alpha: float) -> DataFrame:
    """`docs` (id, row, text) as id, row, n_words, part: the words alone, and the gains of hot n-grams."""
    schema = docs.select("id", "row").schema.add("n_words", "long").add("part", "double")

    def run(batches):
        numbers, (hot_keys, hot_gains) = Numbers(known.value), hot.value
        for part in each_slice(batches):
            n, sums = [], []
            for own in numbers.encoded(part.column(2)):
                missing = sum(range(min(order, len(own)))) + max(len(own) - order, 0) * (order - 1)
                total = logs.value[own].sum() + missing * np.log10(alpha)
                for k in range(2, order + 1):
                    at, there = found(hot_keys, keys(own, k))
                    total += hot_gains[at[there]].sum()
                n.append(len(own))
                sums.append(total)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(sums, pa.float64())], names=["id", "row", "n_words", "part"])

    return docs.select("id", "row", "text").mapInArrow(run, schema)


def score(
    docs: DataFrame, corpus: DataFrame | None = None, order: int = 2, vocabulary: int = VOCABULARY, alpha: float = ALPHA, least: int = LEAST,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """A row for each row of `docs`: the id, n_words, total (the sum of log10 scores) and score (their mean), counted over `corpus` (else `docs`)."""
    if not (1 <= order <= 3 and vocabulary < (1 << BITS) - 1):
        raise ValueError(f"order is 1 to 3 and vocabulary less than {(1 << BITS) - 1}")
    spark, corpus = docs.sparkSession, docs if corpus is None else corpus
    counted = word_counts(corpus, text_col)
    total = counted.agg(F.sum("n")).first()[0] or 0
    top = first_rows(counted, [F.desc("n"), F.asc("word")], vocabulary)
    n = np.array([0, *(r["n"] for r in top), total - sum(r["n"] for r in top)], np.int64)
    send = spark.sparkContext.broadcast
    # without a corpus word that is unknown, an unknown word scores as one that was seen once
    known, logs = send([bytes(r["word"]) for r in top]), send(np.log10(np.maximum(n, 1) / max(total, 1)))
    hot = send((np.empty(0, np.int64), np.empty(0)))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), row_key(F.col(text_col))).alias("row"), F.col(text_col).alias("text"))
    if order > 1:
        singles = spark.createDataFrame([(i, int(x)) for i, x in enumerate(n) if i and x], "key long, n long")
        counts = ngram_counts(corpus, known, order, text_col).filter(F.col("n") >= least)
        gained = gains(shared_table(counts) if order > 2 else counts, singles, total, order, alpha)
        heavy = most_frequent(gained, HOT_KEPT).select("key", "gain").toPandas().sort_values("key")  # bounded by HOT_KEPT
        hot = send((heavy["key"].to_numpy(np.int64), heavy["gain"].to_numpy(float)))
        sums = exploded(rows, known, hot, order).join(gained.select("key", "gain"), "key").groupBy("row").agg(F.sum("gain").alias("more"))
    each = alone(rows, known, logs, hot, order, alpha)
    if order > 1:
        copies = rows.groupBy("row").agg(F.count(F.lit(1)).alias("copies"))  # rows that repeat an id and text
        each = each.join(sums.join(copies, "row").select("row", (F.col("more") / F.col("copies")).alias("more")), "row", "left")
        each = each.withColumn("part", F.col("part") + F.coalesce("more", F.lit(0.0)))
    return each.select(F.col("id").alias(id_col), "n_words", F.col("part").alias("total"), F.when(F.col("n_words") > 0, F.col("part") / F.col("n_words")).alias("score"))


def hashes(own: np.ndarray, order: int) -> np.ndarray:
    """64-bit keys of all n-grams of one order, from the hashes of words."""
    n = max(len(own) - order + 1, 0)
    key = mixed(own[:n] + MIX[order % len(MIX)])
    for i in range(1, order):
        key = mixed(key + own[i : i + n])
    return key.view(np.int64)


class Grams:
    """The n-grams of the texts of a slice: of the full order and the next shorter one, with what the log10 of their count is worth to their text.

    A text's sum is the log10 counts of its n-grams of the full order (a shorter text's: of the whole text), less those of the
    next shorter ones inside it (without the first and the last), less log10 of the number of all words: contexts cancel between neighbours.
    """

    def __init__(self, order: int):
        self.order, self.split = order, Words()

    def read(self, texts: pa.Array) -> None:
        self.own, starts = self.split.words(*utf8(texts))
        self.n = np.diff(starts)
        self.text = np.repeat(np.arange(len(self.n)), self.n)
        at = np.arange(len(self.own))
        self.place, self.left = at - starts[:-1][self.text], starts[1:][self.text] - at

    def keys(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Of all n-grams of one order that stand in one text, and where they begin."""
        key = hashes(self.own, order)
        at = np.flatnonzero(self.left[: len(key)] >= order)
        return key[at], at

    def signed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """key, text, sign (1, -1 or 0) of the n-grams of the two highest orders."""
        k = self.order
        key, at = self.keys(k)
        key_1, at_1 = self.keys(k - 1)
        inside = (self.place[at_1] > 0) & (self.left[at_1] > k - 1)
        sign_1 = np.where(self.n[self.text[at_1]] == k - 1, 1, -inside.astype(np.int64))
        at_all = np.concatenate((at, at_1))
        return np.concatenate((key, key_1)), self.text[at_all], np.concatenate((np.ones(len(key), np.int64), sign_1))

    def short(self) -> tuple[np.ndarray, np.ndarray]:
        """key, text of whole texts that are shorter than both orders."""
        made = [np.empty((2, 0), np.int64)]
        for k in range(1, self.order - 1):
            key, at = self.keys(k)
            whole = self.n[self.text[at]] == k
            made.append(np.stack((key[whole], self.text[at[whole]])))
        return tuple(np.concatenate(made, 1))


def counted(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.unique(np.concatenate(held), return_counts=True)
    return key, n.astype(np.int64)


def hot_ngrams(docs: DataFrame, order: int) -> np.ndarray:
    """Sorted keys of n-grams of the two highest orders that tasks hold often, HOT_KEPT at most: a choice of how to work that no result depends on."""

    def often(held: list[np.ndarray]) -> pa.RecordBatch:
        key, n = counted(held)
        some = n > max(n.sum() // SHARE, 1)
        return pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(n[some])], names=["key", "n"])

    def run(batches):
        grams, held, size = Grams(order), [np.empty(0, np.int64)], 0
        for part in each_slice(batches):
            grams.read(part.column(0))
            held += [grams.keys(k)[0] for k in (order, order - 1)]
            size += 2 * len(grams.own)
            if size > KEYS_HELD:
                yield often(held)
                held, size = [np.empty(0, np.int64)], 0
        yield often(held)

    counts = shared_table(docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    return np.sort(most_frequent(counts, HOT_KEPT).select("key").toPandas()["key"].to_numpy(np.int64))  # bounded by HOT_KEPT


#: An exploded row's `what`: WEIGHT times the occurrences that it counts for, and the sign + 1 with which it adds the count's logarithm.
WEIGHT = 4


def exploded_once(docs: DataFrame, hot, order: int, share: int) -> DataFrame:
    """row, key, what: the n-grams of the two highest orders that aren't hot and fall to this share of PASSES. Counts of lower orders, which only texts of so
    few words need, have row 0. The first share has the counts of hot ones too, and under key 0 that of all words: they have no row."""

    def run(batches):
        grams, keys, total = Grams(order), hot.value, 0
        hot_n, held, size = np.zeros(len(keys), np.int64), [np.empty(0, np.int64)], 0
        names, own = ["row", "key", "what"], lambda key: key.view(np.uint64) % np.uint64(PASSES) == share

        def lower(held):
            key, n = counted(held)
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(key), np.int64)), pa.array(key), pa.array(WEIGHT * n + 1)], names=names)

        for part in each_slice(batches):
            grams.read(part.column(1))
            row = part.column(0).to_numpy()
            key, text, sign = grams.signed()
            if not share:
                at, there = found(keys, key)
                hot_n += np.bincount(at[there], minlength=len(keys))
            key, text, sign = (x[own(key)] for x in (key, text, sign))
            cold = ~found(keys, key)[1]
            few, its_text = grams.short()
            few, its_text = few[own(few)], its_text[own(few)]
            what = np.concatenate((WEIGHT + sign[cold] + 1, np.full(len(few), 2)))
            yield pa.RecordBatch.from_arrays([pa.array(row[np.concatenate((text[cold], its_text))]), pa.array(np.concatenate((key[cold], few))), pa.array(what)], names=names)
            for k in range(1, order - 1):
                held.append((key := grams.keys(k)[0])[own(key)])
                size += len(held[-1])
            total += len(grams.own)
            if size > KEYS_HELD:
                yield lower(held)
                held, size = [np.empty(0, np.int64)], 0
        yield lower(held)
        if not share:
            ends, n = np.append(keys, 0), np.append(hot_n, total)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(ends), pa.int64()), pa.array(ends), pa.array(WEIGHT * n + 1)], names=names)

    return docs.select("row", "text").mapInArrow(run, "row long, key long, what long")


def sums_of(docs: DataFrame, hot, order: int, share: int) -> DataFrame:
    """A stored table row, hot, more, n: for each row the sum of signed log10 counts of its n-grams of a share; for hot n-grams their count."""
    met = exploded_once(docs, hot, order, share).withColumn("n", F.sum(F.floor(F.col("what") / WEIGHT)).over(Window.partitionBy("key")))
    sign = F.col("what") % WEIGHT - 1
    return shared_table(met.filter((sign != 0) | F.col("row").isNull()).groupBy("row", F.when(F.col("row").isNull(), F.col("key")).alias("hot")).agg(
        F.sum(F.log10(F.col("n").cast("double")) * sign).alias("more"), F.max("n").alias("n")
    ))


def score_whole(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`score` of `docs` by their own counts, of every word and every n-gram: no vocabulary and no least count."""
    if order < 2:
        raise ValueError("order is 2 at least")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), row_key(F.col(text_col))).alias("row"), F.col(text_col).alias("text"))
    keys = spark.sparkContext.broadcast(hot_ngrams(rows, order))
    parts = [sums_of(rows, keys, order, share) for share in range(PASSES)]
    frequent = parts[0].filter("row IS NULL").select("hot", "n").toPandas()  # HOT_KEPT + 1 rows at most
    n = dict(zip(frequent["hot"], frequent["n"]))
    total = int(n.get(0, 0))
    logs = spark.sparkContext.broadcast(np.log10(np.maximum([int(n.get(k, 1)) for k in keys.value.tolist()], 1.0)))
    schema = rows.select("id", "row").schema.add("n_words", "long").add("part", "double")

    def hot_part(batches):
        grams = Grams(order)
        for part in each_slice(batches):
            grams.read(part.column(2))
            key, text, sign = grams.signed()
            at, there = found(keys.value, key)
            sums = np.bincount(text[there], logs.value[at[there]] * sign[there], len(grams.n)) - np.where(grams.n > 0, np.log10(max(total, 1)), 0)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(grams.n.astype(np.int64)), pa.array(sums)], names=["id", "row", "n_words", "part"])

    copies = rows.groupBy("row").agg(F.count(F.lit(1)).alias("copies"))  # rows that repeat an id and text
    sums = reduce(DataFrame.unionByName, parts).filter("row IS NOT NULL").groupBy("row").agg(F.sum("more").alias("more"))
    more = sums.join(copies, "row").select("row", (F.col("more") / F.col("copies")).alias("more"))
    each = rows.mapInArrow(hot_part, schema).join(more, "row", "left").withColumn("part", F.col("part") + F.coalesce("more", F.lit(0.0)))
    return each.select(F.col("id").alias(id_col), "n_words", F.col("part").alias("total"), F.when(F.col("n_words") > 0, F.col("part") / F.col("n_words")).alias("score"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram scores of all documents by the counts of all words and n-grams of all documents, to six places."""
    bound_batches(spark)
    out = score_whole(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.round("total", 6).alias("total"), F.round("score", 6).alias("score"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT r, unnest(w) AS c, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT r, i, c, lag(c) OVER w AS b, lag(c, 2) OVER w AS a FROM t WINDOW w AS (PARTITION BY r ORDER BY i)),
n1 AS (SELECT c, count(*) AS n FROM g GROUP BY c),
n2 AS (SELECT b, c, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY b, c),
n3 AS (SELECT a, b, c, count(*) AS n FROM g WHERE a IS NOT NULL GROUP BY a, b, c),
s AS (SELECT r, count(*) AS m, sum(log10(CASE WHEN i = 1 THEN x1.n / (SELECT count(*) FROM t) WHEN i = 2 THEN x2.n / y1.n ELSE x3.n / y2.n END)) AS total
      FROM g JOIN n1 AS x1 ON x1.c = g.c LEFT JOIN n2 AS x2 ON x2.b = g.b AND x2.c = g.c LEFT JOIN n1 AS y1 ON y1.c = g.b
      LEFT JOIN n3 AS x3 ON x3.a = g.a AND x3.b = g.b AND x3.c = g.c LEFT JOIN n2 AS y2 ON y2.b = g.a AND y2.c = g.b GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(total, 0.0), 6) AS total, round(total / m, 6) AS score FROM d LEFT JOIN s USING (r)
"""
