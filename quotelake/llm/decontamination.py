"""Operator 10: benchmark decontamination with a broadcast hash set of test n-grams. DataFrame functions only.

Each benchmark item gives its windows of SIZE words (an item of fewer words, but not none, is one
window). The distinct windows, keyed by hash, are broadcast when they are at most MOST_BROADCAST rows and MOST_BYTES
of text; which items hold them is joined to verified hits only. Every word of every document is looked up with the word
behind it among the windows' first two words, what is left by the hash of the whole window, and a hit is verified word by word.
For a larger benchmark hashes meet in a shuffle, the frequent ones of the documents by broadcast. Flags, the removal of
spans and the removal of documents follow from the verified hits.

Null and empty texts have no words and no hits. Rows that repeat an id and text have equal results; rows
that share only an id are kept apart. Items that repeat an id count once; a null item id counts as an
empty string. Empty tables give empty or clean results. Columns beyond the named ones, of any name, are kept where
documents are returned, and play no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.llm.common import row_key, shared_table, table, without
from quotelake.llm.words import SQL_WORDS, once, words

#: Words of a window; the most windows, and bytes of them, that are broadcast.
SIZE, MOST_BROADCAST, MOST_BYTES = 10, 500_000, 100 << 20


def windows(of: Column, n: int) -> Column:
    """array<array<string>>: every n consecutive words."""
    return F.transform(F.sequence(F.lit(1), F.size(of) - (n - 1)), lambda i: F.slice(of, i, n))


def benchmark_windows(bench: DataFrame, size: int = SIZE, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """A stored table hash, n, gram array<string>, item: the distinct windows of each item."""
    items = bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("w"))
    grams = F.when(F.size("w") >= size, windows(F.col("w"), size)).otherwise(F.array("w"))
    each = items.filter(F.size("w") > 0).select("item", F.explode(grams).alias("gram")).distinct()
    return shared_table(each.select(F.xxhash64("gram").alias("hash"), F.size("gram").alias("n"), "gram", "item"))


def two(at: Column, n: int) -> Column:
    """A hash of the word at `at` of _w and, in windows of more than one word, of the next."""
    return F.xxhash64(F.get("_w", at), F.get("_w", at + 1)) if n > 1 else F.xxhash64(F.get("_w", at))


def looked_up(base: DataFrame, side: DataFrame, n: int) -> DataFrame:
    """The verified hits of windows of n words, of which `side` (hash, gram) is small."""
    first = side.select((F.xxhash64(F.get("gram", F.lit(0)), F.get("gram", F.lit(1))) if n > 1 else F.xxhash64(F.get("gram", F.lit(0)))).alias("_two")).distinct()
    # Generator, look-ups and check run in one generated loop that copies hits only. The outer generator keeps the optimiser from a filter on its input.
    at = base.filter(F.size("_w") >= n).select("_id", "_row", "_w", F.posexplode_outer("_w").alias("_at", "_word"))
    near = at.withColumn("_two", two(F.col("_at"), n)).join(F.broadcast(first), "_two")
    found = near.withColumn("_hash", F.xxhash64(F.slice("_w", F.col("_at") + 1, n))).join(F.broadcast(side).withColumnRenamed("hash", "_hash"), "_hash")
    return found.filter(F.slice("_w", F.col("_at") + 1, n) == F.col("gram")).select("_id", "_row", F.col("_at").alias("start"), F.lit(n).alias("n"), F.col("_hash").alias("hash"), "gram")


def shuffled(base: DataFrame, side: DataFrame, n: int) -> DataFrame:
    """The same where `side` is large: hashes meet first, those that documents hold often by broadcast, and then the windows, as small rows; the words of a text move only to
    its own hits, by id and row, to be verified."""
    spark = base.sparkSession
    hashed = base.filter(F.size("_w") >= n).select("_id", "_row", F.posexplode_outer(F.transform(windows(F.col("_w"), n), lambda g: F.xxhash64(g))).alias("_at", "hash"))
    known = side.select("hash").distinct()
    counts = shared_table(hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("c")).join(known, "hash"))
    total = counts.agg(F.sum("c")).first()[0] or 0
    often = F.broadcast(counts.filter(F.col("c") > total / int(spark.conf.get("spark.sql.shuffle.partitions"))).select("hash"))  # no more than partitions
    met = hashed.join(often, "hash").unionByName(hashed.join(often, "hash", "left_anti").join(known, "hash").select("hash", "_id", "_row", "_at"))
    met = met.select(F.col("_id").alias("i"), F.col("_row").alias("r"), F.col("_at").alias("start"), "hash").distinct()
    heavy = shared_table(side.join(often, "hash"))  # windows of as many hashes as there are partitions, so broadcast
    light = met.join(often, "hash", "left_anti").join(side, "hash")
    windows_of = shared_table(met.join(F.broadcast(heavy), "hash").unionByName(light))
    own = windows_of.groupBy("i", "r").agg(F.collect_set(F.struct("start", "hash", "gram")).alias("_hits"))  # no more than a text has words
    texts = base.join(own, F.col("_id").eqNullSafe(F.col("i")) & (F.col("_row") == F.col("r"))).select("_id", "_row", "_w", F.inline("_hits"))
    return texts.filter(F.slice("_w", F.col("start") + 1, n) == F.col("gram")).select("_id", "_row", "start", F.lit(n).alias("n"), "hash", "gram")


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stored table _id, _row, start (from 0), n, hash, gram: every verified occurrence of a window (`items`: see benchmark_windows) in a document."""
    grams = items.select("hash", "n", "gram").distinct()
    sizes = grams.groupBy("n").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(F.array_join("gram", " "))).alias("bytes")).orderBy("n").collect()  # at most SIZE rows
    small = sum(r["rows"] for r in sizes) <= MOST_BROADCAST and sum(r["bytes"] for r in sizes) <= MOST_BYTES
    base = docs.select(F.col(id_col).alias("_id"), row_key(F.col(text_col)).alias("_row"), once(words(F.col(text_col))).alias("_w"))
    found = [(looked_up if small else shuffled)(base, grams.filter(F.col("n") == n).select("hash", "gram"), n) for n in [r["n"] for r in sizes] or [SIZE]]
    return shared_table(reduce(DataFrame.unionByName, found))


def covered(starts: Column) -> Column:
    """How many words lie in the union of sorted struct<start, n>."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("words"))

    def step(seen, x):
        end = x["start"] + x["n"]
        more = F.greatest(F.lit(0), end - F.greatest(seen["end"], x["start"]))
        return F.struct(F.greatest(seen["end"], end).alias("end"), (seen["words"] + more).alias("words"))

    return F.aggregate(starts, zero, step, lambda s: s["words"])


def contamination(docs: DataFrame, bench: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of `docs`: the id, row_key, n_words, n_hit, spans array<struct<start, n>>, items array<string> sorted."""
    items = benchmark_windows(bench, size)
    seen = hits(docs, items, id_col, text_col)
    spans = seen.groupBy("_id", "_row").agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("spans"))
    holding = seen.select("_id", "_row", "hash", "gram").distinct().join(items.drop("n"), ["hash", "gram"])
    named = holding.groupBy("_id", "_row").agg(F.array_sort(F.collect_set("item")).alias("items")).select(F.col("_id").alias("_i"), F.col("_row").alias("_r"), "items")
    per_doc = spans.join(named, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_row") == F.col("_r")))
    every = docs.select(F.col(id_col), row_key(F.col(text_col)).alias("row_key"), F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_row"))
    none = F.array().cast("array<struct<start:int,n:int>>")
    return every.join(per_doc, same, "left").select(
        id_col, "row_key", "n_words",
        F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("spans", none).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def decontaminated(docs: DataFrame, bench: DataFrame, remove: str = "documents", size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with its columns, without contaminated documents, or with the hit words (and what stands before each) cut out."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    seen = hits(docs, benchmark_windows(bench, size), id_col, text_col)
    if remove == "documents":
        return without(docs, seen.select("_id", "_row").distinct(), id_col, text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]
    own, text = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col))
    spans = seen.groupBy("_id", "_row").agg(F.collect_set(F.struct("start", "n")).alias("_spans"))
    pieces = F.regexp_extract_all(text, F.lit(r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), 1)
    tail = F.regexp_extract(text, r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)\z", 1)
    kept = F.filter(pieces, lambda _, i: ~F.exists("_spans", lambda s: (i >= s["start"]) & (i < s["start"] + s["n"])))
    cut = F.when(F.col("_spans").isNull(), text).otherwise(F.concat(F.array_join(kept, ""), tail))
    out = docs.toDF(*names).join(spans, own.eqNullSafe(F.col("_id")) & (row_key(text) == F.col("_row")), "left")
    return out.select(*[cut if c == text_col else F.col(n) for c, n in zip(docs.columns, names)]).toDF(*docs.columns)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = f"""
WITH d AS (SELECT doc_id, {SQL_WORDS.format("text")} AS w FROM documents),
b AS (SELECT item_id, {SQL_WORDS.format("text")} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), {SIZE}) AS n, w[i:i + least(len(w), {SIZE}) - 1] AS gram
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {SIZE}) + 2)) AS i FROM b WHERE len(w) > 0)),
h AS (SELECT x.doc_id, x.i, g.n, g.item_id
      FROM (SELECT doc_id, l.n, i, w[i:i + l.n - 1] AS gram
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) AS k) AS l) AS x
      JOIN g ON x.n = g.n AND x.gram = g.gram),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
