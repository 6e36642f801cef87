"""Operator 11: ranked lexical search over term-bucketed postings.

Postings are rows (term, document, occurrences, words of the document), dealt by term, a term's documents over SALTS buckets,
and stored once in order of term; one row without a term stands for each document, so that one pass counts how many documents hold each
term, all documents and all words. Item terms are joined to their postings by term, every match is scored in integers, and
scores are summed by item and document. A posting goes to its document's partition once, before the items that ask for its term are
joined to it: a frequent term sends one row a document, however many items hold it, and sums need no shuffle of their own. Each partition ranks
its documents first, so that top * partitions rows of an item meet at most.

While item terms are at most MOST_BROADCAST rows and MOST_BYTES, they are broadcast, and other terms get no postings; else postings of all terms are
joined by shuffles, with equal results.

Null and empty texts have no terms: they are no documents of the corpus and are never found. Rows that repeat an id, or a whole row, are documents
each, and take a rank each; of equal scores the smaller id is first, a null id is last. Items that repeat an id (null is one too) are one item with the
terms of all. Items without terms, or whose terms no document holds, have no rows. Empty tables give no rows. Extra columns of any name play no part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelake.llm.common import bound_batches, shared_table, slices, table
from quotelake.llm.words import SQL_WORDS, words

#: Documents of an item; buckets of one term; the most item terms, and bytes of them, that are broadcast.
TOP, SALTS, MOST_BROADCAST, MOST_BYTES = 50, 16, 200_000, 16 << 20
#: Terms of a text's UTF-8 with A-Z in lower case.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """A stored table item, term: the distinct terms of each item."""
    return shared_table(items.select(F.col(id_col).alias("item"), F.explode(words(F.col(text_col))).alias("term")).distinct())


def postings(docs: DataFrame, wanted: frozenset[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stored table term, doc, at (a number of the row), tf, n, of the `wanted` terms or else of all; and a row without term for each row of `docs`."""
    kind = docs.schema[id_col].dataType
    read = docs.select(F.col(id_col).alias("doc"), F.monotonically_increasing_id().alias("at"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                rows, lengths, terms, tfs = [], [], [], []
                for i, text in enumerate(part.column(2).to_pylist()):
                    counts = Counter(TERM.findall((text or "").encode().lower()))
                    found = list(counts if wanted is None else counts.keys() & wanted)
                    rows += [i] * (len(found) + 1)
                    lengths += [counts.total()] * (len(found) + 1)
                    terms += [None, *found]
                    tfs += [0, *map(counts.get, found)]
                at = pa.array(np.array(rows, np.int64))
                made = [pa.array(terms, pa.binary()).cast(pa.string()), part.column(0).take(at), part.column(1).take(at), pa.array(tfs, pa.int64()), pa.array(lengths, pa.int64())]
                yield pa.RecordBatch.from_arrays(made, names=["term", "doc", "at", "tf", "n"])

    schema = f"term string, doc {kind.simpleString()}, at long, tf long, n long"
    dealt = read.mapInArrow(run, schema).repartition("term", F.pmod(F.xxhash64("at"), F.lit(SALTS)))
    return shared_table(dealt.sortWithinPartitions("term"))


def weight(df: Column, n_docs: int) -> Column:
    return F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * df + 1))).cast("long")


def match_score(tf: Column, n: Column, n_docs: int, n_words: int) -> Column:
    """What a posting is worth before its term's weight: integers only, rounded down."""
    div = lambda a, b: F.call_function("div", a, b)
    m = F.lit(50) + div(50 * n * F.lit(n_docs), F.lit(max(n_words, 1)))
    return div(F.lit(1_000_000_000) * tf, 1000 * tf + 20 * m)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item, rank, doc, score: the `top` documents of each item."""
    asked = item_terms(items, item_col, item_text)
    size = asked.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("bytes")).first()
    small = size["rows"] <= MOST_BROADCAST and size["bytes"] <= MOST_BYTES
    named = sorted(r[0] for r in asked.select("term").distinct().collect()) if small else []  # bounded just above
    found = postings(docs, frozenset(x.encode() for x in named) if small else None, id_col, text_col)

    counts = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("words"))
    counts = shared_table(counts)
    corpus = counts.filter("term IS NULL").select("docs", "words").first() or (0, 0)
    weights = counts.filter("term IS NOT NULL").select("term", weight(F.col("df"), corpus[0]).alias("w")).filter("w > 0")
    worth = F.col("w") * match_score(F.col("tf"), F.col("n"), *corpus)

    if small:
        numbers = F.broadcast(docs.sparkSession.createDataFrame(list(enumerate(named)), "no int, term string"))
        scored = found.join(F.broadcast(weights.join(numbers, "term")), "term").select("no", "doc", "at", worth.alias("score")).filter("score > 0")
        matches = scored.repartition("at").join(F.broadcast(asked.join(numbers, "term").select("no", "item")), "no")
    else:
        scored = found.join(weights.join(asked, "term", "left_semi"), "term").select("term", "doc", "at", worth.alias("score")).filter("score > 0")
        matches = scored.join(asked, "term")
    sums = matches.groupBy("item", "at", "doc").agg(F.sum("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"), "at"))
    return sums.withColumn("rank", rank).filter(F.col("rank") <= top).select("item", "rank", "doc", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    out = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("item").alias("item_id"), "rank", F.col("doc").cast("long").alias("doc_id"), "score")


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {SQL_WORDS.format("text")} AS w FROM documents),
p AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_words FROM d WHERE len(w) > 0),
b AS (SELECT DISTINCT item_id, unnest({SQL_WORDS.format("text")}) AS term FROM benchmark),
f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
s AS (SELECT item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_words))))::BIGINT AS score
      FROM b JOIN f USING (term) JOIN p USING (term), c GROUP BY item_id, rid, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, rid) AS rank FROM s WHERE score > 0) WHERE rank <= {TOP}
"""
