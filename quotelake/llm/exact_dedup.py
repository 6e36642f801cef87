"""Operator 2: exact de-duplication with a heavy-hitter split.

A digest of each normalised text stands for the text. Misra-Gries summaries of the digests, one for
each task and then merged, name every digest that more than 1 row in SLOTS + 1 has (and perhaps some
others; at most SLOTS). One exact aggregation over the rows of the named digests verifies them; the
verified winners, at most SLOTS rows, are broadcast and settle their rows without a shuffle. All other
rows are shuffled by digest, where no digest can have more than 1 row in SLOTS + 1.

Null and empty texts are equal to each other. Of equal texts the row with the largest id stays; a null
id is less than any other, and stays only where no row of the group has an id. Rows that repeat one
id and text carry the same verdict; `deduplicated` keeps one of them, and of different texts that are equal
under one id the one of largest hash. An empty table gives an empty one. Extra columns of any name are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.llm.common import ascii_lower, bound_batches, first_rows, row_key, shared_table, table, without

#: Counters of a Misra-Gries summary, and so the most rows that are broadcast.
SLOTS = 2048


def text_digest(text) -> F.Column:
    """SHA-256 of a text with A-Z lower-cased; null counts as empty."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


def decremented(counts: pd.Series, slots: int) -> pd.Series:
    """Misra-Gries: less the (slots + 1)-th largest count, without what falls to nothing."""
    if len(counts) <= slots:
        return counts
    counts = counts - counts.nlargest(slots + 1).iloc[-1]
    return counts[counts > 0]


def frequent(digests: DataFrame, column: str, slots: int = SLOTS) -> DataFrame:
    """At most `slots` values of `column`, all those among them that more than 1 row in slots + 1 has."""

    def summary(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.Series(dtype="int64")
        for part in parts:
            held = decremented(held.add(part[column].value_counts(), fill_value=0).astype("int64"), slots)
        yield pd.DataFrame({column: held.index.astype(str), "n": held.to_numpy()})

    # Sums of summaries fall short of a count by less than 1 row in slots + 1, so one that stands first stays.
    merged = digests.select(column).mapInPandas(summary, f"{column} string, n long").groupBy(column).agg(F.sum("n").alias("n"))
    first = first_rows(merged, [F.desc("n"), F.asc(column)], slots)
    return digests.sparkSession.createDataFrame([(r[column],) for r in first], f"{column} string")


def exact_groups(digests: DataFrame, id_col: str, digest_col: str, slots: int = SLOTS, tie_col: str | None = None) -> DataFrame:
    """`digests` with keep_id, keep_tie (of ids that tie), group_size and kept. Reads `digests` three times: pass a stored table."""
    tie = F.col(tie_col) if tie_col else F.lit(0)
    best = [F.max(F.struct(F.col(id_col).alias("id"), tie.alias("tie"))).alias("keep"), F.count(F.lit(1)).alias("group_size")]
    named = F.broadcast(frequent(digests, digest_col, slots))
    winners = shared_table(digests.join(named, digest_col, "left_semi").groupBy(digest_col).agg(*best))
    heavy = digests.join(F.broadcast(winners), digest_col)
    rest = digests.join(F.broadcast(winners.select(digest_col)), digest_col, "left_anti")
    light = rest.join(rest.groupBy(digest_col).agg(*best), digest_col)
    kept = [*digests.columns, F.col("keep.id").alias("keep_id"), F.col("keep.tie").alias("keep_tie"), "group_size"]
    both = heavy.select(*kept).unionByName(light.select(*kept))
    return both.withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `df`: the id, row (key of the text), text_sha256, keep_id, keep_tie, group_size, kept."""
    digests = shared_table(df.select(F.col(id_col), row_key(F.col(text_col)).alias("row"), text_digest(F.col(text_col)).alias("text_sha256")))
    return exact_groups(digests, id_col, "text_sha256", tie_col="row")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of `df` for each text, with its columns."""
    out = shared_table(dedup(df, id_col, text_col))
    first = F.col("kept") & (F.col("row") == F.col("keep_tie"))
    twice = out.filter(first).groupBy(id_col, "row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(id_col, "row")
    return without(df, out.filter(~first).select(id_col, "row").distinct(), id_col, text_col, twice)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""
