"""A corpus pipeline of five stages over `documents`: from raw texts to the token ids of what is worth training on.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. The first four return the
columns of `documents`; the last returns what is written for training.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.llm import decontamination, exact_dedup, ngram_jaccard, quality, sentencepieces
from quotelake.llm.common import free_name, shared_table, table


#: Rows of an Arrow batch: workers live through all stages, so that each holds little at once.
ROWS = 250


def small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS:
        spark.conf.set(name, str(ROWS))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labelled ones among them, rejects (score under 0.5) go."""
    small_batches(spark)
    trees = quality.train(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs.columns, "_score")
    return quality.score(docs, trees, out_col=name).filter(F.col(name) >= 0.5).drop(name)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that differ in the case of A-Z at most, the row with the largest doc_id stays."""
    small_batches(spark)
    return exact_dedup.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a 5-word Jaccard similarity of 0.75 or more, the row with the smallest doc_id stays."""
    small_batches(spark)
    return ngram_jaccard.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"), remove="documents")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens and the digests of ids and of what they decode to."""
    import public_tokenizers

    small_batches(spark)
    model = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
    out = sentencepieces.encode(docs.select("doc_id", "lang", "source", "text"), model)
    return sentencepieces.digests(out, "lang", "source", "ids")


STAGES: list = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("SentencePiece encoding", token_ids),
]
#: A classifier fitted to the data can't be stated in SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir))  # stages read their input several times
    return STAGES[-1][1](spark, docs, sf_dir)
