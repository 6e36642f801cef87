"""Event flows as Structured Streaming: append-only log, usage costs by window, at-least-once jobs, elapsed times.

Every flow takes a streaming frame and returns one; `run` drives a stream over what is there and gives its result.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.operators.joins import latest


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares; a folder of this machine only in a local session without one, as in tests."""
    if not (root := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="quotelake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/quotelake-stream/{uuid.uuid4().hex}"


def source(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A table's files as a stream: one batch, unless `files_per_batch` cuts it, so that no watermark drops a row for the file it stands in. The pattern finds a table that is one file as well as a folder of files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{sf_dir}/{name}.parque[t]")


def run(stream: DataFrame, mode: str = "append", key: list[str] | None = None) -> DataFrame:
    """Everything that is there now, then end. append: all rows that were put out; update: the last row of each `key`, whose state may end with its watermark."""
    spark, path = stream.sparkSession, scratch(stream.sparkSession)

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={n}")  # a batch that is repeated overwrites its own rows

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    return (latest(out, key, [F.desc("batch")]) if mode == "update" else out).drop("batch")


def append_log(stream: DataFrame, key: str, columns: list[str], ts: str, late: str = "2 days") -> DataFrame:
    """An event is written once and never changed; a key is remembered as long as a copy of its event may be late."""
    return stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark([key]).select(key, *columns)


def windowed_cost(stream: DataFrame, ts: str, by: list[str], cost: str, length: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """Calls and cost in tumbling (or, with a slide, overlapping) windows."""
    timed = stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    w = F.window("_t", length, slide) if slide else F.window("_t", length)
    return timed.groupBy(w, *by).agg(F.count(F.lit(1)).alias("calls"), F.sum(cost).alias("cost")).select(F.col("window.start").alias("start"), *by, "calls", "cost")


def jobs_once(stream: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """A queue that delivers at least once, each job once within the watermark."""
    return stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark([key]).drop("_t")


def elapsed(starts: DataFrame, ends: DataFrame, key: str, ts: str, within: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """key, seconds: from each start to the ends of the same key that follow within a time; a join of two streams with bounded state."""
    a = starts.select(F.col(key), F.col(ts).cast("timestamp").alias("_a")).withWatermark("_a", late)
    b = ends.select(F.col(key).alias("_key"), F.col(ts).cast("timestamp").alias("_b")).withWatermark("_b", late)
    hit = (F.col(key) == F.col("_key")) & (F.col("_b") >= F.col("_a")) & (F.col("_b") <= F.col("_a") + F.expr(f"INTERVAL {within}"))
    return a.join(b, hit).select(key, F.col("_a").alias("started_at"), F.timestamp_diff("SECOND", F.col("_a"), F.col("_b")).alias("seconds"))
