"""What the operators of this subpackage share: table access, bounded Arrow slices, shared scratch tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts are handed to the Python kernels in slices of about so many bytes, from Arrow batches of at most so many rows.
SLICE_BYTES, BATCH_ROWS = 8 << 20, 1000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_table(df: DataFrame) -> DataFrame:
    """Write `df` under spark.checkpoint.dir and read it back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    if not (root := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="quotelake-")  # one process, as in tests
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/quotelake/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # what was shuffled for a stored table isn't needed any more
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables (see shared_table) that nothing will read again."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/quotelake/" in f}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def first_rows(df: DataFrame, order: list[Column], k: int) -> list[Row]:
    """The first k rows in a total order. The driver takes them from the first ranges, not k from each partition as after orderBy."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order).take(k)


def row_key(text: Column) -> Column:
    """With the id, names a row where two passes over the texts meet."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str, repeated: DataFrame | None = None) -> DataFrame:
    """`docs` with its columns, less the rows whose id and row key stand in `gone` (id, row); of those in `repeated` (id, row) one stays.

    Both are stored first, so that Spark knows their size: a small one is broadcast, else both sides are shuffled by id and row key.
    The frame goes through the joins under plain names, so that any name of a column is allowed.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c: n for c, n in zip(docs.columns, names)}
    keys = [F.col(at[id_col]).alias("_i"), row_key(F.col(at[text_col])).alias("_r")]
    same = lambda x: (F.col("_i").eqNullSafe(x["_id"])) & (F.col("_r") == x["_row"])
    gone = shared_table(gone.toDF("_id", "_row"))
    out = docs.toDF(*names).select("*", *keys).join(gone, same(gone), "left_anti")
    if repeated is not None:
        twice = shared_table(repeated.toDF("_id", "_row"))
        if not twice.isEmpty():
            some = out.join(twice, same(twice), "left_semi").dropDuplicates(["_i", "_r"])
            out = out.join(twice, same(twice), "left_anti").unionByName(some)
    return out.select(*names).toDF(*docs.columns)


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's rows of an Arrow batch, which Spark and each worker hold whole: rows of documents are long. For queries and stages."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def free_name(columns: list[str], name: str) -> str:
    """A column name like `name` that none of `columns` has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its text column reaches `most` bytes; a single longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total + n > most and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def add_by_text(
    df: DataFrame, text_col: str, new: list[T.StructField], kernel: Callable[[], Callable[[list[str]], list[pa.Array]]]
) -> DataFrame:
    """All columns of `df` and the `new` ones, which `kernel()` makes from lists of texts (null: empty).

    A column of `df` with the name of a new one is replaced. The kernel is made once in each task.
    """
    kept = df.drop(*(f.name for f in new))
    fields = [*kept.schema.fields, *new]
    names = [f"c{i}" for i in range(len(fields))]  # a frame goes through Arrow under plain names: any name of a column is allowed
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, fields)])
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = kernel()
        for batch in batches:
            for part in slices(batch, at):
                made = work([x or "" for x in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=names)

    return kept.toDF(*names[: len(kept.columns)]).mapInArrow(run, schema).toDF(*(f.name for f in fields))
