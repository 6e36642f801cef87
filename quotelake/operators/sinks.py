"""Writes as frames: upsert, insert if absent, back-fill, cascade delete, revision copy, numbering, flat export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def upsert(target: DataFrame, changes: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """`target` with the last change of each key in place of its row; new keys are added."""
    w = Window.partitionBy(*key).orderBy(*order)
    last = changes.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return target.join(last.select(*key), key, "left_anti").unionByName(last.select(*target.columns))


def insert_absent(target: DataFrame, rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Rows whose key `target` lacks, the first of each key, added."""
    w = Window.partitionBy(*key).orderBy(*order)
    first = rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return target.unionByName(first.join(target.select(*key), key, "left_anti").select(*target.columns))


def backfill(target: DataFrame, source: DataFrame, key: list[str], column: str) -> DataFrame:
    """Nulls of a column filled from another table with unique keys."""
    given = source.select(*key, F.col(column).alias("_given"))
    return target.join(given, key, "left").withColumn(column, F.coalesce(column, "_given")).drop("_given")


def delete_cascade(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame, id_col: str) -> dict[str, DataFrame]:
    """Each table without the rows whose column refers to one of the ids."""
    gone = ids.select(F.col(id_col).alias("_gone")).distinct()
    return {name: df.join(gone, F.col(c) == F.col("_gone"), "left_anti") for name, (df, c) in tables.items()}


def blank_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) if isinstance(df.schema[c].dataType, T.StringType) else F.col(c) for c in df.columns])


def numbered(rows: DataFrame, given: str, key: list[str], start: Column, order: list[Column]) -> DataFrame:
    """Line numbers where none are given, going on from the larger of `start` and the given ones."""
    most = F.greatest(F.coalesce(F.max(given).over(Window.partitionBy(*key)), F.lit(0)), start)
    n = F.row_number().over(Window.partitionBy(*key, F.col(given).isNull()).orderBy(*order))
    return rows.withColumn(given, F.coalesce(given, (most + n).cast("int")))


def next_code(codes: DataFrame, column: str, prefix: str) -> DataFrame:
    """One row, code: PREFIX-0001 and so on after the largest that there is."""
    number = F.regexp_extract(column, f"^{prefix}-([0-9]+)$", 1).cast("string")
    most = F.coalesce(F.max(F.nullif(number, F.lit("")).cast("long")), F.lit(0))
    return codes.agg(most.alias("_n")).select(F.concat(F.lit(f"{prefix}-"), F.lpad((F.col("_n") + 1).cast("string"), 4, "0")).alias("code"))


def flat(df: DataFrame) -> DataFrame:
    """Struct leaves as columns joined by _, arrays and maps as JSON: what a flat file can hold."""

    def leaves(schema: T.StructType, path: tuple[str, ...]) -> list[Column]:
        out = []
        for f in schema.fields:
            own = (*path, f.name)
            c = F.col(".".join(f"`{p}`" for p in own))
            if isinstance(f.dataType, T.StructType):
                out += leaves(f.dataType, own)
            else:
                out.append((F.to_json(c) if isinstance(f.dataType, (T.ArrayType, T.MapType)) else c).alias("_".join(own)))
        return out

    return df.select(*leaves(df.schema, ()))


def next_versions(versions: DataFrame, key: list[str], version: str) -> DataFrame:
    """key, next_version: one more than the largest of each key."""
    return versions.groupBy(*key).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next_version"))


def revised(runs: DataFrame, items: DataFrame, ids: DataFrame, run: str, parent: str, version: str, status: str) -> tuple[DataFrame, DataFrame]:
    """(new runs, new items): a draft revision of each run in `ids`, with copies of its items.

    Revisions of one run are a family under the run that none of them revises; each gets the version after the family's newest, several at once one after the other.
    """
    family = F.coalesce(parent, run)
    newest = runs.groupBy(family.alias("_family")).agg(F.max(version).alias("_newest"))
    asked = runs.join(ids.select(run).distinct(), run, "left_semi").withColumn("_family", family).join(newest, "_family")
    number = F.col("_newest") + F.row_number().over(Window.partitionBy("_family").orderBy(version, run))
    named = asked.withColumn("_version", number).withColumn("_new", F.concat("_family", F.lit("-r"), (F.col("_version") - 1).cast("string")))
    made = {run: F.col("_new"), parent: F.col("_family"), version: F.col("_version").cast(runs.schema[version].dataType), status: F.lit("draft")}
    copies = items.join(named.select(F.col(run).alias("_of"), "_new"), F.col(run) == F.col("_of")).withColumn(run, F.col("_new"))
    return named.select(*[made.get(c, F.col(c)).alias(c) for c in runs.columns]), copies.select(*items.columns)
