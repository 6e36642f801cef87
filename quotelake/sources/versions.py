"""Keyed tables in versions: rows in files by bucket of the key, a version as a manifest of folders, unchanged buckets shared between versions.

A version is whole when its manifest is written, in one step that fails where the version is there already; readers never see half of one. Work and new files
of a version grow with the buckets that changes touch, a copy writes no rows, and a difference reads the buckets that differ. Manifests have
a row for each bucket, the only thing that comes to the driver. Keys are unique and not null.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotelake.operators.joins import difference

MANIFEST = "bucket int, folder string, parent long, reason string"


class Versions:
    """The table under `path`. `by` (columns of the key, all by default) decides the bucket of a row, so that rows alike in them lie together."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, key: list[str], by: list[str] | None = None, buckets: int = 64):
        self.spark, self.path, self.key, self.by, self.buckets = spark, path.rstrip("/"), key, by or key, buckets
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self._known: dict[int, dict[int, str]] = {}  # manifests, which never change once they are there
        if not set(self.by) <= set(key):
            raise ValueError(f"{self.by} are not all columns of the key {key}")

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._path(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def numbers(self) -> list[int]:
        """Versions that are whole, the newest last."""
        found = sorted(int(n) for n in self._names(f"{self.path}/versions") if n.isdigit())
        return [n for n in found if "_SUCCESS" in self._names(f"{self.path}/versions/{n}")]

    def latest(self) -> int:
        """The newest version, 0 before the first."""
        return max(self.numbers(), default=0)

    def manifest(self, version: int | None = None) -> dict[int, str]:
        """bucket -> folder, of buckets that have rows."""
        version = self.latest() if version is None else version
        if not version:
            return {}
        if version not in self._known:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/versions/{version}").filter("folder IS NOT NULL").collect()  # at most `buckets`
            self._known[version] = {r["bucket"]: r["folder"] for r in rows}
        return dict(self._known[version])

    def read(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        folders = [f for b, f in self.manifest(version).items() if buckets is None or b in buckets]
        if folders:
            return self.spark.read.schema(self.schema).parquet(*folders)
        return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]).filter(F.lit(False))  # known to be empty: joins with it go

    def touched(self, *keys: DataFrame) -> set[int]:
        """The buckets that rows with these `by` columns lie in."""
        return {r[0] for r in reduce(DataFrame.union, [df.select(self.bucket()) for df in keys]).distinct().collect()} if keys else set()  # at most `buckets`

    def _name(self, folders: dict[int, str], parent: int, reason: str | None, number: int) -> int:
        rows = F.array(*[F.struct(F.lit(b).cast("int").alias("bucket"), F.lit(f).cast("string").alias("folder")) for b, f in sorted(folders.items()) or [(None, None)]])
        named = self.spark.range(0, 1, 1, 1).select(F.inline(rows), F.lit(parent).cast("long").alias("parent"), F.lit(reason).cast("string").alias("reason"))
        named.write.mode("errorifexists").parquet(f"{self.path}/versions/{number}")
        self._known[number] = dict(folders)
        return number

    def commit(self, put: DataFrame | None = None, gone: DataFrame | None = None, reason: str | None = None, number: int | None = None) -> int:
        """A new version with the rows of `put` in place of those with their keys, and without the keys of `gone`. Both are read twice.

        With a `number` (of a micro-batch, say) a version that is there already is left as it is, so that a repeated batch changes nothing.
        """
        parent = self.latest()
        if number is not None and number <= parent:
            return number
        changes = [df for df in (put, gone) if df is not None]
        old, at = self.manifest(parent), self.touched(*changes)
        kept = self.read(parent, at)
        if changes:
            kept = kept.join(reduce(DataFrame.union, [df.select(*self.key) for df in changes]), self.key, "left_anti")
        names = self.schema.fieldNames()
        rows = kept.select(*names) if put is None else kept.select(*names).unionByName(put.select(*names))
        folder = f"{self.path}/rows/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self.bucket()).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(folder)
        new = {int(n.split("=")[1]): f"{folder}/{n}" for n in self._names(folder) if n.startswith("_bucket=")}
        return self._name({b: f for b, f in old.items() if b not in at} | new, parent, reason, parent + 1 if number is None else number)

    def copy(self, version: int | None = None, reason: str | None = None) -> int:
        """A version (the newest by default) as a new one: a manifest only."""
        parent = self.latest() if version is None else version
        return self._name(self.manifest(parent), parent, reason, self.latest() + 1)

    def history(self) -> DataFrame:
        """version, parent, reason, buckets, shared: how many of its folders its parent has too."""
        rows = []
        for n in self.numbers():
            first = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/versions/{n}").select("parent", "reason").first()
            own, before = self.manifest(n), self.manifest(first["parent"]) if first["parent"] in {0, *self.numbers()} else {}
            rows.append((n, first["parent"], first["reason"], len(own), len(set(own.values()) & set(before.values()))))
        return self.spark.createDataFrame(rows, "version long, parent long, reason string, buckets int, shared int")

    def changed(self, old: int, new: int) -> set[int]:
        """Buckets whose rows were written anew between two versions."""
        a, b = self.manifest(old), self.manifest(new)
        return {k for k in a.keys() | b.keys() if a.get(k) != b.get(k)}

    def diff(self, old: int, new: int, values: list[str]) -> DataFrame:
        """The key, status (added, removed, modified) and old_ and new_ values of rows that differ."""
        at = self.changed(old, new)
        return difference(self.read(old, at), self.read(new, at), self.key, values).filter("status <> 'unchanged'")

    def vacuum(self, keep: int = 2) -> int:
        """Delete all but the newest `keep` versions, and the folders that only those had; how many folders went."""
        numbers = self.numbers()
        stay = {f for n in numbers[-keep:] for f in self.manifest(n).values()}
        go = {f for n in numbers[:-keep] for f in self.manifest(n).values()} - stay
        for path in [*(f"{self.path}/versions/{n}" for n in numbers[:-keep]), *sorted(go)]:
            fs, p = self._path(path)
            fs.delete(p, True)
        self._known = {n: f for n, f in self._known.items() if n in numbers[-keep:]}
        return len(go)
