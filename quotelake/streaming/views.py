"""Aggregates that are kept up to date by deltas: sums and counts are added, a maximum is read again only where the row that held it goes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelake.operators.joins import latest
from quotelake.sources.versions import Versions

SIGN = "sign"


def delta(changes: DataFrame, key: list[str], sums: dict[str, str], most: dict[str, str]) -> DataFrame:
    """By key: n, the sums, and for each maximum the largest of the rows that come and of those that go. changes: rows with a `sign`, 1 or -1."""
    sign = F.col(SIGN)
    aggs = [F.sum(sign).alias("n"), *[F.sum(sign * F.col(c)).alias(n) for n, c in sums.items()]]
    for n, c in most.items():
        aggs += [F.max(F.when(sign > 0, F.col(c))).alias(f"{n}_in"), F.max(F.when(sign < 0, F.col(c))).alias(f"{n}_out")]
    return changes.groupBy(*key).agg(*aggs)


def refreshed(old: DataFrame, d: DataFrame, key: list[str], sums: dict[str, str], most: dict[str, str]) -> DataFrame:
    """The view's rows of the delta's keys, with `again`: a maximum went, or may have, and nothing as large came."""
    both = d.select(*key, *[F.col(c).alias(f"_{c}") for c in d.columns if c not in key]).join(old, key, "left")
    new = {c: F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"_{c}"), F.lit(0)) for c in ("n", *sums)}
    lost = F.lit(False)
    for n in most:
        out, come = F.col(f"_{n}_out"), F.col(f"_{n}_in")
        lost = lost | F.coalesce((out >= F.coalesce(F.greatest(n, come), out)) & ~F.coalesce(come > out, F.lit(False)), F.lit(False))
        new[n] = F.greatest(n, come)
    again = (lost & (new["n"] > 0)).alias("again")
    return both.select(*key, *[c.alias(n) for n, c in new.items()], again)


class View:
    """`table` (a Versions keyed by `key`, with columns n, those of `sums` and of `most`: name -> column of the rows) over the rows of `base` (a Versions with the view's key as `by`).

    Of several changes of a row in one batch, the last by `order` says whether it stays.
    """

    def __init__(self, table: Versions, base: Versions, sums: dict[str, str], most: dict[str, str], order: str):
        self.table, self.base, self.sums, self.most, self.order = table, base, sums, most, order

    def apply(self, changes: DataFrame, number: int) -> None:
        """One batch of changes (rows of `base` with a sign) into base and view. A repeated batch changes nothing."""
        key, spark = self.table.key, self.table.spark
        changes = changes.repartition(*self.base.key).persist()  # a row's changes lie together: they are grouped where they are
        try:
            names = self.base.schema.fieldNames()
            final = latest(changes, self.base.key, [F.desc(self.order), F.desc(SIGN)]).select(SIGN, *names).persist()
            self.base.commit(final.filter(f"{SIGN} > 0"), final.filter(f"{SIGN} < 0"), number=number)
            final.unpersist()
            if number <= self.table.latest():
                return
            d = delta(changes, key, self.sums, self.most).persist()
            new = refreshed(self.table.read(buckets=self.table.touched(d)), d, key, self.sums, self.most).persist()
            lost = new.filter("again").select(*key).persist()
            at = self.base.touched(lost)
            if at:  # the base lies by the view's key: only buckets of these keys are read
                rows = self.base.read(number, at).join(lost, key, "left_semi")
                most = rows.groupBy(*key).agg(*[F.max(c).alias(f"_{n}") for n, c in self.most.items()])
                right = new.join(most, key, "left").select(*key, "n", *self.sums, *[F.when(F.col("again"), F.col(f"_{n}")).otherwise(F.col(n)).alias(n) for n in self.most])
            else:
                right = new.drop("again")
            self.table.commit(right.filter("n > 0"), right.filter("n <= 0"), number=number)
            for x in (lost, new, d):
                x.unpersist()
        finally:
            changes.unpersist()
        self.base.vacuum()
        self.table.vacuum()


def maintained(stream: DataFrame, view: View, checkpoint: str) -> DataFrame:
    """Apply a stream of changes batch by batch; the view as it is then."""

    def put(batch: DataFrame, n: int) -> None:
        view.apply(batch, n + 1)

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return view.table.read()
