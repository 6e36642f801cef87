"""Pages, tables and line items of documents: chunks, page choice, table scores, merging across chunks, repairs and checks."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quotelake.functions import text as tx
from quotelake.operators.tables import by_layout


def pages(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, page (from 1), text: cut at form feeds."""
    return docs.select(doc, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\f")).alias("page", "text")).withColumn("page", F.col("page") + 1)


def chunks(n_pages: Column, size: int = 4, overlap: int = 1, most: int | None = None, limit: int = 200) -> Column:
    """array<struct<first, last>>: one chunk up to 3 pages; else `size` pages each, with `overlap`, the first `most` chunks if that is given; null beyond `limit` pages."""
    step = size - overlap
    many = F.transform(F.sequence(F.lit(1), n_pages, F.lit(step)), lambda s: F.struct(s.alias("first"), F.least(s + (size - 1), n_pages).alias("last")))
    one = F.array(F.struct(F.lit(1).alias("first"), n_pages.alias("last")))
    return F.when(n_pages > limit, None).when(n_pages <= 3, one).otherwise(many if most is None else F.slice(many, 1, most))


def with_neighbours(hits: DataFrame, doc: str, page: str, n_pages: str, before: int = 2, after: int = 2) -> DataFrame:
    """doc, page: the pages that were hit and those around them, inside the document."""
    around = F.sequence(F.greatest(F.col(page) - before, F.lit(1)), F.least(F.col(page) + after, F.col(n_pages)))
    return hits.select(doc, F.explode(around).alias(page)).distinct()


def sampled_then_dense(scored: DataFrame, doc: str, page: str, score: str, every: int = 5, least: float = 20.0) -> DataFrame:
    """Every fifth page is looked at; all pages from the first hit to the last are kept."""
    looked = scored.filter((F.col(page) % every == 1) & (F.col(score) >= least)).groupBy(doc).agg(F.min(page).alias("_a"), F.max(page).alias("_b"))
    return scored.join(looked, doc).filter(F.col(page).between(F.col("_a"), F.col("_b"))).drop("_a", "_b")


#: Table score: points of header groups that are there, and of others that speak against a table of items.
GROUPS = {
    "item": (["item", "no", "pos"], 40), "description": (["desc"], 30), "quantity": (["qty", "quantity"], 30), "unit": (["unit", "uom"], 15), "weight": (["weight", "kg"], 10),
    "dimension": (["size", "dimension"], 8), "material": (["material", "grade"], 8), "total": (["total"], 5), "shipment": (["shipment"], 5), "revision": (["revision", "rev."], -35),
    "inspection": (["inspection"], -25), "remarks": (["remarks"], -10),
}
CORE, REJECT, ACCEPT = ("item", "description", "quantity", "unit"), ("vendor", "document no"), 45


def looks_like_data(headers: Column) -> Column:
    return F.size(F.filter(headers, lambda h: h.rlike("^[0-9]{2,}$"))) * 2 > F.size(headers)


def header_points(headers: Column) -> Column:
    """struct<points, reject>: what headers alone say. Words count inside other words too."""

    def told(h: Column) -> Column:
        has = {g: reduce(lambda a, b: a | b, [F.exists(h, _contains(t)) for t in terms]) for g, (terms, _) in GROUPS.items()}
        points = reduce(lambda a, b: a + b, [F.when(has[g], p).otherwise(0) for g, (_, p) in GROUPS.items()])
        core = reduce(lambda a, b: a + b, [has[g].cast("int") for g in CORE])
        reject = reduce(lambda a, b: a | b, [F.exists(h, _contains(t)) for t in REJECT]) | looks_like_data(headers)
        return F.struct((points - F.when(F.size(h) < 3, 20).otherwise(0) + F.when(core >= 2, 15).otherwise(0)).alias("points"), reject.alias("reject"))

    return tx.once(F.transform(headers, tx.header), told)


def table_points(header: Column, rows: Column) -> Column:
    """The score of a table by its header_points and its rows."""
    sparse = tx.once(F.flatten(rows), lambda cells: F.size(F.filter(cells, lambda c: F.coalesce(F.trim(c), F.lit("")) == "")) * 2 > F.size(cells))
    numeric = F.exists(rows, lambda r: F.get(r, 0).rlike("^[0-9]+$"))
    return F.when(header["reject"], -100).otherwise(header["points"] - F.when(sparse, 20).otherwise(0) + F.when(numeric, 10).otherwise(0))


def table_score(headers: Column, rows: Column) -> Column:
    """Headers array<string>, rows array<array<string>>; -100 for what is no table of items."""
    return tx.once(header_points(headers), lambda h: table_points(h, rows))


def scored_tables(df: DataFrame, headers: str, rows: str) -> DataFrame:
    """`df` with score; what headers say is found once for each layout."""
    known = by_layout(df, headers, lambda e: e.withColumn("_header", header_points(F.col(headers))))
    return known.withColumn("score", table_points(F.col("_header"), F.col(rows))).drop("_header")


def _contains(term: str):
    return lambda x: F.contains(x, F.lit(term))


def best_table(tables: DataFrame, doc: str, index: str, score: str) -> DataFrame:
    """The best table of each document that is accepted; the first of equal ones."""
    w = Window.partitionBy(doc).orderBy(F.desc(score), index)
    return tables.filter(F.col(score) >= ACCEPT).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def islands(items: DataFrame, key: list[str], chunk: str) -> DataFrame:
    """`items` with island: rows of a key whose chunks lie at most one apart belong together, and so on along the chain."""
    w = Window.partitionBy(*key).orderBy(chunk)
    gap = F.when(F.col(chunk) - F.lag(chunk).over(w) <= 1, 0).otherwise(1)
    return items.withColumn("_gap", gap).withColumn("island", F.sum("_gap").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_gap")


def merged(items: DataFrame, key: list[str], chunk: str, texts: list[str], quantity: str, length: str, notes: str) -> DataFrame:
    """One row for each island: the first text that isn't empty, notes joined, the smaller plausible quantity, the larger length.

    Order is by chunk and then by the values, and every field is an aggregate, so that no group is handed to Python.
    """
    order = F.struct(chunk, *texts, quantity, length, notes)
    rows = items.withColumn("_o", order)
    first = [F.min(F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.struct(F.col(chunk), F.col(c)))).getField(c).alias(c) for c in texts]
    joined = F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_set(F.when(F.coalesce(F.trim(notes), F.lit("")) != "", F.struct(F.col(chunk), F.col(notes))))), lambda x: x[notes])), "; ")
    plausible = F.min(F.when(F.col(quantity) > 0, F.col(quantity)))
    return rows.groupBy(*key, "island").agg(*first, plausible.alias(quantity), F.max(length).alias(length), joined.alias(notes), F.count(F.lit(1)).alias("n_merged"))


def repaired_quantity(quantity: Column, length_m: Column, unit_kg: Column, total_kg: Column) -> Column:
    """struct<quantity, length_m, method>: a quantity that is really a length is swapped, or estimated from weights or 12 m pieces."""
    by_weight = F.floor(total_kg / F.nullif(unit_kg * F.coalesce(length_m, F.lit(1.0)), F.lit(0.0)) + 0.5)
    swap = (quantity > 100) & (length_m <= 20) & (F.floor(length_m) == length_m)
    same = (quantity == length_m) & (quantity > 12)
    return (
        F.when(swap, F.struct(length_m.alias("quantity"), quantity.alias("length_m"), F.lit("swap").alias("method")))
        .when(same & (by_weight >= 1), F.struct(by_weight.cast("double").alias("quantity"), length_m.alias("length_m"), F.lit("weight").alias("method")))
        .when(same, F.struct(F.ceil(length_m / 12).cast("double").alias("quantity"), length_m.alias("length_m"), F.lit("pieces").alias("method")))
        .otherwise(F.struct(quantity.alias("quantity"), length_m.alias("length_m"), F.lit("none").alias("method")))
    )


def keyed_rows(headers: Column, rows: Column) -> Column:
    """array<map<header, cell>> of the rows that aren't all empty; cells without a header are column_i."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    names = F.transform(F.sequence(F.lit(0), F.greatest(width, F.lit(1)) - 1), lambda i: F.coalesce(F.nullif(F.trim(F.get(headers, i)), F.lit("")), F.concat(F.lit("column_"), i.cast("string"))))
    full = F.filter(rows, lambda r: F.exists(r, lambda c: F.coalesce(F.trim(c), F.lit("")) != ""))
    return F.transform(full, lambda r: F.map_from_entries(F.transform(F.sequence(F.lit(0), F.size(r) - 1), lambda i: F.struct(F.get(names, i), F.get(r, i)))))


def carried_down(rows: DataFrame, key: str, order: str, is_section: Column, label: str, out: str) -> DataFrame:
    """Rows that aren't section lines, with the last section above them."""
    last = F.last(F.when(is_section, F.col(label)), ignorenulls=True).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn(out, last).filter(~is_section)


def warnings(checks: dict[str, Column]) -> Column:
    """array<string> of the checks that fail; null counts as not failing."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))


def confidence(weights: dict[str, float]) -> Column:
    """Weights of the fields that have a value, summed."""
    return reduce(lambda a, b: a + b, [F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "", w).otherwise(0.0) for c, w in weights.items()])


def weight_checks(items: DataFrame, section: str, sub: str, stated: str, computed: str, tolerance: tuple[float, float, float] = (0.01, 0.1, 0.5)) -> DataFrame:
    """level, name, off: stated and computed weights by item, subsection and section, with a tolerance for each."""
    off = lambda a, b, t: F.abs(a - b) > t
    item = items.agg(F.lit("item").alias("level"), F.lit("all").alias("name"), F.count(F.when(off(F.col(stated), F.col(computed), tolerance[0]), 1)).alias("off"))
    out = item
    for level, keys, t in (("subsection", [section, sub], tolerance[1]), ("section", [section], tolerance[2])):
        s = items.groupBy(*keys).agg(F.sum(stated).alias("_s"), F.sum(computed).alias("_c"))
        out = out.unionByName(s.select(F.lit(level).alias("level"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("name"), off(F.col("_s"), F.col("_c"), t).cast("long").alias("off")))
    return out
