"""Catalogue tables of pipe dimensions: which column is what, by votes of all rows instead of by headers or places.

Columns vote in pairs, as a value in one unit stands beside the same value in another: millimetres and inches, kilograms per metre and pounds per foot,
nominal diameters and nominal sizes. Of the two pairs of lengths the larger is the outside diameter. The schedule is the column of schedule names that no
pair has taken. A table's votes are sums, counted in the tasks by batch, so its rows are never gathered; a row offers as many pairs as it has columns squared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quotelake.functions.sku_parts import given

# Nominal sizes in inches and their nominal diameters; ratios of units; names of schedules, and which of them have a pressure series.
DN = {
    0.125: 6, 0.25: 8, 0.375: 10, 0.5: 15, 0.75: 20, 1.0: 25, 1.25: 32, 1.5: 40, 2.0: 50, 2.5: 65, 3.0: 80, 3.5: 90, 4.0: 100, 5.0: 125, 6.0: 150, 8.0: 200, 10.0: 250, 12.0: 300, 14.0: 350, 16.0: 400,
    18.0: 450, 20.0: 500, 24.0: 600, 30.0: 750, 36.0: 900, 42.0: 1050, 48.0: 1200,
}
RATIOS, NAMES = {"length": 25.4, "weight": 1.488}, "^(STD|XS|XXS|[0-9]{1,3}S?)$"
SERIES = {"STD": "STD", "40": "STD", "40S": "STD", "XS": "XS", "80": "XS", "80S": "XS", "XXS": "XXS"}
#: How far a ratio may be off, which share of a table's rows has to agree.
OFF, SHARE = 0.01, 0.6
ROLES = ["nps", "dn", "od_in", "od_mm", "wall_in", "wall_mm", "weight_lb_ft", "weight_kg_m", "schedule"]


def number(cell: Column) -> Column:
    """A number in a cell: thousands' commas and inch marks don't count."""
    return F.regexp_replace(cell, '[," ]', "").try_cast("double")


def tallied(table: str):
    """Batches of table, numbers, names (whether a cell is a schedule's) -> votes of each batch by table, big, small and kind: a kind of pair, `name` or `row`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, cells = b.column(0).dictionary_encode(), b.column(1)
            code, counts = of.indices.to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(cells), 0).to_numpy(zero_copy_only=False)
            flat, width = cells.flatten(), int(counts.max(initial=0))
            row = np.repeat(np.arange(len(counts)), counts)
            at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            numbers, names = np.full((width, len(counts)), np.nan), np.zeros((width, len(counts)), bool)
            numbers[at, row] = flat.to_numpy(zero_copy_only=False)  # nulls as NaN, which agrees with nothing
            names[at, row] = pc.fill_null(b.column(2).flatten(), False).to_numpy(zero_copy_only=False)
            nominal = np.full_like(numbers, np.nan)
            for n, d in DN.items():
                nominal[numbers == n] = d
            out: list[tuple] = []

            def put(big: int, small: int, kind: str, yes: np.ndarray, value: np.ndarray | None = None) -> None:
                if yes.any():
                    n = np.bincount(code[yes], minlength=len(of.dictionary))
                    total = n if value is None else np.bincount(code[yes], value[yes], len(n))
                    out.extend((t, big, small, kind, n[t], total[t]) for t in n.nonzero()[0])

            put(0, 0, "row", np.bincount(row[flat.is_valid().to_numpy(zero_copy_only=False)], minlength=len(counts)) >= 2)
            for i in range(width):
                put(i, i, "name", names[i])
                for j in range(width):
                    with np.errstate(all="ignore"):
                        ratio, rest = numbers[i] / numbers[j], nominal[j] != numbers[i]
                    put(i, j, "nominal", ~rest, numbers[i])
                    for kind, r in RATIOS.items():
                        yes = rest & (np.abs(ratio / r - 1) <= OFF)
                        put(i, j, kind, yes, numbers[i])
                        rest &= ~yes
            if out:
                t, big, small, kind, n, total = zip(*out)
                tables = of.dictionary.take(pa.array(t, pa.int64()))
                yield pa.RecordBatch.from_arrays([tables, pa.array(big, pa.int32()), pa.array(small, pa.int32()), pa.array(kind), pa.array(n, pa.int64()), pa.array(total, pa.float64())], [table, "big", "small", "kind", "votes", "total"])

    return run


def votes(grid: DataFrame, table: str) -> DataFrame:
    """table, big, small, kind, votes, total: how many rows say that two columns hold one thing in two units, and the sum of the larger one; of kind `name`, in how many
    rows column `big` is a schedule, and of kind `row`, how many rows have two numbers. Cells are read once for all of these."""
    seen = grid.filter(F.col(table).isNotNull()).select(table, F.transform("cells", number).alias("numbers"), F.transform("cells", lambda c: F.upper(F.trim(c)).rlike(NAMES)).alias("names"))
    schema = T.StructType([grid.schema[table], *T._parse_datatype_string("big int, small int, kind string, votes long, total double").fields])
    return seen.mapInArrow(tallied(table), schema).groupBy(table, "big", "small", "kind").agg(F.sum("votes").alias("votes"), F.sum("total").alias("total"))


def columns_of(grid: DataFrame, table: str) -> DataFrame:
    """table and the place of each of ROLES, null where the rows don't agree on one. grid: table, cells array<string>, a row for each row; headers and empty rows don't matter."""
    rows = F.max(F.when(F.col("kind") == "row", F.col("votes"))).over(Window.partitionBy(table))
    agreed = votes(grid, table).withColumn("_rows", rows).filter((F.col("kind") != "row") & (F.col("votes") >= SHARE * F.col("_rows")))
    first = lambda x: F.struct(x, -F.col("big"), -F.col("small"))
    of = lambda k, order: F.max_by(F.when(F.col("kind") == k, F.struct("big", "small")), F.when(F.col("kind") == k, first(order)))
    mean = F.col("total") / F.col("votes")
    named = agreed.groupBy(table).agg(
        of("nominal", F.col("votes")).alias("nominal"), of("length", mean).alias("od"), of("length", -mean).alias("wall"), of("weight", F.col("votes")).alias("weight"), F.count_if(F.col("kind") == "length").alias("_lengths"),
        F.count_if(F.col("kind") != "name").alias("_pairs"), F.collect_list(F.when(F.col("kind") == "name", F.struct("votes", (-F.col("big")).alias("at")))).alias("_names"))
    wall = F.when(F.col("_lengths") > 1, F.col("wall"))
    taken = F.array_compact(F.array(*[F.col(f"{c}.{x}") for c in ("nominal", "od", "wall", "weight") for x in ("big", "small")]))
    schedule = -F.array_max(F.filter("_names", lambda x: ~F.array_contains(taken, -x["at"])))["at"]
    return named.filter("_pairs > 0").select(table, F.col("nominal.small").alias("nps"), F.col("nominal.big").alias("dn"), F.col("od.small").alias("od_in"), F.col("od.big").alias("od_mm"), wall["small"].alias("wall_in"), wall["big"].alias("wall_mm"),
        F.col("weight.small").alias("weight_lb_ft"), F.col("weight.big").alias("weight_kg_m"), schedule.alias("schedule"))


def dimensions(grid: DataFrame, table: str) -> DataFrame:
    """The rows of `grid` by role, with the pressure series of their schedule; rows without a nominal size are left out."""
    both = grid.join(columns_of(grid, table), table)
    cell = lambda r: F.get("cells", F.col(r))
    schedule = given(F.upper(F.trim(cell("schedule"))))
    series = F.try_element_at(F.create_map(*[F.lit(x) for kv in SERIES.items() for x in kv]), F.replace(schedule, F.lit(" "), F.lit("")))
    own = [c for c in grid.columns if c != "cells"]
    numbers = [number(cell(r)).alias(f"_{r}") for r in ROLES if r != "schedule"]
    out = both.select(*own, *numbers, schedule.alias("schedule"), series.alias("pressure_series")).filter("_nps IS NOT NULL")
    return out.select(*own, *[F.col(f"_{r}").alias(r) for r in ROLES if r != "schedule"], "schedule", "pressure_series")
