"""Money and ratio expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return a / F.nullif(b, F.lit(0).cast("double"))


def margin_on_cost(price: Column, cost: Column) -> Column:
    """(price - cost) / cost: what the analytics call margin."""
    return safe_div(price - cost, cost)


def percent_change(now: Column, before: Column) -> Column:
    """In per cent to one place; 0 where there was nothing before."""
    return F.coalesce(F.round(100 * safe_div(now - before, before), 1), F.lit(0.0))


def nearest(x: Column, step: float) -> Column:
    """To the nearest multiple of `step`, halves up."""
    return F.floor(x / step + 0.5) * step


def bucket(x: Column, bounds: list[tuple[float, str]], other: str) -> Column:
    """The label of the first bound that x is less than; `other` for the rest and for null."""
    return reduce(lambda c, b: c.when(x < b[0], b[1]), bounds, F).otherwise(other)


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def sum_if(cond: Column, x: Column) -> Column:
    """0 where no row meets the condition."""
    return F.coalesce(F.sum(F.when(cond, x)), F.lit(0.0))
