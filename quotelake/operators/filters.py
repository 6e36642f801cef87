"""Predicates and tenant-scoped scans."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, timedelta
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def day_range(ts: Column, start: str, end: str) -> Column:
    """Inclusive by calendar day."""
    return F.to_date(ts).between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))


def half_open(ts: Column, start: str, end: str) -> Column:
    return (ts >= F.to_timestamp_ntz(F.lit(start))) & (ts < F.to_timestamp_ntz(F.lit(end)))


def until_midnight(ts: Column, start: str, end: str) -> Column:
    """As a timestamp compared with a bare date: the last day counts at midnight only."""
    return (ts >= F.to_timestamp_ntz(F.lit(start))) & (ts <= F.to_timestamp_ntz(F.lit(end)))


def trailing(ts: Column, as_of: str, days: int) -> Column:
    """The `days` days before `as_of`, which is given and never the clock."""
    start = (date.fromisoformat(as_of) - timedelta(days)).isoformat()
    return half_open(ts, f"{start} 00:00:00", f"{as_of} 00:00:00")


def default_range(start: str | None, end: str | None, today: str) -> tuple[str, str]:
    """Valid dates as given; else today and 90 days before the end."""

    def valid(x):
        try:
            return date.fromisoformat(x)
        except (TypeError, ValueError):
            return None

    last = valid(end) or date.fromisoformat(today)
    return (valid(start) or last - timedelta(90)).isoformat(), last.isoformat()


def optional(predicates: Mapping[str, object]) -> Column:
    """Equality with each value that is given; no predicate where all are None."""
    given = [F.col(k) == v for k, v in predicates.items() if v is not None]
    return reduce(and_, given, F.lit(True))


def any_contains(columns: list[str], term: str) -> Column:
    """Case-insensitive search for a term in several columns; % and _ in it are plain."""
    return reduce(or_, [F.coalesce(F.contains(F.lower(c), F.lit(term.lower())), F.lit(False)) for c in columns])


def catalogue_search(df: DataFrame, term: str, columns: list[str], exact: Mapping[str, str]) -> DataFrame:
    """A term in any of `columns`, and each exact choice that isn't 'all'."""
    chosen = {k: v for k, v in exact.items() if v and v.lower() != "all"}
    return df.filter((any_contains(columns, term) if term else F.lit(True)) & optional(chosen))


def wildcard(column: str, value: Column, any_value: str | None = "ANY") -> Column:
    """A dimension that equals the value or stands for all."""
    c = F.col(column)
    return (c == value) | (c.isNull() if any_value is None else (c == any_value))


def valid_on(day: Column, start: str, end: str) -> Column:
    """start <= day, and end is open or not before the day."""
    return (F.col(start) <= day) & (F.col(end).isNull() | (F.col(end) >= day))


class TenantCatalog:
    """Tables as one tenant sees them: its own rows, and for shared tables the rows of nobody too."""

    def __init__(self, tables: Mapping[str, DataFrame], tenant: object, shared: frozenset[str] = frozenset(), column: str = "tenant_id"):
        if tenant is None:
            raise ValueError("a tenant is needed")
        self.tables, self.tenant, self.shared, self.column = tables, tenant, shared, column

    def table(self, name: str) -> DataFrame:
        own = F.col(self.column) == self.tenant
        return self.tables[name].filter(own | F.col(self.column).isNull() if name in self.shared else own)


def expiring(df: DataFrame, until: str, today: str, days: int) -> DataFrame:
    """Rows whose date lies between today and `days` later, with days_left: what a job that runs once a day reports."""
    left = F.date_diff(F.col(until), F.lit(today).cast("date"))
    return df.withColumn("days_left", left).filter(F.col("days_left").between(0, days))
