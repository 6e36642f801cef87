"""Extracted tables: whether their headers are headers, how well they fit a list of items, and what their columns are for."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelake.functions.text import once

# Words of header groups, points, limits and patterns.
GROUPS = {
    "item": ["item", "no", "#", "number", "line", "line no", "line number"],
    "description": ["desc", "description", "descriptions", "item description", "detail", "specification of goods"],
    "quantity": ["qty", "quantity", "qty unit", "round quantity", "quant"],
    "unit": ["unit", "uom", "unit of measure"],
    "weight": ["weight", "total weight"],
    "dimension": ["length", "width", "thickness", "size", "dia", "od", "id"],
    "material": ["material", "grade", "spec"],
    "total": ["total", "amount"],
    "shipment": ["shipment", "batch", "delivery"],
    "revision": ["rev", "revision", "date", "approved", "prepared", "checked", "verified", "sign", "signature", "approved by"],
    "inspection": ["witness", "hold", "inspect", "inspection", "test", "report", "qc", "qa"],
    "remarks": ["remarks", "comment"],
}
REJECTED = ["vendor", "vdrl", "data requirement", "document list", "document no", "document number", "document title", "document code"]
POINTS = {
    "item": 40, "description": 30, "quantity": 30, "unit": 15, "weight": 10, "dimension": 8, "material": 8, "total": 5, "shipment": 5, "revision": -35, "inspection": -25, "remarks": -10,
    "few headers": -20, "several groups": 15, "sparse rows": -20, "numbered items": 10, "items in spite of revisions": 50, "none": -100,
}
CORE, LEAST_HEADERS, ACCEPT = ("item", "description", "quantity", "unit"), 3, 45
DATE = r"^[0-9]{1,2}\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\s+[0-9]{2,4}$|^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}$"
NAME = r"^[A-ZÀ-ɏ][a-zÀ-ɏ]+(\s+[A-ZÀ-ɏ][a-zÀ-ɏ]+)+$"
KEYWORDS = {
    "item": ["item", "no", "number", "line", "line no", "line number", "item no", "#", "pos"],
    "description": ["description", "desc", "detail", "material", "item description", "specification", "spec", "material description"],
    "quantity": ["qty", "quantity", "quant", "pcs", "round quantity", "total quantity", "nett quantity", "net quantity"],
    "unit": ["unit", "uom", "unit of measure", "u.o.m"],
}
LEAST_SCORE, STARTS = 0.6, 0.8
#: Layouts of headers that are broadcast.
MOST_LAYOUTS = 20_000
#: Behind all columns.
NOWHERE = 1 << 30


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def cell(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def normal(h: Column) -> Column:
    """A header in lower case, without punctuation, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(cell(h)), r"""[.,;:!?'"()\[\]{}]""", ""), r"\s+", " "))


def holds(h: Column, words: list[str]) -> Column:
    return any_of(F.contains(h, F.lit(w)) for w in words)


def some_hold(headers: Column, words: list[str]) -> Column:
    return F.exists(headers, lambda h: holds(h, words))


def looks_like_data(headers: Column) -> Column:
    """Over 30 % dates, over half numbers of two digits or more, or names of people beside dates or numbers; or nothing at all."""
    c = F.filter(F.transform(F.coalesce(headers, F.array().cast("array<string>")), cell), lambda x: x != "")
    of = lambda f: F.size(F.filter(c, f))
    dates, numbers = of(lambda x: F.lower(x).rlike(DATE)), of(lambda x: x.rlike("^[0-9]{2,}$"))
    names = of(lambda x: x.rlike(NAME) & ~F.lower(x).rlike(DATE))
    return (F.size(c) == 0) | (dates > 0.3 * F.size(c)) | (numbers > 0.5 * F.size(c)) | ((names > 0) & (dates + numbers > 0))


def by_layout(df: DataFrame, headers: str, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`df` with the columns that `made` adds to a frame of its distinct headers. Layouts are counted first: up to MOST_LAYOUTS are broadcast, more are joined by a shuffle."""
    each = df.select(headers).distinct()
    few = each.limit(MOST_LAYOUTS + 1).count() <= MOST_LAYOUTS
    right = made(each).withColumnRenamed(headers, "_layout")
    return df.join(F.broadcast(right) if few else right, F.col(headers).eqNullSafe(F.col("_layout")), "left").drop("_layout")


def header_points(headers: Column) -> Column:
    """struct<points, at, item, is_data, none>: what headers alone say; `at`: the first column of items, from 1, 0 for none."""

    def told(n: Column) -> Column:
        has = {g: some_hold(n, w) for g, w in GROUPS.items()}
        at = F.array_position(F.transform(n, lambda h: holds(h, GROUPS["item"])), True)
        named = cell(F.get(headers, (at - 1).cast("int")))
        has["item"] = has["item"] & ~(named.rlike("^[0-9]+$") | F.lower(named).rlike(DATE))
        more = {
            "few headers": F.size(headers) < LEAST_HEADERS, "several groups": sum((has[g].cast("int") for g in CORE), F.lit(0)) >= 2,
            "items in spite of revisions": has["item"] & has["quantity"] & has["revision"] & any_of(has[g] for g in ("description", "material", "dimension")),
        }
        total = sum((F.when(yes, POINTS[g]).otherwise(0) for g, yes in (has | more).items()), F.lit(0))
        is_data = looks_like_data(headers)
        return F.struct(total.alias("points"), at.alias("at"), has["item"].alias("item"), is_data.alias("is_data"), (is_data | some_hold(n, REJECTED)).alias("none"))

    return once(F.transform(headers, normal), told)


def points(header: Column, rows: Column) -> Column:
    """Points of a table by its header_points and its rows array<array<string>>."""
    some = F.size(rows) > 0
    sparse = some & (2 * F.size(F.filter(rows, lambda r: F.size(F.filter(r, lambda c: cell(c) != "")) <= 1)) > F.size(rows))
    numbered = header["item"] & F.exists(rows, lambda r: F.coalesce(F.get(r, (header["at"] - 1).cast("int")).rlike(r"^\s*\+?0*[1-9]"), F.lit(False)))
    more = {"sparse rows": sparse, "numbered items": numbered}
    return F.when(header["none"], POINTS["none"]).otherwise(sum((F.when(yes, POINTS[g]).otherwise(0) for g, yes in more.items()), header["points"]))


def score(headers: Column, rows: Column) -> Column:
    """Points of a table with headers array<string> and rows array<array<string>>; -100 where it is none of items. ACCEPT or more is a table of items."""
    return once(header_points(headers), lambda h: points(h, rows))


def scored(df: DataFrame, headers: str, rows: str) -> DataFrame:
    """`df` with score and is_data of each table; what headers say is found once for each layout."""
    known = by_layout(df, headers, lambda e: e.withColumn("_header", header_points(F.col(headers))))
    return known.withColumns({"score": points(F.col("_header"), F.col(rows)), "is_data": F.col("_header.is_data")}).drop("_header")


def starts(keywords: list[str]) -> list[str]:
    """What a word of a header has to begin with to stand for a keyword: most of one of its words."""
    return sorted({w[: max(3, len(w) - 2)] for k in keywords for w in k.split()})


def fit(h: Column, keywords: list[str]) -> Column:
    """1 where a header contains a keyword; else the better of 0.8, if a word of it begins like a keyword, and the similarity, from 0.6 on; else 0."""

    def told(t: Column) -> Column:
        alike = F.greatest(*[1 - F.levenshtein(t, F.lit(k)) / F.greatest(F.length(t), F.lit(len(k))) for k in keywords])
        begins = F.exists(F.split(t, r"\s+"), lambda w: any_of(F.startswith(w, F.lit(p)) for p in starts(keywords)))
        best = once(alike, lambda x: F.greatest(F.when(begins, STARTS).otherwise(0.0), F.when(x >= LEAST_SCORE, x).otherwise(0.0)))
        return F.when(t == "", 0.0).when(holds(t, keywords), 1.0).otherwise(best)

    return once(F.lower(cell(h)), told)


def fits(headers: Column) -> Column:
    """array<struct<item, description, quantity, unit>>: how well each header fits each role."""
    return F.transform(headers, lambda h: F.struct(*[fit(h, k).alias(r) for r, k in KEYWORDS.items()]))


def first_fits(fitted: Column) -> Column:
    """struct of the first column (from 0) of each role, null where none fits, and the confidence: 0.4 for each of description and quantity, 0.1 for each of item and unit."""
    fitting = lambda r: F.transform(fitted, lambda f: f[r] >= LEAST_SCORE)
    at = {r: F.nullif(F.array_position(fitting(r), True), F.lit(0)) - 1 for r in KEYWORDS}
    tenths = sum(((4 if r in ("description", "quantity") else 1) * at[r].isNotNull().cast("int") for r in KEYWORDS), F.lit(0))
    return F.struct(*[c.cast("int").alias(r) for r, c in at.items()], (tenths / 10).alias("confidence"))


def best_assignment(df: DataFrame, fitted: str) -> DataFrame:
    """`df` with assigned struct<item, description, quantity, unit, total>: each column for one role at most, with the best total fit; of equal totals, roles in their order take the
    first columns. A role without a column that fits is null.

    `fitted`: see fits. An assignment of r roles needs only the r best columns of each role, so choices are made among at most r ** 2 pairs, whatever the width.
    """
    roles = list(KEYWORDS)
    top = lambda r: F.slice(F.array_sort(F.filter(F.transform(fitted, lambda f, i: F.struct((-f[r]).alias("worse"), i.alias("at"))), lambda x: x["worse"] <= -LEAST_SCORE)), 1, len(roles))
    tops = df.select("*", F.struct(*[top(r).alias(r) for r in roles]).alias("_tops"))
    options = [ks for ks in product([*range(len(roles)), None], repeat=len(roles)) if any(k is not None for k in ks)]
    rows = ",".join("{" + ",".join(f'"{r}":{k}' for r, k in zip(roles, ks) if k is not None) + "}" for ks in options)
    table = F.from_json(F.lit(f"[{rows}]"), f"array<struct<{', '.join(f'{r}:int' for r in roles)}>>")  # choices as data: the expression stays small

    def made(o: Column) -> Column:
        at = {r: F.when(o[r].isNotNull(), F.get(F.col(f"_tops.{r}"), o[r])) for r in roles}
        used = F.array_compact(F.array(*[x["at"] for x in at.values()]))
        asked = sum((o[r].isNotNull().cast("int") for r in roles), F.lit(0))
        worse = F.round(sum((F.coalesce(x["worse"], F.lit(0.0)) for x in at.values()), F.lit(0.0)), 9)
        ok = (F.size(used) == asked) & (F.size(F.array_distinct(used)) == asked)
        return F.when(ok, F.struct(worse.alias("worse"), *[F.coalesce(x["at"], F.lit(NOWHERE)).alias(r) for r, x in at.items()]))

    best = F.array_min(F.array_compact(F.transform(table, made)))
    assigned = F.struct(*[F.when(best[r] < NOWHERE, best[r]).cast("int").alias(r) for r in roles], F.coalesce(-best["worse"], F.lit(0.0)).alias("total"))
    return tops.select(*df.columns, assigned.alias("assigned"))


def best_tables(scored: DataFrame, doc: str, table: str, points: str) -> DataFrame:
    """The best accepted table of each document, the first of equal ones; documents without one have no row."""
    best = F.max_by(F.struct(table, points), F.struct(F.col(points), -F.col(table))).alias("_best")
    return scored.filter(F.col(points) >= ACCEPT).groupBy(doc).agg(best).select(doc, f"_best.{table}", f"_best.{points}")
