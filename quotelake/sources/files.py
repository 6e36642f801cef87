"""Readers and writers of files: price lists, sheets, page texts, dimension tables, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.operators.sinks import blank_to_null, flat
from quotelake.sources.sheets import SheetSource

PRICE_COLUMNS = ("material_code", "base_cost", "currency", "effective_date", "notes", "source")


def read_prices(spark: SparkSession, path: str, required: tuple[str, ...] = ("material_code", "base_cost")) -> DataFrame:
    """A CSV of prices: trimmed, blanks and costs that are no numbers as null, rows that are empty left out, lines that don't parse kept in _corrupt_record."""
    head = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path).columns
    if missing := [c for c in required if c not in head]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    schema = ", ".join(f"`{c}` string" for c in [*head, "_corrupt_record"])
    raw = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    out = blank_to_null(raw)
    out = out.withColumns({c: F.col(c).try_cast("double") for c in ("base_cost", "price") if c in head})
    return out.dropna("all", subset=head)


def write_prices(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).option("quoteAll", True).csv(path)


def export_flat(df: DataFrame, path: str) -> None:
    """Nested rows as one CSV line each, everything quoted."""
    flat(df).write.mode("errorifexists").option("header", True).option("quoteAll", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def read_sheets(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """path, sheet, row (from 1), cells array<string> of all .xlsx files: a partition for each sheet. first: only rows up to this one are looked for, as for headers."""
    spark.dataSource.register(SheetSource)
    reader = spark.read.format("sheets")
    return (reader.option("first", first) if first else reader).load(path)


def write_sheets(df: DataFrame, path: str, mode: str = "append") -> None:
    """sheet, row, cells as .xlsx files: one for each partition that has rows, sheets by name."""
    df.sparkSession.dataSource.register(SheetSource)
    df.select(F.lit("").alias("path"), "sheet", F.col("row").cast("int").alias("row"), "cells").sortWithinPartitions("sheet", "row").write.format("sheets").mode(mode).save(path)


def keyed_sheets(sheets: DataFrame, words: list[str], first: int = 20, tops: DataFrame | None = None) -> DataFrame:
    """path, sheet, title, row, cells map<header, text>: the rows below each sheet's header row with what its first cell above says; sheets without a header are left out.

    tops: the rows up to `first` of the same sheets, where they can be read without the others; else every sheet is read for its header too.
    """
    s = sheets.select("path", "sheet", "row", "cells")
    t = s.filter(F.col("row") <= first) if tops is None else tops.select("path", "sheet", "row", "cells")
    at = header_row(t, words, first).withColumnRenamed("row", "_at")
    known, below = (x.join(F.broadcast(at), ["path", "sheet"]) for x in (t, s))  # a row for each sheet, as in the reader's partitions
    own = known.filter(F.col("row") == F.col("_at")).select("path", "sheet", F.transform("cells", lambda c: F.lower(F.trim(c))).alias("_heads"))
    above = known.filter(F.col("row") < F.col("_at")).groupBy("path", "sheet").agg(F.min_by(F.get("cells", F.lit(0)), "row").alias("title"))
    below = below.filter(F.col("row") > F.col("_at")).join(F.broadcast(own), ["path", "sheet"]).join(F.broadcast(above), ["path", "sheet"], "left")
    named = F.zip_with("_heads", "cells", lambda h, c: F.struct(h.alias("key"), c.alias("value")))
    cells = F.map_from_entries(F.filter(named, lambda e: (F.coalesce(e["key"], F.lit("")) != "") & e["value"].isNotNull()))
    return below.select("path", "sheet", "title", "row", cells.alias("cells"))


def header_row(sheets: DataFrame, words: list[str], first: int = 20) -> DataFrame:
    """path, sheet, row: the first of a sheet's first rows with two of the words."""
    hits = sum(F.exists("cells", _holds(w)).cast("int") for w in words)
    return sheets.filter((F.col("row") <= first) & (hits >= 2)).groupBy("path", "sheet").agg(F.min("row").alias("row"))


def _holds(word: str):
    return lambda c: F.contains(F.lower(c), F.lit(word))


def page_range(text: Column, first: Column, last: Column, n_pages: Column) -> Column:
    """The text of pages `first` to `last`: between --- PAGE n --- marks where there are any, else by share of the characters."""
    parts = F.split(text, r"--- PAGE [0-9]+ ---\n?")
    marked = F.array_join(F.slice(parts, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    length = F.length(text)
    start = F.floor(length * (first - 1) / n_pages)
    cut = F.substr(text, (start + 1).cast("int"), (F.floor(length * last / n_pages) - start).cast("int"))
    return F.when(F.size(parts) > 1, marked).otherwise(cut)


def dimension_rows(cells: DataFrame, names: dict[str, int]) -> DataFrame:
    """Rows of a dimension table: named columns by place, numbers where they are numbers; rows without a first number are left out."""
    cols = [F.trim(F.get("cells", F.lit(i))).try_cast("double").alias(n) for n, i in names.items()]
    return cells.select(*[c for c in cells.columns if c != "cells"], *cols).filter(F.col(next(iter(names))).isNotNull())
