"""Line items and catalogues: trees, keys, classification by rule tables, weights, compliance, order texts, tables by page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelake.functions import parse
from quotelake.operators.joins import latest


def flattened(docs: DataFrame, tree: str, keep: list[str]) -> DataFrame:
    """One row for each item of sections array<struct<section_id, subsections array<struct<subsection_id, items array<struct>>>>>; empty levels keep one row."""
    a = docs.select(*keep, F.explode_outer(tree).alias("s"))
    b = a.select(*keep, F.col("s.section_id").alias("section_id"), F.explode_outer("s.subsections").alias("u"))
    c = b.select(*keep, "section_id", F.col("u.subsection_id").alias("subsection_id"), F.explode_outer("u.items").alias("i"))
    return c.select(*keep, "section_id", "subsection_id", "i.*")


def item_key(line: Column, kind: Column, text: Column) -> Column:
    """line|kind|dimension or the first 50 characters|numeral of a TYPE."""
    u = F.upper(F.coalesce(text, F.lit("")))
    size = F.nullif(F.regexp_extract(u, r"([0-9.]+\s*[X×]\s*[0-9.]+(?:\s*[X×]\s*[0-9.]+)?)", 1), F.lit(""))
    numeral = F.nullif(F.regexp_extract(u, r"\bTYPE\s+([IVX]+|[0-9]+)\b", 1), F.lit(""))
    return F.concat_ws("|", F.coalesce(line.cast("string"), F.lit("")), F.coalesce(kind, F.lit("")), F.coalesce(F.regexp_replace(size, r"\s", ""), F.left(u, F.lit(50))), F.coalesce(numeral, F.lit("")))


def classified(df: DataFrame, text: str, rules: DataFrame, key: list[str], out: str) -> DataFrame:
    """`df` with the label of the first rule (by its rank) whose keyword stands in the text; none: null.

    rules: keyword, label, rank, a small table that is broadcast by the optimiser.
    """
    hit = F.contains(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lower("keyword"))
    found = latest(df.select(*key, text).distinct().join(rules, hit).select(*key, F.col("label").alias(out), "rank"), key, [F.asc("rank")]).drop("rank")
    return df.join(found, key, "left")


def domain_relevance(text: Column, points: dict[str, int]) -> Column:
    """Points of the words that stand in a text as words; relevant from 16 on."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a + b, [F.when(low.rlike(rf"\b{re.escape(w)}\b"), p).otherwise(0) for w, p in points.items()])


def pipe_weights(items: DataFrame, pipes: DataFrame) -> DataFrame:
    """`items` (dn, nps, schedule) with kg_per_m: by DN and schedule first, else by size in inches; preferred entries first."""
    order = [F.desc("is_preferred"), F.coalesce(F.col("schedule").try_cast("int"), F.lit(999)).asc(), F.asc("kg_per_m")]
    by_dn = latest(pipes.filter("dn IS NOT NULL"), ["dn", "schedule"], order).select("dn", "schedule", F.col("kg_per_m").alias("_dn_kg"))
    by_nps = latest(pipes.filter("nps IS NOT NULL"), ["nps", "schedule"], order).select("nps", "schedule", F.col("kg_per_m").alias("_nps_kg"))
    out = items.join(by_dn, ["dn", "schedule"], "left").join(by_nps, ["nps", "schedule"], "left")
    return out.withColumn("kg_per_m", F.coalesce("_dn_kg", "_nps_kg")).drop("_dn_kg", "_nps_kg")


def compliance(items: DataFrame, rules: DataFrame) -> DataFrame:
    """`items` (operator, origin, certificates, vendor) with blocking and advisory arrays and compliant.

    rules: operator, banned_origins, needed_certificates, approved_vendors (null: any), one row for each operator.
    """
    out = items.join(rules, "operator", "left")
    none = F.array().cast("array<string>")
    missing = F.array_except(F.coalesce("needed_certificates", none), F.coalesce("certificates", none))
    blocking = F.concat(
        F.array_compact(F.array(F.when(F.array_contains("banned_origins", F.col("origin")), F.concat(F.lit("origin "), "origin")))), F.transform(missing, lambda c: F.concat(F.lit("certificate "), c))
    )
    advisory = F.array_compact(F.array(F.when(F.col("approved_vendors").isNotNull() & ~F.coalesce(F.array_contains("approved_vendors", F.col("vendor")), F.lit(False)), F.lit("vendor not listed"))))
    out = out.withColumns({"blocking": F.coalesce(blocking, none), "advisory": F.coalesce(advisory, none)})
    return out.withColumn("compliant", F.size("blocking") == 0).drop("banned_origins", "needed_certificates", "approved_vendors")


def pipe_sku(nps: Column, schedule: Column, standard: Column, grade: Column) -> Column:
    """PIPE-<size>-S<schedule>-<standard>-<grade>; null without size or schedule."""
    return F.concat(F.lit("PIPE-"), parse.size_code(nps), F.lit("-S"), schedule, F.lit("-"), F.coalesce(standard, F.lit("XX")), F.lit("-"), F.coalesce(grade, F.lit("XX")))


def flange_sku(nps: Column, rating: Column, face: Column, standard: Column) -> Column:
    return F.concat(F.lit("FLG-"), parse.size_code(nps), F.lit("-R"), rating.cast("string"), F.lit("-"), F.coalesce(face, F.lit("RF")), F.lit("-"), F.coalesce(standard, F.lit("XX")))


def fitting_sku(shape: Column, angle: Column, nps: Column, schedule: Column) -> Column:
    return F.concat(F.lit("FIT-"), shape, F.coalesce(F.concat(F.lit("-A"), angle.cast("string")), F.lit("")), F.lit("-"), parse.size_code(nps), F.lit("-S"), schedule)


def sku_fields(sku: Column) -> Column:
    """struct<kind, size, schedule, rating, angle> of a pipe, flange or fitting SKU."""
    part = lambda p: F.nullif(F.regexp_extract(sku, p, 1), F.lit(""))
    size = F.replace(F.coalesce(part(r"^(?:PIPE|FLG)-([0-9_]+)"), part(r"^FIT-[A-Z]+(?:-A[0-9]+)?-([0-9_]+)")), F.lit("_"), F.lit(".")).cast("double")
    return F.struct(part(r"^(PIPE|FLG|FIT)-").alias("kind"), size.alias("size"), part(r"-S([0-9A-Z]+)").alias("schedule"), part(r"-R([0-9]+)").cast("int").alias("rating"), part(r"-A([0-9]+)").cast("int").alias("angle"))


def related_tables(tables: DataFrame, doc: str, index: str, page: str, headers: str, least: float = 0.6, pages: int = 2) -> DataFrame:
    """doc, index, group: tables whose headers agree (Jaccard) with an earlier one at most `pages` pages before, chained to the first.

    A table sees those of its page and the pages before it through one window, so that tables are neither multiplied nor joined, and a document
    of many tables isn't compared as a whole.
    """
    t = tables.select(doc, index, page, F.transform(F.filter(headers, lambda h: h.isNotNull()), lambda h: F.lower(F.trim(h))).alias("_h"))
    near = F.collect_list(F.struct(F.col(index).alias("at"), F.col("_h").alias("h"))).over(Window.partitionBy(doc).orderBy(page).rangeBetween(-pages, 0))

    def share(h: Column) -> Column:
        jaccard = F.size(F.array_intersect(h, "_h")) / F.nullif(F.size(F.array_union(h, "_h")), F.lit(0)).cast("double")
        return F.when((h == F.col("_h")) & (F.size(h) > 0), 1.0).otherwise(jaccard)

    agree = F.filter("_near", lambda o: (o["at"] < F.col(index)) & (share(o["h"]) >= least))
    before = F.when(F.col(doc).isNotNull() & F.col(page).isNotNull(), F.array_max(F.transform(agree, lambda o: o["at"])))
    found = t.withColumn("_near", near).select(doc, index, before.alias("_before"))
    # a table follows the nearest earlier one that it agrees with; a new group begins where there is none
    w = Window.partitionBy(doc).orderBy(index)
    new = F.max("_before").over(Window.partitionBy(doc, index)).isNull()
    return found.withColumn("_new", new.cast("int")).select(doc, index, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("group"))


def merged_rows(rows: DataFrame, doc: str, group: str, key: list[str], cells: str) -> DataFrame:
    """Of rows with one key in a group, the one with the most filled cells."""
    filled = F.size(F.filter(cells, lambda c: F.coalesce(F.trim(c), F.lit("")) != ""))
    return latest(rows.withColumn("_filled", filled), [doc, group, *key], [F.desc("_filled"), F.asc(cells)]).drop("_filled")


def tables_in_range(tables: DataFrame, ranges: DataFrame, doc: str, page: str, first: str, last: str, margin: int = 2) -> DataFrame:
    """The tables that lie in a chunk's pages, or a few pages around them."""
    pages = ranges.withColumn(page, F.explode(F.sequence(F.greatest(F.col(first) - margin, F.lit(1)), F.col(last) + margin)))
    return tables.join(pages, [doc, page])


def reindexed(tables: DataFrame, doc: str, chunk: str, index: str, out: str) -> DataFrame:
    """Running numbers of tables over a document's chunks."""
    return tables.withColumn(out, F.row_number().over(Window.partitionBy(doc).orderBy(chunk, index)) - 1)


def document_checks(items: DataFrame, doc: str, n_rows: str, quantity: str, description: str) -> DataFrame:
    """doc, n_items, no_quantity, coverage, review: items without a quantity or description are critical; under 80 % of 10 rows or more needs review."""
    bad = F.col(quantity).isNull() | (F.coalesce(F.trim(F.col(description)), F.lit("")) == "")
    s = items.groupBy(doc).agg(F.count(F.lit(1)).alias("n_items"), F.count(F.when(bad, 1)).alias("critical"), F.max(n_rows).alias("_rows"))
    coverage = F.col("n_items") / F.nullif(F.col("_rows"), F.lit(0)).cast("double")
    review = (F.col("critical") > 0) | ((F.col("_rows") >= 10) & (coverage < 0.8))
    return s.select(doc, "n_items", "critical", coverage.alias("coverage"), review.alias("review"))


ITEM = re.compile(r"^\s*(\d{1,4})[.)]?\s+(.*\S)")
AMOUNT = re.compile(r"\b(\d+(?:[.,]\d+)?)\s*(EA|PCS|M|KG|SET|NOS)\b", re.I)


def _order_items(text: str) -> list[tuple[int, str, float, str]]:
    """An item begins at a numbered line, goes on over plain lines, and ends at the next number or an empty line."""
    out, now = [], None
    for line in [*text.split("\n"), ""]:
        if m := ITEM.match(line):
            if now:
                out.append(now)
            now = [int(m[1]), m[2]]
        elif not line.strip():
            if now:
                out.append(now)
            now = None
        elif now:
            now[1] += " " + line.strip()
    found = []
    for number, words in out:
        if a := AMOUNT.search(words):
            found.append((number, AMOUNT.sub("", words, count=1).strip(), float(a[1].replace(",", ".")), a[2].upper()))
    return found


def order_items(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, item, description, quantity, unit of purchase orders in plain text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(d, *i) for d, t in zip(part[doc], part[text]) for i in _order_items(t or "")]
            yield pd.DataFrame(rows, columns=[doc, "item", "description", "quantity", "unit"])

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(doc, text).mapInPandas(run, f"{doc} {kind}, item long, description string, quantity double, unit string")


def corrected_dimensions(od: Column) -> Column:
    """Diameters as misread by OCR: five digits that end in 0, and four digits over 3000, lose their last digit."""
    whole = od == F.floor(od)
    return F.when(whole & od.between(10000, 99999) & (od % 10 == 0), F.floor(od / 10)).when(whole & od.between(3001, 9999), F.floor(od / 10)).otherwise(od)


#: Five digits that end in a lost ".0" and are 4000 mm at most without it; four of over 3000 mm; each before the sign and the wall.
FIVE, FOUR, WALL = "(0[1-9][0-9]{2}|[1-3][0-9]{3}|4000)0", "(3(?:0[1-9]|[1-9][0-9])|[4-9][0-9]{2})0", "([xX×*][0-9]{1,3})"


def corrected_text(description: Column) -> Column:
    """A description whose diameters have lost a decimal point (508.0x15 read as 5080x15), with all of them repaired.

    What the first rule leaves of a diameter the second may shorten again; neither can apply once more to what both have left of a number of five
    digits or fewer, so one round is all there is.
    """
    return F.regexp_replace(F.regexp_replace(description, FIVE + WALL, "$1$2"), FOUR + WALL, "$1$2")


def document_kind(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.when(low.rlike(r"\bmto\b|take.?off"), "MTO").when(low.rlike(r"\brfq\b|enquiry|inquiry"), "RFQ").when(low.rlike(r"\b(po|order)\b"), "PO").when(low.rlike(r"spec"), "SPEC").otherwise("OTHER")
