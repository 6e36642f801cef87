"""Line items from table rows, tables and columns chosen by headers, page scores, quantities that are lengths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelake.functions import text as tx

#: Words that make a row without an item number a section's heading.
SECTIONS = ("FLANGES", "SP ITEMS", "OTHERS", "OPTIONAL")
#: A row without an item number gets its index and this.
SYNTHETIC = 10_000


def _cell(cells: Column, at: int | None) -> Column:
    return F.trim(F.coalesce(F.get(cells, F.lit(at)), F.lit(""))) if at is not None else F.lit("")


def leading_number(t: Column) -> Column:
    """The number that a text begins with, thousands marked by commas or not; null if there is none."""
    return F.nullif(F.regexp_extract(F.regexp_replace(t, ",", ""), r"^\s*([0-9]+(?:\.[0-9]*)?|\.[0-9]+)", 1), F.lit("")).cast("double")


def line_items(rows: DataFrame, doc: str, row: str, cells: str, columns: dict[str, int], headers: list[str]) -> DataFrame:
    """doc, row, line_number, section, item_group, description, quantity, unit, size, extras map: the rows of tables that are items.

    `columns` says where item, description, quantity, unit, group, size1 and size2 stand (any may be missing). Separators (item XX) and headings of sections are
    carried down and skipped. Without a positive item number a row is an item only with a description of more than 3 characters and a
    quantity, and gets a synthetic number. Without a column for it, the description is the first of five cells that has more than 5 characters and a letter,
    and the quantity the first cell behind it that holds a positive number. Other cells that aren't empty are kept under their headers.
    """
    c, at = F.col(cells), columns.get
    item, group = _cell(c, at("item")), _cell(c, at("group"))
    if at("description") is not None:
        description = _cell(c, at("description"))
    else:
        wordy = F.filter(F.slice(c, 1, 5), lambda x: (F.length(F.trim(x)) > 5) & x.rlike("[a-zA-Z]"))
        description = F.coalesce(F.trim(F.get(wordy, F.lit(0))), F.lit(""))
    behind = F.slice(c, at("description", 0) + 2, 1000)
    first = F.get(F.filter(behind, lambda x: F.coalesce(leading_number(F.regexp_extract(x, r"([0-9.,]+)", 1)), F.lit(0.0)) > 0), F.lit(0))
    amount = _cell(c, at("quantity")) if at("quantity") is not None else F.coalesce(F.trim(first), F.lit(""))
    number = F.nullif(F.regexp_extract(item, r"^([+-]?[0-9]+)", 1), F.lit("")).cast("long")
    heading = reduce(lambda a, b: a | b, [F.contains(F.upper(description), F.lit(s)) for s in SECTIONS]) & (item == "")
    separator = F.upper(item) == "XX"
    split = F.regexp_extract(amount, r"^[0-9.,]+\s*(.*)$", 1)
    sizes = _cell(c, at("size1")), _cell(c, at("size2"))
    used = set(columns.values())
    extras = F.array(*[F.struct(F.regexp_replace(F.replace(tx.header(F.lit(h)), F.lit(" "), F.lit("_")), "[^a-z0-9_]", "").alias("k"), _cell(c, i).alias("v")) for i, h in enumerate(headers) if i not in used])
    read = rows.select(
        doc, row, item.alias("_item"), number.alias("_number"), description.alias("description"), leading_number(amount).alias("quantity"), separator.alias("_separator"), heading.alias("_heading"), group.alias("_group"),
        F.coalesce(F.nullif(F.trim(split), F.lit("")), F.nullif(_cell(c, at("unit")), F.lit(""))).alias("unit"),
        F.when(sizes[1] != "", F.concat(sizes[0], F.lit(" × "), sizes[1])).otherwise(F.nullif(sizes[0], F.lit(""))).alias("size"),
        F.map_from_entries(F.filter(extras, lambda x: x["v"] != "")).alias("extras"),
    )
    down = Window.partitionBy(doc).orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    read = read.withColumns({
        "section": F.last(F.when(F.col("_heading") & ~F.col("_separator"), F.upper("description")), ignorenulls=True).over(down),
        "item_group": F.last(F.nullif(F.col("_group"), F.lit("")), ignorenulls=True).over(down),
    })
    numbered = F.coalesce(F.col("_number") > 0, F.lit(False))
    valid = numbered | ((F.length("description") > 3) & F.col("quantity").isNotNull())
    kept = read.filter(~F.col("_separator") & ~F.col("_heading") & valid)
    line = F.when(numbered, F.col("_number")).otherwise(F.col(row) + SYNTHETIC)
    return kept.select(doc, row, line.cast("long").alias("line_number"), "section", "item_group", F.nullif(F.col("description"), F.lit("")).alias("description"), "quantity", "unit", "size", "extras")


#: Headers of tables that list documents, and of tables of revisions.
DOCUMENT_LIST = ("vendor", "vdrl", "data requirement", "document list", "document no", "document number", "document title", "document code")
REVISION, APPROVAL = ("rev", "revision", "approved by", "approved", "prepared by"), ("approved", "prepared", "checked")


def holds(headers: Column, words: tuple[str, ...]) -> Column:
    """Whether some header contains one of the words."""
    return F.exists(F.transform(headers, tx.header), lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(w)) for w in words]))


def administrative(headers: Column) -> Column:
    """Whether a table lists documents or revisions; one without headers is of no use either."""
    return F.coalesce(F.size(headers) < 1, F.lit(True)) | holds(headers, DOCUMENT_LIST) | (holds(headers, REVISION) & holds(headers, APPROVAL))


#: Role -> expressions over a header, the first that any header fits counts.
SHEET_COLUMNS = {
    "item_no": (r"^no\.?$|^item$|item no|item number|item #|line no|line number|^s\.?n\.?o\.?$|^#$",),
    "description": (r"^(description|item description|spec|specification)$", r"^(?!.*material\s+description).*(description|detail|specification)"),
    "material": (r"material description|material specification|material spec", r"^material$", r"material type"),
    "quantity": (r"purchased quantity|purchase quantity", r"erected quantity", r"nett quantity|net quantity", r"qty|quantity"),
    "unit": (r"unit|uom",), "unit_weight": (r"unit weight",), "total_weight": (r"purchased weight", r"total weight", r"erected weight"), "size": (r"^size$|dimension|spec|profile",), "notes": (r"remark|notes?|shipment|revision|rev\.",),
}


def sheet_columns(headers: Column) -> dict[str, Column]:
    """role -> index (from 0) of a sheet's column for it, -1 if there is none."""
    h = F.transform(headers, lambda x: F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"\s+", " ")))
    at = lambda p: F.nullif(F.array_position(F.transform(h, lambda x: x.rlike(p)), F.lit(True)), F.lit(0).cast("long"))
    return {role: F.coalesce(*[at(p) for p in patterns], F.lit(0)) - 1 for role, patterns in SHEET_COLUMNS.items()}


def length_for_quantity(quantity: Column, length: Column, unit: Column) -> Column:
    """struct<quantity, length, unit, reason, fixed>: a quantity in metres, a large one with decimals, or one five times the length is a length; swapped where the
    length is a whole number under 500."""
    u = F.upper(F.coalesce(unit, F.lit("")))
    metres = u.isin("M", "MTR", "METER", "METERS")
    decimals = (quantity > 500) & (quantity != F.floor(quantity)) & (quantity % 1 >= 0.01)
    larger = (length != 0) & (quantity > 50) & (quantity > length * 5)
    reason = F.when(quantity.isNull(), None).when(metres, "unit_is_meters").when(decimals, "large_decimal_value").when(larger, "quantity_larger_than_length")
    fixed = F.coalesce(reason.isNotNull() & (length > 0) & (length < 500) & (length == F.floor(length)), F.lit(False))
    return F.struct(
        F.when(fixed, length).otherwise(quantity).alias("quantity"), F.when(fixed, quantity).otherwise(length).alias("length"), F.when(fixed, "EA").otherwise(unit).alias("unit"), reason.alias("reason"), fixed.alias("fixed")
    )


def page_score(text: Column, keywords: list[str]) -> Column:
    """0.4 keywords (15 are enough) + 0.3 digits (a fifth is enough) + 0.3 looks of a table, from 0 to 1."""
    low, solid = F.lower(F.coalesce(text, F.lit(""))), F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "")
    found = reduce(lambda a, b: a + b, [F.contains(low, F.lit(k)).cast("int") for k in keywords])
    digits = F.length(F.regexp_replace(solid, "[^0-9]", "")) / F.nullif(F.length(solid), F.lit(0)).cast("double")
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s", " ")) != "")

    def looks(own: Column, mean: Column) -> Column:
        share = lambda test: F.size(F.filter(own, test)) / F.size(own).cast("double")
        aligned = share(lambda x: x.rlike(r"\t|\s{3,}"))
        alike = share(lambda x: F.abs(F.length(x) - mean) < mean * 0.3)
        parted = share(lambda x: F.contains(x, F.lit("|")) | x.rlike(r"\s{4,}|\t.*\t"))
        return F.when(F.size(own) < 3, 0.0).otherwise(F.least(aligned * 0.4 + alike * 0.3 + parted * 0.3, F.lit(1.0)))

    mean_of = lambda own: F.aggregate(own, F.lit(0.0), lambda a, x: a + F.length(x)) / F.nullif(F.size(own), F.lit(0)).cast("double")
    tabular = tx.once(lines, lambda own: tx.once(mean_of(own), lambda mean: looks(own, mean)))  # else each line would find all lines and their mean anew
    return 0.4 * F.least(found / 15.0, F.lit(1.0)) + 0.3 * F.coalesce(F.least(digits / 0.2, F.lit(1.0)), F.lit(0.0)) + 0.3 * tabular


def page_position(page: Column, pages: Column) -> Column:
    """How likely a page's place makes it one of interest: covers are not, the last third is."""
    return F.when(pages <= 5, 0.8).when(page <= 2, 0.2).when(page <= F.floor(pages * 0.7), 0.5).otherwise(0.9)
