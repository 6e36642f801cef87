"""Checks of extracted line items: how sure each field is, what looks wrong, what is repaired; and what a document's items come to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelake.functions.sku_parts import found, given
from quotelake.operators.items import corrected_text

# Weights of fields, and how sure a field is that is given, and that is not.
WEIGHTS = {"line_number": 0.2, "description": 0.25, "quantity": 0.25, "unit": 0.15, "spec": 0.05, "size1": 0.05, "size2": 0.02, "notes": 0.02, "revision": 0.01}
GIVEN, ABSENT = {"line_number": 0.95, "unit": 0.8, "spec": 0.7, "size1": 0.7, "size2": 0.7, "notes": 0.7, "revision": 0.7}, {"line_number": 0.95, "unit": 0.3, "spec": 0.1, "size1": 0.1, "size2": 0.1, "notes": 0.1, "revision": 0.1}
METRES, PIECES = ["m", "meter", "meters"], r"(?i)(?:pcs|pieces|quantity\s*\(pcs\)|qty\s*\(pcs\))[\s:]*([0-9]+)"
LARGE = r"([0-9]{5,})\s*[xX×*]\s*[0-9]+"
NO_SCORES = 0.5


def number_of(text: Column) -> Column:
    """The whole number that a text begins with."""
    return F.regexp_extract(F.trim(text), r"^([+-]?[0-9]+)", 1).try_cast("long")


def field_confidence(name: str) -> Column:
    c = F.col(name)
    if name == "description":
        return F.when(given(c).isNull(), 0.3).when(F.length(c) > 10, 0.85).otherwise(0.6)
    if name == "quantity":
        return F.when(c.isNull() | (c == 0), 0.3).when(c > 0, 0.9).otherwise(0.5)
    return F.when(given(c).isNotNull(), GIVEN[name]).otherwise(ABSENT[name])


def checked(items: DataFrame) -> DataFrame:
    """`items` (line_number string, description, quantity double, unit, spec, size1, size2, notes, revision, and others) with number, confidence, fields struct, warnings array<string>, and the
    repaired description, size1, quantity and total_length; rows whose number is none above 0 have a null number and confidence, and no warnings.

    The confidence is that of the fields as they came; what is found wrong later lowers the field only.
    """
    first = {n: field_confidence(n) for n in WEIGHTS}
    number = number_of(F.col("line_number").cast("string"))
    overall = sum((first[n] * w for n, w in WEIGHTS.items()), F.lit(0.0))
    q, unit = F.col("quantity"), F.lower(F.trim(F.coalesce("unit", F.lit(""))))
    description, notes = F.coalesce("description", F.lit("")), F.coalesce("notes", F.lit(""))
    twice = (q > 10) & (q < 100) & (q % 11 == 0)
    length = unit.isin(METRES) & ((q != F.floor(q)) | (q > 100))
    pieces = F.when(length, found(notes, PIECES).cast("double"))
    large = found(description, LARGE)
    lost = (F.length(large) == 5) & F.endswith(large, F.lit("0"))
    fixed = {n: corrected_text(F.col(n)) for n in ("description", "size1")}
    says = {
        "description missing": first["description"] < 0.5, "quantity missing or invalid": first["quantity"] < 0.5, "unit missing": (first["unit"] < 0.5) & (q != 0), "zero or missing quantity": q.isNull() | (q == 0),
        "description very short": (first["description"] < 0.7) & (given(F.col("description")).isNotNull()) & (F.length("description") < 5), "quantity may be a digit read twice": twice,
        "quantity taken from notes": pieces.isNotNull(), "quantity may be a length": length & pieces.isNull(), "dimension may have lost a point": lost,
        "description repaired": fixed["description"] != F.col("description"), "size repaired": fixed["size1"] != F.col("size1"),
    }
    lowered = first | {
        "quantity": F.least(first["quantity"], F.when(twice, 0.6).otherwise(1.0), F.when(length & pieces.isNull(), 0.5).otherwise(1.0)),
        "description": F.least(first["description"], F.when(lost, 0.6).otherwise(1.0)),
    }
    warnings = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), w) for w, c in says.items()]))
    kept = number > 0
    made = {
        "number": F.when(kept, number), "confidence": F.when(kept, overall), "fields": F.when(kept, F.struct(*[c.alias(n) for n, c in lowered.items()])),
        "warnings": F.when(kept, warnings).otherwise(F.array().cast("array<string>")), "total_length": F.when(pieces.isNotNull(), q), "quantity": F.coalesce(pieces, q), **fixed,
    }
    return items.select(*[c for c in items.columns if c not in made], *[c.alias(n) for n, c in made.items()])


def summed_up(done: DataFrame, expected: DataFrame, doc: str, rows: str) -> DataFrame:
    """doc, items, skipped (rows without a number above 0), missing (of the `rows` that tables of the document have), warned, confidence; documents that only `expected` has too."""
    valid = F.col("number").isNotNull()
    own = done.groupBy(doc).agg(F.count_if(valid).alias("items"), F.count_if(~valid).alias("skipped"), F.sum(F.size("warnings")).alias("warned"), F.avg("confidence").alias("confidence"))
    both = expected.select(doc, F.col(rows).alias("_rows")).join(own, doc, "full")
    n = F.coalesce("items", F.lit(0))
    skipped = F.coalesce("skipped", F.lit(0))
    missing = F.greatest(F.coalesce("_rows", F.lit(0)) - n, F.lit(0))
    warned = F.coalesce("warned", F.lit(0)) + (missing > 0).cast("long") + (skipped > 0).cast("long")
    return both.select(doc, n.alias("items"), skipped.alias("skipped"), missing.alias("missing"), warned.alias("warned"), F.coalesce("confidence", F.lit(NO_SCORES)).alias("confidence"))
