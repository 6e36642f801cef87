"""Material descriptions to attributes: beams, tubulars, plates, pipes, standards, and the codes built from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
TIMES = r"\s*[X×]\s*"


def number(t: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(t, pattern, group), F.lit("")).cast("double")


def found(t: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(t, pattern, group), F.lit(""))


def upper(t: Column) -> Column:
    return F.upper(F.coalesce(t, F.lit("")))


def beam(t: Column) -> Column:
    """struct<family, depth_mm, weight_kg_m, width_mm, web_mm, confidence>: W inch x lb/ft, HEA / HEB depth x width x web, I depth x width."""
    u = upper(t)
    w, he, i = rf"\bW\s*{NUMBER}{TIMES}{NUMBER}", rf"\b(HE[AB])\s*{NUMBER}(?:{TIMES}{NUMBER}(?:{TIMES}{NUMBER})?)?", rf"\bI(?:PE)?\s*{NUMBER}(?:{TIMES}{NUMBER})?"
    is_w, is_he, is_i = u.rlike(w), u.rlike(he), u.rlike(i)
    return F.struct(
        F.when(is_w, "W").when(is_he, found(u, he)).when(is_i, "I").alias("family"),
        F.when(is_w, number(u, w) * 25.4).when(is_he, number(u, he, 2)).when(is_i, number(u, i)).alias("depth_mm"),
        F.when(is_w, number(u, w, 2) * 1.488).alias("weight_kg_m"),
        F.when(is_w, None).when(is_he, number(u, he, 3)).when(is_i, number(u, i, 2)).alias("width_mm"),
        F.when(~is_w & is_he, number(u, he, 4)).alias("web_mm"),
        F.when(is_w, 0.95).when(is_he, 0.9).when(is_i, 0.7).when(u.rlike(r"\bBEAM\b"), 0.5).otherwise(0.0).alias("confidence"),
    )


def tubular(t: Column) -> Column:
    """struct<od_mm, wall_mm, length_mm, id_mm, confidence>: od x wall, and a length; large or named ones only are sure."""
    u = upper(t)
    p = rf"(?:^|[^0-9.W]){NUMBER}{TIMES}{NUMBER}(?:{TIMES}{NUMBER})?"
    od, wall = number(u, p), number(u, p, 2)
    named = u.rlike(r"\b(TUBULAR|TUBE)\b")
    sure = (od > 500) | named
    return F.struct(
        od.alias("od_mm"), wall.alias("wall_mm"), number(u, p, 3).alias("length_mm"), F.when(sure, od - 2 * wall).alias("id_mm"),
        F.when(od.isNull(), 0.0).when(sure, 0.9).when(od.between(50, 500), 0.7).otherwise(0.4).alias("confidence"),
    )


def plate(t: Column) -> Column:
    """struct<thickness_mm, confidence>: PL12, 12 MM, or a bare number that a plate could have."""
    u = upper(t)
    named, mm = number(u, r"\bPL(?:ATE)?\s*([0-9]+(?:\.[0-9]+)?)"), number(u, rf"{NUMBER}\s*MM\b")
    bare = number(u, r"\b([0-9]{1,3})\b")
    bare = F.when(u.rlike("PLATE") & bare.between(6, 200), bare)
    return F.struct(F.coalesce(named, mm, bare).alias("thickness_mm"), F.when(named.isNotNull(), 0.95).when(mm.isNotNull(), 0.85).when(bare.isNotNull(), 0.6).otherwise(0.0).alias("confidence"))


def european(t: Column) -> Column:
    """struct<standard, grade, designation, confidence>: EN 10210 S355 K2H, EN10225 S275, EN 10025-2 S355J2."""
    u = upper(t)
    standard, grade = found(u, r"\bEN\s*([0-9]{5}(?:-[0-9])?)"), found(u, r"\b(S[0-9]{3}[A-Z0-9]*)\b")
    designation = found(u, r"\bEN\s*[0-9]{5}(?:-[0-9])?\s+S[0-9]{3}[A-Z0-9]*\s+([A-Z][0-9][A-Z0-9]+)\b")
    sure = F.when(standard.isNull(), 0.0).when(designation.isNotNull(), 0.95).when(grade.isNotNull(), 0.85).otherwise(0.7)
    return F.struct(standard.alias("standard"), grade.alias("grade"), designation.alias("designation"), sure.alias("confidence"))


#: Nominal diameters in mm -> inches.
DN_INCHES = {50: 2.0, 100: 4.0, 150: 6.0, 200: 8.0, 250: 10.0, 300: 12.0, 500: 20.0}
SIZE_WORDS = {"TWO": 2.0, "THREE": 3.0, "FOUR": 4.0, "SIX": 6.0, "EIGHT": 8.0, "TEN": 10.0, "TWELVE": 12.0}
FAMILIES = {"LTCS": r"LOW TEMP|\bLTCS\b|\bLT CS\b", "CS": r"CARBON STEEL|\bCS\b", "SS": r"STAINLESS|\bSS(304L?|316L?)?\b", "ALLOY": r"ALLOY"}


def inches(t: Column) -> Column:
    """Nominal size: 6", 6 INCH, SIX INCH, DN by its table, else DN / 25 to the nearest half."""
    u = upper(t)
    word = reduce(lambda c, x: c.when(u.rlike(rf"\b{x[0]}\s*(INCH|IN)\b"), x[1]), SIZE_WORDS.items(), F)
    dn = number(u, r"\bDN\s*([0-9]+)")
    known = reduce(lambda c, x: c.when(dn == x[0], x[1]), DN_INCHES.items(), F)
    return F.coalesce(number(u, rf"{NUMBER}\s*(?:\"|INCH\b|IN\b)"), word, known, F.floor(dn / 25 * 2 + 0.5) / 2)


def schedule(t: Column) -> Column:
    return found(upper(t), r"\bSCH(?:EDULE)?\.?\s*([0-9]+S?|STD|XS|XXS)\b")


def grade(t: Column) -> Column:
    return found(upper(t), r"\bGR(?:ADE)?\.?\s*([A-Z0-9]+)\b")


def pipe(t: Column) -> Column:
    """struct<nps, schedule, family, standard, grade, form, words>: size in inches, schedule without SCH, kind of steel, ASTM number, grade, seamless or welded,
    and how many of four words (seamless, welded, pipe, sch) it uses, as a mask."""
    u = upper(t)
    family = reduce(lambda c, x: c.when(u.rlike(x[1]), x[0]), FAMILIES.items(), F)
    mask = reduce(lambda a, b: a + b, [F.when(F.contains(u, F.lit(w)), 1 << i).otherwise(0) for i, w in enumerate(("SEAMLESS", "WELDED", "PIPE", "SCH"))])
    return F.struct(
        inches(t).alias("nps"), schedule(t).alias("schedule"), family.alias("family"), found(u, r"\b(A[0-9]{2,3}[A-Z]?)\b").alias("standard"), grade(t).alias("grade"),
        F.when(u.rlike(r"\b(SMLS|SEAMLESS)\b"), "SEAMLESS").when(u.rlike(r"\b(WELDED|ERW|SAW)\b"), "WELDED").alias("form"), mask.alias("words"),
    )


PRODUCTS = {"FLANGE": r"FLANGE|BLIND|SPECTACLE|SPADE", "FITTING": r"FITTING|ELBOW|\bTEE\b|REDUCER", "GASKET": r"GASKET", "FASTENER": r"FASTENER|BOLT|\bNUT\b"}


def generic(t: Column) -> Column:
    """struct<product, standard, grade, size, schedule, marks> of what has no parser of its own: kind of product, any standard, grade, size in inches, schedule (or
    rating), and a mask of the words spade, spectacle and ring."""
    u = upper(t)
    product = reduce(lambda c, x: c.when(u.rlike(x[1]), x[0]), PRODUCTS.items(), F)
    marks = reduce(lambda a, b: a + b, [F.when(F.contains(u, F.lit(w)), 1 << i).otherwise(0) for i, w in enumerate(("SPADE", "SPECTACLE", "RING"))])
    return F.struct(
        product.alias("product"), found(u, r"\b(?:ASTM\s*)?(A[0-9]{2,3}[A-Z]?|B16\.[0-9]+|API\s?5L)\b").alias("standard"), grade(t).alias("grade"),
        inches(t).alias("size"), F.coalesce(schedule(t), found(u, r"\b([0-9]+#)")).alias("schedule"), marks.alias("marks"),
    )


def best(beam: Column, tubular: Column, plate: Column, european: Column) -> Column:
    """struct<kind, confidence> of the parsed structs: the parser that is surest, the first of equal ones, and none at confidence 0. A European standard can raise the confidence."""
    parsers = [("BEAM", beam), ("TUBULAR", tubular), ("PLATE", plate)]
    top = F.greatest(*[p["confidence"] for _, p in parsers])
    kind = reduce(lambda c, x: c.when((top > 0) & (x[1]["confidence"] == top), x[0]), parsers, F)
    return F.struct(kind.alias("kind"), F.when(kind.isNotNull(), F.greatest(top, european["confidence"])).otherwise(0.0).alias("confidence"))


def ambiguous(t: Column) -> Column:
    """Whether a description looks like more than one kind."""
    u = upper(t)
    signs = (rf"W\s*[0-9]+{TIMES}[0-9]|HE[AB]", r"TUBULAR", r"PL\s*[0-9]", r"[0-9]\s*\"\s*SCH")
    return reduce(lambda a, b: a + b, [u.rlike(p).cast("int") for p in signs]) > 1


def kind(t: Column) -> Column:
    """Of what sort a description is; the first that fits."""
    u = upper(t)
    return (
        F.when(u.rlike(rf"\bW\s*[0-9.]+{TIMES}[0-9]|\bHE[AB]\s*[0-9]|\bBEAM\b"), "BEAM").when(u.rlike(r"\b(TUBULAR|TUBE)\b"), "TUBULAR")
        .when(u.rlike(r"\bPL(ATE)?\s*[0-9]|\bPLATE\b"), "PLATE").when(u.rlike(r"\bPIPE\b|\bSCH"), "PIPE").otherwise("OTHER")
    )


def size_code(x: Column) -> Column:
    """A size as it stands in a code: no trailing zeros, _ for the point."""
    return F.replace(F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", ""), F.lit("."), F.lit("_"))


def material_code(family: Column, shape: Column, size: Column, form: Column, standard: Column) -> Column:
    """M-family-shape-size-form-standard; null where a part is missing."""
    return F.concat(F.lit("M-"), family, F.lit("-"), shape, F.lit("-"), size, F.lit("-"), form, F.lit("-"), standard)


def reducer_size(t: Column) -> Column:
    """From 1828.8->1371.6x38: both diameters first, then the wall."""
    t = upper(t)
    p = rf"{NUMBER}\s*(?:->|→|/)\s*{NUMBER}{TIMES}{NUMBER}"
    return F.concat_ws("_", size_code(number(t, p)), size_code(number(t, p, 2)), F.concat(F.lit("T"), size_code(number(t, p, 3))))


SKU_PARTS = ("category", "material", "standard", "size", "variant", "sub")


def sku(parts: dict[str, Column]) -> Column:
    """Six segments, in capitals; what is missing is XX."""
    clean = lambda c: F.coalesce(F.nullif(F.regexp_replace(F.upper(c), "[^A-Z0-9_.]", ""), F.lit("")), F.lit("XX"))
    return F.concat_ws("-", *[clean(parts.get(p, F.lit(None).cast("string"))) for p in SKU_PARTS])


def sku_errors(s: Column) -> Column:
    """array<string> of what is wrong with a SKU."""
    parts = F.split(F.coalesce(s, F.lit("")), "-")
    wrong = [F.when(F.size(parts) != 6, F.lit("segments")), F.when(F.exists(parts, lambda x: ~x.rlike("^[A-Z0-9_.]+$")), F.lit("characters")), F.when(F.element_at(parts, 1) == "XX", F.lit("category"))]
    return F.array_compact(F.array(*wrong))


def first_points(*steps: tuple[Column, int]) -> Column:
    """Points of the first condition that holds; none where it can't be told."""
    return F.coalesce(reduce(lambda c, x: c.when(x[0], x[1]), steps, F).otherwise(0), F.lit(0))


def text_points(a: Column, b: Column, equal: int, part: int) -> Column:
    """Points for equal texts, and fewer where one contains the other."""
    return first_points((a == b, equal), (F.contains(a, b) | F.contains(b, a), part))


def equal_points(a: Column, b: Column, points: int) -> Column:
    return F.when(F.upper(a.cast("string")) == F.upper(b.cast("string")), points).otherwise(0)
