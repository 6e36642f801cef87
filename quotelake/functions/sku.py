"""Codes of materials: normalised parts of a SKU, material codes of take-off lines, specifications by how they begin."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotelake.functions.parse import NUMBER, found, number, size_code, upper

#: Word -> code; a text that is a word counts first, then the first word in order that it contains.
CATEGORIES = {
    "pipe": "PIPE", "tube": "PIPE", "fitting": "FITG", "elbow": "FITG", "tee": "FITG", "reducer": "FITG", "coupling": "FITG", "flange": "FLNG", "grating": "GRAT", "grate": "GRAT",
    "fastener": "FAST", "bolt": "FAST", "screw": "FAST", "nut": "FAST", "washer": "FAST", "plate": "PLAT", "sheet": "PLAT", "valve": "VALV", "beam": "STRU", "angle": "STRU", "channel": "STRU",
}
MATERIALS = {
    "304": "SS", "316": "SS", "carbon steel": "CS", "cs": "CS", "mild steel": "CS", "ms": "CS", "carbon": "CS", "stainless steel": "SS", "ss": "SS", "stainless": "SS", "316l": "SS", "304l": "SS",
    "low temperature carbon steel": "LTCS", "ltcs": "LTCS", "low temp carbon steel": "LTCS", "low temp cs": "LTCS", "alloy steel": "ALLOY", "alloy": "ALLOY", "chrome moly": "ALLOY", "crmo": "ALLOY",
    "aluminum": "AL", "al": "AL", "aluminium": "AL", "copper": "CU", "cu": "CU", "brass": "BR", "br": "BR",
}
#: What names the grade of fasteners, the longer ones first; what names a finish.
FASTENER_GRADES = r"(A193B7M|A193B7|A194[A-Z0-9]*|A320[A-Z0-9]*|A325|A490|A307|SAE\s*J429)"
FINISHES = {"GALV": "GALV|HDG|HOT-DIP", "ZP": "ZINC|ZP", "BLK": "BLACK|BLK|BITUMEN"}


def _mapped(text: Column, codes: dict[str, str]) -> Column:
    low = F.lower(F.trim(text))
    direct = F.try_element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), low)
    return F.coalesce(direct, reduce(lambda w, kv: w.when(F.contains(low, F.lit(kv[0])), kv[1]), codes.items(), F))


def category_code(text: Column) -> Column:
    """Four letters; UNK for none, and the first four of an unknown one, filled with X."""
    given = F.nullif(F.trim(text), F.lit(""))
    return F.when(given.isNull(), "UNK").otherwise(F.coalesce(_mapped(given, CATEGORIES), F.rpad(F.left(F.upper(given), F.lit(4)), 4, "X")))


def material_code_of(text: Column, category: Column, notes: Column) -> Column:
    """Code of a material; gratings of plastic by how they were made, which the notes may say."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    made = lambda c: F.when(F.contains(low(c), F.lit("pultruded")), "FRPP").when(F.contains(low(c), F.lit("molded")), "FRPM")
    plastic = F.contains(low(category), F.lit("frp")) | F.contains(low(category), F.lit("grating"))
    return F.coalesce(_mapped(F.nullif(F.trim(text), F.lit("")), MATERIALS), F.when(plastic, F.coalesce(made(text), made(notes))), F.lit("UNK"))


def fastener_grade(code: Column) -> Column:
    return found(upper(code), FASTENER_GRADES)


def finish(code: Column, notes: Column) -> Column:
    """What the code says of the finish, else the notes."""
    says = lambda c: reduce(lambda w, kv: w.when(upper(c).rlike(kv[1]), kv[0]), FINISHES.items(), F)
    return F.coalesce(says(code), says(notes))


def takeoff_code(description: Column, steel: Column, standard: Column) -> Column:
    """M-steel-shape-size-form-standard of a take-off line: W beams, plates, cone reducers, and diameters with a wall, which are seamless pipe if they are called so,
    or are not called rolled and are under 1000 mm. Null for others."""
    u = F.trim(upper(description))
    n = r"([0-9]+(?:\.[0-9]+)?)"
    cone, tube = rf"{n}\s*(?:→|->|>|-)\s*{n}\s*[×X]\s*{n}", rf"{n}\s*[×X]\s*{n}"
    seamless = u.rlike("SEAMLESS|SMLS|PIPE") | (~u.rlike("ROLLED|TUBULAR|TUBE") & (number(u, tube) < 1000))
    size = lambda p, g=1: size_code(number(u, p, g))
    od = F.concat(F.lit("OD"), size(tube), F.lit("_WT"), size(tube, 2))
    body = (
        F.when(u.rlike(r"W[0-9]+X[0-9]+"), F.concat(F.lit("BEAM-"), found(u, r"(W[0-9]+X[0-9]+)"), F.lit("-ROLL")))
        .when(u.rlike(r"PL[0-9]+"), F.concat(F.lit("PLATE-T"), found(u, r"PL([0-9]+)"), F.lit("-PLAT")))
        .when(u.rlike(cone), F.concat(F.lit("CONE-"), size(cone), F.lit("_"), size(cone, 2), F.lit("_T"), size(cone, 3), F.lit("-FABR")))
        .when(u.rlike(tube), F.concat(F.when(seamless, F.lit("PIPE-")).otherwise("TUBROLLED-"), od, F.when(seamless, "-SEAM").otherwise("-ROLL")))
    )
    own = F.regexp_replace(F.replace(F.regexp_replace(F.regexp_replace(upper(standard), r"\s+", ""), "ASTM", ""), F.lit("GR."), F.lit("GR")), r"\.", "")
    return F.concat(F.lit("M-"), F.coalesce(F.upper(steel), F.lit("CS")), F.lit("-"), body, F.when(own != "", F.concat(F.lit("-"), own)).otherwise(""))


def specification(description: Column) -> Column:
    """struct<kind, first, second, third, confidence> of a text by how it begins: beam depth and weight; tubular diameter, wall, length; plate thickness; or anywhere: a pipe's
    size, a European standard."""
    t = F.trim(description)
    beam, tube, plate = r"(?i)^(W|HEA|HEB|HEM|IPE|UB|UC|WF)\s*([0-9]+)\s*[xX×]\s*([0-9]+)", rf"^{NUMBER}\s*[xX×]\s*{NUMBER}\s*[xX×]?\s*{NUMBER}?", r"(?i)^PL\s*([0-9]+)"
    pipe, en = r"""(?i)([0-9]+)\s*["']\s*(?:SCH|Schedule|DN|NPS)""", r"(?i)EN\s*([0-9]+)"
    od, wall = number(t, tube), number(t, tube, 2)
    is_tube = F.coalesce((od > 100) & (od < 50_000) & (wall > 1) & (wall < 500), F.lit(False))
    length = number(t, tube, 3)
    none = F.lit(None).cast("double")
    part = lambda kind, a, b, c, sure: F.struct(F.lit(kind).alias("kind"), a.alias("first"), b.alias("second"), c.alias("third"), sure.cast("double").alias("confidence"))
    return (
        F.when(t.isNull() | (t == ""), part(None, none, none, none, F.lit(0.0)))
        .when(t.rlike(beam), part("BEAM", number(t, beam, 2), number(t, beam, 3), none, F.lit(0.9)))
        .when(is_tube, part("TUBULAR", od, wall, length, F.when(length.isNotNull(), 0.95).otherwise(0.85)))
        .when(t.rlike(plate), part("PLATE", number(t, plate), none, none, F.lit(0.9)))
        .when(t.rlike(pipe), part("PIPE", number(t, pipe), none, none, F.lit(0.85)))
        .when(t.rlike(en), part("STANDARD", number(t, en), none, none, F.lit(0.8)))
        .otherwise(part(None, none, none, none, F.lit(0.3)))
    )
