"""The six parts of a SKU from a catalogue record and the JSON in its notes: ordered rules as data, fields by precedence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotelake.functions.sku import FASTENER_GRADES, category_code, finish, material_code_of

# Fixed values, each table in the order in which it counts: a text that is a word first, then the first word that it contains.
STANDARDS = {
    "astm a106": "A106", "a106": "A106", "astm a106 gr.b": "A106", "astm a106 gr.a": "A106", "astm a333": "A333", "a333": "A333", "astm a333 gr.6": "A333", "astm a312": "A312", "a312": "A312",
    "astm a312 tp304": "A312", "astm a312 tp316": "A312", "astm a312 tp316l": "A312", "astm a53": "A53", "a53": "A53", "astm a234": "A234", "a234": "A234", "astm a105": "A105", "a105": "A105",
    "astm a182": "A182", "a182": "A182", "api 5l": "API5L", "api5l": "API5L", "api 5l x42": "API5L", "api 5l x52": "API5L", "asme b16.9": "B169", "b16.9": "B169", "asme b16.5": "B165", "b16.5": "B165",
    "iso 9001": "ISO9K", "iso 14001": "ISO14K", "din": "DIN", "bs": "BS",
}
VARIANTS = {
    "seamless": "SLS", "welded": "WLD", "erw": "WLD", "saw": "WLD", "plain": "PLN", "serrated": "SER", "smooth": "PLN", "galvanized": "GALV", "galvanised": "GALV", "gi": "GALV", "hdg": "GALV",
    "hot dip galvanized": "GALV", "black": "BLK", "bitumen": "BLK", "untreated": "UNT", "bare": "UNT", "coated": "CTD", "gr.b": "GRB", "gr.a": "GRA", "gr.6": "GR6", "tp304": "TP304", "tp316": "TP316",
    "tp316l": "TP316L", "x42": "X42", "x52": "X52", "x60": "X60", "china": "CN", "non-china": "NCN", "non_china": "NCN",
}
#: What a code's words say of the subcategory; {type in the notes: its words}; by words of the category, what a subcategory's words stand for.
CODE_WORDS = {"HEXBOLT|HEX-BOLT": "HX", "STUDBOLT|STUD-BOLT": "ST", "NUT": "NT", "ANCHORBOLT|ANCHOR-BOLT": "UB", "WASHER": "WS", "ELB": "EL", "TEE": "TE", "RED": "RE", "CAP|COUPLING": "CA", "SORF|SO-RF": "SORF", "BLRF|BL-RF": "BLRF", "WNRF|WN-RF|WNRTJ": "WNRF"}
NOTE_WORDS = {
    "fastener_type": {"HEX": "HX", "STUD": "ST", "NUT": "NT", "ANCHOR": "UB", "WASHER": "WS"}, "fitting_type": {"ELBOW": "EL", "TEE": "TE", "REDUCER": "RE", "CAP|COUPLING": "CA"}, "form": {"SEAMLESS": "SMS", "WELDED": "WLD"},
}
KIND_WORDS = {
    "FAST": {"HEX": "HX", "STUD": "ST", "NUT": "NT", "ANCHOR": "UB", "WASHER": "WS"}, "FITG|FITTING": {"ELBOW": "EL", "TEE": "TE", "REDUCER": "RE", "CAP|COUPLING": "CA"},
    "FLNG|FLANGE": {"SORF|SO-RF": "SORF", "BLRF|BL-RF": "BLRF", "WNRF|WN-RF|WNRTJ": "WNRF"}, "PIPE": {"SMS|SEAMLESS": "SMS", "WLD|WELDED": "WLD"},
}
PIPE_GRADES = {"X42": "X42", "X52": "X52", "X60": "X60", "X65": "X65", "X70": "X70", r"GR\.B|GRB|A106B": "GRB", r"GR\.A|GRA|A106A": "GRA"}
SURFACES, COATINGS = {"-S-|SERR": "SER", "-P-|PLAIN|SMOOTH": "PLN"}, {"GALV|HDG|-G": "HDG", "BLACK|BLK|-B": "BLK", "UNPAINT|-U": "UNP"}
ANGLES, RATINGS, SERIES, SCHEDULE = {"ELB.*90|90.*ELB": "90", "ELB.*45|45.*ELB": "45", "RECC": "CC", "REEE|REECC": "ECC"}, "150|300|600|900|1500|2500", r"TA-?[0-9]+-([0-9]+)", r"SCH\s*([0-9]+|STD|XS|XXS)"
FRACTIONS = {"0.5": "1_2", "0.625": "5_8", "0.75": "3_4", "0.875": "7_8", "0.25": "1_4", "0.125": "1_8", "0.375": "3_8"}
#: The most characters of each part, and which it may have.
LIMITS = {"category": 10, "material": 10, "subcategory": 15, "std": 15, "size": 15, "variant": 15}
ALLOWED = {"subcategory": "A-Za-z0-9_", "std": "A-Za-z0-9", "size": "A-Za-z0-9x_", "variant": "A-Za-z0-9_"}

Rules = dict[str, str]


def given(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_match(text: Column, rules: Rules) -> Column:
    """The code of the first pattern that is found."""
    return reduce(lambda w, kv: w.when(text.rlike(kv[0]), kv[1]), rules.items(), F)


def coded(text: Column, words: Rules) -> Column:
    """The code of the word that the text is, else of the first that it contains: rules are data in one expression, whatever their number."""
    table = F.from_json(F.lit("[" + ",".join(f'{{"w":"{k}","c":"{v}"}}' for k, v in words.items()) + "]"), "array<struct<w:string,c:string>>")
    same = F.get(F.filter(table, lambda r: r["w"] == text), 0)
    within = F.get(F.filter(table, lambda r: F.contains(text, r["w"])), 0)
    return F.coalesce(same["c"], within["c"])


def note(notes: Column, *names: str) -> Column:
    """The first of these fields of the JSON in the notes that is there."""
    return F.coalesce(*[given(F.get_json_object(notes, f"$.{n}")) for n in names])


def found(text: Column, pattern: str, group: int = 1) -> Column:
    return given(F.regexp_extract(text, pattern, group))


def decimal(number: Column) -> Column:
    """A decimal number without its point, or as a fraction."""
    short = F.regexp_replace(F.regexp_replace(number, r"0+$", ""), r"\.$", "")
    names = F.create_map(*[F.lit(x) for kv in FRACTIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(names, short), F.replace(short, F.lit("."), F.lit("")))


def with_decimal(text: Column) -> Column:
    """The first decimal number of a text in short."""
    own = found(text, r"([0-9]+\.[0-9]+)")
    return F.when(own.isNotNull(), F.concat(F.regexp_extract(text, r"^(.*?)[0-9]+\.[0-9]+", 1), decimal(own), F.regexp_extract(text, r"^.*?[0-9]+\.[0-9]+(.*)$", 1)))


def size_part(text: Column) -> Column:
    t = F.trim(text)
    inch, alone, quote = found(t, r"(?i)([0-9]+\.[0-9]+)\s*IN"), found(t, r"^([0-9]+\.[0-9]+)$"), found(t, r'([0-9]+(?:\.[0-9]+)?)\s*"')
    by = F.concat(found(t, r"(?i)([0-9]+)\s*x\s*[0-9]+"), F.lit("X"), F.regexp_extract(t, r"(?i)[0-9]+\s*x\s*([0-9]+)", 1))
    cleaned = F.regexp_replace(t, r"(?i)[^A-Z0-9X._-]", "")
    rest = F.left(F.replace(F.coalesce(with_decimal(cleaned), F.replace(cleaned, F.lit("."), F.lit(""))), F.lit("-"), F.lit("")), F.lit(10))
    return F.when(given(text).isNull(), "UNK").otherwise(F.coalesce(
        F.concat(decimal(inch), F.lit("IN")), decimal(alone), F.concat(F.coalesce(with_decimal(quote), quote), F.lit("IN")), F.concat(F.lit("DN"), found(t, r"(?i)dn\s*([0-9]+)")),
        F.concat(F.lit("SCH"), F.upper(found(t, r"(?i)sch\s*([0-9]+|[a-z]+)"))), by, found(t, r"^([0-9]+)$"), F.upper(given(rest)), F.lit("UNK")))


def standard_part(text: Column) -> Column:
    low = F.lower(F.trim(text))
    known = F.coalesce(coded(low, STANDARDS), F.upper(found(low, r"astm\s*([a-z0-9]+)")), F.concat(F.lit("API"), F.upper(found(low, r"api\s*([a-z0-9]+)"))), F.upper(F.replace(found(low, r"asme\s*([a-z0-9.]+)"), F.lit("."), F.lit(""))))
    rest = F.regexp_replace(F.upper(F.left(low, F.lit(6))), "[^A-Z0-9]", "")
    return F.when(given(text).isNull(), "UNK").otherwise(F.coalesce(known, F.when(F.length(rest) < 4, F.rpad(rest, 4, "X")).otherwise(rest)))


def variant_part(text: Column, notes: Column, origin: Column) -> Column:
    low = lambda c: F.lower(given(c))
    within = lambda c: coded(F.concat(F.lit(" "), low(c)), VARIANTS)  # noqa: E731  never equal to a word: notes are searched only
    from_origin = F.when(low(origin) == "china", "CN").when(low(origin).isin("non_china", "non-china"), "NCN")
    return F.coalesce(coded(F.trim(low(text)), VARIANTS), within(notes), from_origin, F.lit("UNK"))


def subcategory_part(text: Column, category: Column) -> Column:
    u, kind = F.upper(F.trim(given(text))), F.upper(F.coalesce(category, F.lit("")))
    words = F.coalesce(*[F.when(kind.rlike(k), first_match(u, rules)) for k, rules in KIND_WORDS.items()])
    series = F.concat(F.lit("S"), found(u, "S([0-9]+)"), F.when(u.rlike("SERR|S-"), "_SERR").otherwise("_SMOOTH"))
    grating = F.when(F.contains(kind, F.lit("GRAT")), F.when(u.rlike("^S[0-9]+[_-](SERR|SMOOTH)$"), F.replace(u, F.lit("-"), F.lit("_"))).otherwise(series))
    plain = F.when((F.length(u) <= 10) & u.rlike("^[A-Z0-9-]+$"), u)
    return F.when(u.isNull(), "NCN").otherwise(F.coalesce(F.when(kind.rlike("FAST|FITG|FITTING|FLNG|FLANGE"), words), grating, words, plain, F.lit("NCN")))


def raw(record: dict[str, Column]) -> dict[str, Column]:
    """What a record says of each part: its own fields, then the notes', then rules of its category. record: category, material_type, spec_standard, size, code, grade, notes, origin."""
    r = {k: given(c) for k, c in record.items()}
    code, notes = F.upper(F.coalesce(r["code"], F.lit(""))), F.coalesce(r["notes"], F.lit(""))
    number = lambda n: note(notes, n)
    nps = F.concat(number("nps_inch"), F.lit('"'), F.coalesce(F.concat(F.lit(" SCH"), number("schedule")), F.lit("")))
    bars = F.concat(number("load_bar_width_mm"), F.lit("x"), number("load_bar_thickness_mm"))
    words = {k: v for k, v in CODE_WORDS.items() if k != "NUT"}
    before = {k: v for k, v in CODE_WORDS.items() if v in ("HX", "ST")}
    nut = F.when(F.contains(code, F.lit("NUT")) & ~F.contains(code, F.lit("ANCHOR")), "NT")
    series = F.concat(F.lit("S"), found(code, SERIES), F.when(code.rlike("-S-|SERR"), "_SERR").otherwise("_SMOOTH"))
    said = [first_match(F.upper(number(f)), rules) for f, rules in NOTE_WORDS.items()]
    sub = F.coalesce(first_match(code, before), nut, first_match(code, words), series, *said)
    std = F.coalesce(r["spec_standard"], note(notes, "standard", "spec_standard"))
    grade = F.coalesce(r["grade"], note(notes, "form", "finish", "surface", "grade"), r["origin"])
    kind = F.upper(F.coalesce(r["category"], F.lit("")))
    is_ = {k: F.contains(kind, F.lit(k)) for k in ("FAST", "FLNG", "FITG", "PIPE", "GRAT")}
    only = lambda k: reduce(lambda a, b: a & ~b, [is_[x] for x in is_ if list(is_).index(x) < list(is_).index(k)], is_[k])  # noqa: E731  the first category that fits
    rating = F.coalesce(found(code, f"-({RATINGS})-|^({RATINGS})-"), found(code, f"^({RATINGS})-"), found(code, rf"\b({RATINGS})\b"), F.concat(F.lit("PN"), found(code, "PN([0-9]+)")))
    schedule = found(F.upper(F.concat_ws(" ", F.coalesce(r["code"], F.lit("")), F.coalesce(r["size"], F.lit("")))), SCHEDULE)
    base = F.coalesce(std, F.lit("UNK"))
    surface, coating = first_match(code, SURFACES), first_match(F.upper(F.concat_ws(" ", F.coalesce(r["code"], F.lit("")), notes)), COATINGS)
    std = F.coalesce(
        F.when(only("FAST"), found(code, FASTENER_GRADES)), F.when(only("FLNG"), F.concat(base, F.lit("R"), rating)), F.when(only("FITG") | only("PIPE"), F.concat(base, F.lit("S"), schedule)), std)
    grade = F.coalesce(
        F.when(only("FAST") & r["code"].isNotNull(), finish(code, notes)), F.when(only("PIPE"), first_match(F.upper(F.concat_ws(" ", F.coalesce(r["code"], F.lit("")), F.coalesce(r["grade"], F.lit("")))), PIPE_GRADES)),
        F.when(only("GRAT"), given(F.concat_ws("_", surface, coating))), grade)
    angle = F.when(only("FITG"), first_match(code, ANGLES))
    return {
        "category": r["category"], "material": F.coalesce(r["material_type"], note(notes, "material_family", "material_type")), "subcategory": F.coalesce(F.concat(sub, angle), sub),
        "std": std, "size": F.coalesce(r["size"], nps, bars, note(notes, "size", "size_description")), "variant": grade, "notes": notes, "origin": r["origin"],
    }


def parts(said: dict[str, Column]) -> dict[str, Column]:
    """The six normalised parts of what `raw` gives; take its columns out of a generator first, as they are used several times."""
    return {
        "category": category_code(said["category"]), "material": material_code_of(said["material"], said["category"], said["notes"]), "subcategory": subcategory_part(said["subcategory"], said["category"]),
        "std": standard_part(said["std"]), "size": size_part(said["size"]), "variant": variant_part(said["variant"], said["notes"], said["origin"]),
    }


def sku(p: dict[str, Column]) -> Column:
    return F.concat_ws("-", *[p[k] for k in LIMITS])


def problems(p: dict[str, Column]) -> Column:
    """array<string>: the parts that are empty, too long or have other characters than they may."""
    wrong = {k: (F.length(p[k]) == 0) | (F.length(p[k]) > n) | (~p[k].rlike(f"^[{ALLOWED[k]}]+$") if k in ALLOWED else F.contains(p[k], F.lit("-"))) for k, n in LIMITS.items()}
    return F.array_compact(F.array(*[F.when(w, k) for k, w in wrong.items()]))
