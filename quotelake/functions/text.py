"""Text expressions: headers, page scores, quantities, units, titles, embedded metadata."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotelake.functions.similarity import similarity

#: role -> expression over a normalised header, in order of precedence.
ROLES = {
    "item_number": r"^(item|pos|line|no|s/?n)\b", "description": r"\b(desc|description|material|name|title|particulars)\b", "quantity": r"\b(qty|quantity|pcs|count)\b",
    "unit": r"\b(unit|uom)\b", "size": r"\b(size|dn|nps|diameter)\b", "weight": r"\b(weight|wt|kg|mt)\b", "length": r"\b(length|len)\b", "standard": r"\b(standard|spec|norm)\b", "grade": r"\bgrade\b",
}


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with `value` computed once for each row however often f names it, inside other functions of arrays too."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def header(h: Column) -> Column:
    """Lower case, punctuation as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(h, F.lit(""))), r"[^a-z0-9/ ]", " "), " +", " "))


def role(h: Column) -> Column:
    n = header(h)
    return reduce(lambda c, r: c.when(n.rlike(r[1]), r[0]), ROLES.items(), F)


def keyword_score(h: Column, keyword: str) -> Column:
    """1 where the header contains the keyword; 0.8 where a word begins like it; else the similarity, from 0.6 on."""
    n, k = header(h), F.lit(keyword)
    s = similarity(n, k)
    return F.when(F.contains(n, k), 1.0).when(F.exists(F.split(n, " "), lambda w: (F.length(w) >= 3) & F.startswith(k, w)), 0.8).when(s >= 0.6, s).otherwise(0.0)


def share_of(t: Column, pattern: str) -> Column:
    """Share of a text's characters that match a class."""
    return F.length(F.regexp_replace(t, f"[^{pattern}]", "")) / F.nullif(F.length(t), F.lit(0)).cast("double")


def page_relevance(t: Column, keywords: list[str], negative: list[str]) -> Column:
    """Keywords found (up to 40 points), digits, columns and length add; words of other matter take away; at least 0."""
    low = F.lower(F.coalesce(t, F.lit("")))
    n = reduce(lambda a, b: a + b, [F.contains(low, F.lit(k)).cast("int") for k in keywords])
    bad = reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in negative])
    lines = F.size(F.split(low, "\n"))
    score = F.least(F.lit(40), 3 * n) + F.when(F.coalesce(share_of(low, "0-9"), F.lit(0.0)) >= 0.15, 30).otherwise(0)
    score = score + F.when(low.rlike(r"(\t|\|| {3,})"), 20).otherwise(0) + F.when(lines > 30, 10).otherwise(0) - F.when(bad, 50).otherwise(0)
    return F.greatest(score, F.lit(0))


def quantity(t: Column) -> Column:
    """The number in a text: 1,234 and 1.234,5 and 1,5 are read by where their separators stand; to the nearest whole, halves up."""
    s = F.regexp_extract(F.coalesce(t, F.lit("")), r"([0-9][0-9.,]*)", 1)
    s = F.regexp_replace(s, r"[.,]+$", "")
    comma, dot = F.instr(s, ","), F.instr(s, ".")
    plain = (
        F.when((comma > 0) & (dot > 0) & (dot < comma), F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when((comma > 0) & (dot > 0), F.replace(s, F.lit(","), F.lit("")))
        .when(s.rlike(r"^[0-9]{1,3}(,[0-9]{3})+$"), F.replace(s, F.lit(","), F.lit("")))
        .otherwise(F.replace(s, F.lit(","), F.lit(".")))
    )
    return F.floor(F.try_to_number(plain, F.lit("999999999999.999999")).cast("double") + 0.5).cast("long")


#: Names of units -> code.
UNITS = {"pcs": "EA", "pc": "EA", "each": "EA", "nos": "EA", "ea": "EA", "m": "M", "mtr": "M", "meter": "M", "kg": "KG", "kgs": "KG", "mt": "MT", "ton": "MT", "set": "SET", "ft": "FT"}


def unit(t: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.regexp_replace(F.lower(F.trim(t)), "[^a-z]", "")), F.lit("EA"))


def title_of(file_name: Column) -> Column:
    """A file's name without folders, ending, and separators; words capitalised."""
    base = F.regexp_replace(F.regexp_replace(file_name, r"^.*/", ""), r"\.[A-Za-z0-9]+$", "")
    return F.initcap(F.trim(F.regexp_replace(base, r"[_\-\s]+", " ")))


def embedded(notes: Column, tag: str, schema: str) -> Column:
    """A JSON object that stands in notes as [tag:{...}]."""
    return F.from_json(F.regexp_extract(notes, rf"(?s)\[{tag}:(\{{.*?\}})\]", 1), schema)


def without_embedded(notes: Column, tag: str) -> Column:
    return F.trim(F.regexp_replace(notes, rf"(?s)\[{tag}:\{{.*?\}}\]", ""))


def layout_signature(kind: Column, headers: Column, text: Column) -> Column:
    return F.concat_ws("::", kind, F.array_join(F.transform(headers, header), "|"), F.left(text, F.lit(120)))


def weighted_search(fields: list[tuple[Column, float]], term: str) -> Column:
    """Sum over fields of their weight times the number of words of the term that they hold."""
    words = F.array(*map(F.lit, term.lower().split()))
    return reduce(lambda a, b: a + b, [w * F.size(F.array_intersect(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), words)) for c, w in fields])
