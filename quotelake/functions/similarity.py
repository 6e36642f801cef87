"""String similarity. All of it ignores case; all but Jaro-Winkler are built-in expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def distance(a: Column, b: Column) -> Column:
    return F.levenshtein(F.lower(a), F.lower(b))


def similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 0 where either is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - distance(a, b) / F.nullif(longest, F.lit(0)).cast("double"))


def grams(a: Column, n: int = 2) -> Column:
    """Distinct n-grams without white space; none where the raw text is shorter than n."""
    t = F.regexp_replace(F.lower(a), r"\s+", "")
    cut = F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substr(t, i, F.lit(n)))
    return F.when((F.length(a) >= n) & (F.length(t) >= n), F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def tokens(a: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(a), r"[^a-z0-9\s]", " "), r"\s+"), lambda x: x != "")


def jaccard(x: Column, y: Column) -> Column:
    """Of two arrays; both empty: 1, one empty: 0."""
    both = F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)).cast("double")
    return F.coalesce(both, F.lit(1.0))


def soundex(a: Column) -> Column:
    """Equal codes merge even across vowels (so Tymczak is T520); other characters than letters don't count."""
    letters = F.regexp_replace(F.upper(a), "[^A-Z]", "")
    codes = F.regexp_replace(F.translate(letters, "BFPVCGJKQSXZDTLMNRAEIOUYHW", "111122222222334556"), r"(\d)\1+", "$1")
    rest = F.when(F.contains(F.lit("AEIOUYHW"), F.left(letters, F.lit(1))), codes).otherwise(F.substr(codes, F.lit(2)))
    return F.when(letters == "", "").otherwise(F.rpad(F.left(F.concat(F.left(letters, F.lit(1)), rest), F.lit(4)), 4, "0"))


def _jaro_winkler(a: str, b: str) -> float:
    a, b = a.lower(), b.lower()
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, left = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                left.append(x)
                break
    m = len(left)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(left, [y for j, y in enumerate(b) if taken[j]])) / 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    head = 0
    while head < min(4, len(a), len(b)) and a[head] == b[head]:
        head += 1
    return jaro + head * 0.1 * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """With the bonus for a common start of up to four characters always applied."""
    return pd.Series([_jaro_winkler(x or "", y or "") for x, y in zip(a, b)], dtype=float)


def weighted(a: Column, b: Column, jw: Column) -> Column:
    """0.3 edit + 0.3 Jaro-Winkler + 0.2 bigrams + 0.15 tokens + 0.05 sound; equal: 1, one empty: 0."""
    sound = F.when(soundex(a) == soundex(b), 1.0).otherwise(0.0)
    s = 0.3 * similarity(a, b) + 0.3 * jw + 0.2 * jaccard(grams(a), grams(b)) + 0.15 * jaccard(tokens(a), tokens(b)) + 0.05 * sound
    return F.when(F.lower(a) == F.lower(b), 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(F.least(s, F.lit(1.0)))
