"""Words of a text as the license and benchmark operators take them: ASCII letters and digits in lower case, and all characters beyond ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotelake.llm.common import ascii_lower

#: What stands between words of a lower-cased text, as a Java and RE2 class.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """array<string>; null has no words."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def once(value: Column) -> Column:
    """A generator of just this value: select it under a name, and the optimiser can't repeat the expression wherever the name is used."""
    return F.explode(F.array(value))


#: The same in DuckDB's SQL.
SQL_WORDS = (
    r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
