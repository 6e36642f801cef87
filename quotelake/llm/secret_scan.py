"""Operator 5: secret scan with a keyword automaton, anchored expressions and embedded checksums.

An Aho-Corasick automaton over the lower-cased text (A-Z only) finds every keyword; at each hit, in order and not
before the end of the kind's last match, the kind's expression is tried at that place only, which gives
the leftmost matches that do not overlap. Keys that embed a CRC-32 (the last six base-62 digits) count
only if it agrees. Runs of hexadecimal digits have no keyword; they are looked up as maximal runs.

Spans are code points, end exclusive. Null and empty texts have none. Rows are independent: repeated rows
repeat, an empty table stays empty, other columns are kept and columns with an output's name are replaced.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotelake.llm.common import add_by_text, bound_batches, free_name, table

KINDS = ("assign", "access", "hex", "github", "npm")
BASE = KINDS[:3]
#: kind -> the expression that is tried at a keyword, and the least characters: of group 2 for assign, else of the match.
ANCHORED = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 18),
    "github": (re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), 40),
    "npm": (re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), 40),
}
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access"} | {
    f"gh{c}_": "github" for c in "pousr"
} | {"npm_": "npm"}
CHECKED = {"github", "npm"}
HEX = re.compile(r"[0-9a-f]{16,}")
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum_agrees(key: str) -> bool:
    """Whether the last six base-62 digits are the CRC-32 of what stands between the prefix and them."""
    body, check = key.split("_", 1)[1][:-6], key[-6:]
    n = zlib.crc32(body.encode())
    digits = ""
    for _ in range(6):
        n, r = divmod(n, 62)
        digits = DIGITS[r] + digits
    return digits == check


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def find(text: str, keywords) -> list[tuple[int, int, int]]:
    """(start, kind as listed, end) in order."""
    low = text.lower() if text.isascii() else text.encode().lower().decode()
    found = [(m.start(), KINDS.index("hex"), m.end()) for m in HEX.finditer(text)]
    behind = dict.fromkeys(ANCHORED, 0)
    for start, kind in sorted((end + 1 - n, kind) for end, (kind, n) in keywords.iter(low)):
        if start < behind[kind]:
            continue
        expression, least = ANCHORED[kind]
        if m := expression.match(text, start):
            behind[kind] = m.end()
            if len(m[2] if kind == "assign" else m[0]) >= least and (kind not in CHECKED or checksum_agrees(m[0])):
                found.append((start, KINDS.index(kind), m.end()))
    return sorted(found)


def scan(df: DataFrame, text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """`df` with `out_col` array<struct<kind, start, end>> in order of start, then kind as listed in KINDS."""

    def kernel():
        words = automaton()

        def run(texts: list[str]) -> list[pa.Array]:
            rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find(x, words)] for x in texts]
            return [pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))]

        return run

    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    return add_by_text(df, text_col, [T.StructField(out_col, T.ArrayType(span))], kernel)


def redacted(df: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """`df` with every found span (overlapping ones as one) of `text_col` replaced by `mark`."""

    def kernel():
        words = automaton()

        def clean(text: str) -> str:
            parts, at = [], 0
            for start, _, end in find(text, words):
                if start >= at:
                    parts += [text[at:start], mark]
                at = max(at, end)
            return "".join([*parts, text[at:]])

        return lambda texts: [pa.array(map(clean, texts), pa.string())]

    name = free_name(df.columns, "_clean")
    new = add_by_text(df, text_col, [T.StructField(name, T.StringType())], kernel)
    return new.select(*[F.col(name).alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns])


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return out.select("doc_id", *map(of, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
