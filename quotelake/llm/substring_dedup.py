"""Operator 12: removal of passages that repeat across documents, by fixed-block anchors.

Every window of SIZE words holds a whole block of BLOCK words that begins at a multiple of BLOCK, wherever it begins itself. So
blocks alone are indexed (one row for BLOCK words, then the smallest id of each block), and every rolling window of BLOCK words of every document
probes the index. A hit is a probe that found its block in a document of smaller id. Hits are extended on both sides: by probing document and
indexed document, all windows of SIZE words around an anchor meet by two further hashes of their words, and a window whose words also
start in a smaller id is a repeat. Overlapping repeats join to maximal spans, which are removed.

No pairs of documents are made: a block, and a window, is known by its smallest id. Probes and windows meet these by joins of which only the
rows of documents can be skewed, so adaptive execution splits a frequent passage over tasks. Texts are read three times and hashed in numpy; rows that
meet are hashes and ids only. Blocks and probes meet by 64 bits, which decides only what is looked at; windows by 128 bits, so that
n different ones are all told apart but for a chance of about n^2 / 2^129.

Null and empty texts have no words. Rows that repeat an id and text are equal documents of one id: none is smaller than the other, and
they have equal results. Rows that share only an id are kept apart. A null id is neither smaller nor larger than any: nothing is removed from it or for
its sake. Texts of any length are read whole. An empty table gives no rows. Extra columns of any name are kept where documents are returned.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotelake.llm.common import bound_batches, discard, row_key, shared_table, slices, table
from quotelake.llm.hashing import HASHED_BYTES, MIX, Words, mixed, utf8

SIZE = 50
WORD = re.compile("[^ \t-\r]+")


def block_of(size: int) -> int:
    """Words of a block: the most of which every window of `size` words holds a whole one."""
    return (size + 1) // 2


class Rolling(Words):
    """Hashes of every k consecutive words of a text, capitals kept: mixed sums of the words' hashes times odd numbers. `seed` gives other numbers."""

    def __init__(self, k: int, seed: int = 0):
        super().__init__()
        capitals = slice(ord("A"), ord("Z") + 1)
        self.byte[capitals] = mixed(np.arange(1, 257, dtype=np.uint64) * MIX[0])[capitals]
        self.k, self.mix = k, mixed(np.arange(1 + seed * k, 1 + (seed + 1) * k, dtype=np.uint64) * MIX[2]) | np.uint64(1)

    def of(self, w: np.ndarray) -> np.ndarray:
        """One for each place where k words begin; those that cross the end of a text are there too."""
        rolled = np.full(max(len(w) - self.k + 1, 0), self.k, np.uint64)
        for i in range(self.k if len(rolled) else 0):
            rolled += w[i : i + len(rolled)] * self.mix[i]
        return mixed(rolled)


def places(ends: np.ndarray, k: int, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of every step-th window of k words that lies within one text; `ends`: where the words of each text begin."""
    counts = np.maximum((np.diff(ends) - k) // step + 1, 0)
    counts[np.diff(ends) < k] = 0
    text = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    return text, ends[:-1][text] + within * step


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, row (key of the text), text: the rows whose id can be compared."""
    return docs.select(F.col(id_col).alias("doc"), row_key(F.col(text_col)).alias("row"), F.col(text_col).alias("text")).filter("doc IS NOT NULL AND text IS NOT NULL")


def grams(texts: DataFrame, k: int, step: int) -> DataFrame:
    """h, doc, row: the hashes of every step-th window of k words; of a text's equal ones that follow each other, one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(k)
        for batch in batches:
            for part in slices(batch, 2, HASHED_BYTES):
                w, ends = rolling.words(*utf8(part.column(2)))
                text, at = places(ends, k, step)
                order = pa.array(text)
                yield pa.RecordBatch.from_arrays([signed(rolling.of(w)[at]), part.column(0).take(order), part.column(1).take(order)], names=["h", "doc", "row"])

    return texts.mapInArrow(run, f"h long, doc {texts.schema['doc'].dataType.simpleString()}, row long")


def anchors(texts: DataFrame, size: int) -> DataFrame:
    """A stored table doc, row, hs array<long>: of each document, the blocks' hashes by which it found a smaller id or was found by a larger one."""
    block = block_of(size)
    blocks = shared_table(grams(texts, block, block))
    index = shared_table(blocks.groupBy("h").agg(F.min("doc").alias("smallest")))
    hits = shared_table(grams(texts, block, 1).join(index.hint("shuffle_hash"), "h").filter("doc > smallest").select("h", "doc", "row"))
    found = shared_table(hits.select("h").distinct())
    both = hits.unionByName(blocks.join(found, "h", "left_semi"))
    out = shared_table(both.groupBy("doc", "row").agg(F.collect_set("h").alias("hs")))
    discard(blocks, index, hits, found)
    return out


def around(texts: DataFrame, marked: DataFrame, size: int) -> DataFrame:
    """a, b, doc, row, at: the two hashes of each window of `size` words that holds an anchor (marked: doc, row, hs), and its first word."""
    block = block_of(size)
    names = marked.select(F.col("doc").alias("_doc"), F.col("row").alias("_row"), "hs")
    read = texts.join(names, (F.col("doc") == F.col("_doc")) & (F.col("row") == F.col("_row"))).select("doc", "row", "text", "hs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, first, second = Rolling(block), Rolling(size, 1), Rolling(size, 2)
        for batch in batches:
            for part in slices(batch, 2, HASHED_BYTES):
                w, ends = short.words(*utf8(part.column(2)))
                rolled, marks = short.of(w), np.zeros(len(w) + 1, np.int64)
                hs = part.column(3)
                known, bounds = hs.flatten().to_numpy().view(np.uint64), hs.offsets.to_numpy() - hs.offsets[0].as_py()
                for (a, b), (c, d) in zip(pairwise(ends.tolist()), pairwise(bounds.tolist()), strict=True):
                    if b - a >= size:
                        own = np.sort(known[c:d])
                        probe = rolled[a : b - block + 1]
                        at = np.minimum(np.searchsorted(own, probe), len(own) - 1)
                        marks[a + 1 : a + 1 + len(probe)] = own[at] == probe
                before = np.cumsum(marks)
                text, at = places(ends, size)
                near = before[at + size - block + 1] > before[at]
                text, at = text[near], at[near]
                order = pa.array(text)
                made = [signed(first.of(w)[at]), signed(second.of(w)[at]), part.column(0).take(order), part.column(1).take(order), pa.array((at - ends[text]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(made, names=["a", "b", "doc", "row", "at"])

    return read.mapInArrow(run, f"a long, b long, doc {texts.schema['doc'].dataType.simpleString()}, row long, at int")


def repeats(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stored table _id, _row, starts array<int>: of each document, the first words of its windows that also start in a smaller id."""
    texts = named(docs, id_col, text_col)
    marked = anchors(texts, size)
    windows = shared_table(around(texts, marked, size))
    discard(marked)
    first = windows.groupBy("a", "b").agg(F.min("doc").alias("smallest"), F.max("doc").alias("largest"))
    first = shared_table(first.filter("smallest < largest").drop("largest"))
    again = windows.join(first.hint("shuffle_hash"), ["a", "b"]).filter("doc > smallest")
    out = shared_table(again.groupBy(F.col("doc").alias("_id"), F.col("row").alias("_row")).agg(F.collect_set("at").alias("starts")))
    discard(windows, first)
    return out


def cut(text: str, starts: list[int], size: int) -> tuple[list[str], np.ndarray]:
    """The words of a text, and which of them stay."""
    words = WORD.findall(text)
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.asarray(starts, np.int64)
    edge[at] += 1  # starts are distinct
    edge[at + size] -= 1
    return words, np.cumsum(edge)[:-1] == 0


def without_repeats(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of `docs`, and the struct<n_words long, n_removed long, kept string> `_cut` as the last one: kept words joined by one space."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    own, text = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col))
    found = repeats(docs, size, id_col, text_col)
    plain = docs.toDF(*names).withColumn("_key", row_key(text))
    read = plain.join(found, (own == F.col("_id")) & (F.col("_key") == F.col("_row")), "left").select(*names, "starts")
    at, kind = docs.columns.index(text_col), "struct<n_words:bigint,n_removed:bigint,kept:string>"
    fields = [*read.schema.fields[:-1], T.StructField("_cut", T._parse_datatype_string(kind))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                total, gone, kept = [], [], []
                for t, s in zip(part.column(at).to_pylist(), part.column(len(names)).to_pylist()):
                    words, stays = cut(t or "", s or [], size)
                    total.append(len(words))
                    gone.append(int(len(words) - stays.sum()))
                    kept.append(" ".join(words if not s else [w for w, y in zip(words, stays.tolist()) if y]))
                made = pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["n_words", "n_removed", "kept"])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], made], names=[*names, "_cut"])

    return read.mapInArrow(run, T.StructType(fields)).toDF(*docs.columns, "_cut")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "_cut.n_words", "_cut.n_removed", F.sha2("_cut.kept", 256).alias("kept_sha256"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT rid, doc_id, i, array_to_string(w[i:i + {SIZE - 1}], ' ') AS gram FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - {SIZE - 2})) AS i FROM d WHERE len(w) >= {SIZE})),
f AS (SELECT gram, min(doc_id) AS smallest FROM g GROUP BY gram),
r AS (SELECT rid, list(DISTINCT p) AS gone FROM (SELECT rid, unnest(range(i, i + {SIZE})) AS p FROM g JOIN f USING (gram) WHERE doc_id > smallest) GROUP BY rid),
k AS (SELECT d.rid, string_agg(w[d.p], ' ' ORDER BY d.p) AS kept, count(*) AS n
      FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS p FROM d) AS d LEFT JOIN (SELECT rid, unnest(gone) AS p FROM r) AS x ON d.rid = x.rid AND d.p = x.p
      WHERE x.p IS NULL GROUP BY d.rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""
