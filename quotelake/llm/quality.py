"""Operator 9: quality classifier of histogram gradient-boosted trees over document statistics.

Statistics of each whole text (never its id, language, source or labels) are cut into at most BINS bins
each. Trees of fixed depth are grown on the logistic loss from gradient histograms and flattened into
arrays (split statistic and bound of each inner node, value of each leaf), which one numpy step per
level walks for all rows of a batch and all trees.

Training reads at most MAX_ROWS labelled rows, those of least hash of their id, so the fit is the same
at every partitioning; scoring covers every row. A label counts once, with the least of its id's texts where rows
repeat an id. Null texts count as empty, and both have scores. Null
labels and labels without a document are passed over. Without any label the score is 0.5; with labels
of one kind it is their smoothed share. Rows are scored independently; an empty table stays empty,
other columns are kept and columns with an output's name are replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotelake.llm.common import add_by_text, bound_batches, first_rows, table

MAX_ROWS, BINS, ROUNDS, DEPTH, RATE, L2, LEAST = 20_000, 64, 80, 4, 0.15, 1.0, 20
STATISTICS = (
    "log_chars", "log_words", "word_length", "longest_word", "distinct_words", "commonest_word", "repeated_next", "repeated_pairs",
    "lines", "distinct_lines", "line_length", "upper", "lower", "digit", "space", "beyond_ascii", "stop", "comma", "exclaim", "bar",
    "sign", "other_punctuation", "capital_words", "short_words", "no_letter_words", "sign_words",
)


def statistics(texts: list[str]) -> np.ndarray:
    """One row for each text, one column for each of STATISTICS."""
    out = np.zeros((len(texts), len(STATISTICS)))
    for row, text in zip(out, texts):
        if not text:
            continue
        raw = text.encode()
        n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        size, words, lines = len(raw), text.split(), text.split("\n")
        w = max(len(words), 1)
        counts = Counter(words)
        pairs = len(set(zip(words, words[1:]))) / max(len(words) - 1, 1)
        signs = n[35] + n[36] + n[37] + n[38] + n[42]
        ascii_marks = n[33:48].sum() + n[58:65].sum() + n[91:97].sum() + n[123:127].sum()
        row[:] = (
            np.log1p(len(text)), np.log1p(len(words)), len(text) / w, max(map(len, words), default=0), len(counts) / w,
            max(counts.values(), default=0) / w, sum(map(str.__eq__, words, words[1:])) / w, 1 - pairs,
            len(lines), len(set(lines)) / len(lines), len(text) / len(lines), n[65:91].sum() / size, n[97:123].sum() / size,
            n[48:58].sum() / size, n[32] / size, n[128:].sum() / size, n[46] / w, n[44] / w, n[33] / w, n[124] / w, signs / w,
            (ascii_marks - signs - n[46] - n[44] - n[33] - n[124]) / w, sum(map(str.isupper, words)) / w,
            sum([len(x) <= 3 for x in words]) / w, sum([not x.isalpha() for x in words]) / w, sum([x[-1] in "#$%&*!|" for x in words]) / w,
        )
    return out


@dataclass
class Trees:
    """Complete trees of one depth: split[t, node], bound[t, node] and leaf[t, place]."""

    start: float
    split: np.ndarray
    bound: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        if len(x) and len(self.leaf):
            rows, trees = np.arange(len(x))[:, None], np.arange(len(self.leaf))[None, :]
            node = np.zeros((len(x), len(self.leaf)), np.int64)
            for _ in range(int(np.log2(self.leaf.shape[1]))):
                node = 2 * node + 1 + (x[rows, self.split[trees, node]] > self.bound[trees, node])
            total += self.leaf[trees, node - self.split.shape[1]].sum(1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH) -> Trees:
    inner = 2**depth - 1
    ones = y.sum()
    start = float(np.log((ones + 1) / (len(y) - ones + 1)))
    if ones in (0, len(y)):
        rounds = 0
    split, bound = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf)
    leaf = np.zeros((rounds, 2**depth))
    if not rounds:
        return Trees(start, split, bound, leaf)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], 1)
    total = np.full(len(y), start)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = (node - first) * BINS
            gain, best, cut = np.zeros(width), np.zeros(width, np.int64), np.full(width, -1)
            for f in range(x.shape[1]):
                place = at + binned[:, f]
                G, H, N = (np.bincount(place, v, width * BINS).reshape(width, BINS).cumsum(1) for v in (g, h, None))
                gl, hl, nl = G[:, :-1], H[:, :-1], N[:, :-1]
                ga, ha, na = G[:, -1:], H[:, -1:], N[:, -1:]
                got = gl**2 / (hl + L2) + (ga - gl) ** 2 / (ha - hl + L2) - ga**2 / (ha + L2)
                got[(nl < LEAST) | (na - nl < LEAST)] = 0
                b = got.argmax(1)
                top = got[np.arange(width), b]
                better = top > gain + 1e-9
                gain, best, cut = np.where(better, top, gain), np.where(better, f, best), np.where(better, b, cut)
            for i in range(width):
                if cut[i] >= 0:
                    split[t, first + i], bound[t, first + i] = best[i], cuts[best[i]][cut[i]]
            own = node - first
            node = 2 * node + 1 + ((cut[own] >= 0) & (binned[np.arange(len(y)), best[own]] > cut[own]))
        place = node - inner
        G, H = np.bincount(place, g, 2**depth), np.bincount(place, h, 2**depth)
        leaf[t] = -RATE * G / (H + L2)
        total += leaf[t][place]
    return Trees(start, split, bound, leaf)


def crc_third(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Trees fitted to `labels` (0 or 1) of rows whose id's CRC-32 mod 3 is not 1, at most `max_rows` of them."""
    usable = labels.filter(F.col(label).isin(0, 1) & (crc_third(id_col) != 1)).select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).distinct()
    known = usable.join(docs.select(F.col(id_col).alias("_have")), F.col("_id") == F.col("_have"), "left_semi")
    first = first_rows(known, [F.xxhash64("_id"), F.col("_id"), F.col("_y")], max_rows)
    chosen = docs.sparkSession.createDataFrame(first, known.schema)
    texts = docs.select(F.col(id_col).alias("_have"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), F.col("_have") == F.col("_id"))
    texts = texts.groupBy("_id", "_y").agg(F.min("_text").alias("_text"))  # one for each label, however often an id repeats
    out = with_statistics(texts, "_text").select("_id", "_y", "_statistics").toPandas()
    if not len(out):
        return Trees(0.0, np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)))
    x, y = np.array(out["_statistics"].tolist()), out["_y"].to_numpy()
    order = np.lexsort((*x.T, y, out["_id"].to_numpy()))
    return fit(x[order], y[order].astype(float))


def with_statistics(df: DataFrame, text_col: str = "text", out_col: str = "_statistics") -> DataFrame:
    """`df` with `out_col` array<double>, the statistics of each text."""

    def kernel():
        def run(texts: list[str]) -> list[pa.Array]:
            x = statistics(texts)
            return [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))]

        return run

    return add_by_text(df, text_col, [T.StructField(out_col, T.ArrayType(T.DoubleType()))], kernel)


def score(df: DataFrame, trees: Trees, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """`df` with `out_col` double from 0 to 1, higher where label 1 is likelier."""
    shared = df.sparkSession.sparkContext.broadcast(trees)

    def kernel():
        return lambda texts: [pa.array(shared.value.score(statistics(texts)))]

    return add_by_text(df, text_col, [T.StructField(out_col, T.DoubleType())], kernel)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc_third("doc_id") == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
