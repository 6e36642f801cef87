"""Operator 6: token counts by byte-pair merging with a heap over a linked list of symbols.

A pretoken starts as one symbol for each UTF-8 byte. The heap yields the adjacent pair of lowest rank
(leftmost first), the pair becomes one symbol, its new neighbours enter the heap, and entries that no
longer stand are passed over. The count is the initial symbols less the merges; no identifier is made.

Null and empty texts count 0. Rows are independent: repeated rows repeat, an empty table stays empty,
other columns are kept and columns with the name of an output are replaced. A pretoken of any length
costs n log n.
"""

from __future__ import annotations

import heapq
import json
import re
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotelake.llm.common import add_by_text, bound_batches, table

#: Counts that a worker keeps before it starts anew, and characters of the longest string kept.
KEPT, KEPT_CHARS = 1_000_000, 64
#: A space before one of these characters always opens a pretoken, so counts of what lies between add up.
OPENS = re.compile(" (?=[!-~\u00c0-\u024f])")
#: The pattern that cuts text before byte-level merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class MergeCounter:
    def __init__(self, definition: str):
        import regex

        d = json.loads(definition)
        model, pre = d["model"], d["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if d["normalizer"] or model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or odd:
            raise ValueError("only plain byte-level BPE definitions are counted")
        special = [t for t in d["added_tokens"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in special):
            raise ValueError("added tokens with stripping or word rules are not counted")
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.symbol = {x: i for i, x in enumerate(byte_symbols())}  # a number for each symbol, bytes in order first
        for a, b in merges:
            self.symbol.setdefault(a + b, len(self.symbol))
        self.rank = {self.symbol[a] << 20 | self.symbol[b]: i for i, (a, b) in enumerate(merges)}
        self.made = [self.symbol[a + b] for a, b in merges]
        self.words = regex.compile(PATTERN).findall
        by_length = sorted((t["content"] for t in special), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, by_length))) if by_length else None
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}

    def pretoken(self, word: str) -> int:
        """Initial symbols less merges. A heap entry is rank << 32 | place of the pair's left symbol."""
        symbols = list(word.encode())
        n, rank = len(symbols), self.rank.get
        if n < 2:
            return n
        ranks = [rank(a << 20 | b, -1) for a, b in pairwise(symbols)]  # of the pair that now begins at each place
        heap = [r << 32 | i for i, r in enumerate(ranks) if r >= 0]
        if not heap:
            return n
        ranks.append(-1)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heapq.heapify(heap)
        merges, pop, push, made = 0, heapq.heappop, heapq.heappush, self.made
        while heap:
            e = pop(heap)
            i, r = e & 0xFFFFFFFF, e >> 32
            if ranks[i] != r:
                continue
            merges += 1
            j = after[i]
            symbols[i] = new = made[r]
            ranks[j] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                ranks[i] = r = rank(new << 20 | symbols[k], -1)
                if r >= 0:
                    push(heap, r << 32 | i)
            else:
                ranks[i] = -1
            h = before[i]
            if h >= 0:
                ranks[h] = r = rank(symbols[h] << 20 | new, -1)
                if r >= 0:
                    push(heap, r << 32 | h)
        return n - merges

    def learn(self, part: str, known: dict[str, int], lead: str) -> int:
        n = sum(map(self.pretoken, self.words(lead + part)))
        if len(part) <= KEPT_CHARS:
            if len(known) >= KEPT:
                known.clear()
            known[part] = n
        return n

    def plain(self, text: str) -> int:
        first, *rest = OPENS.split(text)
        n = self.first.get(first)
        if n is None:
            n = self.learn(first, self.first, "")
        counts = list(map(self.later.get, rest))
        if None in counts:
            return n + sum(self.learn(x, self.later, " ") if c is None else c for x, c in zip(rest, counts))
        return n + sum(counts)

    def text(self, text: str) -> int:
        if not self.special or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))

    def count(self, texts: list[str]) -> list[pa.Array]:
        return [pa.array(np.fromiter((self.text(x) for x in texts), np.int64, len(texts)))]


_counters: dict[int, MergeCounter] = {}


def count_tokens(df: DataFrame, definition: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """`df` with `out_col` long, the tokens of each text. `definition` is the content of a tokenizer .json file.

    Counts as the tokenizers library encodes: no truncation or padding; special strings inside a text are one token each.
    """
    shared = df.sparkSession.sparkContext.broadcast(definition)

    def kernel():
        own = _counters.get(key := hash(shared.value))
        if own is None:
            _counters.clear()
            own = _counters[key] = MergeCounter(shared.value)
        return own.count

    return add_by_text(df, text_col, [T.StructField(out_col, T.LongType())], kernel)


def op6_token_counts(spark: SparkSession, sf_dir: str, limit: int = 1024) -> DataFrame:
    import public_tokenizers

    bound_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = count_tokens(docs, Path(public_tokenizers.path("byte_bpe_50k.json")).read_text())
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return out.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
