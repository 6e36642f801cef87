"""Operator 1: SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model crosses from a letter to a white-space marker, so a marked text falls into
chunks (markers, then the characters up to the next marker) that segment independently. Each worker
keeps a bounded table of distinct chunks: a chunk is segmented and decoded once by the library, and
a text's ids are the chunks' ids gathered by position.

Nulls and empty texts have no ids and decode to "". Rows are independent: repeated rows give repeated
results, an empty table gives an empty one, other columns are kept, and columns that have the name of
an output are replaced. A very long text is one slice of work, a very long chunk is not kept.
"""

from __future__ import annotations

import re
from array import array
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotelake.llm.common import add_by_text, bound_batches, table

#: Chunks that a worker keeps before it starts its table anew, and characters of the longest one kept.
TABLE_CHUNKS, CHUNK_CHARS = 150_000, 200
MARK = "▁"
#: The first space of a run that follows another character: it stands for the marker that opens the next chunk.
OPENS = re.compile("(?<=[^ ]) ")


class ChunkTable:
    """Distinct chunks with their ids (ragged, flat) and decoded texts."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.splits = self._splits()
        self.reset()

    def _splits(self) -> bool:
        """Whether chunks are independent: a marker for a leading space, spaces kept as they are, and no piece with a marker inside."""
        sp = self.sp
        pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
        plain = [" a", "a  b", "éﬁ① Ａ́", "\t 　x"]
        return (
            not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
            and not sp.is_unknown(sp.piece_to_id(MARK))
            and sp.id_to_piece(sp.encode("a")).count(f"{MARK}a") == 1
            and all(sp.decode(sp.encode(x)) == x for x in plain)
        )

    def reset(self) -> None:
        self.code: dict[str, int] = {}
        self.starts, self.lengths, self.ids = array("q"), array("q"), array("i")
        self.texts: list[str] = []

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text, each without the marker that opens it and with spaces for the others."""
        if not self.splits or not text:
            return [text] if text else []
        if MARK in text:
            text = text.replace(MARK, " ")
        return text.split(" ") if "  " not in text and text[0] != " " else OPENS.split(text)

    def add(self, new: list[str]) -> None:
        sp = self.sp
        made = sp.encode(new, num_threads=1)
        if self.splits:
            alone = [sp.piece_to_id(MARK)]
            made = [m if x else alone for x, m in zip(new, made)]
        for x, ids, text in zip(new, made, sp.decode(made)):
            self.code[x] = len(self.texts)
            self.starts.append(len(self.ids))
            self.lengths.append(len(ids))
            self.ids.extend(ids)
            self.texts.append(text)

    def encode(self, texts: list[str]) -> list[pa.Array]:
        """The ids of each text and what they decode to."""
        per_text = [self.chunks(x) for x in texts]
        codes = [list(map(self.code.get, chunks)) for chunks in per_text]
        open_ = [i for i, c in enumerate(codes) if None in c]
        new = set(chain.from_iterable(per_text[i] for i in open_)).difference(self.code)
        if new:
            self.add(list(new))
        for i in open_:
            codes[i] = list(map(self.code.__getitem__, per_text[i]))
        known = self.texts
        # a chunk's decoding lacks the one leading space that its marker stands for
        decoded = [" ".join([known[c] for c in cs]) for cs in codes]
        n = np.fromiter(map(len, codes), np.int64, len(codes))
        flat = np.fromiter(chain.from_iterable(codes), np.int64, int(n.sum()))
        lengths = np.frombuffer(self.lengths, np.int64)[flat] if len(flat) else flat
        ends = np.cumsum(lengths)
        if len(ends) and ends[-1]:
            first = np.frombuffer(self.starts, np.int64)[flat] - (ends - lengths)
            values = np.frombuffer(self.ids, np.int32)[np.repeat(first, lengths) + np.arange(ends[-1])]
        else:
            values = np.empty(0, np.int32)
        bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(n)))]
        out = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))
        if new:
            self.shrink(max(map(len, new)))
        return [out, pa.array(decoded, pa.string())]

    def shrink(self, longest: int) -> None:
        """Start anew where the table is full; forget very long chunks at once."""
        if len(self.texts) > TABLE_CHUNKS or len(self.ids) > 16 * TABLE_CHUNKS:
            self.reset()
        elif longest > CHUNK_CHARS:
            for x in [x for x in self.code if len(x) > CHUNK_CHARS]:
                self.texts[self.code.pop(x)] = ""


_tables: dict[int, ChunkTable] = {}


def encode(df: DataFrame, model: bytes, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """`df` with `ids_col` array<int> (no begin or end ids) and `decoded_col`, the library's decode of these ids.

    `model` is the content of a SentencePiece model file. Equals the library's encode of the whole text.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def kernel():
        own = _tables.get(key := hash(shared.value))
        if own is None:
            _tables.clear()
            own = _tables[key] = ChunkTable(shared.value)
        return own.encode

    new = [T.StructField(ids_col, T.ArrayType(T.IntegerType(), True)), T.StructField(decoded_col, T.StringType())]
    return add_by_text(df, text_col, new, kernel)


def op1_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    bound_batches(spark)
    model = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
    out = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return digests(out)


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    return encoded.select(
        "doc_id",
        *more,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
