import hashlib
from pathlib import Path

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quotelake.llm import sentencepieces as s

from .conftest import HARD, TESTDATA

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
TABLE = s.ChunkTable(Path(PATH).read_bytes())


def expected(text):
    ids = LIBRARY.encode(text or "")
    return ids, LIBRARY.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from(" ▁ab\n\té🙂.'") | st.characters(exclude_categories=["Cs"]), max_size=30), max_size=5))
def test_equals_library_on_any_text(texts):
    ids, decoded = TABLE.encode(texts)
    assert [list(zip([i], [d])) for i, d in zip(ids.to_pylist(), decoded.to_pylist())] == [[(expected(x)[0], expected(x)[1])] for x in texts]


def test_chunks_are_used():
    assert TABLE.splits and len(TABLE.chunks("one two  three")) == 3


def test_full_table_starts_anew(monkeypatch):
    monkeypatch.setattr(s, "TABLE_CHUNKS", 3)
    own = s.ChunkTable(Path(PATH).read_bytes())
    for x in ["a b c d e f", "a z y", "a b c d e f"]:
        assert own.encode([x])[0].to_pylist() == [LIBRARY.encode(x)]


def test_frame_keeps_rows_and_columns(spark, hard):
    out = s.encode(hard, Path(PATH).read_bytes()).collect()
    assert len(out) == len(HARD) + 3 and "a.b" in out[0].asDict()
    for r in out:
        assert (r.ids, r.decoded) == expected(r.text)
    assert s.encode(hard.limit(0), Path(PATH).read_bytes()).count() == 0


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{TESTDATA}/documents.parquet").collect()}
    out = s.op1_sentencepieces(spark, TESTDATA).collect()
    assert len(out) == len(texts)
    for r in out:
        ids, decoded = expected(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
