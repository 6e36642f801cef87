from pathlib import Path

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quotelake.llm import token_counts as t

from .conftest import HARD, TESTDATA

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = t.MergeCounter(Path(PATH).read_text())


def expected(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from(" ab\n\té🙂.'s1") | st.characters(exclude_categories=["Cs"]), max_size=60))
def test_equals_library_on_any_text(text):
    assert COUNTER.text(text) == expected(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|", "endoftext", "|>", " ", "a", "\n"]), max_size=8).map("".join))
def test_special_strings(text):
    assert COUNTER.text(text) == expected(text)


def test_frame(spark, hard):
    out = t.count_tokens(hard, Path(PATH).read_text()).collect()
    assert len(out) == len(HARD) + 3
    assert all(r.n_tokens == expected(r.text) for r in out)
    assert t.count_tokens(hard.limit(0), Path(PATH).read_text()).count() == 0


def test_other_kinds_are_refused():
    with pytest.raises(ValueError):
        t.MergeCounter(Path(public_tokenizers.path("word_bpe_49k.json")).read_text())


def test_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{TESTDATA}/documents.parquet").collect()}
    for r in t.op6_token_counts(spark, TESTDATA).collect():
        text = texts[r.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), expected(text), expected(text) > 1024)
