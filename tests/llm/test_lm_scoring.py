import math
from collections import Counter

import pytest

from quotelake.llm import lm_scoring as m

from .conftest import TESTDATA


def expected(texts, corpus, order, vocabulary, alpha=m.ALPHA, least=m.LEAST):
    """Stupid backoff by its recursive definition."""
    split = lambda t: (t or "").encode().lower().split()
    single = Counter(w for t in corpus for w in split(t))
    known = {w for w, _ in sorted(single.items(), key=lambda x: (-x[1], x[0]))[:vocabulary]}
    fold = lambda t: [w if w in known else None for w in split(t)]
    counts, total = Counter(), sum(single.values())
    for t in corpus:
        w = fold(t)
        counts.update(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1))

    def s(gram):
        if len(gram) == 1:
            return math.log10(max(counts[gram], 1) / max(total, 1))
        return math.log10(counts[gram] / counts[gram[:-1]]) if counts[gram] >= least else math.log10(alpha) + s(gram[1:])

    out = []
    for t in texts:
        w = fold(t)
        out.append((len(w), sum(s(tuple(w[max(0, i - order + 1) : i + 1])) for i in range(len(w)))))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("hot", [0, 50])
def test_equals_definition(spark, hard, monkeypatch, order, hot):
    monkeypatch.setattr(m, "HOT_KEPT", hot)
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet").select("doc_id", "text").limit(30).cache()
    both = hard.select("doc_id", "text").unionByName(docs)
    rows = both.collect()
    texts = [r.text for r in rows]
    want = {}
    for r, (n, total) in zip(rows, expected(texts, texts, order, 40)):
        want.setdefault(r.doc_id, []).append((n, total))
    out = m.score(both, order=order, vocabulary=40).collect()
    assert len(out) == len(rows)
    for r in out:
        assert any(r.n_words == n and abs(r.total - total) < 1e-6 for n, total in want[r.doc_id])
        assert r.score is None if not r.n_words else abs(r.score - r.total / r.n_words) < 1e-9


def test_another_corpus_and_empty_tables(spark, hard):
    corpus = spark.createDataFrame([("a b a b c",), ("a b",)], "text string")
    docs = spark.createDataFrame([(1, "a b z"), (2, "b a")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.total) for r in m.score(docs, corpus).collect()}
    for r, want in zip((1, 2), expected(["a b z", "b a"], ["a b a b c", "a b"], 2, m.VOCABULARY)):
        assert got[r][0] == want[0] and abs(got[r][1] - want[1]) < 1e-9
    assert m.score(hard.limit(0)).count() == 0
    assert m.score(docs, corpus.limit(0)).count() == 2


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize("hot", [0, 50])
def test_whole_counts_equal_definition(spark, hard, monkeypatch, order, hot):
    """Every word and n-gram counts, also those that stand once."""
    monkeypatch.setattr(m, "HOT_KEPT", hot)
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet").select("doc_id", "text").limit(30).cache()
    both = hard.select("doc_id", "text").unionByName(docs)
    rows = both.collect()
    texts, want = [r.text for r in rows], {}
    for r, x in zip(rows, expected(texts, texts, order, 10**9, least=1)):
        want.setdefault(r.doc_id, []).append(x)
    out = m.score_whole(both, order=order).collect()
    assert len(out) == len(rows)
    assert all(any(r.n_words == n and abs(r.total - total) < 1e-6 for n, total in want[r.doc_id]) for r in out)
    assert m.score_whole(hard.limit(0), order=order).count() == 0


def test_query_is_whole(spark, tmp_path):
    """More words than VOCABULARY, most of them once: none is lumped together, no n-gram is left out."""
    texts = [" ".join(f"w{i}" for i in range(a, a + 7000)) for a in range(0, 70_000, 6900)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.total) for r in m.op7_lm_scoring(spark, str(tmp_path)).collect()}
    for i, (n, total) in enumerate(expected(texts, texts, m.ORDER, 10**9, least=1)):
        assert got[i][0] == n and abs(got[i][1] - total) < 2e-6
