import re

import pytest

from quotelake.llm import decontamination as d

from .conftest import TESTDATA

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall((text or "").encode().lower().decode())


def expected(text, bench, size=10):
    """(words, hit words, items) by sliding every window of every item over the text."""
    w, hit, items = split(text), set(), set()
    for item, t in bench:
        b = split(t)
        for i in range(max(1, len(b) - size + 1)) if b else []:
            gram = b[i : i + size]
            for at in range(len(w) - len(gram) + 1):
                if w[at] == gram[0] and w[at : at + len(gram)] == gram:
                    hit.update(range(at, at + len(gram)))
                    items.add(str(item) if item is not None else "")
    return len(w), len(hit), sorted(items)


BENCH = [(1, " ".join(f"q{i}" for i in range(14))), (2, "Short ITEM"), (3, None), (4, "..."), (2, "Short ITEM"), (5, "x x x x x x x x x x x x"), (None, "one word")]
TEXTS = [
    None, "", "q0 q1 q2", "pre " + " ".join(f"Q{i}" for i in range(14)) + " post", " ".join(f"q{i}," for i in range(12)), "a short item, a SHORT-item", "x " * 30,
    "one word", "q3 q4 q5 q6 q7 q8 q9 q10 q11 no", "q3 q4 q5 q6 q7 q8 q9 q10 q11 q12", "short", "item short", "one " * 500 + "word",
]


@pytest.mark.parametrize("most", [0, d.MOST_BROADCAST])
def test_hits_and_removal(spark, monkeypatch, most):
    monkeypatch.setattr(d, "MOST_BROADCAST", most)
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (3, "another text"), (None, "short item")]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, items string, n int")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    out = d.contamination(docs, bench).collect()
    want = sorted((repr(i), *map(repr, expected(t, BENCH))) for i, t in rows)
    assert sorted((repr(r.doc_id), repr(r.n_words), repr(r.n_hit), repr(r["items"])) for r in out) == want
    kept = d.decontaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(repr(r) for r in rows if not expected(r[1], BENCH)[1])
    cut = d.decontaminated(docs, bench, remove="spans")
    assert cut.columns == docs.columns and cut.count() == len(rows)
    for r in cut.collect():
        assert not expected(r.text, [x for x in BENCH if x[0] in (1, 5)])[1]
    assert [r.text for r in cut.filter("doc_id = 3 AND text LIKE 'pre%'").collect()] == ["pre post"] * 2


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert [tuple(r)[2:4] for r in d.contamination(docs, bench.limit(0)).collect()] == [(3, 0)]
    assert d.contamination(docs.limit(0), bench).count() == 0
    assert d.decontaminated(docs, bench.limit(0)).count() == 1


def test_query(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet").collect()
    bench = [tuple(r) for r in spark.read.parquet(f"{TESTDATA}/benchmark.parquet").collect()]
    want = {r.doc_id: expected(r.text, bench) for r in docs}
    for r in d.op10_decontamination(spark, TESTDATA).collect():
        n, hit, items = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(items), hit > 0)


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a short item", 1, 2, 3), (1, "clean", 4, 5, 6)], "doc_id long, text string, _id int, _row int, c1 int")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    for remove, texts in (("documents", ["clean"]), ("spans", ["a", "clean"])):
        out = d.decontaminated(docs, bench, remove=remove)
        assert out.columns == docs.columns and sorted(r.text for r in out.collect()) == texts
