import random
import re

import pytest

from quotelake.llm import substring_dedup as s

WORD = re.compile("[^ \t-\r]+")


def expected(rows, size):
    """(id, words, removed, kept) by looking every window up among the windows of all smaller ids."""
    words = [WORD.findall(t or "") for _, t in rows]
    starts = {}
    for (i, _), w in zip(rows, words):
        if i is not None:
            for k in range(len(w) - size + 1):
                gram = tuple(w[k : k + size])
                starts[gram] = min(i, starts.get(gram, i))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - size + 1) if i is not None else []:
            if starts[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        out.append((repr(i), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def rows_of(df):
    return sorted((repr(r.doc_id), r["_cut"].n_words, r["_cut"].n_removed, r["_cut"].kept) for r in df.collect())


def made(rng, size):
    """Texts of few words, with passages of every length around `size` planted at every offset, copies, repeats within a text, and hard cases."""
    word = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passages = [word(n) for n in (size - 1, size, size + 1, 2 * size, 3 * size + 7)]
    texts = []
    for i in range(60):
        w = word(rng.randrange(0, 2 * size))
        for p in rng.sample(passages, rng.randrange(0, 4)):
            cut = p[rng.randrange(0, 3) : len(p) - rng.randrange(0, 3)]
            w = w + word(rng.randrange(0, 4)) + cut + word(rng.randrange(0, 3))
        texts.append(rng.choice([" ", "\n", "\t \x0b"]).join(w))
    texts += [texts[5], texts[5].upper(), "same " * 500, "same " * (size - 1), "same " * size, None, "", " \r\n", "é 日本　x\xa0y " * 40, " ".join(passages[4] * 3)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return [*rows, rows[3], (7, texts[9]), (7, texts[5]), (None, texts[5]), (None, "same " * 500), (-5, texts[11])]


@pytest.mark.parametrize("size", [50, 7, 1])
def test_equals_brute_force(spark, size):
    rows = made(random.Random(size), size)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("'e' AS `_id`", "*", "1 AS `starts`", "2 AS `a.b`", "3 AS `row`", "'k' AS `_key`")
    out = s.without_repeats(docs, size)
    assert out.columns == [*docs.columns, "_cut"]
    assert rows_of(out) == expected(rows, size)


def test_long_texts_and_slices(spark, monkeypatch):
    """Texts that are cut into many slices, and one longer than a slice."""
    monkeypatch.setattr(s, "HASHED_BYTES", 2000)
    rng = random.Random(1)
    long = " ".join(f"x{rng.randrange(10**6)}" for _ in range(20000))
    rows = [(i, " ".join(long.split()[i * 37 : i * 37 + 90 + i])) for i in range(1, 80)] + [(0, long), (200, long)]
    assert rows_of(s.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == expected(rows, 50)


def test_frequent_passage_makes_no_pairs(spark):
    """Anchors of a passage that all documents share grow with the documents, not with their pairs."""
    passage = " ".join(f"p{i}" for i in range(80))
    counts = []
    for n in (100, 400):
        docs = spark.range(n).selectExpr("id AS doc_id", f"concat('u', id, ' {passage} v', id) AS text")
        texts = s.named(docs, "doc_id", "text")
        windows = s.around(texts, s.anchors(texts, 50), 50)
        counts.append(windows.count())
    assert counts[1] <= 4.2 * counts[0]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert s.without_repeats(docs).count() == 0
    only = spark.createDataFrame([(1, None), (None, "a b")], "doc_id long, text string")
    assert rows_of(s.without_repeats(only)) == [("1", 0, 0, ""), ("None", 2, 0, "a b")]
