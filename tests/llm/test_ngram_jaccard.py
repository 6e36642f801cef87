import random
import re

import pytest

from quotelake.llm import ngram_jaccard as j

from .conftest import TESTDATA


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def expected(rows):
    """id -> (size, component) by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (_, a) in enumerate(sets):
        for y, (_, b) in enumerate(sets[:x]):
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(x)] = root(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        least[root(x)] = min(i, least.get(root(x), i))
    return sorted((i, len(s), least[root(x)]) for x, (i, s) in enumerate(sets))


def made(seed, groups=40):
    """Groups of texts with edits, chains that drift away from their start, and a passage that many share."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(3000)}"
    passage, texts = [word() for _ in range(60)], []
    for g in range(groups):
        text = [word() for _ in range(r.choice([1, 3, 5, 8, 30, 90, 300]))] + passage * (g % 3 == 0)
        for _ in range(r.choice([1, 1, 2, 6, 15])):
            texts.append(" ".join(text))
            now = list(text)
            for _ in range(r.choice([0, 1, len(now) // 40, len(now) // 25])):
                now[r.randrange(len(now))] = word()
            text = now if g % 2 else text
            if g % 2 == 0:
                texts.append(" ".join(now).upper() if r.random() < 0.3 else " ".join(now))
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    rows = made(seed)
    out = j.joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(map(tuple, out)) == expected(rows)
    assert len({r.component_id for r in out}) < len(rows)


def test_passage_order_and_pairs_do_not_change_results(spark, monkeypatch):
    monkeypatch.setattr(j, "MOST_BROADCAST", 0)
    rows = made(3, 25)
    assert sorted(map(tuple, j.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == expected(rows)


def test_hard_rows(spark, hard):
    out = j.joined(hard).collect()
    rows = hard.select("doc_id", "text").collect()
    want = {}
    for i, n, c in expected([(10**9 if r.doc_id is None else r.doc_id, r.text) for r in rows]):
        want.setdefault(i, set()).add((n, c))
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) in want[r.doc_id]
        elif r.n_shingles:
            assert r.component_id is None
    assert j.joined(hard.limit(0)).collect() == []
    kept = j.one_of_each(hard)
    assert kept.columns == hard.columns and kept.filter("doc_id IS NULL").count() == 1


def test_query(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, j.op3_ngram_jaccard(spark, TESTDATA).collect())) == expected(list(map(tuple, docs)))


def test_split_lists(spark, monkeypatch):
    """Lists dealt over partitions, blocks in chunks and cells: the same links."""
    monkeypatch.setattr(j, "partitions", lambda spark: 64)
    monkeypatch.setattr(j, "BLOCK", 2)
    monkeypatch.setattr(j, "CELL", 3)
    rows = made(4, 30)
    assert sorted(map(tuple, j.joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())) == expected(rows)


def passage_texts(n):
    """Texts that share a passage of 60 words behind 10 words of their own: none is linked."""
    r = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    return [(i, " ".join(f"own{r.randrange(10**9)}" for _ in range(10)) + " " + passage) for i in range(n)]


def test_a_common_passage_pairs_nothing(spark, monkeypatch):
    met = []
    left_over = j.left_over
    monkeypatch.setattr(j, "left_over", lambda lists: met.append(left_over(lists).count()) or left_over(lists))
    rows = passage_texts(400)
    out = j.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert met == [0] and all(r.component_id == r.doc_id for r in out)


def test_no_row_is_lost_or_doubled(spark):
    """Ids that stand for different texts, repeated rows and columns with names of helpers."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (3, long + " more"), (3, "quite another text of six words"), (5, "alone and only five words"), (5, "alone and only five words"), (7, None), (7, None), (None, long), (8, "x"), (8, "y")]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, _gone int, _id int, _row int, c0 int")
    out = j.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(repr((r.doc_id, r.text)) for r in out.collect()) == sorted(map(repr, [rows[0], rows[2], rows[3], (7, None), (None, long), (8, "x"), (8, "y")]))


def test_sql_tells_words_apart_as_the_contract(spark):
    """The SQL over texts with every kind of white space, against all pairs."""
    import duckdb
    import pyarrow as pa

    rows = [(0, "a\rb\x0cc\x0bd e f g"), (1, "A b\tc\nd e f g"), (2, "a\xa0b c d e f g"), (3, "a\x0bb"), (4, "A\rB"), (5, "a\x1fb c d e f"), (6, None), (7, "\r\x0c")]
    documents = pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})  # noqa: F841  read by name
    got = duckdb.sql(j.ORACLE)
    at = [got.columns.index(c) for c in ("doc_id", "n_shingles", "component_id")]
    assert sorted(tuple(r[k] for k in at) for r in got.fetchall()) == expected(rows)


def test_bitmaps_never_rule_out_too_much():
    """The bound that bitmaps give is at least the overlap, and falls for sets that differ."""
    import numpy as np

    rng = np.random.default_rng(5)
    for n, same in ((1, 1), (30, 30), (40, 20), (700, 350), (700, 690), (5000, 2500)):
        x = rng.integers(0, 2**63, n, dtype=np.uint64)
        y = np.concatenate([x[:same], rng.integers(0, 2**63, n - same, dtype=np.uint64)])
        a, b = j.bitmap(x).view(np.uint64), j.bitmap(y).view(np.uint64)
        bound = n - max(int(np.bitwise_count(a & ~b).sum()), int(np.bitwise_count(b & ~a).sum()))
        assert len(a) == len(b) and bound >= same
        assert same > n // 2 or 7 * bound < 6 * n  # ruled out at a similarity of 0.75
