import math
import random
import re
from collections import Counter

import pytest

from quotelake.llm import lexical_search as s

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [x.encode().lower().decode() for x in TERM.findall(text or "")]


def expected(docs, items, top):
    """(item, rank, doc, score) by scoring every document for every item."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_words = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, ts in asked.items():
        scores = []
        for doc, c in held:
            m = 50 + (50 * c.total() * n_docs) // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc))
        out += [(item, r, d, -x) for r, (x, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=repr)


WORDS = ["the", "The", "THE", "é", "É", "日本", "a1", "x", "rare", "b-c", "d_e", "'", "ſ", "zz"]


def rows_of(df):
    return sorted(((r["item"], r["rank"], r["doc"], r["score"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("most", [0, s.MOST_BROADCAST])
def test_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(s, "MOST_BROADCAST", most)
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices(WORDS, weights=range(20, 6, -1), k=rng.randint(1, 40)))) for i in range(150)]
    docs += [(500, None), (501, ""), (502, "..."), (None, "rare rare é"), (7, docs[7][1]), (7, "other rare"), (None, "rare rare é"), (503, "rare " * 30000), (504, "the " * 9), (505, "the " * 9)]
    items = [(1, "The rare É b"), (2, None), (3, "..."), (4, "nowhere"), (1, "x x X"), (None, "日本 zz"), (5, "the"), (6, "a1 c d e")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS `term`", "'x' AS `at`", "2 AS `a.b`", "0 AS `n`")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS `term`", "2 AS `item`")
    for top in (3, 50, 1000):
        assert rows_of(s.search(frame, bench, top)) == expected(docs, items, top)


def test_ids_of_any_type_and_empty_tables(spark):
    frame = spark.createDataFrame([("b", "one two"), ("a", "one two"), ("c", "two")], "doc_id string, text string")
    bench = spark.createDataFrame([("i", "one")], "item_id string, text string")
    assert [(r["item"], r["rank"], r["doc"]) for r in s.search(frame, bench).orderBy("rank").collect()] == [("i", 1, "a"), ("i", 2, "b")]
    for d, b in ((frame.limit(0), bench), (frame, bench.limit(0))):
        assert s.search(d, b).columns == ["item", "rank", "doc", "score"] and s.search(d, b).count() == 0


def test_frequent_terms_are_spread(spark):
    """A term that every document holds: its postings lie in several buckets."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('all w', id % 7) AS text")
    try:
        table = s.postings(docs, frozenset([b"all"]))
    finally:
        spark.conf.unset(name)
    assert table.filter("term = 'all'").count() == 2000 and table.filter("term IS NULL").count() == 2000
    files = table.filter("term = 'all'").selectExpr("input_file_name() AS f").groupBy("f").count().collect()
    assert len(files) > 1 and max(r["count"] for r in files) < 1800
