import hashlib

import pytest

from quotelake.llm import exact_dedup as e

from .conftest import TESTDATA


def digest(text):
    return hashlib.sha256((text or "").encode().lower()).hexdigest()


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(digest(t), []).append(i)
    out = []
    for i, t in rows:
        own = groups[digest(t)]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, digest(t)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("slots", [1, 3, e.SLOTS])
def test_equals_grouping(spark, monkeypatch, slots):
    rows = [(i, f"text {i % 17}".upper() if i % 3 else f"text {i % 17}") for i in range(300)] + [(1000 + i, "Hot") for i in range(200)]
    rows += [(5, None), (6, ""), (None, ""), (None, "alone"), (7, "İ"), (7, "i̇"), (7, "İ")]
    digests = e.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    out = e.exact_groups(digests.select("doc_id", "text_sha256"), "doc_id", "text_sha256", slots)
    got = sorted(repr((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in out.collect())
    assert got == expected(rows)


def test_frequent_values_are_named(spark):
    df = spark.createDataFrame([("a",)] * 50 + [("b",)] * 40 + [(f"x{i}",) for i in range(60)], "d string").repartition(6)
    assert {"a", "b"} <= {r.d for r in e.frequent(df, "d", 4).collect()}


def test_hard_rows(spark, hard):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    got = sorted(repr((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in e.dedup(hard).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == expected(rows)
    assert e.dedup(hard.limit(0)).count() == 0
    kept = e.deduplicated(hard)
    assert kept.columns == hard.columns
    assert {digest(r.text) for r in kept.collect()} == {digest(t) for _, t in rows}


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{TESTDATA}/documents.parquet").collect()]
    out = e.op2_exact_dedup(spark, TESTDATA).collect()
    assert sorted(map(repr, map(tuple, out))) == expected(docs)


def test_one_row_of_each_text(spark):
    rows = [(5, "Same text"), (5, "Same text"), (5, "same text"), (4, "SAME TEXT"), (5, "other"), (None, None), (None, ""), (6, "b"), (6, "c")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, _gone int, _digest int, row int")
    out = e.deduplicated(docs)
    assert out.columns == docs.columns
    got = [(r.doc_id, (r.text or "").lower()) for r in out.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(5, "same text"), (5, "other"), (None, ""), (6, "b"), (6, "c")]))
