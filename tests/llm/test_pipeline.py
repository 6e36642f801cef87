import hashlib

import public_tokenizers
import sentencepiece

import corpus_pipeline as c
from quotelake.llm import quality

from .conftest import TESTDATA
from .test_decontamination import expected as leaks
from .test_ngram_jaccard import expected as near


def lower(text):
    return (text or "").encode().lower().decode()


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{TESTDATA}/benchmark.parquet").collect()]
    columns, names = docs.columns, [n for n, _ in c.STAGES]
    assert len(names) == 5
    good = c.quality_filter(spark, docs, TESTDATA)
    scores = quality.score(docs, quality.train(docs, spark.read.parquet(f"{TESTDATA}/labels.parquet"))).collect()
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in scores if r.score >= 0.5)

    kept = {}
    for r in good.collect():
        kept[lower(r.text)] = max(r.doc_id, kept.get(lower(r.text), r.doc_id))
    once = c.exact_copies(spark, good, TESTDATA)
    assert sorted(r.doc_id for r in once.collect()) == sorted(kept.values())

    rows = [(r.doc_id, r.text) for r in once.collect()]
    apart = c.near_copies(spark, once, TESTDATA)
    assert sorted(r.doc_id for r in apart.collect()) == sorted(i for i, _, comp in near(rows) if i == comp)

    rows = [(r.doc_id, r.text) for r in apart.collect()]
    clean = c.benchmark_leaks(spark, apart, TESTDATA)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, t in rows if not leaks(t, bench)[1])
    assert good.columns == once.columns == apart.columns == clean.columns == columns

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in clean.collect()}
    out = c.run(spark, TESTDATA).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        assert r.ids == sp.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(r.ids).encode()).hexdigest()


def test_stages_keep_columns_of_any_name_and_empty_tables(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet").selectExpr("*", "doc_id AS `_score`", "'x' AS `a.b`")
    good = c.quality_filter(spark, docs, TESTDATA)
    assert good.columns == docs.columns and good.filter("_score <> doc_id").isEmpty() and not good.isEmpty()
    assert c.quality_filter(spark, docs.limit(0), TESTDATA).columns == docs.columns
