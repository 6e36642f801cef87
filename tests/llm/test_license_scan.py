import re
import textwrap

from quotelake.llm import license_scan as s

from .conftest import TESTDATA

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall((text or "").encode().lower().decode())


def expected(text):
    """(words, places, first, last, base labels, labels, score) from every window of twice a template's length against the template."""
    w = split(text)
    at, base = [], set()
    for p, label in s.PHRASES.items():
        p = p.split()
        own = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        at += own
        base |= {label} if own else set()
    best, labels = 0.0, set(base)
    for label, t in s.TEMPLATES.items():
        n, t = len(t.split()), set(t.split())
        for i in range(0, len(w), n):
            common = len(set(w[i : i + 2 * n]) & t)
            if common >= s.THRESHOLD * len(t) - 1e-9:
                labels.add(label)
                best = max(best, common / len(t))
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if at else best


def rows_of(out):
    return sorted(repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, ",".join(r.base_labels), ",".join(r.labels), round(r.score, 9))) for r in out)


def want(rows):
    return sorted(repr((i, *expected(t)[:-1], round(expected(t)[-1], 9))) for i, t in rows)


TEXTS = [
    "All rights reserved. ALL RIGHTS-RESERVED", "CC BY 4.0, cc-by", "gnu General Public License version 3 licensed under the", "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "permission is hereby\ngranted free of charge", " ".join(reversed(s.TEMPLATES["mit"].split())), s.TEMPLATES["bsd"].upper() + "\n" + s.TEMPLATES["apache-2.0"], "cc by by cc by",
]


def test_equals_all_windows_against_all_templates(spark, hard):
    rows = [*enumerate(TEXTS, 500), *[(i, " ".join(t.split()[k:])) for i, t in enumerate(s.TEMPLATES.values(), 600) for k in (*range(5), 25, 40)]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(s.scan(df).collect()) == want(rows)
    assert rows_of(s.scan(hard).collect()) == want([(r.doc_id, r.text) for r in hard.collect()])
    assert s.scan(hard.limit(0)).count() == 0


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{TESTDATA}/documents.parquet").collect()]
    got = sorted(repr((*tuple(r)[:-1], round(r.score, 9))) for r in s.op4_license_scan(spark, TESTDATA).collect())
    assert got == want(docs)


def test_notices_across_lines_and_short_ones(spark):
    """Notices wrapped at any width, with other words before them; and a line that names the license only."""
    before = "some other words stand here first "
    texts = {label: [before * k + "\n".join(textwrap.wrap(t, width)) for width in (20, 40, 72) for k in (0, 1, 3)] for label, t in s.TEMPLATES.items()}
    rows = [(i, label, t) for i, (label, t) in enumerate((label, t) for label, ts in texts.items() for t in ts)]
    rows += [(-1, "mit-notice", "Readme\nReleased under the MIT License."), (-2, "", "released under the license of the\nmitt"), (-3, "", "\n".join(["permission is hereby granted", *["other words"] * 40, "free of charge to any person obtaining a copy of this software and"]))]
    got = {r.doc_id: r for r in s.scan(spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")).collect()}
    for i, label, t in rows:
        assert (label in got[i].labels and got[i].score == 1.0) if label else (not got[i].labels and got[i].score == 0.0), t
