import re
from collections import Counter
from itertools import permutations

from quotelake.llm import filter_audit as a

WORD = re.compile("[^ \t-\r]+")


def failed(rows, i):
    """Letters that row i fails, read off the definition."""
    key, text = rows[i][0], rows[i][1] or ""
    w = WORD.findall(text)
    return {
        x for x, yes in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)),
            any(key is not None and r[0] is not None and r[0] < key and (r[1] or "") == text for r in rows)))
        if yes
    }


def expected(rows, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    fails = [failed(rows, i) for i in range(len(rows))]
    out, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {r[2] or "" for r in rows}:
            left = [i for i, r in enumerate(rows) if (r[2] or "") == part]
            every = list(left)
            for step, f in enumerate(order, 1):
                gone = [i for i in left if f in fails[i]]
                shapley[part, f] += len(gone)
                redundant = sum(f in fails[i] for i in every) - len(gone)
                left = [i for i in left if f not in fails[i]]
                out[part, order, step] = (len(left), len(gone), redundant, sum(fails[i] == {f} for i in every), sum(rows[i][0] in good for i in gone), sum(rows[i][0] in toxic for i in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


LONG = " ".join(f"w{i}" for i in range(300))
ROWS = [
    (1, LONG, "en"), (2, LONG, "de"), (3, LONG, "en"), (3, LONG, "en"), (None, LONG, "en"), (4, None, "en"), (5, "", None), (6, "word " * 250, "en"), (7, "A B C $", "fr"), (8, LONG.upper(), "de"),
    (9, LONG + " #", "de"), (9, LONG + " # other", "de"), (0, "A B C $", "fr"), (10, "É " * 40 + "a\x0bb\x0cc\rd", "en"), (11, " \t\n", None), (-1, LONG + " #", "fr"), (12, "x%" * 5000, "de"), (None, None, None),
]
LABELS = [(1, 1, 0), (3, 1, 1), (3, 0, 0), (7, 0, 1), (8, 1, None), (9, None, 1), (None, 1, 1), (99, 1, 1)]


def test_equals_definition(spark):
    docs = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id long, text string, lang string, part string, mask int").selectExpr("*", "1 AS `n`", "'z' AS `a.b`", "0 AS `_id`", "0 AS `good`")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS `n`", "2 AS `_l`")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in a.audit(a.mask_cells(docs, labels)).collect()}
    want = expected(ROWS, LABELS)
    assert len(got) == 600 * 4 and got == want


def test_empty_tables(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert a.audit(a.mask_cells(docs.limit(0), labels)).count() == 0
    out = a.audit(a.mask_cells(docs, labels.limit(0)))
    assert out.count() == 2400 and out.filter("good_lost + toxic_lost > 0").count() == 0


def test_cells_do_not_grow_with_the_rows(spark):
    """Windows and orders see mask cells only."""
    docs = spark.range(5000).selectExpr("id AS doc_id", "concat('text ', id % 10) AS text", "'en' AS lang")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    cells = a.mask_cells(docs, labels)
    assert cells.count() == 2 and sorted(r.n for r in cells.collect()) == [10, 4990]
    assert dict(a.audit(cells, ["EABCD"]).dtypes)["shapley"] == "bigint"
