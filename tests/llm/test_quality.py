import zlib

import numpy as np

from quotelake.llm import quality as q

SF = "/root/testdata/sf0.01"


def test_trees_equal_a_walk():
    r = np.random.default_rng(1)
    x = r.normal(size=(500, 5))
    t = q.fit(x, (x[:, 0] + x[:, 1] ** 2 > 0.7).astype(float), rounds=12, depth=3)
    for row, score in zip(x[:60], t.score(x)):
        total = t.start
        for split, bound, leaf in zip(t.split, t.bound, t.leaf):
            node = 0
            while node < len(split):
                node = 2 * node + (2 if row[split[node]] > bound[node] else 1)
            total += leaf[node - len(split)]
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-12
    assert ((t.score(x) > 0.5) == (x[:, 0] + x[:, 1] ** 2 > 0.7)).mean() > 0.9


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality IS NOT NULL").collect()}
    out = q.op9_quality(spark, SF).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and sum(r.predicted == labels[r.doc_id] for r in held) / len(held) >= 0.85


def test_partitions_do_not_change_the_fit(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    a, b = q.train(docs, labels), q.train(docs.repartition(7), labels.repartition(3))
    assert np.array_equal(a.split, b.split) and np.allclose(a.leaf, b.leaf)


def test_hard_rows(spark, hard):
    some = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (999, None, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    for labels in (some, some.limit(0), some.filter("quality = 1")):
        out = q.score(hard, q.train(hard, labels))
        assert out.count() == hard.count() and out.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert q.score(hard.limit(0), q.train(hard.limit(0), some)).count() == 0


def plain_fit(x, y, rounds, depth):
    """Boosted trees by their definition, node by node: the best split of the rows of each node over all statistics and cuts."""
    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, q.BINS + 1)[1:-1])) for c in x.T]
    total = np.full(len(y), start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)

        def grow(rows, level):
            if level == depth:
                return -q.RATE * g[rows].sum() / (h[rows].sum() + q.L2)
            best = (1e-9, None, None)
            for f, column in enumerate(cuts):
                for cut in column:
                    left = rows[x[rows, f] <= cut]
                    right = rows[x[rows, f] > cut]
                    if min(len(left), len(right)) < q.LEAST:
                        continue
                    gain = sum(s * g[r].sum() ** 2 / (h[r].sum() + q.L2) for r, s in ((left, 1), (right, 1), (rows, -1)))
                    if gain > best[0] + 1e-9:
                        best = (gain, f, cut)
            return (best[1], best[2], *(grow(r, level + 1) for r in ((rows[x[rows, best[1]] <= best[2]], rows[x[rows, best[1]] > best[2]]) if best[1] is not None else (rows, rows[:0]))))

        tree = grow(np.arange(len(y)), 0)
        for i, row in enumerate(x):
            node = tree
            while isinstance(node, tuple):
                node = node[3] if node[0] is not None and row[node[0]] > node[1] else node[2]
            total[i] += node
    return 1 / (1 + np.exp(-total))


def test_fit_equals_its_definition():
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 3)).round(1)
    y = (x[:, 0] * x[:, 1] + 0.3 * r.normal(size=300) > 0).astype(float)
    assert np.allclose(q.fit(x, y, rounds=3, depth=2).score(x), plain_fit(x, y, 3, 2))


def test_a_repeated_id_is_one_row(spark, monkeypatch):
    docs = spark.createDataFrame([(0, f"text number {i}") for i in range(50)] + [(1, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (0, 1), (2, 0)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(q, "fit", lambda x, y: seen.append(len(y)))
    q.train(docs, labels)
    q.train(docs, labels, max_rows=1)
    assert seen == [1, 1]
