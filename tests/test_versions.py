"""Tables in versions and views kept by deltas equal what is computed anew, and touch only what changed."""

import random

import pytest
from pyspark.sql import functions as F

from quotelake.sources.versions import Versions
from quotelake.streaming import views

SCHEMA = "g long, k long, v long"


def table(spark, path, buckets=8):
    return Versions(spark, str(path), SCHEMA, ["g", "k"], ["g"], buckets)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_commit_copy_diff_and_vacuum(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.latest() == 0 and t.read().count() == 0
    rows = {(g, k): g * k for g in range(40) for k in range(3)}
    frame = lambda r: spark.createDataFrame([(*k, v) for k, v in r.items()], SCHEMA)
    first = t.commit(frame(rows))
    second = t.copy(reason="revision")
    assert t.manifest(first) == t.manifest(second) and t.changed(first, second) == set() and t.diff(first, second, ["v"]).count() == 0
    third = t.commit(frame({(5, 1): 99, (5, 7): 1}), frame({(5, 2): 0}), "new prices")
    assert len(t.changed(second, third)) == 1  # one group, one bucket
    want = rows | {(5, 1): 99, (5, 7): 1}
    del want[5, 2]
    assert rows_of(t.read()) == sorted((*k, v) for k, v in want.items()) and rows_of(t.read(first)) == sorted((*k, v) for k, v in rows.items())
    assert {(r.g, r.k, r.status, r.old_v, r.new_v) for r in t.diff(first, third, ["v"]).collect()} == {(5, 1, "modified", 5, 99), (5, 7, "added", None, 1), (5, 2, "removed", 10, None)}
    assert [(r.version, r.parent, r.reason, r.buckets - r.shared) for r in t.history().orderBy("version").collect()] == [(1, 0, None, len(t.manifest(1))), (2, 1, "revision", 0), (3, 2, "new prices", 1)]
    assert t.commit(frame({(1, 1): 5}), number=3) == 3 and t.latest() == 3  # a repeated batch
    with pytest.raises(Exception, match="(?i)exist"):
        t._name({}, 2, None, 3)
    assert t.vacuum(1) == 1 and t.numbers() == [3] and rows_of(t.read()) == sorted((*k, v) for k, v in want.items())
    fourth = t.commit(gone=frame(want))
    assert t.read(fourth).count() == 0 and t.manifest(fourth) == {}


def test_difference_reads_changed_buckets_only(spark, tmp_path):
    t = table(spark, tmp_path, 32)
    first = t.commit(spark.range(5000).select((F.col("id") % 100).alias("g"), F.col("id").alias("k"), F.lit(1).cast("long").alias("v")))
    second = t.commit(spark.createDataFrame([(7, 7, 2)], SCHEMA))
    files = set(t.read(first, t.changed(first, second)).inputFiles())
    assert files and {f.rsplit("/", 2)[1] for f in files} == {f"_bucket={b}" for b in t.changed(first, second)} and len(t.changed(first, second)) == 1


def test_nothing_kept_is_known_to_be_empty(spark, tmp_path):
    """What a version without rows gives drops out of plans, instead of being joined."""
    t = table(spark, tmp_path)
    none, keys = t.read(), spark.range(9).select(F.col("id").alias("g"), F.col("id").alias("k"))
    assert none.schema.simpleString() == t.schema.simpleString() and none.count() == 0
    plan = none.join(keys, ["g", "k"], "left_anti")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "LocalRelation <empty>" in plan


def test_manifests_are_those_of_the_files(spark, tmp_path):
    """A version that another has written is read from its files, with and without a reason, with and without rows."""
    t = table(spark, tmp_path)
    t.commit(spark.createDataFrame([(g, 1, g) for g in range(40)], SCHEMA), reason="it's \\ new")
    t.commit(gone=t.read())
    again = table(spark, tmp_path)
    assert [again.manifest(n) for n in (1, 2)] == [t.manifest(n) for n in (1, 2)] and again.manifest(1) and again.manifest(2) == {}
    assert rows_of(again.history()) == rows_of(t.history()) == [(1, 0, "it's \\ new", len(t.manifest(1)), 0), (2, 1, None, 0, 0)]
    t.manifest(1).clear()
    assert t.manifest(1) == again.manifest(1)


@pytest.mark.parametrize("seed", range(3))
def test_view_equals_full_aggregation(spark, tmp_path, seed):
    """Random rows come and go in batches, the largest of a group often; the view equals an aggregation of what is there."""
    rng = random.Random(seed)
    base = table(spark, tmp_path / "base")
    view = views.View(Versions(spark, str(tmp_path / "view"), "g long, n long, total long, highest long", ["g"], buckets=4), base, {"total": "v"}, {"highest": "v"}, "at")
    there: dict[int, tuple[int, int]] = {}
    for number in range(1, 5):
        come = {number * 1000 + i: (rng.randrange(6), rng.choice([None, -3, 0, 5, 5, 9])) for i in range(25)}
        tops = [k for k, (g, v) in there.items() if v == max((x for h, x in there.values() if h == g and x is not None), default=None)]
        go = set(rng.sample(sorted(there), len(there) // 4)) | set(tops[: rng.randrange(0, 9)])
        brief = {number * 1000 + 500 + i: (rng.randrange(6), rng.choice([7, 99])) for i in range(9)}  # come and go in one batch
        new = {k: (there[k][0], rng.choice([None, 1, 50])) for k in rng.sample(sorted(there), len(there) // 5)}  # other values
        changes = [(g, k, v, 1, 1) for k, (g, v) in (come | brief).items()] + [(there[k][0], k, there[k][1], -1, 2) for k in go | set(new)]
        changes += [(g, k, v, -1, 2) for k, (g, v) in brief.items()] + [(g, k, v, 1, 3) for k, (g, v) in new.items()]
        df = spark.createDataFrame(changes, f"{SCHEMA}, sign int, at int")
        view.apply(df, number)
        view.apply(df, number)  # as after a failure
        there = {k: v for k, v in (there | come).items() if k not in go} | new
        want = []
        for g in {g for g, _ in there.values()}:
            own = [v for h, v in there.values() if h == g]
            some = [v for v in own if v is not None]
            want.append((g, len(own), sum(some), max(some, default=None)))
        assert sorted(view.table.read().collect(), key=repr) == sorted(want, key=repr)
    assert len(base.numbers()) <= 2
