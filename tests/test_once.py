"""What an expression names often is computed once, and what headers say once for each layout, with the same results."""

import pytest
from pyspark.sql import functions as F

from quotelake import plans
from quotelake.functions import json_repair
from quotelake.operators import documents, extraction, joins, tables

TABLES = [
    (1, ["Item No.", "Description", "Qty"], [["1", "a", "2"], ["2", "b", "3"]]), (2, ["Item No.", "Description", "Qty"], [["", "", ""]]), (3, ["Rev", "Date", None], [["x", "y", "z"]]),
    (4, None, [["1"]]), (5, [], []), (6, ["Vendor", "Unit", "Qty"], [["1", " ", "2"]]), (7, ["12 jan 24", "John Smith", "117"], [["1", "2", "3"]]),
]


@pytest.mark.parametrize("most", [0, 100])
def test_scores_by_layout_equal_scores_by_table(spark, monkeypatch, most):
    monkeypatch.setattr(tables, "MOST_LAYOUTS", most)  # layouts joined by a shuffle, or broadcast
    df = spark.createDataFrame(TABLES, "i long, headers array<string>, rows array<array<string>>")
    for by_layout, by_table in ((tables.scored, tables.score), (documents.scored_tables, documents.table_score)):
        want = {r.i: r.s for r in df.select("i", by_table(F.col("headers"), F.col("rows")).alias("s")).collect()}
        assert {r.i: r.score for r in by_layout(df, "headers", "rows").collect()} == want and len(set(want.values())) > 2


def test_lines_of_a_page_are_found_once(spark, capsys):
    df = spark.createDataFrame([("Item | Qty\nflange | 2\n\npipe    | 10\n",), ("",), (None,)], "text string")
    df = df.select(extraction.page_score(F.col("text"), ["item", "qty"]).alias("s"))
    df.explain(True)
    assert capsys.readouterr().out.split("== Physical Plan ==")[1].count("split(") == 1
    assert [round(r.s, 6) for r in df.collect()][1:] == [0.3, 0.3] and df.first().s > 0.1  # without text: as its SQL, which leaves out the null


def test_a_header_is_normalised_once_for_each_role(spark, capsys):
    df = spark.createDataFrame([(["Item", "Qty"],)], "h array<string>")
    df.select(tables.fit(F.get("h", F.lit(0)), tables.KEYWORDS["quantity"]).alias("s")).explain(True)
    assert capsys.readouterr().out.split("== Physical Plan ==")[1].count("lower(") == 1


def test_priced_items_are_read_and_sorted_once(spark, capsys):
    """Agreements are evaluated on conditions, not on items, and no item meets itself again by its whole key."""
    sf = "/root/testdata/sf0.001"
    for name in ("p01_agreement_prices", "p11_price_run"):
        plans.queries()[name](spark, sf).explain()
        plan = capsys.readouterr().out
        assert plan.count("l_extendedprice#") and sum("FileScan" in x and "lineitem" in x for x in plan.splitlines()) == 1 and "SortAggregate" not in plan
    items = spark.createDataFrame([(1, "m"), (2, "x"), (3, None)], "id int, m string")
    by_m = spark.createDataFrame([("m", 1), (None, 2)], "m string, v int")
    assert sorted((r.id, r.level, r.v) for r in joins.cascade(items, [(by_m, ["m"])], ["id"], outer=True).collect()) == [(1, 1, 1), (2, None, None), (3, None, None)]


def test_answers_are_grouped_once(spark, capsys):
    out = plans.queries()["s28_recovered_items"](spark, "/root/testdata/sf0.001")
    out.explain()
    plan = capsys.readouterr().out
    assert "Generate" not in plan and plan.count("Exchange") == 1 and plan.count("partial_") == 1
    answers = spark.createDataFrame([('{"items": [{"a": 1}, {"b": ',), ("none",), (None,)], "t string")
    assert [r.x for r in answers.select(json_repair.recovered_items("t").alias("x")).collect()] == [['{"a": 1}'], [], []]
