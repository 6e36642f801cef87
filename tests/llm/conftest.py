import pytest

TESTDATA = "/root/testdata/sf0.001"

#: Texts on which text operators go wrong most easily.
HARD = [
    None, "", " ", "  ", "\n", "\t\n\x0b", "a", " a", "a ", "A  b   C", "▁", "a▁b", "▁ ▁▁", "é", "é", "ﬁ ①", "日本語 テキスト。", "🙂🙂 ok", "　wide nbsp",
    "don't we'll I'M", "123 4567 89", "...!!!", "<|endoftext|>", "x<|endoftext|>y <|endoftext|>", "</s>[INST] ok [/INST]", "\x00\x01", "a" * 3000,
    "word " * 2000, "same line\n" * 300, "MiXeD CaSe", "İ ſ K", "tab\tand\r\nreturn",
]


@pytest.fixture
def hard(spark):
    """HARD as documents, with a repeated row, a null id and columns whose names clash with outputs and helpers."""
    rows = [(i, x, "n") for i, x in enumerate(HARD)] + [(0, None, "n"), (None, "no id", "n"), (3, "another text of one id", "n")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").selectExpr("*", "1 AS `n`", "'x' AS `_id`", "'y' AS `word`", "0 AS `start`", "'z' AS `a.b`")
