"""Workbooks written and read as a stream, a partition for each sheet."""

import zipfile

import pytest
from pyspark.sql import functions as F

from quotelake.sources import files, sheets

NS = f'xmlns="{sheets.MAIN}"'


def book(path, shared, *named):
    """A workbook as other programs write it: shared texts, cells without places, numbers."""
    with zipfile.ZipFile(path, "w") as z:
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si><r><t>{x[:2]}</t></r><r><t>{x[2:]}</t></r></si>" for x in shared) + "</sst>")
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{sheets.OFFICE}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, (n, _) in enumerate(named)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{sheets.PACKAGE}">' + "".join(f'<Relationship Id="r{i}" Target="{"/xl/" if i % 2 else ""}worksheets/s{i}.xml"/>' for i in range(len(named))) + "</Relationships>")
        for i, (_, rows) in enumerate(named):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {NS}><sheetData>{rows}</sheetData></worksheet>")


def test_reads_what_other_programs_write(spark, tmp_path):
    book(tmp_path / "a.xlsx", ["Item", "Qty"], ("First", '<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="5"><c r="A5"><v>7</v></c><c><f>A5</f><v>8</v></c></row>'), ("Second", ""), ("Third", '<row><c t="inlineStr"><is><t>é &lt;</t></is></c></row>'))
    (tmp_path / "sub").mkdir()
    book(tmp_path / "sub" / "b.xlsx", [], ("Only", '<row><c r="AB1"><v>1</v></c></row>'))
    (tmp_path / "note.txt").write_text("no workbook")
    s = files.read_sheets(spark, str(tmp_path))
    assert s.rdd.getNumPartitions() == 4  # one for each sheet
    assert sorted((r.path.rsplit("/", 1)[1], r.sheet, r.row, r.cells) for r in s.collect()) == [
        ("a.xlsx", "First", 1, ["Item", "", "Qty"]), ("a.xlsx", "First", 5, ["7", "8"]), ("a.xlsx", "Third", 1, ["é <"]), ("b.xlsx", "Only", 1, [""] * 27 + ["1"]),
    ]
    assert files.header_row(s, ["item", "qty"]).first().row == 1


def test_round_trip(spark, tmp_path):
    rows = [(f"s {i % 3} & \"q\"", i // 3 + 1, [str(i), "", " x ", "a<b&c", "日本"][: i % 6]) for i in range(3000)]
    df = spark.createDataFrame(rows, "sheet string, row int, cells array<string>").repartition(2, "sheet")
    files.write_sheets(df, str(tmp_path / "out"))
    trimmed = lambda cells: next((cells[: k + 1] for k in range(len(cells) - 1, -1, -1) if cells[k]), [])  # noqa: E731  empty cells at the end are not written
    assert sorted((r.sheet, r.row, r.cells) for r in files.read_sheets(spark, str(tmp_path / "out")).collect()) == sorted((s, r, trimmed(c)) for s, r, c in rows)
    files.write_sheets(df.limit(3).coalesce(1), str(tmp_path / "out"), "overwrite")
    assert files.read_sheets(spark, str(tmp_path / "out")).count() == 3


def test_empty_folder_and_order(spark, tmp_path):
    assert files.read_sheets(spark, str(tmp_path)).count() == 0
    spark.dataSource.register(sheets.SheetSource)
    mixed = spark.createDataFrame([("", "a", 1, ["1"]), ("", "b", 1, ["1"]), ("", "a", 2, ["1"])], sheets.SCHEMA).coalesce(1)
    with pytest.raises(Exception, match="follow each other"):
        mixed.write.format("sheets").mode("append").save(str(tmp_path / "x"))
    assert files.read_sheets(spark, str(tmp_path / "x")).count() == 0


def test_columns_of_cells():
    assert [sheets.column(sheets.letters(i)) for i in (0, 25, 26, 701, 702, 18277)] == [0, 25, 26, 701, 702, 18277]
    assert (sheets.letters(27), sheets.column("AB12")) == ("AB", 27)


def test_keyed_sheets(spark, tmp_path):
    rows = [("s", 1, ["Offer 7"]), ("s", 2, ["Item", " Qty "]), ("s", 3, ["1", "5"]), ("s", 4, ["2"]), ("t", 1, ["no", "header"])]
    files.write_sheets(spark.createDataFrame(rows, "sheet string, row int, cells array<string>").coalesce(1), str(tmp_path / "o"))
    out = files.keyed_sheets(files.read_sheets(spark, str(tmp_path / "o")), ["item", "qty"]).orderBy("row")
    assert [(r.sheet, r.title, r.row, r.cells) for r in out.collect()] == [("s", "Offer 7", 3, {"item": "1", "qty": "5"}), ("s", "Offer 7", 4, {"item": "2"})]
    assert out.filter(F.col("sheet") == "t").count() == 0


def test_headers_are_read_without_the_rest(spark, tmp_path):
    rows = [("a", 1, ["Offer"]), ("a", 3, ["Item", "Qty"]), *[("a", i, [str(i), "2"]) for i in range(4, 60)]]
    path = str(tmp_path / "books")
    files.write_sheets(spark.createDataFrame(rows, "sheet string, row int, cells array<string>").coalesce(1), path)
    tops = files.read_sheets(spark, path, 20)
    assert tops.agg({"row": "max"}).first()[0] == 20
    plain, by_tops = (sorted((r.title, r.row, tuple(sorted(r.cells.items()))) for r in files.keyed_sheets(files.read_sheets(spark, path), ["item", "qty"], tops=t).collect()) for t in (None, tops))
    assert plain == by_tops and len(plain) == 56


def test_a_long_offer_takes_several_workbooks(spark, monkeypatch):
    from quotelake.plans import scans

    monkeypatch.setattr(scans, "SHEET_ROWS", 50)
    written = []
    monkeypatch.setattr(files, "write_sheets", lambda df, path, f=files.write_sheets: (written.append(df.groupBy("sheet").count().agg({"count": "max"}).first()[0]), f(df, path)))
    out = scans.io05(spark, "/root/testdata/sf0.001").collect()
    assert len(out) == 10 and sum(r.n for r in out) == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count() and written[0] < 200


def test_whole_totals_stay_whole(spark, tmp_path):
    from quotelake.plans import scans

    prices = [0.7, 0.1, 0.2, 1000.0, 8.3, 16.1, 4.6]
    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(1).selectExpr("* except (l_orderkey, l_extendedprice)", f"1L as l_orderkey", f"explode(array({', '.join(f'{p}d' for p in prices)})) as l_extendedprice").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert [r.totals_price for r in scans.io10(spark, str(tmp_path)).collect()] == ["1030"]
