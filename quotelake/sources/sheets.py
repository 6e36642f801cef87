"""Workbooks as a Spark data source: one partition for each sheet of each .xlsx file, rows read and written as a stream.

    spark.dataSource.register(SheetSource)
    spark.read.format("sheets").load(path)     # path, sheet, row int (from 1), cells array<string>
    spark.read.format("sheets").option("first", 20).load(path)     # rows up to the 20th of each sheet
    df.write.format("sheets").save(path)       # the same columns but for path, in order of sheet and row in each partition

The driver reads the directories of the archives only. A task holds the texts that cells share and one row at a time, never a whole workbook or sheet. Files
are reached by pyarrow's file systems (local and shared folders, and stores with a scheme that they know).
"""

from __future__ import annotations

import os
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Names that the format gives.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
SCHEMA = "path string, sheet string, row int, cells array<string>"
ARROW = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("cells", pa.list_(pa.string()))])
ROWS = 1000


def located(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:")))


def column(ref: str) -> int:
    """The number of a cell's column, from 0: A1 is 0, AB7 is 27."""
    at = 0
    for x in ref:
        if not x.isalpha():
            break
        at = at * 26 + ord(x) - 64
    return at - 1


def letters(at: int) -> str:
    out = ""
    while at >= 0:
        at, out = at // 26 - 1, chr(65 + at % 26) + out
    return out


def elements(z: zipfile.ZipFile, member: str, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of a member, one after the other, each forgotten when the next is asked for."""
    with z.open(member) as f:
        root = None
        for event, e in ElementTree.iterparse(f, events=("start", "end")):
            if root is None:
                root = e
            if event == "end" and e.tag == f"{{{MAIN}}}{tag}":
                yield e
                e.clear()
                if tag == "row":  # rows are children of one element, which would keep them all
                    for parent in root:
                        if parent.tag == f"{{{MAIN}}}sheetData":
                            parent.clear()


def text_of(e: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in e.iter(f"{{{MAIN}}}t"))


def sheets_of(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, member) of a workbook's sheets in their order."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    full = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    return [(s.get("name"), full(targets[s.get(f"{{{OFFICE}}}id")])) for s in book.iter(f"{{{MAIN}}}sheet")]


def rows_of(z: zipfile.ZipFile, member: str) -> Iterator[tuple[int, list[str]]]:
    """(number, cells) of a sheet's rows; cells that are not there are empty texts."""
    shared = [text_of(e) for e in elements(z, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in z.namelist() else []
    number = 0
    for row in elements(z, member, "row"):
        number = int(row.get("r") or number + 1)
        cells: dict[int, str] = {}
        at = -1
        for c in row.iter(f"{{{MAIN}}}c"):
            at = column(c.get("r")) if c.get("r") else at + 1
            v = c.find(f"{{{MAIN}}}v")
            value = text_of(c) if c.get("t") == "inlineStr" else "" if v is None else v.text or ""
            cells[at] = shared[int(value)] if c.get("t") == "s" and value else value
        yield number, [cells.get(k, "") for k in range(max(cells, default=-1) + 1)]


@dataclass
class Sheet(InputPartition):
    path: str
    name: str
    member: str


class SheetReader(DataSourceReader):
    def __init__(self, path: str, first: int | None = None):
        self.path, self.first = path, first

    def partitions(self) -> list[Sheet]:
        fs, root = located(self.path)
        found = fs.get_file_info(root)
        files = [found] if found.is_file else fs.get_file_info(pa.fs.FileSelector(root, recursive=True))
        out = []
        for f in sorted((f for f in files if f.is_file and f.path.endswith(".xlsx") and not f.base_name.startswith(("_", ".", "~"))), key=lambda f: f.path):
            with fs.open_input_file(f.path) as raw, zipfile.ZipFile(raw) as z:
                out += [Sheet(f.path, name, member) for name, member in sheets_of(z)]
        return out

    def read(self, partition: Sheet) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file
            return
        fs, _ = located(self.path)
        with fs.open_input_file(partition.path) as raw, zipfile.ZipFile(raw) as z:
            held: list[tuple[int, list[str]]] = []

            def batch():
                n = len(held)
                return pa.RecordBatch.from_arrays([pa.array([x] * n if not isinstance(x, list) else x, f.type) for x, f in zip((partition.path, partition.name, [r for r, _ in held], [c for _, c in held]), ARROW)], schema=ARROW)

            for row in rows_of(z, partition.member):
                if self.first is not None and row[0] > self.first:
                    break
                held.append(row)
                if len(held) == ROWS:
                    yield batch()
                    held.clear()
            if held:
                yield batch()


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class SheetWriter(DataSourceWriter):
    """A file for each partition with rows, under a hidden name until the job is committed."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator) -> Written:
        fs, root = located(self.path)
        fs.create_dir(root, recursive=True)
        name, names, sheet = f"_part-{uuid.uuid4().hex}.xlsx", [], None
        raw = z = out = None
        try:
            for r in iterator:
                if raw is None:
                    raw = fs.open_output_stream(f"{root}/{name}")
                    z = zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED)
                if r["sheet"] != sheet:
                    if r["sheet"] in names:
                        raise ValueError("rows of a sheet must follow each other: sort each partition by sheet and row")
                    if out:
                        out.write(b"</sheetData></worksheet>")
                        out.close()
                    sheet = r["sheet"]
                    names.append(sheet)
                    out = z.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True)
                    out.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN}"><sheetData>'.encode())
                cells = "".join(f'<c r="{letters(i)}{r["row"]}" t="inlineStr"><is><t xml:space="preserve">{escape(x)}</t></is></c>' for i, x in enumerate(r["cells"]) if x)
                out.write(f'<row r="{r["row"]}">{cells}</row>'.encode())
            if raw is None:
                return Written(None)
            out.write(b"</sheetData></worksheet>")
            out.close()
            listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1))
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets>{listed}</sheets></workbook>')
            rels = "".join(f'<Relationship Id="r{i}" Type="{OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
            z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}">{rels}</Relationships>')
            z.writestr("_rels/.rels", f'<Relationships xmlns="{PACKAGE}"><Relationship Id="r1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{KIND}.worksheet+xml"/>' for i in range(1, len(names) + 1))
            z.writestr("[Content_Types].xml", f'<Types xmlns="{TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{KIND}.sheet.main+xml"/>{parts}</Types>')
            z.close()
            return Written(name)
        finally:
            if raw is not None:
                raw.close()

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = located(self.path)
        new = [m.name for m in messages if m and m.name]
        if self.overwrite and fs.get_file_info(root).type != pa.fs.FileType.NotFound:
            for f in fs.get_file_info(pa.fs.FileSelector(root)):
                if f.is_file and f.base_name.endswith(".xlsx") and f.base_name not in new:
                    fs.delete_file(f.path)
        for n in new:
            fs.move(f"{root}/{n}", f"{root}/{n[1:]}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = located(self.path)
        for m in messages:
            if m and m.name:
                fs.delete_file(f"{root}/{m.name}")


class SheetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sheets"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> SheetReader:
        first = self.options.get("first")
        return SheetReader(self.options["path"], int(first) if first else None)

    def writer(self, schema: StructType, overwrite: bool) -> SheetWriter:
        return SheetWriter(self.options["path"], overwrite)
