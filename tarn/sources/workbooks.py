"""Spreadsheet workbooks (Office Open XML) as tables, by the standard library alone: a partition a sheet.

``spark.read.format("workbook")`` gives ``file, sheet, place, row, cells`` for all sheets of all workbooks at a path, in ``cells`` the texts of a row
from the first column on, null where a cell is missing. Numbers come as texts, whole ones without a point; cells
with a date format as ISO dates or timestamps; truth values as ``true`` and ``false``; errors as null. Sheets are
read as streams, so a task holds a row and the workbook's shared texts, not a sheet.

``table`` makes one sheet a table with the names in its first row.
"""

from __future__ import annotations

import datetime
import re
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .arrays import open_fs

SCHEMA = "file string, sheet string, place int, row long, cells array<string>"
#: Rows of a batch that a task hands on.
BATCH = 1000
# Fixed values of the format: namespaces, and built-in number formats that are dates.
MAIN, RELATIONS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


@dataclass
class Sheet(InputPartition):
    path: str
    name: str
    place: int
    member: str
    date1904: bool


def _root(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    with z.open(name) as f:
        return ElementTree.parse(f).getroot()


def sheets(file, path: str) -> list[Sheet]:
    with zipfile.ZipFile(file) as z:
        book = _root(z, "xl/workbook.xml")
        targets = {r.get("Id"): r.get("Target") for r in _root(z, "xl/_rels/workbook.xml.rels")}
        properties = book.find(f"{MAIN}workbookPr")
        late = properties is not None and properties.get("date1904") in ("1", "true")
        out = []
        for i, s in enumerate(book.iter(f"{MAIN}sheet")):
            target = targets[s.get(f"{RELATIONS}id")]
            out.append(Sheet(path, s.get("name"), i, target.lstrip("/") if target.startswith("/") else f"xl/{target}", late))
        return out


def shared_texts(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    return ["".join(t.text or "" for t in item.iter(f"{MAIN}t")) for item in _root(z, "xl/sharedStrings.xml").iter(f"{MAIN}si")]


def date_styles(z: zipfile.ZipFile) -> set[int]:
    """The places of cell styles that show numbers as dates."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = _root(z, "xl/styles.xml")
    own = {int(f.get("numFmtId")) for f in root.iter(f"{MAIN}numFmt") if re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode").lower()))}
    formats = root.find(f"{MAIN}cellXfs")
    return {i for i, x in enumerate(formats if formats is not None else ()) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}


def column_of(reference: str) -> int:
    """The place of a cell's column: A is 0, AA is 26."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def as_date(days: float, late: bool) -> str:
    """Days since the workbook's epoch as text; without a time of day, a date."""
    epoch = datetime.datetime(1904, 1, 1) if late else datetime.datetime(1899, 12, 30)
    at = epoch + datetime.timedelta(seconds=round(days * 86400))
    return at.date().isoformat() if at.time() == datetime.time() else at.isoformat(sep=" ")


def as_number(text: str) -> str:
    x = float(text)
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def cell_text(cell: ElementTree.Element, shared: list[str], dates: set[int], late: bool) -> str | None:
    kind, value = cell.get("t", "n"), cell.find(f"{MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
    if value is None or value.text is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return "true" if value.text == "1" else "false"
    if kind in ("str", "d"):
        return value.text
    return as_date(float(value.text), late) if int(cell.get("s", 0)) in dates else as_number(value.text)


def rows_of(file, sheet: Sheet) -> Iterator[tuple[int, list[str | None]]]:
    with zipfile.ZipFile(file) as z:
        shared, dates = shared_texts(z), date_styles(z)
        with z.open(sheet.member) as f:
            data = number = None
            for event, x in ElementTree.iterparse(f, events=("start", "end")):
                if event == "start" and x.tag == f"{MAIN}sheetData":
                    data = x
                elif event == "end" and x.tag == f"{MAIN}row":
                    number = int(x.get("r", (number or 0) + 1))
                    cells: list[str | None] = []
                    for c in x.iter(f"{MAIN}c"):
                        at = column_of(c.get("r")) if c.get("r") else len(cells)
                        cells += [None] * (at - len(cells))
                        cells.append(cell_text(c, shared, dates, sheet.date1904))
                    yield number, cells
                    data.clear()  # rows that were read need no memory


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.only = options["path"], options.get("sheet")

    def partitions(self) -> list[Sheet]:
        store, root = open_fs(self.path)
        info = store.get_file_info(root)
        files = [root] if info.type == fs.FileType.File else sorted(i.path for i in store.get_file_info(fs.FileSelector(root)) if i.path.endswith(".xlsx"))
        out = []
        for path in files:
            with store.open_input_file(path) as f:
                out += [s for s in sheets(f, path) if self.only in (None, s.name)]
        return out

    def read(self, partition: Sheet | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], ["file", "sheet", "place", "row", "cells"])

        with open_fs(self.path)[0].open_input_file(partition.path) as f:
            for number, cells in rows_of(f, partition):
                held.append((partition.path, partition.name, partition.place, number, cells))
                if len(held) == BATCH:
                    yield batch()
                    held.clear()
        if held:
            yield batch()


class Workbook(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options)


def read(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    spark.dataSource.register(Workbook)
    reader = spark.read.format("workbook")
    return (reader.option("sheet", sheet) if sheet else reader).load(path)


def table(spark: SparkSession, path: str, sheet: str, schema: str) -> DataFrame:
    """The rows of a sheet of every workbook at a path, below the names in each one's first row; columns that a workbook lacks are null.

    ``schema`` has the columns wanted; a text that doesn't fit its type raises.
    """
    wanted = spark.createDataFrame([], schema).schema
    x = read(spark, path, sheet)
    names = x.filter("row = 1").select("file", F.col("cells").alias("names"))  # a row per workbook
    x = x.filter("row > 1").join(names, "file")
    cell = lambda c: F.get("cells", F.array_position("names", c).cast("int") - 1)
    return x.select(*(F.when(F.array_contains("names", f.name), cell(f.name)).cast(f.dataType).alias(f.name) for f in wanted))


def write(out, book: dict[str, tuple[Sequence[str], Iterable[Sequence]]]) -> None:
    """A workbook of sheets by name, each its column names and its rows, to a binary stream; numbers, truth values, dates, timestamps and texts, None for no cell."""

    def letters(n: int) -> str:
        return (letters(n // 26 - 1) if n >= 26 else "") + chr(65 + n % 26)

    def cell(at: str, v) -> str:
        if isinstance(v, bool):
            return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, int | float):
            return f'<c r="{at}"><v>{v!r}</v></c>'
        if isinstance(v, datetime.date):
            whole = v if isinstance(v, datetime.datetime) else datetime.datetime(v.year, v.month, v.day)
            days = (whole - datetime.datetime(1899, 12, 30)) / datetime.timedelta(days=1)
            return f'<c r="{at}" s="{1 if days == int(days) else 2}"><v>{days!r}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    names = list(book)
    main, relations = MAIN.strip("{}"), RELATIONS.strip("{}")
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        overrides = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(len(names)))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{overrides}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{relations}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        links = "".join(f'<Relationship Id="rId{i + 1}" Type="{relations}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(names)))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}<Relationship Id="rId0" Type="{relations}/styles" Target="styles.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(names))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{relations}"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/styles.xml", f'{head}<styleSheet xmlns="{main}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>')
        for i, n in enumerate(names):
            columns, rows = book[n]
            with z.open(f"xl/worksheets/sheet{i + 1}.xml", "w") as f:
                f.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode())
                for r, row in enumerate([columns, *rows], 1):
                    f.write(f'<row r="{r}">{"".join(cell(f"{letters(c)}{r}", v) for c, v in enumerate(row) if v is not None)}</row>'.encode())
                f.write(b"</sheetData></worksheet>")
