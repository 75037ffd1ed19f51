"""Workbooks (xlsx) as tables: a data source with one partition for each sheet of each file, rows streamed from the
zipped XML.

    spark.dataSource.register(WorkbookSource)
    spark.read.format("workbook").schema("panelist string, score double").option("sheets", "Sapore,Odore").load(folder)

The columns of the schema are a sheet's columns from the left; what a sheet has beyond them is not read, and what it
lacks is null. The names `file`, `sheet` and `row` (the row's number in the sheet, from 1) say where a row comes from.
Sheets are compared without case and outer blanks; unknown ones are skipped, and without `sheets` all are read. `skip`
rows (1) at a sheet's top are its header. Rows without any value are left out.

Numbers, dates (cells whose format is one of date or time), truth values, shared, inline and formula texts become the
schema's types; what cannot become its type is null. A file's shared texts are held by each task that reads a sheet of
it, its rows are not.

The data source opens files itself, so they have to lie in a folder that every executor sees. read_workbooks() takes
them from any store that Spark reads: there Spark brings each file's bytes (under 2 GB) to one task.
"""

from __future__ import annotations

import glob
import io
import os
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import date, datetime, timedelta
from typing import BinaryIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

PLACES = ("file", "sheet", "row")
#: The formats that mean a date or time where a workbook does not define them itself.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
BATCH_ROWS = 4096


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attribute(node: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if _name(k) == name), None)


def sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part in the zip) of each sheet, in the workbook's order."""
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    at = {r.attrib["Id"]: posixpath.normpath(posixpath.join("/xl", r.attrib["Target"])).lstrip("/") for r in links}
    book_xml = ElementTree.fromstring(book.read("xl/workbook.xml"))
    # a sheet's link is r:id; its own id has the same local name in no namespace
    return [(s.attrib["name"], at[next(v for k, v in s.attrib.items() if k.endswith("}id"))]) for s in book_xml.iter() if _name(s.tag) == "sheet"]


def _texts(node: ElementTree.Element) -> str:
    """The text of a string item: its runs together, without phonetic ones."""
    skip = {id(t) for p in node.iter() if _name(p.tag) == "rPh" for t in p.iter()}
    return "".join(t.text or "" for t in node.iter() if _name(t.tag) == "t" and id(t) not in skip)


def _streamed(book: zipfile.ZipFile, part: str, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of one name as they end; each is forgotten after its use."""
    with book.open(part) as stream:
        path = []
        for event, node in ElementTree.iterparse(stream, ("start", "end")):
            if event == "start":
                path.append(node)
                continue
            path.pop()
            if _name(node.tag) == tag:
                yield node
                node.clear()
                if path:
                    path[-1].remove(node)


def _shared(book: zipfile.ZipFile) -> list[str]:
    part = "xl/sharedStrings.xml"
    return [_texts(node) for node in _streamed(book, part, "si")] if part in book.namelist() else []


def _dated_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a date or time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.attrib["numFmtId"]): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.attrib.get("formatCode", "")) for f in root.iter() if _name(f.tag) == "numFmt"}
    dated = {k for k, code in own.items() if re.search("[ymdhs]", code, re.I)} | (DATE_FORMATS - own.keys())
    used = next((x for x in root if _name(x.tag) == "cellXfs"), [])
    return {i for i, x in enumerate(used) if int(x.attrib.get("numFmtId", 0)) in dated}


def _column(place: str) -> int:
    """A1 -> 0, AB7 -> 27."""
    at = 0
    for c in place:
        if not c.isalpha():
            break
        at = at * 26 + ord(c.upper()) - 64
    return at - 1


def _moment(days: float, from_1904: bool) -> datetime:
    return (datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30)) + timedelta(days=round(days * 86_400) / 86_400)


def rows(book: zipfile.ZipFile, part: str, width: int) -> Iterator[tuple[int, list]]:
    """(row number, values of the first `width` columns) of the rows that have any value."""
    shared, dated = _shared(book), _dated_styles(book)
    since = any(_attribute(p, "date1904") in ("1", "true") for p in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _name(p.tag) == "workbookPr")

    def value(cell: ElementTree.Element) -> object:
        kind, held = cell.attrib.get("t", "n"), next((x.text for x in cell if _name(x.tag) == "v"), None)
        if kind == "inlineStr":
            return _texts(cell)
        if held is None or kind == "e":
            return None
        if kind == "s":
            return shared[int(held)]
        if kind == "b":
            return held == "1"
        if kind in ("str", "d"):
            return held
        number = float(held)
        if int(cell.attrib.get("s", 0)) in dated:
            return _moment(number, since)
        return int(number) if number.is_integer() and abs(number) < 1 << 53 else number

    last = 0
    for row in _streamed(book, part, "row"):
        last = int(row.attrib.get("r", last + 1))
        out, at = [None] * width, -1
        for cell in row:
            at = _column(cell.attrib["r"]) if "r" in cell.attrib else at + 1
            if _name(cell.tag) == "c" and at < width:
                out[at] = value(cell)
        if any(v is not None for v in out):
            yield last, out


def _as(kind: T.DataType, v: object) -> object:
    """A cell's value in a column's type, or null."""
    try:
        if v is None:
            return None
        if isinstance(kind, T.StringType):
            if isinstance(v, bool):
                return "TRUE" if v else "FALSE"
            return (v.date() if v.time() == datetime.min.time() else v).isoformat() if isinstance(v, datetime) else str(v)
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            moment = v if isinstance(v, datetime) else datetime.fromisoformat(str(v).strip())
            return moment.date() if isinstance(kind, T.DateType) else moment
        if isinstance(kind, T.BooleanType):
            return v if isinstance(v, bool) else None
        if isinstance(v, (datetime, date)):
            return None
        number = float(str(v).strip().replace(",", ".")) if isinstance(v, str) else v
        if isinstance(kind, T.IntegralType):
            return int(number) if float(number).is_integer() else None
        return float(number)
    except (ValueError, OverflowError):
        return None


def _batches(opened: BinaryIO, path: str, wanted: list[tuple[str, str]], schema: T.StructType, skip: int) -> Iterator[pa.RecordBatch]:
    arrow, cells = to_arrow_schema(schema), [f for f in schema if f.name not in PLACES]
    with zipfile.ZipFile(opened) as book:
        for sheet, part in wanted:
            held: list[list] = []
            for number, values in rows(book, part, len(cells)):
                if number <= skip:
                    continue
                by_name = {f.name: _as(f.dataType, v) for f, v in zip(cells, values, strict=True)} | {"file": path, "sheet": sheet, "row": number}
                held.append([by_name[f.name] for f in schema])
                if len(held) == BATCH_ROWS:
                    yield _batch(held, arrow)
                    held = []
            if held:
                yield _batch(held, arrow)


def _batch(held: list[list], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)


def _known(book: zipfile.ZipFile, names: str | None) -> list[tuple[str, str]]:
    wanted = {n.strip().lower() for n in names.split(",")} if names else None
    return [(name, part) for name, part in sheets(book) if wanted is None or name.strip().lower() in wanted]


class Sheet(InputPartition):
    def __init__(self, path: str, sheet: str, part: str) -> None:
        self.path, self.sheet, self.part = path, sheet, part


class WorkbookReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.schema, self.path = schema, options.get("path", "")
        self.names, self.skip = options.get("sheets"), int(options.get("skip", 1))

    def partitions(self) -> list[InputPartition]:
        path = re.sub("^file:(//)?", "", self.path)
        found = sorted(glob.glob(os.path.join(path, "**/*.xlsx"), recursive=True) if os.path.isdir(path) else glob.glob(path))
        if not found:
            raise FileNotFoundError(f"no workbook at {path}")
        out: list[InputPartition] = []
        for file in found:
            with zipfile.ZipFile(file) as book:
                out += [Sheet(file, *one) for one in _known(book, self.names)]
        return out

    def read(self, partition: Sheet) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, Sheet):  # where no sheet is known, Spark asks for one empty partition
            with open(partition.path, "rb") as opened:
                yield from _batches(opened, partition.path, [(partition.sheet, partition.part)], self.schema, self.skip)


class WorkbookSource(DataSource):
    """The data source `workbook`."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "file string, sheet string, row int, a string, b string, c string, d string, e string, f string, g string"

    def reader(self, schema: T.StructType) -> WorkbookReader:
        return WorkbookReader(schema, self.options)


def read_workbooks(spark: SparkSession, path: str, schema: str, sheets: str | None = None, skip: int = 1) -> DataFrame:
    """The same rows of the workbooks at path, from any store that Spark reads."""
    kinds = T.StructType.fromDDL(schema)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                held = content.as_buffer().to_pybytes()
                with zipfile.ZipFile(io.BytesIO(held)) as book:
                    known = _known(book, sheets)
                yield from _batches(io.BytesIO(held), at, known, kinds, skip)

    return files.mapInArrow(read, kinds)
