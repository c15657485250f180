"""Spreadsheet workbooks (.xlsx) as a Spark data source.

A sheet is one compressed XML stream, so a task reads it from the start and stops at the end
of its range of rows; nothing holds a whole sheet. Ranges come from the dimension that the
sheet states, and the last one has no end, so a wrong dimension loses no row. The format
allows 1,048,576 rows a sheet, which bounds the ranges of a file; larger data are folders of
files, each with ranges of its own. Texts that cells share are read once by each task.

What cells give, as text unless a schema is set: numbers without a needless fraction, cells
formatted as dates as ``yyyy-mm-dd``, with ``hh:mm:ss`` if they have a time of day, booleans
as true and false; blank cells and errors give null. Rows without any value are left out.
"""

from __future__ import annotations

import datetime as dt
import posixpath
import re
import sys
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

# Tasks carry the source with them, so workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS_PER_PART = 100_000
ROWS_PER_BATCH = 4096

# Fixed values of the file format: namespaces, and the built-in numbers of date formats.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DATE_FORMATS = frozenset([14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47])


class Workbook:
    """An open workbook: its sheets, shared texts and date styles, each read when asked for."""

    def __init__(self, path: str):
        where, inner = (fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:")
                        else (fs.LocalFileSystem(), path))
        self._zip = zipfile.ZipFile(where.open_input_file(inner))
        book = ElementTree.fromstring(self._zip.read("xl/workbook.xml"))
        links = ElementTree.fromstring(self._zip.read("xl/_rels/workbook.xml.rels"))
        target = {link.get("Id"): link.get("Target") for link in links}
        self.sheets = [(sheet.get("name"), posixpath.normpath(
            posixpath.join("/xl", target[sheet.get(LINK)])).lstrip("/"))
            for sheet in book.iter(f"{MAIN}sheet")]
        settings = book.find(f"{MAIN}workbookPr")
        self.from_1904 = settings is not None and settings.get("date1904") in ("1", "true")

    def part_of(self, sheet: str) -> str:
        """The part that holds a sheet, by its number from 1 or its name."""
        for number, (name, part) in enumerate(self.sheets, 1):
            if sheet in (str(number), name):
                return part
        raise ValueError(f"no sheet {sheet}; there are {', '.join(n for n, _ in self.sheets)}")

    def stated_rows(self, part: str) -> int:
        """The last row by the stated dimension; 0 if none is stated."""
        with self._zip.open(part) as stream:
            for _, node in ElementTree.iterparse(stream, ("start",)):
                if node.tag == f"{MAIN}dimension":
                    digits = re.search(r"\d+$", node.get("ref", ""))
                    return int(digits.group()) if digits else 0
                if node.tag == f"{MAIN}sheetData":
                    return 0
        return 0

    def shared_texts(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self._zip.namelist():
            return []
        texts = []
        with self._zip.open("xl/sharedStrings.xml") as stream:
            for _, node in ElementTree.iterparse(stream):
                if node.tag == f"{MAIN}si":
                    texts.append(_text(node))
                    node.clear()
        return texts

    def date_styles(self) -> set[int]:
        """Numbers of the cell styles that show a number as a date or a time."""
        if "xl/styles.xml" not in self._zip.namelist():
            return set()
        styles = ElementTree.fromstring(self._zip.read("xl/styles.xml"))
        custom = {int(f.get("numFmtId")): _shows_date(f.get("formatCode", ""))
                  for f in styles.iter(f"{MAIN}numFmt")}
        cells = styles.find(f"{MAIN}cellXfs")
        formats = [int(x.get("numFmtId", 0)) for x in cells] if cells is not None else []
        return {i for i, f in enumerate(formats) if custom.get(f, f in DATE_FORMATS)}

    def rows(self, part: str, start: int = 1,
             end: int | None = None) -> Iterator[tuple[int, dict[int, str]]]:
        """Number and values by column, from 0, of the rows ``start`` to ``end``."""
        shared, dates = None, self.date_styles()
        number = 0
        with self._zip.open(part) as stream:
            parent = None
            for event, node in ElementTree.iterparse(stream, ("start", "end")):
                if event == "start":
                    parent = node if node.tag == f"{MAIN}sheetData" else parent
                    continue
                if node.tag != f"{MAIN}row":
                    continue
                number = int(node.get("r", number + 1))
                if end is not None and number > end:
                    return
                if number >= start:
                    if shared is None:
                        shared = self.shared_texts()
                    yield number, self._values(node, shared, dates)
                parent.clear()

    def _values(self, row, shared: list[str], dates: set[int]) -> dict[int, str]:
        values, column = {}, -1
        for cell in row.iter(f"{MAIN}c"):
            place = cell.get("r")
            column = _column(place) if place else column + 1
            value = self._value(cell, shared, dates)
            if value is not None:
                values[column] = value
        return values

    def _value(self, cell, shared: list[str], dates: set[int]) -> str | None:
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            inline = cell.find(f"{MAIN}is")
            return None if inline is None else _text(inline) or None
        text = cell.findtext(f"{MAIN}v")
        if not text or kind == "e":
            return None
        if kind == "s":
            return shared[int(text)] or None
        if kind == "b":
            return "true" if text == "1" else "false"
        if kind != "n":
            return text
        if int(cell.get("s", 0)) in dates:
            return date_text(float(text), self.from_1904)
        number = float(text)
        return str(int(number)) if number.is_integer() and abs(number) < 2**53 else text


def _text(node) -> str:
    """The text of a string item, its parts joined, without phonetic readings."""
    parts = []
    for child in node:
        if child.tag == f"{MAIN}t":
            parts.append(child.text or "")
        elif child.tag == f"{MAIN}r":
            parts.append(child.findtext(f"{MAIN}t") or "")
    return "".join(parts)


def _shows_date(code: str) -> bool:
    """Whether a format has letters of dates outside quotes, brackets and escapes."""
    plain = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.|\*.', "", code.lower())
    elapsed = re.search(r"\[(h+|m+|s+)\]", code.lower())
    return bool(elapsed) or (plain != "general" and bool(re.search("[ymdhs]", plain)))


def _column(place: str) -> int:
    number = 0
    for letter in place.rstrip("0123456789"):
        number = number * 26 + ord(letter) - 64
    return number - 1


def date_text(serial: float, from_1904: bool = False) -> str:
    """A day number as text. Days before March 1900 count from a day later, as the format
    has a 29 February 1900."""
    first = dt.datetime(1904, 1, 1) if from_1904 else dt.datetime(
        1899, 12, 31 if serial < 60 else 30)
    moment = first + dt.timedelta(seconds=round(serial * 86400))
    return f"{moment:%Y-%m-%d}" if moment.time() == dt.time() else f"{moment:%Y-%m-%d %H:%M:%S}"


class _Range(InputPartition):
    def __init__(self, path: str, part: str, start: int, end: int | None):
        self.path, self.part, self.start, self.end = path, part, start, end


class SheetReader(DataSourceReader):
    def __init__(self, schema: StructType, options):
        from pyspark.sql.pandas.types import to_arrow_schema

        self._arrow = to_arrow_schema(schema)
        self._sheet, self._header, self._size = _options(options)
        self._files = _files(options)

    def partitions(self):
        """Ranges of rows of every file."""
        ranges = []
        for path in self._files:
            book = Workbook(path)
            part = book.part_of(self._sheet)
            starts = list(range(1, max(1, book.stated_rows(part)) + 1, self._size))
            ranges += [_Range(path, part, start, start + self._size - 1) for start in starts[:-1]]
            ranges.append(_Range(path, part, starts[-1], None))
        return ranges

    def read(self, partition: _Range):
        book = Workbook(partition.path)
        skipped, width = -1, len(self._arrow)
        if self._header:
            skipped, names = next(_filled(book.rows(partition.part)), (-1, {}))
            if sorted(names) and len(_names(names)) != width:
                raise ValueError(f"{partition.path}: {len(_names(names))} columns, not {width}")
        rows = []
        for number, values in _filled(book.rows(partition.part, partition.start, partition.end)):
            if number == skipped:
                continue
            if max(values) >= width:
                raise ValueError(f"{partition.path}: row {number} has more than {width} columns")
            rows.append(values)
            if len(rows) == ROWS_PER_BATCH:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict[int, str]]) -> pa.RecordBatch:
        columns = [pa.array([row.get(i) for row in rows], pa.string()).cast(field.type)
                   for i, field in enumerate(self._arrow)]
        return pa.RecordBatch.from_arrays(columns, schema=self._arrow)


class SheetSource(DataSource):
    """``spark.read.format("sheet")``: options ``sheet`` (number from 1, or name; 1), ``header``
    (true), ``rowsPerPartition``. The path is a file or a folder of files of the same columns.
    Without a schema all columns are text, named by the header or by their place."""

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def schema(self) -> StructType:
        sheet, header, _ = _options(self.options)
        book = Workbook(_files(self.options)[0])
        _, first = next(_filled(book.rows(book.part_of(sheet))), (0, {}))
        if not first:
            raise ValueError(f"sheet {sheet} is empty; set a schema")
        names = _names(first) if header else [f"column_{i + 1}" for i in range(max(first) + 1)]
        return StructType([StructField(name, StringType()) for name in names])

    def reader(self, schema: StructType) -> SheetReader:
        return SheetReader(schema, self.options)


def _filled(rows):
    return ((number, values) for number, values in rows if values)


def _names(first: dict[int, str]) -> list[str]:
    """Names of the columns up to the last one named; one without a name goes by its place."""
    return [first.get(i, f"column_{i + 1}") for i in range(max(first) + 1)]


def _options(options) -> tuple[str, bool, int]:
    size = int(options.get("rowsPerPartition", ROWS_PER_PART))
    if size < 1:
        raise ValueError("rowsPerPartition has to be positive")
    return options.get("sheet", "1"), options.get("header", "true").lower() == "true", size


def _files(options) -> list[str]:
    """The workbook at the path, or those in the folder there, by name."""
    path = options.get("path")
    if not path:
        raise ValueError("a sheet needs a path")
    uri = "://" in path or path.startswith("file:")
    where, inner = fs.FileSystem.from_uri(path) if uri else (fs.LocalFileSystem(), path)
    kind = where.get_file_info(inner).type
    if kind == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if kind == fs.FileType.File:
        return [path]
    found = sorted(f.base_name for f in where.get_file_info(fs.FileSelector(inner))
                   if f.base_name.endswith(".xlsx") and not f.base_name.startswith(("~", ".")))
    if not found:
        raise FileNotFoundError(f"no workbook in {path}")
    return [f"{path.rstrip('/')}/{name}" for name in found]
