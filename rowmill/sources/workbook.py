"""Workbooks: .xlsx files read in parallel, one task for each file and worksheet."""

from __future__ import annotations

import datetime
import io
import itertools
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import IO
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rowmill.operators.mapping import quoted

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


#: Built-in number formats that show dates or times.
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ET.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in root.iter(f"{_NS}numFmt")}
    dated = _DATE_FORMATS | {i for i, code in own.items() if re.search("[ymdhs]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code.lower()))}
    formats = root.find(f"{_NS}cellXfs")
    return {i for i, x in enumerate(formats if formats is not None else ()) if int(x.get("numFmtId") or 0) in dated}


def _date_text(serial: str) -> str:
    """A date cell's number of days as ISO text, with the time of day if it has one."""
    at = datetime.datetime(1899, 12, 30) + datetime.timedelta(microseconds=round(float(serial) * 86_400_000) * 1000)
    return at.strftime("%Y-%m-%d") if at.time() == datetime.time() else at.strftime("%Y-%m-%d %H:%M:%S") + (f".{at.microsecond // 1000:03d}" if at.microsecond else "")


#: What a cell holds, as the first character of its text where types are kept.
TEXT, NUMBER, BOOLEAN, DATE = "snbd"


class _Texts:
    """Shared texts of a workbook in one block of bytes: a workbook of a million of them costs their length and eight bytes each."""

    def __init__(self, book: zipfile.ZipFile):
        self.block, self.ends = bytearray(), array("Q", [0])
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as part:
                for si in _elements(part, f"{_NS}si"):
                    # runs of phonetic hints are no part of the text
                    self.block += "".join(t.text or "" for t in (*si.iterfind(f"{_NS}t"), *si.iterfind(f"{_NS}r/{_NS}t"))).encode()
                    self.ends.append(len(self.block))

    def __getitem__(self, i: int) -> str:
        return self.block[self.ends[i] : self.ends[i + 1]].decode()


def _elements(part: IO[bytes], tag: str) -> Iterator[ET.Element]:
    """Elements of a name, one at a time: none is kept once the next is asked for."""
    above: list[ET.Element] = []
    for event, element in ET.iterparse(part, events=("start", "end")):
        if event == "start":
            above.append(element)
            continue
        above.pop()
        if element.tag == tag:
            yield element
            above[-1].clear()


def sheet_names(book: zipfile.ZipFile) -> dict[str, str]:
    """The worksheets of a workbook, in order, and where they are in it."""
    targets = {r.get("Id"): r.get("Target").lstrip("/") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = {s.get("name"): targets[s.get(_REL)] for s in ET.fromstring(book.read("xl/workbook.xml")).iter(f"{_NS}sheet")}
    return {name: path if path.startswith("xl/") else f"xl/{path}" for name, path in found.items()}


def sheet_rows(content: bytes | IO[bytes], worksheet: str, typed: bool = False, wanted: Callable[[int], bool] = lambda i: True) -> Iterator[list[str | None]]:
    """Cells of the non-empty rows of a worksheet (its name in any case), as text; booleans as TRUE and FALSE, dates in ISO form.

    typed: each text is led by what the cell holds. wanted: whether a column's cells are needed behind the header; others that are not empty are
    empty text, so that rows stay as wide and as many as they are. The content is bytes or a file that can be read from any place; its rows are read as a stream.
    """
    with zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes) else content) as book:
        paths = {name.lower(): path for name, path in sheet_names(book).items()}
        if worksheet.lower() not in paths:
            raise ValueError(f"The workbook has no worksheet '{worksheet}'.")
        shared, dated = _Texts(book), _date_styles(book)
        with book.open(paths[worksheet.lower()]) as sheet:
            header = True
            for row in _elements(sheet, f"{_NS}row"):
                cells: list[str | None] = []
                for c in row.iter(f"{_NS}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    kind, value = c.get("t"), c.find(f"{_NS}v")
                    if kind != "inlineStr" and value is None:
                        continue
                    if not header and not wanted(at):
                        cells[at] = ""
                        continue
                    if kind == "inlineStr":
                        held, text = TEXT, "".join(t.text or "" for t in (*c.iterfind(f"{_NS}is/{_NS}t"), *c.iterfind(f"{_NS}is/{_NS}r/{_NS}t")))
                    else:
                        held, text = TEXT, value.text or ""
                        if kind in (None, "n") and text:
                            held = DATE if int(c.get("s") or 0) in dated else NUMBER
                            text = _date_text(text) if held == DATE else text
                        elif kind == "b":
                            held, text = BOOLEAN, ("FALSE", "TRUE")[int(text)]
                        elif kind == "s":
                            text = shared[int(text)]
                    cells[at] = held + text if typed else text
                if any(c is not None for c in cells):
                    yield cells
                    header = False


def _parts(content: bytes | IO[bytes], file: str, worksheet: str, columns: list[str], typed: bool, fields: list[str]) -> Iterator[dict[str, list]]:
    """Some thousand rows at a time of a worksheet, by field, with _row_number. The header must be the columns; a wider row fails."""
    places = [columns.index(f) for f in fields]
    rows = sheet_rows(content, worksheet, typed, set(places).__contains__)
    header = [c[1:] if typed and c else c for c in next(rows, [])]
    if header != columns:
        raise ValueError(f"{file}: the header is {header}, not {columns}.")
    numbered = enumerate(rows, 2)
    while part := list(itertools.islice(numbered, 10_000)):
        for n, cells in part:
            if len(cells) > len(columns):
                raise ValueError(f"{file}: row {n} has more cells than the header.")
        found = {f: [cells[i] if i < len(cells) else None for _, cells in part] for f, i in zip(fields, places)}
        yield found | {"_row_number": [n for n, _ in part]}


class WorkbookSource(DataSource):
    """Worksheets as a data source of Spark: a task for each file and worksheet, which opens the file where it lies and reads its rows as a stream.

    Options: path (a folder or an .xlsx file, by any scheme that Arrow's file systems know), worksheets, columns and fields (JSON lists), typed.
    """

    @classmethod
    def name(cls) -> str:
        return "rowmill_workbook"

    def schema(self) -> T.StructType:
        fields = [T.StructField(f, T.StringType()) for f in json.loads(self.options["fields"])]
        return T.StructType([*fields, T.StructField("_file", T.StringType()), T.StructField("_sheet", T.StringType()), T.StructField("_row_number", T.LongType())])

    def reader(self, schema: T.StructType) -> WorkbookReader:
        return WorkbookReader(self.options["path"], *(json.loads(self.options[k]) for k in ("worksheets", "columns", "fields", "typed")))


@dataclass
class Sheet(InputPartition):
    file: str
    worksheet: str


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, worksheets: list[str], columns: list[str], fields: list[str], typed: bool):
        self.path, self.worksheets, self.columns, self.fields, self.typed = path, worksheets, columns, fields, typed

    def partitions(self) -> list[Sheet]:
        system, place = system_of(self.path)
        info = system.get_file_info(place)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else system.get_file_info(fs.FileSelector(place))
        names = sorted(f.path for f in files if f.is_file and f.path.lower().endswith(".xlsx") and not f.base_name.startswith((".", "_", "~")))
        # one file's worksheets stand together, so that tasks that run at once read it while it is cached
        return [Sheet(name, w) for name in names for w in self.worksheets]

    def read(self, partition: Sheet | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's way to read nothing
            return
        schema = pa.schema([*((f, pa.string()) for f in self.fields), ("_file", pa.string()), ("_sheet", pa.string()), ("_row_number", pa.int64())])
        with system_of(self.path)[0].open_input_file(partition.file) as content:
            for part in _parts(content, partition.file, partition.worksheet, self.columns, self.typed, self.fields):
                n = len(part["_row_number"])
                yield pa.RecordBatch.from_pydict(part | {"_file": [partition.file] * n, "_sheet": [partition.worksheet] * n}, schema=schema)


def system_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read_sheets(spark: SparkSession, path: str, worksheets: list[str], columns: list[str], typed: bool = False, fields: list[str] | None = None) -> DataFrame:
    """Rows of worksheets of every .xlsx file at a path, a task for each file and worksheet, with _file, _sheet (as asked for) and _row_number.

    columns: the header of each worksheet; fields: those of them that are read (all unless given), so other cells are neither decoded nor handed on.
    typed: see workbook_rows. A file without one of the worksheets fails the read; a folder without files gives no rows; a worksheet of a header
    alone gives none.
    """
    chosen = columns if fields is None else fields
    unknown = [f for f in chosen if f not in columns]
    if unknown:
        raise ValueError(f"The columns have no fields {unknown}.")
    spark.dataSource.register(WorkbookSource)
    options = {"worksheets": worksheets, "columns": columns, "fields": chosen, "typed": typed}
    found = spark.read.format(WorkbookSource.name()).options(**{k: json.dumps(v) for k, v in options.items()}).load(path)
    return found.select(*(_variant(quoted(c)).alias(c) for c in chosen), "_file", "_sheet", "_row_number") if typed else found


def read_workbooks(spark: SparkSession, path: str, worksheet: str, columns: list[str], typed: bool = False) -> DataFrame:
    """Rows of a worksheet in every .xlsx file at a path, with _file and _row_number; see read_sheets."""
    return read_sheets(spark, path, [worksheet], columns, typed).drop("_sheet")


def workbook_rows(files: DataFrame, worksheet: str, columns: list[str], typed: bool = False) -> DataFrame:
    """Rows of a worksheet in each of the files (path, content): the named columns as text, with _file and _row_number.

    typed: columns are VARIANT, and each cell keeps its type: text, number (double), boolean or date (timestamp).

    The first row of each file is the header and must name the columns in their order; empty rows are skipped and not
    numbered; a row wider than the header fails the read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                for part in _parts(bytes(content), file, worksheet, columns, typed, columns):
                    yield pd.DataFrame(part | {"_file": file})[[*columns, "_file", "_row_number"]]

    fields = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    found = files.select("path", "content").mapInPandas(run, f"{fields}, _file string, _row_number long")
    if not typed:
        return found
    return found.select(*(_variant(quoted(c)).alias(c) for c in columns), "_file", "_row_number")


def _variant(c: Column) -> Column:
    held, text = F.substring(c, 1, 1), F.substring(c, 2, 1 << 30)
    as_kind = lambda kind: text.cast(kind).cast("variant")
    return F.when(held == TEXT, as_kind("string")).when(held == NUMBER, as_kind("double")).when(held == BOOLEAN, as_kind("boolean")).when(held == DATE, as_kind("timestamp_ntz"))


def book_of(worksheet: str, columns: list[str], rows: list[tuple], dated: tuple[int, ...] = ()) -> bytes:
    """A workbook of one worksheet; see book_of_sheets."""
    return book_of_sheets({worksheet: [tuple(columns), *rows]}, dated)


def book_of_sheets(sheets: dict[str, list[tuple]], dated: tuple[int, ...] = ()) -> bytes:
    """A workbook of worksheets, each a header and rows: numbers (as text of digits) and booleans as such, other text in the shared strings; the columns `dated` hold numbers of days."""
    texts: dict[str, int] = {}

    def cell(value: object, column: int) -> str:
        if value is None:
            return "<c/>"
        if isinstance(value, (bool, np.bool_)):
            return f'<c t="b"><v>{int(value)}</v></c>'
        if column in dated or re.fullmatch(r"-?[0-9]+(\.[0-9]+)?", str(value)):
            return f'<c s="{int(column in dated)}"><v>{value}</v></c>'
        return f'<c t="s"><v>{texts.setdefault(str(value), len(texts))}</v></c>'

    main, rel = _NS.strip("{}"), _REL.rpartition("}")[0].strip("{")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        listed = "".join(f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="rId{i}"/>' for i, name in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
        linked = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{linked}</Relationships>')
        book.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        for i, rows in enumerate(sheets.values(), 1):
            lines = ["<row>" + "".join(cell(v, j if n else -1) for j, v in enumerate(r)) + "</row>" for n, r in enumerate(rows)]
            book.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><t>{escape(t)}</t></si>" for t in texts) + "</sst>")
    return out.getvalue()
