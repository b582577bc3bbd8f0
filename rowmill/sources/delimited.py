"""Delimited text: quoted fields with line breaks in files that are split, explicit empty fields told from missing ones, strict widths and quotes.

A file is read in byte ranges by many tasks. Whether a range begins inside quotes follows from the quotes before it:
a first pass counts them for each range, the driver adds them up, a second pass cuts records
from the right state and puts together those that cross ranges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.plans.spec import SourceOptions

_NONE = "\u0001"
_RANGES = "file string, block long, odd boolean, begins boolean, header string"


class Malformed(ValueError):
    """The text breaks the rules of quoting, of width or of headers."""


def checked_names(names: list[str]) -> list[str]:
    """The names of a header; blank and repeated ones are errors."""
    if any(not n.strip() for n in names):
        raise ValueError("The header contains a blank field name.")
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"The header contains duplicate fields: {', '.join(repeated)}.")
    return names


def header_of(spark: SparkSession, path: str, options: SourceOptions) -> list[str]:
    """The names of the first record; blank and repeated ones are errors."""
    first = spark.read.csv(path, sep=options.delimiter, multiLine=True, escape='"', header=False, emptyValue="", nullValue=_NONE).limit(1).collect()
    if not first:
        raise ValueError("The file has no header.")
    return checked_names([(x or "").lstrip("﻿") for x in first[0]])


# ---- records of one range


def fields_of(record: str, delimiter: str) -> list[str]:
    """The fields of a record. A quote may only enclose a whole field, or stand doubled inside one that is enclosed."""
    if '"' not in record:
        return record.split(delimiter)
    plain = re.escape(delimiter)
    one = re.compile(rf'"([^"]*(?:""[^"]*)*)"(?={plain}|\Z)|([^"\r{plain}]*)(?={plain}|\Z)')
    out, at = [], 0
    while True:
        found = one.match(record, at)
        if found is None:
            raise Malformed(f"The text is malformed at field {len(out) + 1} of the record: {record[:200]}")
        out.append(found[2] if found[1] is None else found[1].replace('""', '"'))
        at = found.end() + 1
        if found.end() == len(record):
            return out


@dataclass
class Cutter:
    """Cuts the lines of one range into records. `inside`: the range begins inside quotes, in a record of the range that begins at `owner`."""

    file: str
    block: int
    inside: bool
    owner: int
    records: list[tuple[int, str]] = field(default_factory=list)  # place, text
    pieces: list[tuple[int, int, str]] = field(default_factory=list)  # owner, place (-1: goes on), text

    def __post_init__(self):
        self.open, self.lines, self.size = self.inside, [], 0
        self.place, self.own = -1, self.owner

    def feed(self, lines: list[str]) -> None:
        for line in lines:
            if self.block == 0 and self.size == 0:
                line = line.removeprefix("﻿")
            if not self.open and not self.lines:
                self.place, self.own = self.block + self.size, self.block
            self.size += len(line) + 1
            self.lines.append(line)
            if line.count('"') % 2:
                self.open = not self.open
            if not self.open:
                self._end("\n".join(self.lines).removesuffix("\r"))
                self.lines = []

    def _end(self, text: str) -> None:
        if self.place < 0:
            self.pieces.append((self.own, -1, text))
        elif '"' not in text and "\r" in text:  # a carriage return alone ends a record, too
            for part in text.split("\r"):
                self.records.append((self.place, part))
                self.place += len(part) + 1
        else:
            self.records.append((self.place, text))

    def end(self) -> None:
        if self.lines:
            self.pieces.append((self.own, self.place, "\n".join(self.lines) + "\n"))
            self.lines = []


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """file, block, from, to of the lines of one range that stand together in a batch."""
    block = batch.column("block").to_numpy()
    files = batch.column("file")
    new = np.flatnonzero(np.diff(block) != 0) + 1
    changed = pc.not_equal(files.slice(1), files.slice(0, max(0, batch.num_rows - 1)))
    cuts = sorted({0, *new.tolist(), *(np.flatnonzero(changed.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows})
    for a, b in zip(cuts, cuts[1:]):
        yield files[a].as_py(), int(block[a]), a, b


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range: whether its quotes are odd in number, whether a record begins in it if it starts inside quotes, and, at a file's start, the header."""
    at, odd, begins, header = None, False, False, None

    def row():
        (file, block), text = at, header
        whole = [r for _, r in text.records if r] if text is not None else []
        return pa.RecordBatch.from_pylist([{"file": file, "block": block, "odd": odd, "begins": begins, "header": whole[0] if whole else None}], schema=pa.schema([("file", pa.string()), ("block", pa.int64()), ("odd", pa.bool_()), ("begins", pa.bool_()), ("header", pa.string())]))

    for batch in batches:
        for file, block, a, b in _runs(batch):
            values = batch.column("value").slice(a, b - a)
            if at != (file, block):
                if at is not None:
                    yield row()
                at, odd, begins, header = (file, block), False, False, Cutter(file, 0, False, 0) if block == 0 else None
            else:
                begins |= odd  # the line that comes now begins a record, if the range starts inside quotes
            if header is not None and not any(r for _, r in header.records):
                for start in range(0, b - a, 64):
                    header.feed(values.slice(start, 64).to_pylist())
                    if any(r for _, r in header.records):
                        break
            parity = np.cumsum(pc.count_substring(values, '"').to_numpy(zero_copy_only=False)) % 2
            begins |= bool((parity[:-1] != odd).any())
            odd ^= bool(parity[-1])
    if at is not None:
        yield row()


@dataclass(frozen=True)
class Layout:
    """What the driver knows of the ranges: those that begin inside quotes, with the range of the record they are in; all starts; files with fields in another order."""

    inside: dict[tuple[str, int], int]
    blocks: dict[str, list[int]]
    orders: dict[str, list[int]]
    names: list[str]


def layout_of(lines: DataFrame, delimiter: str) -> Layout:
    """One small row for each range comes to the driver."""
    ranges = lines.mapInArrow(_summaries, _RANGES).orderBy("file", "block").collect()
    inside: dict[tuple[str, int], int] = {}
    blocks: dict[str, list[int]] = {}
    headers: dict[str, list[str]] = {}
    open_, owner, file = False, 0, None
    for r in [*ranges, None]:
        if r is None or r["file"] != file:
            if open_:
                raise Malformed(f"The text is malformed: a quoted field is not closed in {file}.")
            if r is None:
                break
            file, owner = r["file"], 0
            if r["header"] is None:
                raise Malformed(f"The file {file} has no header, or one that is longer than what a task reads.")
            headers[file] = checked_names(fields_of(r["header"], delimiter))
        if open_:
            inside[file, r["block"]] = owner
        if not open_ or r["begins"]:
            owner = r["block"]
        blocks.setdefault(file, []).append(r["block"])
        open_ ^= r["odd"]
    if not headers:
        raise ValueError("The file has no header.")
    names = next(iter(headers.values()))
    other = {f: h for f, h in headers.items() if h != names}
    for f, h in other.items():
        if sorted(h) != sorted(names):
            raise Malformed(f"The header of {f} has other fields than that of {next(iter(headers))}: {', '.join(h)}.")
    return Layout(inside, blocks, {f: [h.index(n) for n in names] for f, h in other.items()}, names)


def _parsed(rows: list[tuple[str, int, str]], layout: Layout, delimiter: str) -> pa.RecordBatch:
    """Records (file, place, text) as columns."""
    width, order = len(layout.names), layout.orders
    columns: list[list[str | None]] = [[] for _ in range(width)]
    for file, _, text in rows:
        values: list[str | None] = list(fields_of(text, delimiter))
        if len(values) > width:
            raise Malformed(f"A record has more fields than the header's {width}: {text[:200]}")
        values += [None] * (width - len(values))
        if file in order:
            values = [values[i] for i in order[file]]
        for c, v in zip(columns, values):
            c.append(v)
    arrays = [pa.array(c, pa.string()) for c in columns]
    arrays += [pa.array([f for f, _, _ in rows], pa.string()), pa.array([p for _, p, _ in rows], pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=[*(f"c{i}" for i in range(width)), "_file", "_position"])


def _cutters(batches: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[tuple[Cutter, bool]]:
    """The cutter of each range after each batch, and whether the range has ended."""
    now: Cutter | None = None
    known = {f: set(b) for f, b in layout.blocks.items()}
    for batch in batches:
        for file, block, a, b in _runs(batch):
            if now is None or (now.file, now.block) != (file, block):
                if now is not None:
                    now.end()
                    yield now, True
                if block not in known.get(file, ()):
                    raise RuntimeError(f"{file} is split in other ranges than before. Read it again.")
                now = Cutter(file, block, (file, block) in layout.inside, layout.inside.get((file, block), block))
            now.feed(batch.column("value").slice(a, b - a).to_pylist())
        if now is not None:
            yield now, False
    if now is not None:
        now.end()
        yield now, True


def _split_files(spark: SparkSession, path: str, options: SourceOptions) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    layout, delimiter = layout_of(lines, options.delimiter), options.delimiter
    schema = ", ".join([*(f"c{i} string" for i in range(len(layout.names))), "_file string", "_position long"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        headed: set[str] = set()
        for cutter, _ in _cutters(batches, layout):
            rows = [(cutter.file, place, text) for place, text in cutter.records if text]
            cutter.records.clear()
            if rows and cutter.block == 0 and cutter.file not in headed:
                headed.add(cutter.file)
                rows = rows[1:]
            if rows:
                yield _parsed(rows, layout, delimiter)

    rows = lines.mapInArrow(whole, schema)
    if layout.inside:
        # the records that cross ranges, from these ranges alone
        crossed = {*layout.inside, *((f, owner) for (f, _), owner in layout.inside.items())}

        def crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for cutter, ended in _cutters(batches, layout):
                cutter.records.clear()
                if ended and cutter.pieces:
                    yield pa.RecordBatch.from_arrays([pa.array([cutter.file] * len(cutter.pieces)), *(pa.array([p[i] for p in cutter.pieces], t) for i, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.string()))), pa.array([cutter.block] * len(cutter.pieces), pa.int64())], names=["file", "owner", "place", "text", "block"])

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(r["file"], r["place"], r["text"]) for r in batch.to_pylist()]
                if rows:
                    yield _parsed(rows, layout, delimiter)

        at = F.concat_ws(":", "block", "file")
        pieces = lines.where(at.isin([f"{b}:{f}" for f, b in crossed])).mapInArrow(crossing, "file string, owner long, place long, text string, block long")
        parts = F.array_sort(F.collect_list(F.struct("block", "text")))
        records = pieces.groupBy("file", "owner").agg(F.max("place").alias("place"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))
        rows = rows.unionByName(records.mapInArrow(joined, schema))
    return rows.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(layout.names)), "_file", "_position")


# ---- by Spark's own reader, a task for each file


def _width(raw: Column, delimiter: str) -> Column:
    """Fields of a raw record: delimiters outside quotes, and one."""
    plain = F.regexp_replace(raw, r'"(?:[^"]|"")*"', "")
    return F.regexp_count(plain, F.lit(re.escape(delimiter))) + 1


def _whole_files(spark: SparkSession, path: str, options: SourceOptions) -> DataFrame:
    names = header_of(spark, path, options)
    fields = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    rows = spark.read.csv(
        path, schema=f"{fields}, `__raw` string", sep=options.delimiter, header=True, enforceSchema=True, multiLine=True, escape='"',
        nullValue=_NONE, emptyValue="", mode="PERMISSIVE", columnNameOfCorruptRecord="__raw", encoding="UTF-8",
    ).select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_position"))
    width = _width(F.col("__raw"), options.delimiter)
    rows = rows.withColumn("__width", F.when(F.col("__raw").isNotNull(), width))
    wide = F.raise_error(F.concat(F.lit(f"A record has more fields than the header's {len(names)}: "), F.col("__raw")))
    checked = F.when(F.col("__width") > len(names), wide.cast("int")).otherwise(F.col("__width"))
    rows = rows.withColumn("__width", checked)
    columns = []
    for i, n in enumerate(names):
        c = F.col("`" + n.replace("`", "``") + "`")
        columns.append(F.when(F.col("__width").isNull() | (F.col("__width") > i), F.coalesce(c, F.lit(""))).alias(n))
    return rows.select(*columns, "_file", "_position")


def read_delimited(spark: SparkSession, path: str, options: SourceOptions = SourceOptions(), multi_line: bool = False) -> DataFrame:
    """Raw text fields of the files at a path, with _file and _position (sortable within a file).

    Missing fields of a short record are null, explicit empty ones are ""; blank lines are skipped. A record with too many fields,
    a quote that neither encloses a field nor stands doubled in one, a quoted field that is not closed, and a
    blank or repeated name in a header fail the read. Every file's header is checked: it must have the first one's names, in
    any order. Line breaks in quotes are kept as they are; files are split, and the texts are read twice: once to count quotes
    (a small row for each range comes to the driver), once to cut records; once more in the JVM where records cross ranges.

    multi_line leaves all to Spark's reader: a task for each file, the first header for all, a CRLF in quotes read as LF.
    """
    return _whole_files(spark, path, options) if multi_line else _split_files(spark, path, options)
