"""Data source of daily panels: a folder with a CSV file for each ticker.

Files are planned into partitions: small ones are packed together, long ones are cut into ranges of bytes. A file is read
by its own header, which each range reads first. Filters on the ticker drop files before they are planned, filters on the
date drop rows before they are made. A row may hold line breaks within quotes; a range that starts inside quotes has to
be told so, which read_daily_csv finds out beforehand for the files that are cut (kind "quotes").
"""

from __future__ import annotations

import csv
import io
import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

SPLIT_BYTES = 64 << 20
#: What opening a file costs, in bytes read.
OPEN_BYTES = 1 << 20
#: A row of more bytes ends its file: a quote was not closed.
MAX_ROW = 64 << 20
ROWS_A_BATCH = 8192

_DATE = re.compile(r"\s*(\d{4})(?:-(\d{1,2})(?:-(\d{1,2})(?:[ T].*)?)?)?\s*", re.DOTALL)
_OPENING = re.compile(rb'(?:^|[,\n])"')


def iso_date(text: str) -> date | None:
    """A year, year-month or year-month-day, with or without a time."""
    m = _DATE.fullmatch(text)
    try:
        return date(*(int(p or 1) for p in m.groups())) if m else None
    except ValueError:
        return None


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def quoted_spans(data: bytes, inside: bool, at_start: bool) -> tuple[list[tuple[int, int]], bool]:
    """Spans of data within quotes, and whether its end is. A quote opens a cell only where the cell begins (at_start: data
    does); within quotes two are one of the text."""
    spans, at, begin = [], 0, 0
    while True:
        if inside:
            q = data.find(b'"', at)
            if q < 0:
                spans.append((begin, len(data)))
                return spans, True
            if data[q + 1 : q + 2] == b'"':
                at = q + 2
                continue
            spans.append((begin, q))
            inside, at = False, q + 1
        else:
            m = _OPENING.match(data) if at_start and at == 0 and data[:1] == b'"' else None
            if m is None:
                q = data.find(b'"', at)  # most ranges have no quotes at all
                while q > 0 and data[q - 1] not in b",\n":
                    q = data.find(b'"', q + 1)
                if q <= 0:
                    return spans, False
                begin = at = q + 1
            else:
                begin = at = 1
            inside = True


def _row_ends(data: bytes, inside: bool, at_start: bool) -> np.ndarray:
    """Places just behind the line breaks that end rows."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    spans, _ = quoted_spans(data, inside, at_start)
    if spans and len(ends):
        low, high = np.array(spans).T
        k = np.searchsorted(low, ends - 1, side="right") - 1
        ends = ends[(k < 0) | (ends - 1 >= high[np.maximum(k, 0)])]
    return ends


@dataclass(frozen=True)
class Piece:
    path: str
    start: int
    end: int
    size: int
    inside: bool = False


@dataclass
class Pieces(InputPartition):
    pieces: tuple[Piece, ...]
    tests: tuple[tuple[str, object], ...] = ()


def planned(files: list[tuple[str, int]], split: int, inside: set[tuple[str, int]]) -> list[tuple[Piece, ...]]:
    """Files (path, size) in order, cut and packed into partitions of about split bytes."""
    out, held, room = [], [], 0
    for path, size in files:
        cuts = [*range(0, size, split)] if size > split else [0]
        for start in cuts:
            piece = Piece(path, start, min(start + split, size) if len(cuts) > 1 else size, size, (path, start) in inside)
            cost = piece.end - piece.start + OPEN_BYTES
            if held and room + cost > split:
                out.append(tuple(held))
                held, room = [], 0
            held.append(piece)
            room += cost
    return [*out, tuple(held)] if held else out


def ticker_of(path: str) -> str:
    return path.rsplit("/", 1)[-1].removesuffix(".csv")


class BadFile(Exception):
    pass


class PanelReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.kind, self.fields = options["path"], options.get("kind", "rows"), schema.names
        self.columns, self.date_col = json.loads(options.get("columns", "[]")), options.get("date_col", "date")
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.inside = {(p, s) for p, s in json.loads(options.get("inside", "[]"))}
        self.tickers: set[str] | None = None
        self.tests: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        """Equality and membership of the ticker, comparisons of the date; Spark keeps the rest."""
        signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if self.kind == "rows" and name == "ticker" and isinstance(f, (EqualTo, In)):
                chosen = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.tickers = chosen if self.tickers is None else self.tickers & chosen
            elif self.kind == "rows" and name == "date" and type(f) in signs and isinstance(f.value, date):
                self.tests.append((signs[type(f)], f.value))
            elif self.kind == "rows" and name in ("ticker", "date") and isinstance(f, IsNotNull):
                continue  # neither is ever null
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, root = _located(self.path)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        files = sorted((i.path, i.size) for i in found if i.type == fs.FileType.File and i.path.endswith(".csv"))
        files = [f for f in files if self.tickers is None or ticker_of(f[0]) in self.tickers]
        if self.kind == "quotes":
            return [Pieces((p,)) for pieces in planned([f for f in files if f[1] > self.split], self.split, set()) for p in pieces] or [Pieces(())]
        return [Pieces(p, tuple(self.tests)) for p in planned(files, self.split, self.inside)] or [Pieces(())]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch] | Iterator[tuple]:
        system, _ = _located(self.path)
        for piece in partition.pieces:
            if self.kind == "quotes":
                yield self._quotes(system, piece)
            elif self.kind == "files":
                yield self._file(system, piece)
            else:
                try:
                    yield from self._batches(system, piece, partition.tests)
                except (BadFile, OSError):
                    continue

    def _quotes(self, system: fs.FileSystem, piece: Piece) -> tuple:
        """Is the end of the piece within quotes, if its start isn't and if it is?"""
        with system.open_input_file(piece.path) as raw:
            start, end = _apart(raw, piece.start, piece.size), _apart(raw, piece.end, piece.size)
            raw.seek(max(start - 1, 0))
            before, data = (raw.read(1) if start else b"\n"), raw.read(end - start)
        first = before in (b"\n", b",")
        return piece.path, piece.start, quoted_spans(data, False, first)[1], quoted_spans(data, True, first)[1]

    def _file(self, system: fs.FileSystem, piece: Piece) -> tuple:
        """Rows with a date, those of them with all columns, and what is wrong with the file."""
        rows = usable = 0
        problem = None
        try:
            for batch in self._batches(system, piece, ()):
                rows += batch.num_rows
                usable += sum(all(_number(v) for v in values) for values in zip(*(batch.column(c).to_pylist() for c in self.columns), strict=True)) if self.columns else batch.num_rows
        except (BadFile, OSError) as e:
            problem = str(e)
        return ticker_of(piece.path), piece.size, rows, usable, problem

    def _batches(self, system: fs.FileSystem, piece: Piece, tests: tuple[tuple[str, object], ...]) -> Iterator[pa.RecordBatch]:
        if not piece.size:
            raise BadFile("empty")
        with system.open_input_file(piece.path) as raw:
            header, body = _header(raw, piece.size)
            if self.date_col not in header:
                raise BadFile("no date column")
            when, places = header.index(self.date_col), [header.index(c) if c in header else None for c in self.columns]
            known: dict[str, date | None] = {}
            ticker, wanted = ticker_of(piece.path), [n for n in self.fields]
            dates: list[date] = []
            cells: list[list[str | None]] = [[] for _ in places]

            def batch() -> pa.RecordBatch:
                made = {"ticker": pa.array([ticker] * len(dates), pa.string()), "date": pa.array(dates, pa.date32()), **{c: pa.array(v, pa.string()) for c, v in zip(self.columns, cells, strict=True)}}
                return pa.RecordBatch.from_arrays([made[n] for n in wanted], names=wanted) if self.kind == "rows" else pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

            for row in _rows(raw, piece, body):
                text = row[when] if when < len(row) else ""
                day = known[text] if text in known else known.setdefault(text, iso_date(text))
                if day is None or not all(_holds(day, sign, value) for sign, value in tests):
                    continue
                dates.append(day)
                for k, place in enumerate(places):
                    cells[k].append(row[place] if place is not None and place < len(row) else None)
                if len(dates) == ROWS_A_BATCH:
                    yield batch()
                    dates, cells = [], [[] for _ in places]
            if dates:
                yield batch()


def _holds(day: date, sign: str, value: date) -> bool:
    return day == value if sign == "=" else day > value if sign == ">" else day >= value if sign == ">=" else day < value if sign == "<" else day <= value


def _number(text: str | None) -> bool:
    try:
        return text is not None and abs(float(text)) < float("inf")
    except ValueError:
        return False


def _apart(raw: pa.NativeFile, at: int, size: int) -> int:
    """The first place from at that no quote stands before, so that a pair of quotes is never cut."""
    while 0 < at < size:
        raw.seek(at - 1)
        if raw.read(1) != b'"':
            break
        at += 1
    return at


def _parsed(rows: list[bytes]) -> Iterator[list[str]]:
    csv.field_size_limit(MAX_ROW)
    text = (r.decode("utf-8", "replace").replace("\0", "") for r in rows)
    yield from csv.reader(text, skipinitialspace=False)


def _header(raw: pa.NativeFile, size: int) -> tuple[list[str], int]:
    """The cells of the first row, and where the next begins."""
    data, want = b"", 1 << 16
    while True:
        raw.seek(0)
        data = raw.read(min(want, size))
        start = 3 if data.startswith(b"\xef\xbb\xbf") else 0
        ends = _row_ends(data[start:], False, True)
        if len(ends) or len(data) >= size or want >= MAX_ROW:
            break
        want *= 8
    end = start + int(ends[0]) if len(ends) else len(data)
    try:
        cells = next(_parsed([data[start:end]]), [])
    except csv.Error as e:
        raise BadFile(str(e)) from e
    return [c.strip() for c in cells], end


def _rows(raw: pa.NativeFile, piece: Piece, body: int) -> Iterator[list[str]]:
    """Rows that begin in the piece; the last may end beyond it."""
    start, end = max(_apart(raw, piece.start, piece.size), 0), _apart(raw, piece.end, piece.size)
    inside = piece.inside
    raw.seek(max(start - 1, 0))
    before = raw.read(1) if start else b"\n"
    data, reach = raw.read(end - start), end
    at_start = before in (b"\n", b",")
    ends = _row_ends(data, inside, at_start)
    if start <= body:
        first = body - start
    elif before == b"\n" and not inside:
        first = 0
    else:  # the row before goes on into this piece
        first = int(ends[0]) if len(ends) else len(data)
    if first >= len(data):
        return
    while reach < piece.size and not (len(ends) and ends[-1] == len(data)):
        if len(data) - (ends[-1] if len(ends) else 0) > MAX_ROW:
            raise BadFile("a row without end")
        more = raw.read(min(1 << 16 if reach - end < 1 << 18 else 1 << 24, piece.size - reach))
        grown = data + more
        found = _row_ends(grown, inside, at_start)
        beyond = found[found >= len(data)]
        reach += len(more)
        data = grown
        if len(beyond):
            data, ends = grown[: int(beyond[0])], found[found <= beyond[0]]
            break
        ends = found
    cuts = [first, *ends[ends > first].tolist()]
    if cuts[-1] < len(data):
        cuts.append(len(data))
    pending = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    for k in range(0, len(pending), 4096):
        part = pending[k : k + 4096]
        try:
            rows = list(_parsed(part))
        except csv.Error:  # one row spoils no others
            rows = []
            for r in part:
                try:
                    rows += list(_parsed([r]))
                except csv.Error:
                    continue
        yield from (r for r in rows if r)


@dataclass
class WrittenFiles(WriterCommitMessage):
    """(temporary, final) of each file that a task wrote."""

    files: list[tuple[str, str]]


class PanelWriter(DataSourceWriter):
    """A file for each ticker from rows (ticker, date, columns) that come by ticker: under a name of its own until the job
    commits, so that a task that is run twice or killed leaves nothing that is read."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.names = options["path"], schema.names

    def write(self, iterator: Iterator[Row]) -> WrittenFiles:
        system, root = _located(self.path)
        system.create_dir(root, recursive=True)
        mark, done = uuid.uuid4().hex[:12], []
        for number, (ticker, rows) in enumerate(groupby(iterator, key=lambda r: r[0])):
            if ticker is None or "/" in ticker:
                raise ValueError(f"{ticker!r} is no name of a file")
            temporary = f"{root}/_{mark}-{number}.tmp"
            with system.open_output_stream(temporary) as out, io.TextIOWrapper(out, "utf-8", newline="") as text:
                writer = csv.writer(text, lineterminator="\n")
                writer.writerow(self.names[1:])
                writer.writerows(r[1:] for r in rows)
            done.append((temporary, f"{root}/{ticker}.csv"))
        return WrittenFiles(done)

    def commit(self, messages: list[WrittenFiles | None]) -> None:
        system, _ = _located(self.path)
        for m in filter(None, messages):
            for temporary, final in m.files:
                system.move(temporary, final)

    def abort(self, messages: list[WrittenFiles | None]) -> None:
        system, _ = _located(self.path)
        for m in filter(None, messages):
            for temporary, _ in m.files:
                if system.get_file_info(temporary).type == fs.FileType.File:
                    system.delete_file(temporary)


class PanelCsv(DataSource):
    """Options: path, columns (a JSON list), date_col, split_bytes; kind rows (ticker, date, columns as text), files (a row
    for each piece of a file: what it holds and what is wrong with it) or quotes."""

    @classmethod
    def name(cls) -> str:
        return "panelcsv"

    def schema(self) -> str:
        kind = self.options.get("kind", "rows")
        if kind == "quotes":
            return "path string, start long, after_outside boolean, after_inside boolean"
        if kind == "files":
            return "ticker string, bytes long, n_rows long, n_usable long, problem string"
        return ", ".join(["ticker string", "date date", *(f"`{c}` string" for c in json.loads(self.options.get("columns", "[]")))])

    def reader(self, schema: StructType) -> PanelReader:
        return PanelReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> PanelWriter:
        return PanelWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PanelCsv)


def starts_inside(spark: SparkSession, folder: str, split: int) -> list[tuple[str, int]]:
    """Of files that are cut, the ranges that start within quotes. Tasks tell for each range where it would end; what the
    driver chains up is two flags for each range."""
    register(spark)
    inside, state, path = [], False, None
    for r in spark.read.format("panelcsv").option("path", folder).option("kind", "quotes").option("split_bytes", split).load().orderBy("path", "start").collect():
        state = False if r["path"] != path else state
        path = r["path"]
        if state:
            inside.append((path, r["start"]))
        state = r["after_inside"] if state else r["after_outside"]
    return inside


__all__ = ["PanelCsv", "iso_date", "planned", "quoted_spans", "register", "starts_inside"]
