"""Zip archives of delimited text and xlsx books as Spark data sources: a task for each archive member or sheet, which it streams.

Only the columns of the reader's schema are cut out of a line or a row.  Tasks open files by path, so archives must lie where
all of them can: a mounted folder (``file:`` or a plain path).  In other stores, ``readers`` reads them as binary rows.
"""

from __future__ import annotations

import glob
import io
import os
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows of an Arrow batch.
BATCH = 20_000
SHEETS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("archive_lines")`` and ``"xlsx_rows"`` known to a session."""
    spark.dataSource.register(ArchiveLines)
    spark.dataSource.register(XlsxRows)


def local(path: str) -> str:
    if re.match(r"(?!file:)[a-z][a-z0-9+.-]+:", path):
        raise ValueError(f"archives are opened by path, in a mounted folder: {path}")
    return re.sub("^file:/*", "/", path)


def files(path: str, ending: str) -> list[str]:
    path = local(path)
    return sorted(glob.glob(os.path.join(glob.escape(path), f"**/*{ending}"), recursive=True)) if os.path.isdir(path) else sorted(glob.glob(path))


@dataclass
class Member(InputPartition):
    file: str
    name: str


def batches(rows: Iterator[list[str | None]], schema: StructType) -> Iterator[pa.RecordBatch]:
    held: list[list[str | None]] = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], schema.names)

    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield made()
            held = []
    if held:
        yield made()


class ArchiveLines(DataSource):
    """Options: path, columns (all columns of a line, comma-separated), sep (default |), encoding (default ISO-8859-1).  Columns are texts, missing ones empty; blank lines are left out.

    As a sink: an archive for each task with rows, with a member for each ``rows`` lines (option, default 100000).
    """

    @classmethod
    def name(cls) -> str:
        return "archive_lines"

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in self.options["columns"].split(","))

    def reader(self, schema: StructType) -> DataSourceReader:
        return LinesReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return LinesWriter(self.options, overwrite)


class LinesReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, dict(options)
        every = self.options["columns"].split(",")
        self.places = [every.index(c) for c in schema.names]

    def partitions(self) -> list[Member]:
        found = []
        for file in files(self.options["path"], ".zip"):
            with zipfile.ZipFile(file) as z:  # the directory at the end, not the members
                found += [Member(file, n) for n in z.namelist() if not n.endswith("/")]
        return found or [Member("", "")]

    def read(self, member: Member) -> Iterator[pa.RecordBatch]:
        if not member.file:
            return
        sep, most = self.options.get("sep", "|"), max(self.places, default=0) + 1

        def rows(lines: Iterator[str]) -> Iterator[list[str]]:
            for line in lines:
                line = line.rstrip("\r\n")
                if line.strip():
                    parts = line.split(sep, most)
                    yield [parts[i].strip() if i < len(parts) else "" for i in self.places]

        with zipfile.ZipFile(member.file) as z, z.open(member.name) as f:
            yield from batches(rows(io.TextIOWrapper(f, self.options.get("encoding", "ISO-8859-1"), newline="\n")), self.schema)


@dataclass
class Written(WriterCommitMessage):
    staged: str | None
    file: str | None


class ZipWriter(DataSourceWriter):
    """An archive for each task with rows, a member for each ``rows`` of them (option).  Archives appear when the job commits; what a failed or repeated task wrote does not."""

    ending = ".zip"

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = dict(options), overwrite

    def write(self, rows: Iterator) -> Written:
        path, most = local(self.options["path"]), int(self.options.get("rows", 100_000))
        os.makedirs(path, exist_ok=True)
        staged = os.path.join(path, f".{uuid.uuid4().hex}.staged")
        n = 0
        member = None
        with zipfile.ZipFile(staged, "w", zipfile.ZIP_DEFLATED) as z:
            for row in rows:
                if n % most == 0:
                    if member:
                        member.write(self.foot())
                        member.close()
                    member = z.open(self.member(n // most), "w")
                    member.write(self.head())
                member.write(self.line(row))
                n += 1
            if member:
                member.write(self.foot())
                member.close()
        if not n:
            os.remove(staged)
            return Written(None, None)
        return Written(staged, os.path.join(path, f"{uuid.uuid4().hex}{self.ending}"))

    def member(self, i: int) -> str:
        raise NotImplementedError

    def line(self, row) -> bytes:
        raise NotImplementedError

    def head(self) -> bytes:
        return b""

    def foot(self) -> bytes:
        return b""

    def commit(self, messages: list[Written | None]) -> None:
        if self.overwrite:
            for old in files(self.options["path"], self.ending):
                os.remove(old)
        for m in messages:
            if m and m.staged:
                os.rename(m.staged, m.file)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and m.staged and os.path.exists(m.staged):
                os.remove(m.staged)


class LinesWriter(ZipWriter):
    def member(self, i: int) -> str:
        return f"part{i:05d}.txt"

    def line(self, row) -> bytes:
        text = self.options.get("sep", "|").join("" if v is None else str(v) for v in row)
        return (text + "\n").encode(self.options.get("encoding", "ISO-8859-1"), "replace")


class XlsxWriter(ZipWriter):
    """Books of sheets with inline strings, the headers first."""

    ending = ".xlsx"

    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        super().__init__(options, overwrite)
        self.names = schema.names

    def member(self, i: int) -> str:
        return f"xl/worksheets/sheet{i + 1}.xml"

    def line(self, row) -> bytes:
        return ("<row>" + "".join(f'<c t="inlineStr"><is><t>{escape("" if v is None else str(v))}</t></is></c>' for v in row) + "</row>").encode()

    def head(self) -> bytes:
        return f'<worksheet xmlns="{SHEETS[1:-1]}"><sheetData>'.encode() + self.line(self.names)

    def foot(self) -> bytes:
        return b"</sheetData></worksheet>"


class XlsxRows(DataSource):
    """Options: path; header (default true): the first row of each sheet names its columns.  The schema lists the wanted columns (texts); columns a sheet lacks are null, cells it lacks are empty."""

    @classmethod
    def name(cls) -> str:
        return "xlsx_rows"

    def schema(self) -> str:
        raise ValueError("give the reader a schema of the wanted columns")

    def reader(self, schema: StructType) -> DataSourceReader:
        return XlsxReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return XlsxWriter(schema, self.options, overwrite)


class XlsxReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, dict(options)

    def partitions(self) -> list[Member]:
        found = []
        for file in files(self.options["path"], ".xlsx"):
            with zipfile.ZipFile(file) as z:
                found += [Member(file, n) for n in sorted(z.namelist()) if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)]
        return found or [Member("", "")]

    def read(self, member: Member) -> Iterator[pa.RecordBatch]:
        if not member.file:
            return
        with zipfile.ZipFile(member.file) as z:
            shared: list[str] = []
            if "xl/sharedStrings.xml" in z.namelist():
                with z.open("xl/sharedStrings.xml") as f:
                    shared = ["".join(t.text or "" for t in item.iter(f"{SHEETS}t")) for item in streamed(f, "si")]
            with z.open(member.name) as f:
                yield from batches(self.rows(f, shared), self.schema)

    def rows(self, sheet, shared: list[str]) -> Iterator[list[str | None]]:
        heads: dict[str, int] | None = None if self.options.get("header", "true").lower() == "true" else {c: i for i, c in enumerate(self.schema.names)}
        for row in streamed(sheet, "row"):
            cells: dict[int, str] = {}
            for i, cell in enumerate(row.iter(f"{SHEETS}c")):
                v = cell.find(f"{SHEETS}v")
                text = "".join(t.text or "" for t in cell.iter(f"{SHEETS}t")) if v is None else shared[int(v.text)] if cell.get("t") == "s" else v.text or ""
                cells[column(cell.get("r"), i)] = text.strip()
            if heads is None:
                heads = {text: i for i, text in cells.items()}
            else:
                yield [cells.get(heads[c], "") if c in heads else None for c in self.schema.names]


def column(reference: str | None, place: int) -> int:
    """The column of a cell by its reference (B7 is 1), or by its place where it has none."""
    letters = re.match("[A-Z]+", reference or "")
    n = 0
    for ch in letters[0] if letters else "":
        n = 26 * n + ord(ch) - 64
    return n - 1 if letters else place


def streamed(f, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a tag, each forgotten once it is used."""
    for _, element in ElementTree.iterparse(f):
        if element.tag == f"{SHEETS}{tag}":
            yield element
            element.clear()
