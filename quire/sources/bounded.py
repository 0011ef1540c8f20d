"""Ranges of files that stop reading at their end, as a data source and over files in a DataFrame.

A file of ``kind`` csv, xlsx, docx, pptx or pdf has units (rows, sheet rows, body blocks, slides, pages). A
range asks for those from ``start`` on, ``size`` of them. Slides and pages have a directory, so only the asked ones are
inflated; rows and blocks are gone through in order, and nothing behind the range's end is parsed. ``units_parsed`` says
how many units a file's reading touched.

    register(spark)
    spark.read.format("quire").option("kind", "docx").option("start", 2).option("size", 3).load("/data/in/*.docx")

A filter on ``unit`` narrows the range, and one on ``path`` the files, before anything is read. Files are listed and read by pyarrow's file systems (local paths, s3://, gs://,
hdfs://); files of a store that only Spark opens are read by ``bounded_units`` over ``read_files``.
"""

from __future__ import annotations

import csv
import fnmatch
import hashlib
import io
import posixpath
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
)

from quire.operators.projections import FIRST
from quire.sources import ooxml, pdf
from quire.sources.base import SourceError, parse_files
from quire.sources.packages import local, streamed
from quire.sources.tabular import MAX_SOURCE

UNITS = "unit int, part int, line int, label string, text string, cells array<string>, units_parsed int"
SCHEMA = f"path string, source_sha256 string, error string, {UNITS}"
#: A unit after the last of any file, and the bytes of files that one partition reads.
NO_END, PARTITION_BYTES = 1 << 31, 64 << 20

#: A unit and its rows (part, line, label, text, cells); None where it was passed over.
_Unit = tuple[int, list[tuple] | None]


def _csv(payload: bytes, start: int, stop: int, sheet: int) -> Iterator[_Unit]:
    if len(payload) > MAX_SOURCE:
        raise SourceError("SOURCE_TOO_LARGE")
    rows = csv.reader(io.TextIOWrapper(io.BytesIO(payload), "utf-8-sig", newline=""), strict=True)
    try:
        if next(rows, None) is None:
            raise SourceError("CSV_EMPTY")
        if start >= stop:
            return
        for i, cells in enumerate(rows):
            yield i, None if i < start else [(0, 0, None, None, cells)]
            if i + 1 >= stop:
                return
    except csv.Error:
        raise SourceError("CSV_INVALID") from None


def _docx(payload: bytes, start: int, stop: int, sheet: int) -> Iterator[_Unit]:
    package = ooxml.open_kind("docx", payload)
    styles = ooxml.styles_of(package)
    if start >= stop:
        return
    for i, node in enumerate(streamed(package, "word/document.xml", "body", ("p", "tbl")), 1):
        if i < start:
            yield i, None
        else:
            kind, style, _, text, rows = ooxml.body_unit(node, styles)
            yield i, [(0, 0, style, text, None)] if kind == "paragraph" else [(0, k, "table", None, r) for k, r in enumerate(rows)]
        if i + 1 >= stop:
            return


def _xlsx(payload: bytes, start: int, stop: int, sheet: int) -> Iterator[_Unit]:
    package = ooxml.open_kind("xlsx", payload)
    sheets, cell = ooxml.workbook(package)
    if sheet >= len(sheets) or start >= stop:
        return
    name, _, part = sheets[sheet]
    for row in streamed(package, part, "sheetData", ("row",)):
        found = [cell(c) for c in row if local(c.tag) == "c"]
        number = found[0][0] if found else None
        if number is None or number < start:
            yield number or 0, None
            continue
        if number >= stop:
            return
        values = [None] * max(c for _, c, _, _ in found)
        for _, col, value, formula in found:
            values[col - 1] = value if value is not None else formula
        yield number, [(sheet, number, name, None, values)]


def _pptx(payload: bytes, start: int, stop: int, sheet: int) -> Iterator[_Unit]:
    package = ooxml.open_kind("pptx", payload)
    parts = ooxml.slide_parts(package)
    for number in range(start, min(stop, len(parts) + 1)):
        out = []
        for shape, kind, text, rows in ooxml.slide_content(package, parts[number - 1]):
            out += [(shape, 0, kind, text, None)] if rows is None else [(shape, k, kind, None, r) for k, r in enumerate(rows)]
        yield number, out


def _pdf(payload: bytes, start: int, stop: int, sheet: int) -> Iterator[_Unit]:
    objects, pages, encoding = pdf.page_tree(payload)
    for number in range(start, min(stop, len(pages) + 1)):
        yield number, [(0, 0, None, pdf.page_text(objects, pages[number - 1], encoding), None)]


KINDS = {"csv": _csv, "docx": _docx, "xlsx": _xlsx, "pptx": _pptx, "pdf": _pdf}


def _units(kind: str, payload: bytes, start: int, stop: int, sheet: int) -> list[tuple]:
    """The rows of a file's range, each with the number of units that were touched."""
    parsed, out = 0, []
    for unit, rows in KINDS[kind](payload, max(start, FIRST[kind]), stop, sheet):
        parsed += 1
        out += [(unit, *r) for r in rows or ()]
    return [(*r, parsed) for r in out]


def _checked(kind: str, start: int | None, size: int | None) -> tuple[int, int]:
    """start and end; without a size all that follows."""
    if kind not in KINDS:
        raise ValueError(f"kind is one of {', '.join(KINDS)}")
    start = FIRST[kind] if start is None else start
    if start < FIRST[kind] or (size is not None and size < 1):
        raise ValueError("RANGE_INVALID")
    return start, NO_END if size is None else start + size


def bounded_units(files: DataFrame, kind: str, start: int | None = None, size: int | None = None, sheet: int = 0) -> DataFrame:
    """(path, source_sha256, error, unit, part, line, label, text, cells, units_parsed) of a range of each file (path, content).

    A file that can't be read up to the range's end is one row with a code. One with no unit in the range has no row.
    """
    begin, end = _checked(kind, start, size)
    return parse_files(files, UNITS, lambda name, payload: iter(_units(kind, payload, begin, end, sheet)))


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(tuple(paths))


class BoundedReader(DataSourceReader):
    def __init__(self, options: dict):
        whole = {k: int(options[k]) for k in ("start", "size", "sheet") if k in options}
        self.kind, self.path = options.get("kind", ""), options.get("path", "")
        self.start, self.stop = _checked(self.kind, whole.get("start"), whole.get("size"))
        self.sheet = whole.get("sheet", 0)
        self.paths: set[str] | None = None
        #: A filter on unit leaves out rows without one, such as those of unreadable files.
        self.errors = True

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take comparisons of ``unit`` and equalities of ``path``; give back the others."""
        for f in filters:
            if f.attribute == ("unit",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNotNull)):
                value = getattr(f, "value", None)
                if isinstance(f, (EqualTo, GreaterThanOrEqual)):
                    self.start = max(self.start, value)
                if isinstance(f, GreaterThan):
                    self.start = max(self.start, value + 1)
                if isinstance(f, (EqualTo, LessThanOrEqual)):
                    self.stop = min(self.stop, value + 1)
                if isinstance(f, LessThan):
                    self.stop = min(self.stop, value)
                self.errors = False
            elif f.attribute == ("path",) and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = wanted if self.paths is None else self.paths & wanted
            elif f.attribute == ("path",) and isinstance(f, IsNotNull):
                continue
            else:
                yield f

    def _listed(self) -> list[tuple[str, int]]:
        """(path, size) of the files under a folder, or of a glob's last part."""
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        head = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        folder, pattern = posixpath.split(path)
        if not any(c in pattern for c in "*?["):
            one = system.get_file_info(path)
            if one.is_file:
                return [(head + path, one.size)]
            folder, pattern = path, "*"
        found = system.get_file_info(fs.FileSelector(folder, recursive=True))
        good = [f for f in found if f.is_file and fnmatch.fnmatch(f.base_name, pattern) and not f.base_name.startswith((".", "_"))]
        return sorted((head + f.path, f.size) for f in good)

    def partitions(self) -> list[InputPartition]:
        """Files together up to a number of bytes; none where the range is empty."""
        out, held, size = [], [], 0
        for path, length in self._listed() if self.start < self.stop or self.errors else ():
            if self.paths is not None and path not in self.paths:
                continue
            if held and size + length > PARTITION_BYTES:
                out.append(_Files(held))
                held, size = [], 0
            held.append(path)
            size += length
        return [*out, _Files(held)] if held else out or [_Files([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        for path in partition.value:
            system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
            with system.open_input_stream(inner) as f:
                payload = f.read()
            head = (path, hashlib.sha256(payload).hexdigest())
            try:
                yield from [(*head, None, *r) for r in _units(self.kind, payload, self.start, self.stop, self.sheet)]
            except (SourceError, UnicodeDecodeError) as e:
                if self.errors:
                    yield (*head, str(e) if isinstance(e, SourceError) else "NOT_UTF8", *[None] * len(UNITS.split(", ")))


class BoundedSource(DataSource):
    """``format("quire")``: options kind, start, size, sheet; see the module."""

    @classmethod
    def name(cls) -> str:
        return "quire"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BoundedReader:
        return BoundedReader(self.options)


def register(spark: SparkSession) -> None:
    """Make ``format("quire")`` known to a session, and let filters reach it, without which Spark refuses the source."""
    spark.dataSource.register(BoundedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
