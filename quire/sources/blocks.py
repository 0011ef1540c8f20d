"""Content blocks of CSV, XLSX, DOCX, PPTX and PDF files, made of the relations that their readers give.

A block is a row (path, source_sha256, format, block, block_id, content); blocks of a document are
numbered from 1 in its order, and ``block_id`` is a letter for the kind with that number. What goes beyond a
bound is left out, and ``truncated`` says so for the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import strip
from quire.operators.blocks import BLOCK
from quire.sinks.tables import written
from quire.sources import ooxml, pdf, tabular
from quire.sources.catalog import parser_of

# The bounds of blocks, the letters of block ids, and what a sheet's name can't hold.
MAX_BLOCKS, MAX_ROWS, MAX_COLUMNS, MAX_PARAGRAPHS, MAX_SLIDE_PARAGRAPHS, MAX_TEXT, MAX_NAME = 200, 500, 32, 200, 50, 8192, 64
LETTERS = {"sheet": "s", "heading": "h", "paragraphs": "p", "table": "t", "slide": "d"}
_FORBIDDEN = r"[\\/?*\[\]:]"
_KEY = ["path", "source_sha256"]


def clipped(text: Column, limit: int = MAX_TEXT) -> Column:
    """Text without NUL and outer white space, at most ``limit`` characters."""
    return F.substring(strip(F.replace(text, F.lit("\0"), F.lit(""))), 1, limit)


def trimmed_rows(rows: Column) -> Column:
    """At most MAX_ROWS rows of at most MAX_COLUMNS cells, empty cells at a row's end left out; a row has one cell at least."""

    def one(row: Column) -> Column:
        some = F.transform(F.slice(row, 1, MAX_COLUMNS), lambda c: F.substring(F.replace(F.coalesce(c, F.lit("")), F.lit("\0"), F.lit("")), 1, MAX_TEXT))
        last = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(some), F.lit(1))), F.lit(1), lambda a, k: F.when(F.get(some, k - 1) != "", k).otherwise(a))
        return F.when(F.size(some) > 0, F.slice(some, F.lit(1), last)).otherwise(F.array(F.lit("")))

    return F.transform(F.slice(rows, 1, MAX_ROWS), one)


def too_large(rows: Column) -> Column:
    return (F.size(rows) > MAX_ROWS) | F.exists(rows, lambda r: F.size(r) > MAX_COLUMNS)


def sheet_name(name: Column) -> Column:
    """A sheet's name in blocks: a dash for what it can't hold, at most 64 characters."""
    plain = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), _FORBIDDEN, "-"))
    return F.substring(F.when(plain == "", "Sheet").otherwise(plain), 1, MAX_NAME)


def distinct_names(rows: DataFrame, key: list[str], order: str, name: str) -> DataFrame:
    """Names that repeat within a key numbered from 2, as name-2; case counts. A name stays within its bound."""
    nth = F.row_number().over(W.partitionBy(*key, name).orderBy(order))
    suffix = F.concat(F.lit("-"), nth.cast("string"))
    return rows.withColumn(name, F.when(nth == 1, F.col(name)).otherwise(F.concat(F.substr(name, F.lit(1), F.lit(MAX_NAME) - F.length(suffix)), suffix)))


def _content(kind: str | Column, **arms: Column) -> Column:
    """A block of the shape that all kinds share; arms that aren't given are null."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    fields = [f.split(":", 1)[0] for f in ("level:int", "text:string", "name:string", "paragraphs:a", "pairs:a", "header_rows:int", "rows:a")]
    types = {
        "level": "int", "text": "string", "name": "string", "paragraphs": "array<string>",
        "pairs": "array<struct<label:string,value:string>>", "header_rows": "int", "rows": "array<array<string>>",
    }
    return F.struct(kind.alias("kind"), *(arms.get(f, F.lit(None)).cast(types[f]).alias(f) for f in fields)).cast(BLOCK)


def _table(kind: str, rows: Column, name: Column | None = None) -> Column:
    own = trimmed_rows(rows)
    arms = {"rows": own, "header_rows": F.when(F.size(own) > 1, 1).otherwise(0)}
    return _content(kind, **arms, **({} if name is None else {"name": name}))


def _numbered(blocks: DataFrame, fmt: str) -> DataFrame:
    """Number blocks (key..., at, content, cut) of documents in order, with ids and the bound on their number."""
    order = W.partitionBy(*_KEY).orderBy("at")
    rows = blocks.withColumn("block", F.row_number().over(order))
    whole = W.partitionBy(*_KEY)
    rows = rows.withColumn("truncated", (F.max("block").over(whole) > MAX_BLOCKS) | F.bool_or("cut").over(whole)).filter(F.col("block") <= MAX_BLOCKS)
    letter = F.create_map(*(F.lit(x) for kv in LETTERS.items() for x in kv))[F.col("content.kind")]
    return rows.select(
        *_KEY, F.lit(fmt).alias("format"), "block", F.concat(letter, F.col("block").cast("string")).alias("block_id"), "content", "truncated"
    )


def _stem(path: str = "path") -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def csv_blocks(files: DataFrame) -> DataFrame:
    """One sheet for each file, named for it, the header being its first row."""
    rows = tabular.csv_rows(files, max_columns=MAX_COLUMNS + 1)
    empty = rows.filter("error = 'CSV_EMPTY'").select(*_KEY, F.array().cast("array<array<string>>").alias("rows"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("row_index", "cells"))), lambda x: x["cells"])
    head = rows.filter("error is null").filter(F.col("row_index") < MAX_ROWS)
    grids = head.groupBy(*_KEY).agg(listed.alias("rows")).unionByName(empty)
    one = F.when(F.size("rows") > 0, F.col("rows")).otherwise(F.array(F.array(F.lit(""))))
    return _numbered(grids.select(*_KEY, F.lit(0).alias("at"), _table("sheet", one, sheet_name(_stem())).alias("content"), too_large(F.col("rows")).alias("cut")), "csv")


def sheet_grids(cells: DataFrame) -> DataFrame:
    """(key..., sheet_ix, sheet, visible, n_rows, n_cols, rows) of workbook cells: whole grids from the first cell on, within the bounds of blocks."""
    some = cells.filter("error is null")
    per = some.groupBy(*_KEY, "sheet_ix", "sheet", "visible").agg(F.max("row").alias("n_rows"), F.max("col").alias("n_cols"))
    inside = some.filter((F.col("row") <= MAX_ROWS + 1) & (F.col("col") <= MAX_COLUMNS + 1))
    lines = inside.groupBy(*_KEY, "sheet_ix", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.coalesce("value", "formula")))).alias("cells"))
    whole = lines.groupBy(*_KEY, "sheet_ix").agg(F.map_from_entries(F.collect_list(F.struct("row", "cells"))).alias("lines"))
    joined = per.join(whole, [*_KEY, "sheet_ix"])
    width = F.least("n_cols", F.lit(MAX_COLUMNS + 1))
    row = lambda r: F.transform(F.sequence(F.lit(1), width), lambda c: F.coalesce(F.try_element_at(F.try_element_at(F.col("lines"), r), c), F.lit("")))
    rows = F.transform(F.sequence(F.lit(1), F.least("n_rows", F.lit(MAX_ROWS + 1))), row)
    return joined.select(*_KEY, "sheet_ix", "sheet", "visible", "n_rows", "n_cols", rows.alias("rows"))


def xlsx_blocks(files: DataFrame) -> DataFrame:
    """A sheet for each worksheet that holds something."""
    grids = sheet_grids(ooxml.workbook_cells(files)).filter(F.exists(F.flatten("rows"), lambda c: c != "")).withColumn("name", sheet_name(F.col("sheet")))
    grids = distinct_names(grids, _KEY, "sheet_ix", "name")
    cut = (F.col("n_rows") > MAX_ROWS) | (F.col("n_cols") > MAX_COLUMNS)
    return _numbered(grids.select(*_KEY, F.col("sheet_ix").alias("at"), _table("sheet", F.col("rows"), F.col("name")).alias("content"), cut.alias("cut")), "xlsx")


def docx_blocks(files: DataFrame) -> DataFrame:
    """Headings, tables, and the runs of paragraphs between them, MAX_PARAGRAPHS at most in one block."""
    rows = ooxml.docx_paragraphs(files).filter("error is null").withColumn("text", clipped(F.col("text")))
    rows = rows.filter((F.col("kind") == "table") & (F.size("rows") > 0) | (F.coalesce("text", F.lit("")) != ""))
    plain = (F.col("kind") == "paragraph") & (F.col("level") == 0)
    order = W.partitionBy(*_KEY).orderBy("idx")
    # A run is numbered by the headings and tables before it.
    run = F.sum((~plain).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("plain", plain).withColumn("run", run)
    nth = F.row_number().over(W.partitionBy(*_KEY, "plain", "run").orderBy("idx"))
    chunk = F.when(F.col("plain"), F.floor((nth - 1) / MAX_PARAGRAPHS)).otherwise(0)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"])
    grouped = rows.withColumn("chunk", chunk).groupBy(*_KEY, "plain", "run", "chunk").agg(
        F.min("idx").alias("at"), texts.alias("texts"), F.first("level").alias("level"), F.first("kind").alias("kind"), F.first("rows").alias("rows")
    )
    content = (
        F.when(F.col("plain"), _content("paragraphs", paragraphs=F.col("texts")))
        .when(F.col("kind") == "table", _table("table", F.col("rows")))
        .otherwise(_content("heading", level=F.col("level"), text=F.get("texts", F.lit(0))))
    )
    cut = (F.col("chunk") > 0) | F.coalesce(too_large(F.col("rows")), F.lit(False))
    return _numbered(grouped.select(*_KEY, "at", content.alias("content"), cut.alias("cut")), "docx")


def pptx_blocks(files: DataFrame) -> DataFrame:
    """A slide with its title and texts, after its tables."""
    shapes = ooxml.slide_shapes(files).filter("error is null and kind <> 'notes'").withColumn("text", clipped(F.col("text")))
    table = (F.col("kind") == "table") & (F.size("rows") > 0)
    tables = shapes.filter(table).select(
        *_KEY, F.struct("slide", F.lit(0).alias("last"), "shape").alias("at"), _table("table", F.col("rows")).alias("content"), too_large(F.col("rows")).alias("cut")
    )
    first = F.row_number().over(W.partitionBy(*_KEY, "slide", F.col("kind") == "title").orderBy("shape"))
    marked = shapes.withColumn("is_title", (F.col("kind") == "title") & (first == 1))
    texts = F.array_sort(F.collect_list(F.when(~F.col("is_title") & F.col("kind").isin("text", "title") & (F.col("text") != ""), F.struct("shape", "text"))))
    slides = marked.groupBy(*_KEY, "slide").agg(F.max(F.when(F.col("is_title"), F.col("text"))).alias("title"), F.transform(texts, lambda x: x["text"]).alias("texts"))
    title = F.when(F.coalesce("title", F.lit("")) == "", F.concat(F.lit("Slide "), F.col("slide").cast("string"))).otherwise(F.col("title"))
    few = F.slice("texts", 1, MAX_SLIDE_PARAGRAPHS)
    content = _content("slide", text=title, paragraphs=F.when(F.size(few) > 0, few))
    own = slides.select(*_KEY, F.struct("slide", F.lit(1).alias("last"), F.lit(0).alias("shape")).alias("at"), content.alias("content"), F.lit(False).alias("cut"))
    return _numbered(tables.unionByName(own), "pptx")


def pdf_blocks(files: DataFrame) -> DataFrame:
    """A block of paragraphs for each page that has text: its lines."""
    pages = pdf.pdf_pages(files).filter("error is null")
    lines = F.filter(F.transform(F.split(clipped(F.col("text")), r"\r\n|[\n\r\f\x0B]"), lambda s: F.substring(s, 1, MAX_TEXT)), lambda s: strip(s) != "")
    some = pages.withColumn("lines", F.slice(lines, 1, MAX_PARAGRAPHS)).filter(F.size("lines") > 0)
    return _numbered(some.select(*_KEY, F.col("page").alias("at"), _content("paragraphs", paragraphs=F.col("lines")).alias("content"), F.lit(False).alias("cut")), "pdf")


READERS = {"csv": csv_blocks, "xlsx": xlsx_blocks, "docx": docx_blocks, "pptx": pptx_blocks, "pdf": pdf_blocks}


def content_blocks(files: DataFrame) -> DataFrame:
    """(path, source_sha256, format, block, block_id, content, truncated) of files (path, content) of the five formats.

    A document that holds nothing gives one block, its title. Files that can't be read, and those of other formats, give none:
    ``block_errors`` lists them.
    """
    # Files may be costly to make and blocks to parse, and both are used more than once below.
    made = written(files.select("path", "content", parser_of().alias("format")).filter(F.col("format").isin(*READERS)), "files")
    there = {r["format"] for r in made.select("format").distinct().collect()}
    out = None
    for fmt, read in READERS.items():
        if fmt in there or not there:
            found = read(made.filter(F.col("format") == fmt).drop("format"))
            out = found if out is None else out.unionByName(found)
    out = written(out, "blocks")
    title = {"xlsx": _content("sheet", name=F.lit("Sheet"), rows=F.array(F.array(F.lit(""))), header_rows=F.lit(0)), "pptx": _content("slide", text=F.lit("Presentation"))}
    title |= {"docx": _content("heading", level=F.lit(1), text=F.lit("Document")), "pdf": _content("heading", level=F.lit(1), text=clipped(_stem(), 512))}
    default = F.lit(None).cast(BLOCK)
    for fmt, content in title.items():
        default = F.when(F.col("format") == fmt, content).otherwise(default)
    # Only what gave no blocks is read again, to tell what holds nothing from what can't be read.
    empty = _readable(made.join(out.select("path").distinct(), "path", "left_anti")).withColumn("content", default).filter("content is not null")
    letter = F.create_map(*(F.lit(x) for kv in LETTERS.items() for x in kv))[F.col("content.kind")]
    alone = empty.select(*_KEY, "format", F.lit(1).alias("block"), F.concat(letter, F.lit("1")).alias("block_id"), "content", F.lit(False).alias("truncated"))
    return out.unionByName(alone)


def _errors(files: DataFrame) -> DataFrame:
    """(path, source_sha256, format, error) of files (path, content, format), null where the file was read; nothing where it holds nothing."""
    readers = {"csv": tabular.csv_rows, "xlsx": ooxml.workbook_cells, "docx": ooxml.docx_paragraphs, "pptx": ooxml.slide_shapes, "pdf": pdf.pdf_pages}
    out = None
    for fmt, read in readers.items():
        rows = read(files.filter(F.col("format") == fmt)).select(*_KEY, F.lit(fmt).alias("format"), "error").distinct()
        out = rows if out is None else out.unionByName(rows)
    return out


def _readable(files: DataFrame) -> DataFrame:
    bad = _errors(files).filter("error is not null and error <> 'CSV_EMPTY'").select("path")
    known = files.filter(F.col("format").isin(*READERS))
    return known.select("path", F.sha2("content", 256).alias("source_sha256"), "format").join(bad, "path", "left_anti")


def block_errors(files: DataFrame) -> DataFrame:
    """(path, error) of the files that give no blocks: what their reader found, or that their format isn't one of the five."""
    joined = files.select("path", "content", parser_of().alias("format"))
    bad = _errors(joined).filter("error is not null and error <> 'CSV_EMPTY'").select("path", "error")
    other = joined.filter(~F.coalesce(F.col("format").isin(*READERS), F.lit(False))).select("path", F.lit("FORMAT_NOT_SUPPORTED").alias("error"))
    return bad.unionByName(other)
