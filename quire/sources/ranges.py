"""Bounded ranges of CSV, XLSX, DOCX, PPTX and PDF sources, that a reader asks for one after another.

A range is asked for by (source_sha256, start, ...) and answered by the units in it and one row of
the relation that ``quire.operators.projections`` judges: (source_sha256, kind, start, end, returned,
next_start, known_total, disposition, omitted). A range is a filter on an ordinal, never a limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.projections import FIRST, WIDEST

#: The columns of a worksheet that a range returns.
MAX_SHEET_COLUMNS = 32


def _check(kind: str, start: int, size: int) -> None:
    if not 1 <= size <= WIDEST[kind]:
        raise ValueError(f"a range of {kind} has 1 to {WIDEST[kind]} units")
    if start < FIRST[kind]:
        raise ValueError("RANGE_INVALID")


def units_in(units: DataFrame, ordinal: str, start: int, size: int) -> DataFrame:
    """The units with start <= ordinal < start + size."""
    return units.filter((F.col(ordinal) >= start) & (F.col(ordinal) < start + size))


def answered(units: DataFrame, kind: str, ordinal: str, start: int, size: int, omitted: Column | None = None) -> DataFrame:
    """One row for each source (source_sha256) of ``units``: what a range of it returns, and where to go on.

    A source has as many units as distinct ordinals. With content left out (``omitted``, an array of names) coverage isn't known.
    """
    _check(kind, start, size)
    inside = (F.col(ordinal) >= start) & (F.col(ordinal) < start + size)
    lacking = F.array().cast("array<string>") if omitted is None else omitted
    per = units.withColumn("__omitted", lacking).groupBy("source_sha256").agg(
        F.count_distinct(ordinal).alias("total"),
        F.count_distinct(F.when(inside, F.col(ordinal))).alias("returned"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("__omitted")))).alias("omitted"),
    )
    end = F.least(F.lit(start + size), F.col("total") + FIRST[kind])
    end = F.greatest(end, F.lit(start))
    more = end < F.col("total") + FIRST[kind]
    disposition = F.when(F.size("omitted") > 0, "partial_unknown").when(more, "partial_known").otherwise("complete")
    if kind == "docx":  # blocks are read from the start on, so how many follow isn't known before the last
        disposition = F.when((F.size("omitted") > 0) | more, "partial_unknown").otherwise("complete")
    total = F.when(~more, F.col("total")) if kind == "docx" else F.col("total")
    return per.select(
        "source_sha256", F.lit(kind).alias("kind"), F.lit(start).cast("long").alias("start"), end.cast("long").alias("end"), "returned",
        F.when(more, end).cast("long").alias("next_start"), total.alias("known_total"), disposition.alias("disposition"), "omitted",
    )


def csv_range(rows: DataFrame, start: int = 0, size: int = 500) -> tuple[DataFrame, DataFrame]:
    """(units, range) of the rows below the header of CSV sources; cells beyond the widest row are an omission."""
    data = rows.filter("error is null and row_index >= 0")
    cut = F.when(F.col("clipped"), F.array(F.lit("columns_beyond_limit"))).otherwise(F.array().cast("array<string>"))
    return units_in(data, "row_index", start, size), answered(data, "csv", "row_index", start, size, cut)


def pdf_range(pages: DataFrame, start: int = 1, size: int = 50) -> tuple[DataFrame, DataFrame]:
    """(units, range) of pages; a page that needs OCR is an omission."""
    data = pages.filter("error is null")
    cut = F.when(F.col("ocr_required"), F.array(F.lit("image_only_pages"))).otherwise(F.array().cast("array<string>"))
    return units_in(data, "page", start, size), answered(data, "pdf", "page", start, size, cut)


def pptx_range(shapes: DataFrame, start: int = 1, size: int = 50) -> tuple[DataFrame, DataFrame]:
    """(units, range) of slides with their shapes; pictures are an omission."""
    data = shapes.filter("error is null")
    cut = F.when(F.col("kind") == "image", F.array(F.lit("images"))).otherwise(F.array().cast("array<string>"))
    return units_in(data, "slide", start, size), answered(data, "pptx", "slide", start, size, cut)


def docx_range(blocks: DataFrame, stories: DataFrame | None = None, start: int = 1, size: int = 200) -> tuple[DataFrame, DataFrame]:
    """(units, range) of a DOCX's blocks; text outside the body (``stories``: source_sha256, part) is an omission."""
    units, found = units_in(blocks, "block", start, size), answered(blocks, "docx", "block", start, size)
    if stories is None:
        return units, found
    names = F.regexp_extract("part", r"word/([a-z]+)", 1)
    other = stories.filter("error is null").groupBy("source_sha256").agg(F.array_sort(F.collect_set(names)).alias("__parts"))
    found = found.join(other, "source_sha256", "left").withColumn("omitted", F.coalesce("__parts", "omitted")).drop("__parts")
    return units, found.withColumn("disposition", F.when(F.size("omitted") > 0, "partial_unknown").otherwise(F.col("disposition")))


def xlsx_range(cells: DataFrame, sheet: int = 0, start: int = 1, size: int = 500, version: str = "2") -> tuple[DataFrame, DataFrame]:
    """(rows, range) of one worksheet: rows (source_sha256, sheet_ix, row, values, formulas), padded to the sheet's width.

    The range has besides what all have next_sheet, sheet_name and sheet_rows; after a sheet's last row the next sheet follows from row 1.
    Version 2 returns rows without cells too, and whether the sheet is visible.
    """
    _check("xlsx", start, size)
    if version not in ("1", "2"):
        raise ValueError("UNSUPPORTED_CONTRACT")
    good = cells.filter("error is null")
    sheets = good.groupBy("source_sha256", "sheet_ix", "sheet", "visible").agg(F.max("row").alias("sheet_rows"), F.max("col").alias("width"))
    counts = sheets.groupBy("source_sha256").agg((F.max("sheet_ix") + 1).alias("n_sheets"))
    mine = sheets.filter(F.col("sheet_ix") == sheet).join(counts, "source_sha256")
    width = F.least("width", F.lit(MAX_SHEET_COLUMNS))
    end = F.greatest(F.least(F.lit(start + size), F.col("sheet_rows") + 1), F.lit(start))
    more, later = end <= F.col("sheet_rows"), F.lit(sheet + 1) < F.col("n_sheets")
    omitted = F.when(F.col("width") > MAX_SHEET_COLUMNS, F.array(F.lit("columns_beyond_limit"))).otherwise(F.array().cast("array<string>"))
    found = mine.select(
        "source_sha256", F.lit("xlsx").alias("kind"), F.lit(start).cast("long").alias("start"), end.cast("long").alias("end"),
        (end - start).cast("long").alias("returned"), F.when(more, end).when(later, 1).cast("long").alias("next_start"),
        F.when(more, F.lit(sheet)).when(later, F.lit(sheet + 1)).alias("next_sheet"), F.col("sheet").alias("sheet_name"),
        F.when(F.lit(version == "2"), F.col("visible")).alias("visible"), F.col("sheet_rows").cast("long").alias("known_total"), omitted.alias("omitted"),
        F.when(F.size(omitted) > 0, "partial_unknown").when(more | later, "partial_known").otherwise("complete").alias("disposition"),
    )
    inside = good.filter((F.col("sheet_ix") == sheet) & (F.col("col") <= MAX_SHEET_COLUMNS))
    lines = units_in(inside, "row", start, size).groupBy("source_sha256", "row").agg(
        F.map_from_entries(F.collect_list(F.struct("col", F.coalesce("value", "formula")))).alias("by_col"),
        F.array_sort(F.collect_list(F.when(F.col("formula").isNotNull(), F.struct("col", "formula", "value")))).alias("formulas"),
    )
    every = mine.select("source_sha256", "sheet_ix", width.alias("width"), F.explode(F.when(end > start, F.sequence(F.lit(start), end - 1))).alias("row"))
    joined = every.join(lines, ["source_sha256", "row"], "left" if version == "2" else "inner")
    values = F.transform(F.sequence(F.lit(1), F.col("width")), lambda c: F.try_element_at("by_col", c))
    nothing = F.array().cast("array<struct<col:int,formula:string,value:string>>")
    return joined.select("source_sha256", "sheet_ix", "row", values.alias("values"), F.coalesce("formulas", nothing).alias("formulas")), found
