"""Pages of text: delimited exports, records of other layouts, and clipping by budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.ordered import running_budget

# Fixed value: the line between pages.
_MARK = r"(?m)^===\s*(.+?)\s*\|\s*Page\s+(\d+)\s*===\s*$"


def delimited_pages(texts: DataFrame) -> DataFrame:
    """(file, page, text, char_count) of texts (text) with lines '=== file | Page n ===' between pages."""
    files = F.regexp_extract_all("text", F.lit(_MARK), F.lit(1))
    numbers = F.regexp_extract_all("text", F.lit(_MARK), F.lit(2))
    bodies = F.slice(F.split("text", _MARK, -1), F.lit(2), F.greatest(F.size(files), F.lit(1)))
    rows = texts.filter(F.col("text").rlike(_MARK)).select(F.explode(F.arrays_zip(files.alias("f"), numbers.alias("n"), bodies.alias("b"))).alias("p"))
    body = F.regexp_replace("p.b", r"^\n+|\n+$", "")
    return rows.select(F.col("p.f").alias("file"), F.col("p.n").cast("int").alias("page"), body.alias("text"), F.length(body).alias("char_count"))


#: Names that layouts give to the columns of a page, most wanted first.
LAYOUTS = {"file": ("file", "Document_ID", "Source_File"), "page": ("page", "Page_Number", "page_number"), "text": ("text", "Extracted_Text", "extracted_text")}


def normalize_pages(records: DataFrame) -> DataFrame:
    """(file, page, text, char_count) of records in any of the known layouts."""
    have = set(records.columns)
    base = lambda c: F.regexp_extract(c, r"([^/\\]*)$", 1) if c == "Source_File" else F.col(c)
    pick = lambda name, default: F.coalesce(*(base(c) for c in LAYOUTS[name] if c in have), F.lit(default))
    text = pick("text", "").cast("string")
    return records.select(pick("file", "").cast("string").alias("file"), pick("page", 0).cast("int").alias("page"), text.alias("text"), F.length(text).alias("char_count"))


def clipped_pages(pages: DataFrame, per_page: int = 50_000, total: int = 500_000, ocr_below: int = 20) -> DataFrame:
    """Page texts within a page's and a file's budget of characters, with truncated and ocr_required flags."""
    size = F.least(F.length("text"), F.lit(per_page)).cast("long")
    rows = running_budget(pages.withColumn("__size", size), ["file"], "page", F.col("__size"), total)
    text = F.substr("text", F.lit(1), F.col("granted").cast("int"))
    return rows.select(
        "file", "page", text.alias("text"), F.col("granted").alias("char_count"), (F.col("granted") < F.length("text")).alias("truncated"),
        (F.length(F.regexp_replace("text", r"(?U)^\s+|\s+$", "")) < ocr_below).alias("ocr_required"),
    )
