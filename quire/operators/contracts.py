"""Checks at the border: what a payload is, what it claims to be, and what a span of a source says."""

from __future__ import annotations

import zipfile
from io import BytesIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from quire.functions.python import iso_instant, strict_json
from quire.functions.text import collapse, plain_float
from quire.sinks.writers import MEDIA

# The marks of archives, and the folder that makes one of a format.
ZIP_MARKS = (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08")
FOLDERS = {"docx": "word/", "xlsx": "xl/", "pptx": "ppt/"}
#: Keys that carry a request and aren't part of what it says.
TRANSPORT = ("payload_base64", "transport", "trace_id")


def media_code(media_type: Column, kind: Column) -> Column:
    """OK where a media type is the one of its format."""
    known = F.create_map(*(F.lit(x) for kv in MEDIA.items() for x in kv))
    return F.when(F.try_element_at(known, kind).eqNullSafe(media_type), "OK").otherwise("MEDIA_TYPE_INVALID")


@F.pandas_udf(BooleanType())
def _has_folder(content: pd.Series, folder: pd.Series) -> pd.Series:
    def one(raw, name):
        try:
            with zipfile.ZipFile(BytesIO(raw)) as z:
                return any(n.startswith(name) for n in z.namelist())
        except (zipfile.BadZipFile, TypeError):
            return False

    return pd.Series([one(r, n) for r, n in zip(content, folder)])


def magic_codes(payloads: DataFrame) -> DataFrame:
    """``payloads`` (content, format) with ``code``: whether the bytes are of the format.

    CSV is text in UTF-8 that begins like neither of the others. Archives alone are opened, by an Arrow function.
    """
    begins = lambda *marks: F.substring("content", 1, 4).isin(*(F.lit(m) for m in marks))
    pdf, archive = F.substring("content", 1, 5) == F.lit(b"%PDF-"), begins(*ZIP_MARKS)
    folder = F.try_element_at(F.create_map(*(F.lit(x) for kv in FOLDERS.items() for x in kv)), F.col("format"))
    text = F.try_validate_utf8(F.col("content").cast("string")).isNotNull()
    inside = _has_folder(F.when(archive & folder.isNotNull(), F.col("content")), folder)
    good = F.when(F.col("format") == "pdf", pdf).when(F.col("format") == "csv", ~pdf & ~archive & text).when(folder.isNotNull(), archive & inside).otherwise(False)
    return payloads.withColumn("code", F.when(F.coalesce(good, F.lit(False)), "OK").otherwise("MAGIC_MISMATCH"))


@F.pandas_udf(StringType())
def strict_error(s: pd.Series) -> pd.Series:
    """Why a JSON text is refused: repeated keys, numbers that aren't finite, or no JSON; null if it is strict."""

    def one(text):
        try:
            strict_json(text)
        except (TypeError, ValueError, RecursionError) as e:
            return str(e) if str(e).startswith("JSON_") else "JSON_INVALID"
        return None

    return s.map(one)


def material(entries: Column) -> Column:
    """A request's entries (MAP) without those that only carry it."""
    return F.map_filter(entries, lambda k, v: ~k.isin(*TRANSPORT))


def utc_timestamp(text: Column) -> Column:
    """The instant of an ISO time that names its zone; null without one."""
    t = iso_instant(text)
    return F.when(t["zoned"], F.timestamp_micros(t["micros"]))


def span_request_errors(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """(span_id, code): spans (span_id, source_sha256, page, start, end, quote) that can't be asked of pages (source_sha256, page, text)."""
    known = pages.select("source_sha256").distinct().withColumn("__source", F.lit(True))
    held = pages.select("source_sha256", "page", F.lit(True).alias("__page"))
    joined = spans.join(known, "source_sha256", "left").join(held, ["source_sha256", "page"], "left")
    twice = F.coalesce(F.col("__n") > 1, F.lit(False))
    counted = spans.groupBy("span_id").agg(F.count(F.lit(1)).alias("__n"))
    code = (
        F.when(twice, "SPAN_ID_NOT_UNIQUE")
        .when(F.col("__source").isNull(), "SOURCE_UNKNOWN")
        .when(F.col("__page").isNull(), "PAGE_UNKNOWN")
        .when((F.col("start") < 0) | (F.col("end") <= F.col("start")), "RANGE_INVALID")
    )
    found = joined.join(counted, "span_id", "left").select("span_id", code.alias("code"))
    return found.filter("code is not null").distinct()


def verify_spans(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """(span_id, status, reason) of spans against the text of their pages.

    A span is (span_id, source_sha256, page, start, end, quote, value, value_type), ends exclusive; a page (source_sha256, page,
    text, ocr_required, truncated). What was read from a page that needs OCR, or in part, is to be reviewed. Texts of pages
    are cut to the span before anything is compared; pages meet spans by an equi-join.
    """
    joined = spans.join(pages.select("source_sha256", "page", "text", "ocr_required", "truncated"), ["source_sha256", "page"], "left")
    there = F.substr("text", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    rows = joined.select(
        "span_id", "start", "end", "quote", "value", "value_type", F.length("text").alias("n"), there.alias("there"),
        (F.coalesce("ocr_required", F.lit(False)) | F.coalesce("truncated", F.lit(False))).alias("unsure"),
    )
    numeric = F.col("value_type").isin("number", "integer")
    read = plain_float(F.replace(F.col("there"), F.lit(","), F.lit("")))
    same = F.when(numeric, F.abs(read - F.col("value").try_cast("double")) <= 1e-9).otherwise(collapse(F.col("there")) == collapse(F.col("value")))
    reason = (
        F.when(F.col("n").isNull() | (F.col("start") < 0) | (F.col("end") > F.col("n")) | (F.col("end") <= F.col("start")), "RANGE_OUT_OF_BOUNDS")
        .when(F.col("there") != F.col("quote"), "QUOTE_MISMATCH")
        .when(numeric & read.isNull(), "VALUE_CONVERSION_FAILED")
        .when(F.col("value").isNotNull() & ~F.coalesce(same, F.lit(False)), "VALUE_MISMATCH")
        .otherwise("SOURCE_SPAN_VERIFIED")
    )
    out = rows.withColumn("reason", reason)
    status = F.when(F.col("reason") != "SOURCE_SPAN_VERIFIED", "fail").when(F.col("unsure"), "review").otherwise("pass")
    return out.select("span_id", status.alias("status"), "reason")


def report_holds(reported: DataFrame, spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows where a report (span_id, status, reason) differs from what is found anew, or lacks a span or has one too many."""
    anew = verify_spans(spans, pages).select("span_id", F.struct("status", "reason").alias("found"))
    joined = reported.select("span_id", F.struct("status", "reason").alias("reported")).join(anew, "span_id", "full_outer")
    return joined.filter(~F.col("reported").eqNullSafe(F.col("found")))


# What the readers and writers can do, by format.
EXTRACTS = {"csv": "rows", "xlsx": "worksheet_rows", "docx": "blocks", "pptx": "slides", "pdf": "pages"}


def capabilities(spark: SparkSession) -> DataFrame:
    """(format, media_type, range_unit, widest_range, writes): the formats that can be read in ranges and written."""
    from quire.operators.projections import WIDEST

    rows = [(f, MEDIA[f], EXTRACTS[f], WIDEST[f], True) for f in EXTRACTS]
    return spark.createDataFrame(rows, "format string, media_type string, range_unit string, widest_range int, writes boolean")


def portable_capabilities(spark: SparkSession) -> DataFrame:
    """(suffix, parser): the portable formats that give text items."""
    from quire.sources.catalog import PORTABLE

    return spark.createDataFrame(sorted(PORTABLE.items()), "suffix string, parser string")


def deliver(outputs: DataFrame, inline_bytes: int = 2 << 20) -> DataFrame:
    """``outputs`` (output_name, media_type, content) as they are handed over: in Base64 up to a bound, else by reference to their digest."""
    fits = F.octet_length("content") <= inline_bytes
    return outputs.select(
        "output_name", "media_type", F.octet_length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("sha256"),
        F.when(fits, "inline").otherwise("sink").alias("delivery"), F.when(fits, F.base64("content")).alias("payload_base64"),
    )
