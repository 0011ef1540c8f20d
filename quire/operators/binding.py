"""Quotes and values bound to spans of a source: replayed by digest, range and exact decimal."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import exact_decimal, sha256


def resolve_quotes(items: DataFrame, citations: DataFrame) -> DataFrame:
    """Replay citations against text items.

    ``items``: source_sha256, parser, locator, text. ``citations``: citation_id, source_sha256,
    parser, locator, quote_start, quote_end (code points, half open), quote_sha256. Every citation
    comes back with its quote or the reason why there is none.
    """
    sources = items.select("source_sha256", "parser").distinct().withColumn("has_source", F.lit(True))
    joined = citations.join(sources, ["source_sha256", "parser"], "left").join(
        items.withColumn("has_item", F.lit(True)), ["source_sha256", "parser", "locator"], "left"
    )
    quote = F.substr("text", F.col("quote_start") + 1, F.col("quote_end") - F.col("quote_start"))
    inside = (F.col("quote_start") >= 0) & (F.col("quote_start") < F.col("quote_end")) & (F.col("quote_end") <= F.length("text"))
    code = (
        F.when(F.col("has_source").isNull(), "STALE_SOURCE")
        .when(F.col("has_item").isNull(), "UNKNOWN_LOCATOR")
        .when(~inside, "INVALID_QUOTE_SPAN")
        .when(sha256(quote) != F.col("quote_sha256"), "QUOTE_DIGEST_MISMATCH")
        .otherwise("RESOLVED")
    )
    return joined.withColumn("code", code).select("citation_id", "code", F.when(F.col("code") == "RESOLVED", quote).alias("quote"))


def bind_spans(pages: DataFrame, checks: DataFrame, scale: int) -> DataFrame:
    """Judge checks against page text.

    ``pages``: source_sha256, page, text, complete. ``checks``: check_id, source_sha256, page,
    quote_start, quote_end, quote, value_start, value_end, value (a decimal of ``scale``).
    Status is pass, fail or review (an incomplete page is never more than review).
    """
    joined = checks.join(pages, ["source_sha256", "page"], "left")
    cut = lambda a, z: F.substr("text", F.col(a) + 1, F.col(z) - F.col(a))
    out_of = lambda a, z: (F.col(a) < 0) | (F.col(a) >= F.col(z)) | (F.col(z) > F.length("text"))
    found = exact_decimal(cut("value_start", "value_end"), scale)
    reason = (
        F.when(F.col("text").isNull(), "SOURCE_UNKNOWN")
        .when(out_of("quote_start", "quote_end") | out_of("value_start", "value_end"), "RANGE_OUT_OF_BOUNDS")
        .when(cut("quote_start", "quote_end") != F.col("quote"), "QUOTE_MISMATCH")
        .when(found.isNull(), "VALUE_CONVERSION_FAILED")
        .when(found != F.col("value"), "VALUE_MISMATCH")
        .otherwise("SOURCE_SPAN_VERIFIED")
    )
    status = F.when(F.col("reason") != "SOURCE_SPAN_VERIFIED", "fail").when(F.col("complete"), "pass").otherwise("review")
    return joined.withColumn("reason", reason).select("check_id", "reason", status.alias("status"))
