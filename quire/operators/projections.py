"""Rules of continued reading: ranges of a source, their cursors, and what they say about coverage.

A range is a row (source_sha256, kind, start, end, returned, next_start, known_total, disposition).
Ordinals are counted from 0 for rows and tiles and from 1 for pages, slides, blocks and sheet rows;
``end`` is exclusive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The first ordinal and the widest range of each kind.
FIRST = {"csv": 0, "image": 0, "pdf": 1, "xlsx": 1, "pptx": 1, "docx": 1}
WIDEST = {"csv": 500, "image": 16, "pdf": 50, "xlsx": 500, "pptx": 50, "docx": 200}


def _lookup(values: dict):
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), F.col("kind"))


def range_violations(ranges: DataFrame) -> DataFrame:
    """(source_sha256, kind, start, code): every rule that a range breaks by itself."""
    first, widest = _lookup(FIRST), _lookup(WIDEST)
    last = F.col("next_start").isNull()
    whole = F.col("known_total") + first
    wrong = lambda cond, code: F.when(F.coalesce(cond, F.lit(False)), F.lit(code))
    partial = F.when(F.col("kind") == "docx", "partial_unknown").otherwise("partial_known")
    codes = F.array_compact(
        F.array(
            wrong(first.isNull(), "UNKNOWN_KIND"),
            wrong((F.col("start") < first) | (F.col("end") < F.col("start")), "RANGE_INVALID"),
            wrong(F.col("end") - F.col("start") > widest, "RANGE_TOO_WIDE"),
            wrong(F.col("returned") != F.col("end") - F.col("start"), "COUNT_MISMATCH"),
            wrong(~last & (F.col("next_start") != F.col("end")), "CURSOR_NOT_AT_END"),
            wrong(F.col("end") > whole, "BEYOND_TOTAL"),
            wrong(~last & (F.col("end") >= whole), "CURSOR_AFTER_LAST"),
            wrong(last & (F.col("end") != whole), "CURSOR_MISSING"),
            wrong(~last & (F.col("disposition") != partial), "DISPOSITION_MISMATCH"),
            wrong(last & ~F.col("disposition").isin("complete", "partial_unknown"), "DISPOSITION_MISMATCH"),
            wrong(~last & (F.col("kind") == "docx") & F.col("known_total").isNotNull(), "TOTAL_NOT_KNOWN_YET"),
        )
    )
    return ranges.select("source_sha256", "kind", "start", F.explode(codes).alias("code"))


# How visible a worksheet may be.
VISIBILITIES = ("visible", "hidden", "veryHidden")


def office_violations(ranges: DataFrame) -> DataFrame:
    """``range_violations`` of version 2 ranges of CSV and XLSX, which have ``visible`` besides: a worksheet's must be told.

    Other kinds have no version 2 (``UNSUPPORTED_CONTRACT``), and nothing else is said of them.
    """
    office = F.coalesce(F.col("kind").isin("csv", "xlsx"), F.lit(False))
    hidden = ~F.coalesce(F.col("visible").isin(*VISIBILITIES), F.lit(False))
    own = F.when(~office, "UNSUPPORTED_CONTRACT").when((F.col("kind") == "xlsx") & hidden, "SHEET_VISIBILITY_REQUIRED")
    told = ranges.withColumn("code", own).filter("code is not null").select("source_sha256", "kind", "start", "code")
    return range_violations(ranges.filter(office)).unionByName(told)


def chain_violations(ranges: DataFrame) -> DataFrame:
    """Ranges of a source that don't follow on from one another: (source_sha256, kind, start, code)."""
    past = W.partitionBy("source_sha256", "kind").orderBy("start")
    rows = ranges.withColumn("__next", F.lag("next_start").over(past)).withColumn("__nth", F.row_number().over(past))
    code = F.when((F.col("__nth") == 1) & (F.col("start") != _lookup(FIRST)), "CHAIN_BEGINS_LATE").when(
        (F.col("__nth") > 1) & ~F.col("start").eqNullSafe(F.col("__next")), "CHAIN_BROKEN"
    )
    return rows.withColumn("code", code).filter("code is not null").select("source_sha256", "kind", "start", "code")


def stale_cursors(cursors: DataFrame, sources: DataFrame) -> DataFrame:
    """Cursors (cursor_id, source_sha256, parser, version) that no source (source_sha256, parser, version) has."""
    return cursors.join(sources, ["source_sha256", "parser", "version"], "left_anti")


def messages(findings: DataFrame, catalog: DataFrame, lang: str, fallback: str = "en") -> DataFrame:
    """Findings (check, params MAP) with their text: templates {name} of (key, lang, template), else the key itself.

    The catalog is a fixed set of messages and is broadcast.
    """
    wanted = catalog.filter(F.col("lang").isin(lang, fallback)).groupBy("key").agg(
        F.max_by("template", F.when(F.col("lang") == lang, 1).otherwise(0)).alias("template")
    )
    joined = findings.join(F.broadcast(wanted), findings["check"] == wanted["key"], "left").drop("key")
    entries = F.map_entries(F.coalesce("params", F.create_map().cast("map<string,string>")))
    text = F.aggregate(
        entries,
        F.coalesce("template", "check"),
        lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))),
    )
    return joined.withColumn("message", text).drop("template")
