"""Profiles of templates: where each wanted section stands, where it ends, and the first table in it.

A template is its body's units (doc, idx, kind, style, text, n_rows, n_cols), paragraphs and tables in order. A section runs from its
heading to the next paragraph with a heading style and a text. Both that paragraph and the next table are looked ahead for in one
window over a document, so sections meet tables without a join of ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import normalize_heading, strip

#: The wanted sections become part of the plan, so their number is bounded.
MAX_SECTIONS = 1000


def discovered_headings(units: DataFrame, heading_styles: list[str]) -> DataFrame:
    """(doc, idx, style, text) of the paragraphs with a heading style and a text."""
    text = strip(F.coalesce("text", F.lit("")))
    rows = units.filter(F.col("kind") == "paragraph").select("doc", "idx", "style", text.alias("text"))
    return rows.filter(F.col("style").isin(*heading_styles) & (F.col("text") != ""))


def _specs(sections: DataFrame) -> list:
    found = sections.select("ord", "section", "heading", "mode").orderBy("ord").limit(MAX_SECTIONS + 1).collect()
    if len(found) > MAX_SECTIONS:
        raise ValueError(f"more than {MAX_SECTIONS} sections")
    return found


def template_profile(units: DataFrame, sections: DataFrame, heading_styles: list[str]) -> DataFrame:
    """A row for each document and wanted section (ord, section, heading, mode): found or not.

    (doc, ord, section, heading, mode, found, match, heading_style, para_start, para_end, has_table, table_rows, table_cols). A
    heading matches the first paragraph that equals it when both are normalised (``exact``), else the first that holds
    it (``contains``). ``para_end`` is null where the section runs to the end. No sections give no rows; a document without paragraphs
    has all of its sections missing. More than ``MAX_SECTIONS`` sections are refused.
    """
    specs = _specs(sections)
    spec = "struct<ord:int,section:string,heading:string,mode:string,want:string>"
    wanted = F.array(
        *(F.struct(F.lit(s.ord).cast("int").alias("ord"), F.lit(s.section).cast("string").alias("section"), F.lit(s.heading).cast("string").alias("heading"),
                   F.lit(s.mode).cast("string").alias("mode"), F.coalesce(normalize_heading(F.lit(s.heading).cast("string")), F.lit("")).alias("want")) for s in specs)
    ).cast(f"array<{spec}>")
    paragraph, text = F.col("kind") == "paragraph", strip(F.coalesce("text", F.lit("")))
    # From the end on: a frame that ends with the partition is added up again for every row.
    behind = W.partitionBy("doc").orderBy(F.desc("idx")).rowsBetween(W.unboundedPreceding, -1)
    heading = paragraph & F.col("style").isin(*heading_styles) & (text != "")
    table = F.when(F.col("kind") == "table", F.struct("idx", "n_rows", "n_cols"))
    looked = units.select(
        "doc", "idx", "kind", "style", text.alias("text"),
        F.last(F.when(heading, F.col("idx")), ignorenulls=True).over(behind).alias("para_end"), F.last(table, ignorenulls=True).over(behind).alias("t"),
    ).withColumn("norm", normalize_heading(F.col("text")))
    equal = lambda s: F.col("norm") == s["want"]
    held = lambda s: (F.col("text") != "") & (s["want"] != "") & F.contains(F.col("norm"), s["want"])
    # A paragraph that matches nothing sends no row.
    hits = looked.filter("kind = 'paragraph'").select("*", F.explode(F.filter(wanted, lambda s: equal(s) | held(s))).alias("s"))
    mine = F.col("norm") == F.col("s.want")
    best = hits.groupBy("doc", "s.ord").agg(
        F.min_by(F.struct(mine.alias("exact"), "idx", "style", "para_end", "t"), F.struct((~mine).alias("inexact"), "idx")).alias("b")
    )
    every = units.select("doc").distinct().select("doc", F.explode(wanted).alias("s")).select("doc", "s.ord", "s.section", "s.heading", "s.mode")
    out = every.join(best, ["doc", "ord"], "left")
    inside = F.col("b.t.idx").isNotNull() & (F.col("b.para_end").isNull() | (F.col("b.t.idx") < F.col("b.para_end")))
    return out.select(
        "doc", "ord", "section", "heading", "mode", F.col("b").isNotNull().alias("found"),
        F.when(F.col("b.exact"), "exact").when(~F.col("b.exact"), "contains").otherwise("").alias("match"), F.coalesce("b.style", F.lit("")).alias("heading_style"),
        F.col("b.idx").alias("para_start"), F.col("b.para_end").alias("para_end"), F.coalesce(inside, F.lit(False)).alias("has_table"),
        F.when(inside, F.col("b.t.n_rows")).alias("table_rows"), F.when(inside, F.col("b.t.n_cols")).alias("table_cols"),
    )


def template_summary(units: DataFrame, profile: DataFrame) -> DataFrame:
    """(doc, paragraph_count, table_count, missing): ``missing`` are the sections that weren't found, in order."""
    counts = units.groupBy("doc").agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(f"{k}_count") for k in ("paragraph", "table")))
    lacking = profile.filter("not found").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("ord", "section"))).alias("m"))
    names = F.coalesce(F.transform("m", lambda m: m["section"]), F.array().cast("array<string>"))
    return counts.join(lacking, "doc", "left").select("doc", "paragraph_count", "table_count", names.alias("missing"))
