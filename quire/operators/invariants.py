"""Invariants of DOCX structure over the relations that the readers give: one row each, passed or not.

``marks`` (doc, seq, kind, name) and ``paragraphs`` (doc, idx, style, level, text) come from
``quire.sources.ooxml``; a document that can't be read skips all but the first invariant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import normalize_heading, strip

#: Paragraphs looked through below a heading of contents.
TOC_SPAN = 15
# Headings of contents, how a line of contents typed by hand ends, and texts that show a broken reference.
TOC_HEADINGS = ("目錄", "目录", "table of contents", "contents", "目 錄")
TOC_LINE = r"(\.{3,}\s*\d+\s*$)|(\t\s*\d+\s*$)|(\s\d{1,4}\s*$)"
ERROR_TEXTS = ("Error! Reference source not found", "錯誤! 找不到參照來源", "找不到參照來源", "找不到參考來源")


def _row(df: DataFrame, code: str, ok: Column, status: str = "checked") -> DataFrame:
    return df.select("doc", F.lit(code).alias("id"), ok.alias("passed"), F.lit(status).alias("status"))


def readable(documents: DataFrame) -> DataFrame:
    """(doc, error): whether each file could be read."""
    return _row(documents, "valid_docx", F.col("error").isNull())


def references_hold(documents: DataFrame, marks: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Every referenced bookmark is there, and no text says that one isn't."""
    named = lambda kind: marks.filter(F.col("kind") == kind).select("doc", F.col("name").alias("ref"))
    broken = named("reference").join(named("bookmark"), ["doc", "ref"], "left_anti").select("doc")
    said = F.exists(F.array(*(F.lit(t) for t in ERROR_TEXTS)), lambda t: F.contains("text", t))
    bad = broken.unionByName(paragraphs.filter(said).select("doc")).distinct().withColumn("bad", F.lit(True))
    return _row(documents.join(bad, "doc", "left"), "cross_references", F.col("bad").isNull())


def toc_is_field(documents: DataFrame, marks: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """A table of contents is a field: lines that end in page numbers below the first heading of contents are typed by hand."""
    fields = marks.filter("kind = 'toc'").select("doc").distinct().withColumn("field", F.lit(True))
    nth = paragraphs.withColumn("__at", F.row_number().over(W.partitionBy("doc").orderBy("idx")))
    heading = F.lower(strip(F.col("text"))).isin(*TOC_HEADINGS)
    first = F.min(F.when(heading, F.col("__at"))).over(W.partitionBy("doc"))
    typed = (strip(F.col("text")) != "") & F.col("text").rlike(TOC_LINE)
    below = nth.withColumn("__first", first).filter(typed & (F.col("__at") - F.col("__first")).between(1, TOC_SPAN))
    hand = below.select("doc").distinct().withColumn("hand", F.lit(True))
    joined = documents.join(fields, "doc", "left").join(hand, "doc", "left")
    return _row(joined, "toc_is_field", F.col("hand").isNull() | F.col("field").isNotNull())


def blank_pages(units: DataFrame) -> DataFrame:
    """(doc, pages, blank): pages that explicit breaks part, and how many hold nothing.

    ``units`` is (doc, idx, breaks, filled, section) from ``quire.sources.ooxml``: each paragraph and
    table of a body with the page breaks in it, whether it holds something, and whether a section ends with it.
    The empty page that the body's last section opens isn't counted.
    """
    upto = W.partitionBy("doc").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    after = F.col("breaks") + F.col("section").cast("int")
    # A paragraph's content stands after its own breaks; the section that it ends opens the page after it.
    rows = units.withColumn("page", F.sum(after).over(upto) - F.col("section").cast("int"))
    last = rows.groupBy("doc").agg(F.sum(after).alias("opened"))
    filled = rows.filter("filled").select("doc", "page").distinct().groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.max("page").alias("top"))
    joined = last.join(filled, "doc", "left")
    # One empty page at the very end is dropped where there are others.
    spare = (F.col("opened") > 0) & (F.coalesce("top", F.lit(-1)) < F.col("opened"))
    pages = F.col("opened") + 1 - spare.cast("int")
    return joined.select("doc", pages.alias("pages"), (pages - F.coalesce("n", F.lit(0))).alias("blank"))


def no_blank_pages(documents: DataFrame, units: DataFrame) -> DataFrame:
    counted = documents.join(blank_pages(units), "doc", "left")
    return _row(counted, "no_blank_pages", F.coalesce("blank", F.lit(0)) == 0)


def no_orphan_section(documents: DataFrame, marks: DataFrame, reference: DataFrame | None) -> DataFrame:
    """As many sections as in the reference (doc, n); skipped without one."""
    if reference is None:
        return _skipped(documents, "no_orphan_section_break")
    return counts_kept(documents, marks, reference, "section", "no_orphan_section_break")


def image_removal_left_nothing(documents: DataFrame, marks: DataFrame, units: DataFrame, reference: DataFrame | None) -> DataFrame:
    """Fewer images than in the reference (doc, images, blank) don't leave more blank pages; skipped without one."""
    if reference is None:
        return _skipped(documents, "image_removal_no_residue")
    n = marks.filter("kind = 'image'").groupBy("doc").agg(F.count(F.lit(1)).alias("have"))
    joined = documents.join(n, "doc", "left").join(blank_pages(units).select("doc", F.col("blank").alias("have_blank")), "doc", "left")
    joined = joined.join(reference.select("doc", "images", "blank"), "doc", "left")
    residue = (F.coalesce("have", F.lit(0)) < F.col("images")) & (F.coalesce("have_blank", F.lit(0)) > F.col("blank"))
    return _row(joined, "image_removal_no_residue", ~F.coalesce(residue, F.lit(False)))


def evidence_rendered(documents: DataFrame, index: DataFrame | None) -> DataFrame:
    """Every item of the evidence index (doc, render, path) that is to be rendered has a path; skipped without an index."""
    if index is None:
        return _skipped(documents, "evidence_render_complete")
    empty = index.filter(F.col("render") & (strip(F.coalesce("path", F.lit(""))) == "")).select("doc").distinct().withColumn("bad", F.lit(True))
    return _row(documents.join(empty, "doc", "left"), "evidence_render_complete", F.col("bad").isNull())


def heading_pagination(documents: DataFrame, paragraphs: DataFrame, expected: DataFrame | None) -> DataFrame:
    """Headings break pages as expected (doc, style, heading, page_break); skipped without a policy.

    ``paragraphs`` has page_break_before; of headings that repeat under a style the last counts.
    """
    if expected is None:
        return _skipped(documents, "heading_pagination_matches_policy")
    off = heading_mismatches(paragraphs, expected).select("doc").distinct().withColumn("bad", F.lit(True))
    return _row(documents.join(off, "doc", "left"), "heading_pagination_matches_policy", F.col("bad").isNull())


def heading_breaks(paragraphs: DataFrame) -> DataFrame:
    """(doc, style, heading, page_break): the break of each normalised heading, the last of equals."""
    some = paragraphs.filter(strip(F.col("text")) != "")
    key = ["doc", "style", normalize_heading(F.col("text")).alias("heading")]
    return some.groupBy(*key).agg(F.max_by(F.coalesce("page_break_before", F.lit(False)), "idx").alias("page_break"))


def heading_mismatches(paragraphs: DataFrame, expected: DataFrame) -> DataFrame:
    """(doc, style, heading, expected, actual) where the break isn't the expected one; a missing heading has no actual."""
    actual = heading_breaks(paragraphs).withColumnRenamed("page_break", "actual")
    joined = expected.withColumnRenamed("page_break", "expected").join(actual, ["doc", "style", "heading"], "left")
    return joined.filter(~F.col("expected").eqNullSafe(F.col("actual"))).select("doc", "style", "heading", "expected", "actual")


def counts_kept(documents: DataFrame, marks: DataFrame, reference: DataFrame, kind: str, code: str) -> DataFrame:
    """As many marks of a kind as in the reference (doc, n)."""
    n = marks.filter(F.col("kind") == kind).groupBy("doc").agg(F.count(F.lit(1)).alias("have"))
    joined = documents.join(n, "doc", "left").join(reference, "doc", "left")
    return _row(joined, code, F.col("n").isNull() | (F.coalesce("have", F.lit(0)) == F.col("n")))


def _skipped(documents: DataFrame, code: str) -> DataFrame:
    return _row(documents, code, F.lit(None).cast("boolean"), "skipped")


def skipped(documents: DataFrame, codes: list[str]) -> DataFrame:
    """All invariants of documents that can't be read."""
    code = F.explode(F.array(*(F.lit(c) for c in codes))).alias("id")
    none = F.lit(None).cast("boolean")
    return documents.filter("error is not null").select("doc", code).select("doc", "id", none.alias("passed"), F.lit("skipped").alias("status"))


def structure_report(
    documents: DataFrame,
    marks: DataFrame,
    paragraphs: DataFrame,
    units: DataFrame | None = None,
    sections: DataFrame | None = None,
    images: DataFrame | None = None,
    expected: DataFrame | None = None,
    evidence: DataFrame | None = None,
) -> DataFrame:
    """(doc, id, passed, status) of all invariants; a document that can't be read skips all but the first.

    ``units`` (see ``blank_pages``), the references ``sections`` (doc, n) and ``images`` (doc, images, blank), the
    ``expected`` breaks of headings and the ``evidence`` index may be missing: their invariants are then skipped.
    """
    good = documents.filter("error is null")
    rows = [references_hold(good, marks, paragraphs), toc_is_field(good, marks, paragraphs), no_orphan_section(good, marks, sections)]
    rows.append(heading_pagination(good, paragraphs, expected))
    rows.append(evidence_rendered(good, evidence))
    if units is None:
        rows += [_skipped(good, "no_blank_pages"), _skipped(good, "image_removal_no_residue")]
    else:
        rows += [no_blank_pages(good, units), image_removal_left_nothing(good, marks, units, images)]
    out = readable(documents)
    for r in rows:
        out = out.unionByName(r)
    return out.unionByName(skipped(documents, INVARIANTS))


#: The invariants that need a readable document, by id.
INVARIANTS = [
    "cross_references", "toc_is_field", "no_orphan_section_break", "heading_pagination_matches_policy", "evidence_render_complete",
    "no_blank_pages", "image_removal_no_residue",
]


def health(report: DataFrame, severity: dict[str, str], fail_on: str = "low") -> DataFrame:
    """(doc, n_failed, worst, passed) of a structure report, by the severity of each invariant's id ("medium" if not given)."""
    from quire.operators.audits import severity_rollup

    level = F.create_map(*(F.lit(x) for kv in severity.items() for x in kv)) if severity else F.create_map().cast("map<string,string>")
    failed = report.filter("passed = false").select("doc", F.coalesce(F.try_element_at(level, F.col("id")), F.lit("medium")).alias("severity"))
    rolled = severity_rollup(failed, report.select("doc").distinct(), fail_on)
    return rolled.withColumnRenamed("n_findings", "n_failed")


def pagination(paragraphs: DataFrame, styles: list[str], first_without_break: bool = True) -> DataFrame:
    """(doc, idx, expected, actual): headings whose page break isn't as the policy wants it.

    ``paragraphs`` has page_break_before BOOLEAN; every heading of the styles breaks but, if so
    asked, the first.
    """
    heads = paragraphs.filter(F.col("style").isin(styles) & (F.trim("text") != ""))
    nth = F.row_number().over(W.partitionBy("doc").orderBy("idx"))
    expected = F.when((nth == 1) & F.lit(first_without_break), False).otherwise(True)
    rows = heads.select("doc", "idx", expected.alias("expected"), F.coalesce("page_break_before", F.lit(False)).alias("actual"))
    return rows.filter("expected <> actual")
