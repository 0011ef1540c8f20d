"""End-to-end audits of files and their reports as lines of text: what a command line would print, one row a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators import audits, clauses, invariants
from quire.sources import ooxml, pages, pdf

#: Characters of a clause that a report shows.
CLIP = 100


def _body(files: DataFrame) -> DataFrame:
    return ooxml.docx_paragraphs(files).withColumnRenamed("path", "doc")


def docx_cells(body: DataFrame) -> DataFrame:
    """(doc, table_ix, row_ix, col_ix, value) of the tables of DOCX bodies."""
    nth = F.row_number().over(W.partitionBy("doc").orderBy("idx")) - 1
    tables = body.filter("error is null and kind = 'table'").withColumn("table_ix", nth).select("doc", "table_ix", F.posexplode("rows").alias("row_ix", "row"))
    return tables.select("doc", "table_ix", "row_ix", F.posexplode("row").alias("col_ix", "value"))


def table_text(rows: Column) -> Column:
    """Rows of cells as text: cells parted by bars, blank lines of a cell left out, rows by line ends."""
    cell = lambda c: F.concat_ws(" ", F.filter(F.split(c, "\n"), lambda s: F.trim(s) != ""))
    return F.concat_ws("\n", F.transform(rows, lambda r: F.concat_ws(" | ", F.transform(r, cell))))


def number_audit(files: DataFrame, fail_on: str = "low") -> tuple[DataFrame, DataFrame]:
    """(findings, verdicts) of the numbers, amounts and dates in DOCX files (path, content)."""
    body = _body(files)
    texts = body.filter("error is null and kind = 'paragraph'").select("doc", "idx", "text")
    found = audits.number_findings(docx_cells(body), texts)
    return found, audits.severity_rollup(found, body.select("doc").distinct(), fail_on)


def structure_health(files: DataFrame, severity: dict[str, str] | None = None, fail_on: str = "low", **references) -> tuple[DataFrame, DataFrame]:
    """(report, verdicts) of the structure of DOCX files; ``references`` go to ``structure_report``."""
    rows = _body(files)
    documents = rows.groupBy("doc").agg(F.max("error").alias("error"))
    marks = ooxml.docx_structure(files).filter("error is null").withColumnRenamed("path", "doc").select("doc", "kind", "name")
    units = ooxml.docx_pages(files).filter("error is null").withColumnRenamed("path", "doc").select("doc", "idx", "breaks", "filled", "section")
    texts = rows.filter("kind = 'paragraph'").select("doc", "idx", "style", "text").withColumn("page_break_before", F.lit(None).cast("boolean"))
    report = invariants.structure_report(documents, marks, texts, units, **references)
    return report, invariants.health(report, severity or {"valid_docx": "high"}, fail_on)


def pdf_extract(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, errors) of PDF files: page texts within the budgets of ``clipped_pages``, and the files that can't be read."""
    rows = pdf.pdf_pages(files)
    good = rows.filter("error is null").select(F.regexp_extract("path", r"([^/\\]*)$", 1).alias("file"), "page", "text")
    return pages.clipped_pages(good), rows.filter("error is not null").select("path", "error")


def clipped(text: Column) -> Column:
    return F.when(F.length(text) > CLIP, F.concat(F.substring(text, 1, CLIP), F.lit("…"))).otherwise(text)


def clause_lines(paragraphs: DataFrame) -> DataFrame:
    """(clause, n, line): clauses of the documents of ``paragraphs`` (doc, idx, text) over which they aren't the same.

    A line for the clause with its status, then one for each document that has it, its text clipped. A clause's lines
    are as many as documents, so the documents are the few versions of one text.
    """
    found = clauses.clauses(paragraphs)
    aligned = clauses.align_clauses(found, paragraphs.select("doc").distinct()).filter("status <> 'same'")
    texts = F.array_sort(F.collect_list(F.struct(F.col("doc").cast("string").alias("doc"), clipped(F.regexp_replace("text", r"\s+", " ")).alias("text"))))
    own = found.join(aligned.select("clause", "status"), "clause").groupBy("clause", "status").agg(texts.alias("texts"))
    head = F.concat(F.lit("["), F.col("status"), F.lit("] "), F.col("clause"))
    lines = F.concat(F.array(head), F.transform("texts", lambda t: F.concat(F.lit("  "), t["doc"], F.lit(": "), t["text"])))
    return own.select("clause", F.posexplode(lines).alias("n", "line"))


def version_lines(pairs: DataFrame) -> DataFrame:
    """(pair_id, at, n, line): the changes of pairs (pair_id, old, new) as lines that go out and come in."""
    changes = clauses.version_changes(pairs)
    some = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda s: F.regexp_replace(s, r"(?U)\s+", "") != "")
    texts = pairs.select("pair_id", some("old").alias("old"), some("new").alias("new"))
    joined = changes.join(texts, "pair_id")
    part = lambda c: F.slice(c, F.col(f"{c}_from") + 1, F.col(f"{c}_to") - F.col(f"{c}_from"))
    out = F.transform(part("old"), lambda s: F.concat(F.lit("- "), s))
    into = F.transform(part("new"), lambda s: F.concat(F.lit("+ "), s))
    return joined.select("pair_id", F.col("old_from").alias("at"), "new_from", F.posexplode(F.concat(out, into)).alias("n", "line")).drop("new_from")


def finding_lines(findings: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """(doc, line): findings (doc, check, severity, loc) as lines, by their messages (check, message) where there are any."""
    rows = findings if messages is None else findings.join(messages, "check", "left")
    text = F.col("check") if messages is None else F.coalesce("message", "check")
    return rows.select("doc", F.concat(F.lit("["), F.col("severity"), F.lit("] "), F.col("loc"), F.lit(": "), text).alias("line"))


def gate(verdicts: DataFrame) -> DataFrame:
    """One row (n_documents, n_failed, passed): whether all documents pass; none at all pass."""
    return verdicts.agg(
        F.count(F.lit(1)).alias("n_documents"), F.count(F.when(~F.col("passed"), 1)).alias("n_failed"),
        F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"),
    )


def source_map(hits: DataFrame) -> DataFrame:
    """(section_id, json): the ranked hits of each section as one JSON array."""
    one = F.struct("file", "page", "score", "snippet")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", one.alias("h")))), lambda x: x["h"])
    return hits.groupBy("section_id").agg(F.to_json(listed).alias("json"))
