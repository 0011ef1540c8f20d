"""Configuration files: mappings of sections, checklists, golden records and exported pages, as relations.

A configuration is one JSON document a file; its readers keep the file's path, so many are read at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import normalize_heading

# What a mapping may say, and its defaults.
TABLE_FILLS, MODES = ("full", "preserve_row_labels"), ("table", "paragraphs")
PAGINATION = ("none", "mapped_sections_only", "all_heading_styles", "break_before_styles")
TABLE_POLICIES = ("fit_to_page", "reuse_template_table_shape_when_possible")
PAGES_SCHEMA = "quire_pages_v1"

_SECTION = "struct<id:string,heading:string,mode:string,detail:string,source_queries:array<string>,table_fill:string>"
_RULES = (
    "struct<heading_styles:array<string>,body_style:string,remove_review_artifacts:array<string>,table_policy:string,"
    "pagination:struct<mode:string,first_no_break:boolean,break_before_styles:array<string>,chapter_break_styles:array<string>>>"
)
_MAPPING = f"template_rules {_RULES}, sections array<{_SECTION}>, front_matter array<struct<field:string,style:string,prefix:string>>"
_CHECKLIST = "placeholders array<string>, sections array<struct<section:string,title:string,keywords:array<string>,required_keywords:array<string>>>"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The fields of one JSON document a file, its path, and ``_bad``, the text of a document that is none."""
    text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    parsed = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return text.select("path", parsed.alias("j")).select("path", "j.*")


def _or(column: str, default) -> Column:
    return F.coalesce(F.col(column), F.lit(default) if not isinstance(default, Column) else default)


def read_mappings(spark: SparkSession, path: str) -> DataFrame:
    """(path, heading_styles, body_style, table_policy, remove_review_artifacts, pagination, sections, front_matter, error) with defaults filled in."""
    none = F.array().cast("array<string>")
    rows = _read(spark, path, _MAPPING)
    p = "template_rules.pagination"
    pagination = F.struct(
        _or(f"{p}.mode", "mapped_sections_only").alias("mode"), _or(f"{p}.first_no_break", True).alias("first_no_break"),
        _or(f"{p}.break_before_styles", none).alias("break_before_styles"), _or(f"{p}.chapter_break_styles", none).alias("chapter_break_styles"),
    )
    filled = F.transform(
        _or("sections", F.array().cast(f"array<{_SECTION}>")),
        lambda s: F.struct(
            s["id"].alias("id"), s["heading"].alias("heading"), F.coalesce(s["mode"], F.lit("paragraphs")).alias("mode"),
            F.coalesce(s["detail"], F.lit("standard")).alias("detail"), F.coalesce(s["source_queries"], none).alias("source_queries"),
            F.coalesce(s["table_fill"], F.lit("full")).alias("table_fill"),
        ),
    )
    return rows.select(
        "path", _or("template_rules.heading_styles", none).alias("heading_styles"), _or("template_rules.body_style", "").alias("body_style"),
        _or("template_rules.table_policy", "fit_to_page").alias("table_policy"),
        _or("template_rules.remove_review_artifacts", none).alias("remove_review_artifacts"), pagination.alias("pagination"),
        filled.alias("sections"), _or("front_matter", F.array().cast("array<struct<field:string,style:string,prefix:string>>")).alias("front_matter"),
        F.when(F.col("_bad").isNotNull(), "CONFIG_INVALID").alias("error"),
    )


def sections(mappings: DataFrame) -> DataFrame:
    """(path, ord, id, heading, mode, detail, source_queries, table_fill): the sections of mappings, in order."""
    return mappings.filter("error is null").select("path", F.posexplode("sections").alias("ord", "s")).select("path", "ord", "s.*")


def section_specs(mappings: DataFrame) -> DataFrame:
    return sections(mappings).select("path", "ord", "id", "heading", "mode")


def section(specs: DataFrame, wanted: str) -> DataFrame:
    """The first section of each mapping with an id."""
    few = specs.filter(F.col("id") == wanted)
    return few.groupBy("path").agg(F.min_by(F.struct("*"), "ord").alias("s")).select("s.*")


def headings_index(mappings: DataFrame) -> DataFrame:
    """(path, heading, id): the section of each normalised heading; of equal headings the last counts."""
    rows = sections(mappings).withColumn("heading", normalize_heading(F.col("heading")))
    return rows.groupBy("path", "heading").agg(F.max_by("id", "ord").alias("id"))


def mapping_issues(mappings: DataFrame) -> DataFrame:
    """(path, subject, issue): what is inconsistent in mappings; a mapping without rows here is sound."""
    good = mappings.filter("error is null")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    nobody = F.lit("")

    def whole(condition: Column, issue: str) -> DataFrame:
        return good.filter(condition).select("path", nobody.alias("subject"), F.lit(issue).alias("issue"))

    rows = sections(good)

    def one(condition: Column, issue: str) -> DataFrame:
        return rows.filter(condition).select("path", F.coalesce("id", nobody).alias("subject"), F.lit(issue).alias("issue"))

    anchors = good.select("path", F.explode("front_matter").alias("a")).select("path", "a.*")
    twice = rows.filter(~blank("id")).groupBy("path", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    out = [
        good.filter("false").select("path", nobody.alias("subject"), nobody.alias("issue")),
        mappings.filter("error is not null").select("path", nobody.alias("subject"), F.col("error").alias("issue")),
        whole(F.size("heading_styles") == 0, "NO_HEADING_STYLES"),
        whole(~F.col("table_policy").isin(*TABLE_POLICIES), "UNKNOWN_TABLE_POLICY"),
        whole(~F.col("pagination.mode").isin(*PAGINATION), "UNKNOWN_PAGINATION"),
        whole((F.col("pagination.mode") == "break_before_styles") & (F.size("pagination.break_before_styles") == 0), "NO_BREAK_STYLES"),
        one(blank("id"), "EMPTY_ID"),
        twice.select("path", F.col("id").alias("subject"), F.lit("DUPLICATE_ID").alias("issue")),
        one(blank("heading"), "NO_HEADING"),
        one(~F.col("mode").isin(*MODES), "UNKNOWN_MODE"),
        one(~F.col("table_fill").isin(*TABLE_FILLS), "UNKNOWN_TABLE_FILL"),
        anchors.filter(blank("field")).select("path", nobody.alias("subject"), F.lit("ANCHOR_WITHOUT_FIELD").alias("issue")),
        anchors.filter(~blank("field") & blank("style") & blank("prefix")).select("path", F.col("field").alias("subject"), F.lit("ANCHOR_WITHOUT_PLACE").alias("issue")),
    ]
    issues = out[0]
    for rows_of in out[1:]:
        issues = issues.unionByName(rows_of)
    return issues


def read_checklists(spark: SparkSession, path: str) -> DataFrame:
    """(path, placeholders, section, title, keywords, required_keywords, error) of checklists, a row for each section."""
    rows = _read(spark, path, _CHECKLIST)
    found = rows.select("path", "placeholders", F.explode_outer("sections").alias("s"), F.when(F.col("_bad").isNotNull(), "CONFIG_INVALID").alias("error"))
    return found.select("path", "placeholders", "s.*", "error")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """(path, split, doc, field, gold, mandatory) of golden records laid out as <split>/<doc>.json, an object of fields each.

    A field is an object with ``value`` and perhaps ``mandatory``, or the value itself; values are JSON texts, strings plain.
    """
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("path"))
    fields = text.select("path", F.explode(F.from_json("value", "map<string,string>")).alias("field", "raw"))
    part = lambda name: F.get_json_object("raw", f"$.{name}")
    is_object = F.col("raw").startswith("{") & part("value").isNotNull()
    return fields.select(
        "path", golden_split(F.col("path")).alias("split"), F.regexp_extract("path", r"([^/\\]*)\.json$", 1).alias("doc"), "field",
        F.when(is_object, part("value")).otherwise(F.col("raw")).alias("gold"), F.when(is_object, F.coalesce(part("mandatory") == "true", F.lit(False))).otherwise(False).alias("mandatory"),
    )


def golden_split(path: Column) -> Column:
    """The folder that a golden record lies in: its split."""
    return F.regexp_extract(path, r"([^/\\]+)[/\\][^/\\]*$", 1)


def golden_path(root: str, split: Column, doc: Column) -> Column:
    return F.concat_ws("/", F.lit(root.rstrip("/")), split, F.concat(doc, F.lit(".json")))


_PAGES = "schema string, engine string, extracted_at string, pages array<struct<file:string,page:int,text:string,char_count:int>>"


def pages_document(pages: DataFrame, engine: str = "quire", extracted_at: str | None = None) -> DataFrame:
    """One row for each file of pages (file, page, text): (file, json), an envelope that names its schema."""
    one = F.struct("file", "page", "text", F.length("text").alias("char_count"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("page", one.alias("p")))), lambda x: x["p"])
    body = F.struct(F.lit(PAGES_SCHEMA).alias("schema"), F.lit(engine).alias("engine"), F.lit(extracted_at).cast("string").alias("extracted_at"), listed.alias("pages"))
    return pages.groupBy("file").agg(F.to_json(body).alias("json"))


def write_pages(documents: DataFrame, path: str) -> None:
    """Write envelopes (json) as lines of JSON."""
    documents.select(F.col("json").alias("value")).write.text(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(file, page, text, char_count, error) of envelopes; one of another schema gives a row with an error alone."""
    rows = spark.read.schema(_PAGES).json(path)
    good = F.col("schema").eqNullSafe(PAGES_SCHEMA)
    found = rows.select(F.explode_outer(F.when(good, F.col("pages"))).alias("p"), F.when(~good, "PAGES_SCHEMA_UNKNOWN").alias("error"))
    return found.select("p.*", "error")


def pages_for_mapping(pages: DataFrame) -> DataFrame:
    return pages.select("file", "page", "text")
