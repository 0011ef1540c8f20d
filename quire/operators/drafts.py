"""What goes into a document and what was left out of it: drafts of sections, anchors, text regions, omissions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import collapse

# The bounds of text regions, and the names of story parts that a body's projection leaves out.
MAX_REGIONS, MAX_REGION_TEXT = 100, 4096
STORIES = {"header": "headers", "footer": "footers", "comments": "comments", "footnotes": "footnotes", "endnotes": "endnotes"}


def parse_drafts(drafts: DataFrame) -> DataFrame:
    """(id, section, paragraphs, rows, header_rows, values, fill_mode, error) of drafts (id, section, json).

    A draft is a text, a list of texts, or an object with ``paragraphs`` and a ``table`` (or its parts themselves): ``rows``,
    ``header_rows``, ``values`` by label, ``fill_mode``. With values, a full fill goes by label.
    """
    raw = F.trim("json")
    table = F.get_json_object("json", "$.table")
    inner = F.when(table.startswith("{"), table).when(F.get_json_object("json", "$.rows").isNotNull(), F.col("json"))
    part = lambda name: F.get_json_object(inner, f"$.{name}")
    texts = "array<string>"
    none = F.array().cast(texts)
    plain = F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")
    paragraphs = (
        F.when(raw.startswith("["), F.from_json("json", texts))
        .when(raw.startswith('"'), F.array(plain))
        .otherwise(F.coalesce(F.from_json(F.get_json_object("json", "$.paragraphs"), texts), none))
    )
    values = F.when(part("values").startswith("{"), F.from_json(part("values"), "map<string,string>"))
    has_values = F.coalesce(F.size(values) > 0, F.lit(False))
    mode = F.coalesce(part("fill_mode"), F.lit("full"))
    known = raw.startswith("[") | raw.startswith('"') | raw.startswith("{")
    return drafts.select(
        "id", "section", paragraphs.alias("paragraphs"), F.coalesce(F.from_json(part("rows"), "array<array<string>>"), F.array().cast("array<array<string>>")).alias("rows"),
        F.greatest(F.lit(0), F.coalesce(part("header_rows").try_cast("int"), F.lit(1))).alias("header_rows"),
        F.coalesce(values, F.create_map().cast("map<string,string>")).alias("values"),
        F.when(has_values & (mode == "full"), "by_label").otherwise(mode).alias("fill_mode"),
        F.when(~F.coalesce(known, F.lit(False)), "DRAFT_TYPE_UNSUPPORTED").alias("error"),
    )


def anchored_paragraphs(paragraphs: DataFrame, anchors: DataFrame, stop_styles: list[str]) -> DataFrame:
    """(doc, field, idx, text): paragraphs (doc, idx, style, text) before a document's first heading that fit anchors (field, style, prefix).

    A heading is a paragraph of a stop style with text. An anchor asks for its style where it has one, and for its prefix, or any text without one.
    """
    filled = collapse(F.col("text")) != ""
    stop = F.min(F.when(F.col("style").isin(stop_styles) & filled, F.col("idx"))).over(W.partitionBy("doc"))
    front = paragraphs.withColumn("__stop", stop).filter("__stop is null or idx < __stop").withColumn("__filled", filled)
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    a = anchors.select("field", F.col("style").alias("__style"), F.col("prefix").alias("__prefix"))
    fits = (blank("__style") | (F.col("style") == F.col("__style"))) & F.when(blank("__prefix"), F.col("__filled")).otherwise(F.startswith("text", "__prefix"))
    return front.join(a, fits).select("doc", "field", "idx", "text")


def text_regions(regions: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(regions, errors): text regions (image_id, x, y, width, height, text, confidence) against images (image_id, image_width, image_height).

    An image with one wrong region gives errors (image_id, code) alone. Regions come in reading order, at most MAX_REGIONS of an image, and
    ``truncated`` says that there were more.
    """
    joined = regions.join(images, "image_id")
    code = (
        F.when(F.col("x").isNull() | F.col("y").isNull() | F.col("width").isNull() | F.col("height").isNull(), "REGION_NOT_WHOLE")
        .when((F.col("x") < 0) | (F.col("y") < 0) | (F.col("width") < 1) | (F.col("height") < 1), "REGION_NOT_POSITIVE")
        .when((F.col("x") + F.col("width") > F.col("image_width")) | (F.col("y") + F.col("height") > F.col("image_height")), "REGION_OUT_OF_BOUNDS")
        .when(F.col("text").isNull() | (F.length("text") > MAX_REGION_TEXT), "REGION_TEXT_LIMIT")
        .when(F.isnan("confidence") | ~F.col("confidence").between(0, 1), "REGION_CONFIDENCE")
    )
    marked = joined.withColumn("code", code)
    errors = marked.filter("code is not null").select("image_id", "code").distinct()
    whole = marked.join(errors.select("image_id").distinct(), "image_id", "left_anti")
    nth = F.row_number().over(W.partitionBy("image_id").orderBy("y", "x", "text"))
    rows = whole.withColumn("n", nth).withColumn("truncated", F.count(F.lit(1)).over(W.partitionBy("image_id")) > MAX_REGIONS)
    return rows.filter(F.col("n") <= MAX_REGIONS).select("image_id", "n", "x", "y", "width", "height", "text", "confidence", "truncated"), errors


def docx_omissions(stories: DataFrame, marks: DataFrame) -> DataFrame:
    """(source_sha256, omitted, warnings) of DOCX files: story parts with text (source_sha256, part) and drawings of the body (source_sha256, kind) that blocks leave out."""
    named = F.create_map(*(F.lit(x) for kv in STORIES.items() for x in kv))
    kind = F.try_element_at(named, F.regexp_extract("part", r"word/([a-z]+)", 1))
    parts = stories.filter("error is null").select("source_sha256", F.concat(F.lit("docx_"), kind).alias("name"), F.concat(F.upper(F.concat(F.lit("docx_"), kind)), F.lit("_NOT_PROJECTED")).alias("warning"))
    drawn = marks.filter("error is null and kind = 'image'").select("source_sha256", F.lit("embedded_graphics").alias("name"), F.lit("EMBEDDED_GRAPHICS_NOT_PROJECTED").alias("warning"))
    found = parts.unionByName(drawn).filter("name is not null")
    return found.groupBy("source_sha256").agg(F.array_sort(F.collect_set("name")).alias("omitted"), F.array_sort(F.collect_set("warning")).alias("warnings"))


def first_table(blocks: DataFrame, key: list[str]) -> DataFrame:
    """(key..., rows): the rows of each document's first table or sheet (blocks key..., block, content), else all its texts, a row each."""
    c = F.col("content")
    tables = blocks.filter(c["kind"].isin("table", "sheet")).groupBy(*key).agg(F.min_by(c["rows"], "block").alias("rows"))
    none = F.array().cast("array<string>")
    texts = F.concat(F.when(c["text"].isNotNull(), F.array(c["text"])).otherwise(none), F.coalesce(c["paragraphs"], none))
    rows = F.when(c["kind"] == "key_values", F.transform(c["pairs"], lambda p: F.array(p["label"], p["value"]))).otherwise(F.transform(texts, lambda t: F.array(t)))
    rest = blocks.join(tables.select(*key), key, "left_anti")
    listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", rows.alias("rows")))), lambda x: x["rows"]))
    return tables.unionByName(rest.groupBy(*key).agg(listed.alias("rows")))
