"""Content blocks: flattened to text items, measured, validated."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_KINDS = ("heading", "paragraphs", "table", "key_values", "sheet", "slide")
MAX_ITEMS, MAX_ROWS, MAX_COLUMNS, MAX_TEXT = 2000, 500, 32, 8192

#: The one shape of all kinds of blocks; the arms that don't apply are null.
BLOCK = (
    "struct<kind:string,level:int,text:string,name:string,paragraphs:array<string>,"
    "pairs:array<struct<label:string,value:string>>,header_rows:int,rows:array<array<string>>>"
)


def flatten_paragraphs(blocks: DataFrame, key: list[str], limit: int | None = MAX_ITEMS) -> DataFrame:
    """(key..., block, sub, text, ordinal): a text item for each paragraph that isn't blank, in order; all if ``limit`` is None."""
    items = blocks.select(*key, "block", F.posexplode("paragraphs").alias("sub", "text")).filter(F.trim("text") != "")
    order = W.partitionBy(*key).orderBy("block", "sub")
    numbered = items.withColumn("ordinal", F.row_number().over(order).cast("long"))
    return numbered if limit is None else numbered.filter(F.col("ordinal") <= limit)


def flatten_blocks(blocks: DataFrame, key: list[str], limit: int = MAX_ITEMS) -> DataFrame:
    """Text items of blocks (key..., block, content: BLOCK): one for each heading, paragraph, pair and row."""
    c = F.col("content")
    joined = lambda rows: F.transform(rows, lambda r: F.concat_ws(" ", r))
    lines = (
        F.when(c["kind"] == "heading", F.array(c["text"]))
        .when(c["kind"].isin("paragraphs"), c["paragraphs"])
        .when(c["kind"] == "key_values", F.transform(c["pairs"], lambda p: F.concat_ws(": ", p["label"], p["value"])))
        .when(c["kind"].isin("table", "sheet"), joined(c["rows"]))
        .otherwise(F.concat(F.array(F.coalesce(c["text"], F.lit(""))), F.coalesce(c["paragraphs"], F.array().cast("array<string>"))))
    )
    return flatten_paragraphs(blocks.select(*key, "block", lines.alias("paragraphs")), key, limit)


def block_metrics(blocks: DataFrame, key: list[str]) -> DataFrame:
    """Rows and UTF-8 bytes of each block, and their running sums over the document."""
    c = F.col("content")
    texts = F.concat(
        F.array(F.coalesce(c["text"], F.lit(""))),
        F.coalesce(c["paragraphs"], F.array().cast("array<string>")),
        F.coalesce(F.flatten(c["rows"]), F.array().cast("array<string>")),
        F.coalesce(F.flatten(F.transform(c["pairs"], lambda p: F.array(p["label"], p["value"]))), F.array().cast("array<string>")),
    )
    size = F.aggregate(texts, F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t))
    running = W.partitionBy(*key).orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    rows = blocks.select(*key, "block", F.coalesce(F.size(c["rows"]), F.lit(0)).alias("n_rows"), size.alias("n_bytes"))
    rows = rows.withColumn("n_rows", F.greatest("n_rows", F.lit(0)))
    return rows.withColumn("total_rows", F.sum("n_rows").over(running)).withColumn("total_bytes", F.sum("n_bytes").over(running))


def block_violations(blocks: DataFrame, key: list[str]) -> DataFrame:
    """What is wrong with blocks: (key..., block, code)."""
    c = F.col("content")
    wrong = lambda cond, code: F.when(F.coalesce(cond, F.lit(False)), F.lit(code))
    codes = F.array_compact(
        F.array(
            wrong(c["kind"].isNull() | ~c["kind"].isin(*BLOCK_KINDS), "UNKNOWN_KIND"),
            wrong((c["kind"] == "heading") & (c["level"].isNull() | ~c["level"].between(1, 6) | (F.trim(F.coalesce(c["text"], F.lit(""))) == "")), "BAD_HEADING"),
            wrong((c["kind"] == "paragraphs") & (F.coalesce(F.size(c["paragraphs"]), F.lit(0)) < 1), "NO_PARAGRAPHS"),
            wrong(c["kind"].isin("table", "sheet") & (F.coalesce(F.size(c["rows"]), F.lit(0)) < 1), "NO_ROWS"),
            wrong(F.size(c["rows"]) > MAX_ROWS, "TOO_MANY_ROWS"),
            wrong(F.exists(c["rows"], lambda r: F.size(r) > MAX_COLUMNS), "TOO_MANY_COLUMNS"),
            wrong((F.length(c["text"]) > MAX_TEXT) | F.exists(c["paragraphs"], lambda p: F.length(p) > MAX_TEXT), "TEXT_TOO_LONG"),
            wrong((c["kind"] == "key_values") & (F.coalesce(F.size(c["pairs"]), F.lit(0)) < 1), "NO_PAIRS"),
        )
    )
    return blocks.select(*key, "block", F.explode(codes).alias("code"))
