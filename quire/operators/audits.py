"""Audits of numbers, dates and placeholders; findings are rows."""

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from quire.functions import text as T
from quire.functions.python import numeral_value

# Numerals in words, hints of money, and plain numbers.
NUMERALS = r"[零〇一壹二貳兩两三參叁四肆五伍六陸七柒八捌九玖十拾百佰千仟萬万億亿]{2,}"
CURRENCY = r"(元|圓|NT\$?|新台幣|新臺幣|金額|價|＄|\$)"
ARABIC = r"\d[\d,]*(?:\.\d+)?"
SEVERITY = {"low": 1, "medium": 2, "high": 3}


def table_totals(cells: DataFrame) -> DataFrame:
    """Compare the first total row of each table with the sums above it.

    ``cells`` is (doc, table_ix, row_ix, col_ix, value). The first row whose first cell has a total
    label decides; a column is compared when its total is a number and at least two cells above it
    are. One aggregation per table finds the row; the sums are one more over the same key.
    """
    key = ["doc", "table_ix"]
    rows = cells.groupBy(*key).agg(
        F.min(F.when((F.col("col_ix") == 0) & T.is_total_label(F.col("value")), F.col("row_ix"))).alias("total_row"),
        (F.max("row_ix") + 1).alias("n_rows"),
    )
    numbers = cells.filter("col_ix > 0").withColumn("number", T.to_number(F.col("value")))
    joined = numbers.join(rows.filter("total_row is not null and n_rows > 1"), key)
    above = F.col("row_ix") < F.col("total_row")
    summed = joined.groupBy(*key, "col_ix").agg(
        F.max(F.when(F.col("row_ix") == F.col("total_row"), F.col("number"))).alias("total"),
        F.sum(F.when(above, F.col("number"))).alias("sum"),
        F.count(F.when(above, F.col("number"))).alias("n"),
    )
    off = F.abs(F.col("sum") - F.col("total")) > F.lit(0.01) + F.abs("total") * 1e-9
    return summed.filter((F.col("n") >= 2) & off).withColumn("diff", F.col("total") - F.col("sum"))


@F.arrow_udf(ArrayType(StructType().add("words", StringType()).add("words_value", LongType()).add("number", StringType())))
def _nearest_numbers(texts: pa.Array) -> pa.Array:
    """A text's numerals in words in order, their values, and the number that begins nearest to each, the earlier of two;
    none without a hint of money.

    A text that repeats in a batch is looked at once. Hints and numerals are looked for here, as Java tries the characters
    of such a class one after the other.
    """

    def found(text: str | None) -> list[dict]:
        if text is None or not _CURRENCY.search(text):
            return []
        numbers = [(m.start(), m[0]) for m in _ARABIC.finditer(text)]
        out = []
        for m in _NUMERALS.finditer(text) if numbers else ():
            # Of the numbers on either side one is the nearest.
            k = bisect_left(numbers, (m.start(),))
            near = min(numbers[max(0, k - 1) : k + 1], key=lambda n: abs(n[0] - m.start()))
            out.append({"words": m[0], "words_value": numeral_value(m[0]), "number": near[1]})
        return out

    encoded = texts.dictionary_encode()
    each = pa.array([found(x) for x in encoded.dictionary.to_pylist()], _FOUND)
    return each.take(encoded.indices)


#: Digits are ASCII's, as they are for Java.
_ARABIC, _NUMERALS, _CURRENCY = re.compile(ARABIC, re.ASCII), re.compile(NUMERALS), re.compile(CURRENCY)
_FOUND = pa.list_(pa.struct([("words", pa.string()), ("words_value", pa.int64()), ("number", pa.string())]))


def amounts_in_words(paragraphs: DataFrame) -> DataFrame:
    """Numerals in words against the nearest number of their paragraph (doc, idx, text).

    The nearest is by the distance of beginnings, the earliest of equals; only paragraphs with a
    hint of money count. Values that differ by more than a half are findings.
    """

    # A paragraph's numbers stay in its row: no shuffle, and nothing sorted.
    words = paragraphs.select("doc", "idx", "text", F.explode(_nearest_numbers("text")).alias("word"))
    valued = words.select(
        "doc", "idx", "word.words", "word.words_value", F.translate("word.number", ",", "").cast("double").alias("number_value"),
        F.substring(T.strip(F.col("text")), 1, 40).alias("snippet"),
    )
    return valued.filter("words_value <> 0 and number_value is not null and abs(words_value - number_value) > 0.5")


def date_formats(paragraphs: DataFrame) -> DataFrame:
    """Documents that use more than one date style, with the styles."""
    styles = paragraphs.select("doc", F.explode(T.date_styles(F.col("text"))).alias("style"))
    found = styles.groupBy("doc").agg(F.array_sort(F.collect_set("style")).alias("styles"))
    return found.filter(F.size("styles") > 1).select("doc", F.concat_ws(", ", "styles").alias("styles"))


def number_findings(cells: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """All findings as (doc, check, severity, loc, params)."""
    finding = lambda df, check, severity, loc, **params: df.select(
        "doc", F.lit(check).alias("check"), F.lit(severity).alias("severity"), loc.alias("loc"),
        F.create_map(*(x for k, v in params.items() for x in (F.lit(k), v.cast("string")))).alias("params"),
    )
    column = F.concat(F.lit("table "), (F.col("table_ix") + 1).cast("string"), F.lit(" column "), (F.col("col_ix") + 1).cast("string"))
    return (
        finding(table_totals(cells), "table_total_mismatch", "high", column, total=F.col("total"), sum=F.col("sum"), diff=F.col("diff"))
        .unionByName(
            finding(amounts_in_words(paragraphs), "amount_words_mismatch", "high", F.col("snippet"),
                    words=F.col("words"), words_value=F.col("words_value"), number_value=F.col("number_value"))
        )
        .unionByName(finding(date_formats(paragraphs), "date_format_inconsistent", "medium", F.lit("document"), styles=F.col("styles")))
    )


def severity_rollup(findings: DataFrame, documents: DataFrame, fail_on: str = "low") -> DataFrame:
    """For each document of ``documents`` (doc): findings, worst severity, whether it passes the gate."""
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv)), F.col("severity"))
    worst = findings.groupBy("doc").agg(
        F.count(F.lit(1)).alias("n_findings"), F.max_by("severity", rank).alias("worst"), F.max(rank).alias("rank")
    )
    return documents.join(worst, "doc", "left").select(
        "doc",
        F.coalesce("n_findings", F.lit(0)).alias("n_findings"),
        F.coalesce("worst", F.lit("none")).alias("worst"),
        (F.coalesce("rank", F.lit(0)) < SEVERITY[fail_on]).alias("passed"),
    )


def placeholders(bodies: DataFrame, patterns: list[str]) -> DataFrame:
    """Which bodies (id, text) hold no real content."""
    words = F.array(*(F.lit(p) for p in patterns))
    return bodies.select("id", T.is_placeholder(F.col("text"), words).alias("placeholder"))


def keyword_audit(bodies: DataFrame, required: DataFrame) -> DataFrame:
    """A checklist (section, keywords) against bodies (section, text): missing sections and keywords.

    Sections without a body stay as missing.
    """
    joined = required.join(bodies, "section", "left")
    found = T.hits(F.coalesce("text", F.lit("")), F.col("keywords"))
    status = F.when(F.col("text").isNull(), "section_missing").when(F.size(found) < F.size("keywords"), "keywords_missing")
    return joined.select("section", F.size(found).alias("n_found"), status.otherwise("complete").alias("status"))
