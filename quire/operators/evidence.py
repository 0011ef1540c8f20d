"""Evidence bundles: documents, typed evidence and checks, joined and judged."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.python import iso_instant
from quire.functions.text import strip


def shuffled(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join by sorted shuffles: neither side is bounded, and a plan takes a side's size from compressed files and not from what is
    exploded or made of them, so it would broadcast one of many times its limit."""
    return left.join(right.hint("merge"), on, how)


def check_items(checks: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row for each (check_id, pos) with its evidence; an unknown evidence_id has a null value and known = false."""
    asked = checks.select("check_id", F.posexplode("evidence_ids").alias("pos", "evidence_id"))
    known = evidence.withColumn("known", F.lit(True))
    return shuffled(asked, known, "evidence_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def unknown_evidence(checks: DataFrame, evidence: DataFrame) -> DataFrame:
    """References to evidence that doesn't exist, by an anti join."""
    asked = checks.select("check_id", F.explode("evidence_ids").alias("evidence_id"))
    return shuffled(asked, evidence.select("evidence_id"), "evidence_id", "left_anti").select("check_id", "evidence_id")


def unbound_evidence(evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """Evidence whose document is unknown or whose source digest differs from its document's."""
    bound = documents.select("document_id", F.col("source_sha256").alias("doc_sha256"))
    joined = shuffled(evidence, bound, "document_id", "left")
    reason = F.when(F.col("doc_sha256").isNull(), "UNKNOWN_DOCUMENT").when(
        F.col("doc_sha256") != F.col("source_sha256"), "SOURCE_DIGEST_MISMATCH"
    )
    return joined.withColumn("reason", reason).filter("reason is not null").select("evidence_id", "document_id", "reason")


def presence(items: DataFrame) -> DataFrame:
    """(check_id, status, reason, missing_count): null or blank values fail."""
    missing = F.count(F.when(F.col("value").isNull() | (strip(F.col("value")) == ""), 1))
    return items.groupBy("check_id").agg(
        F.when(missing > 0, "fail").otherwise("pass").alias("status"),
        F.when(missing > 0, "VALUE_MISSING").otherwise("VALUE_PRESENT").alias("reason"),
        missing.alias("missing_count"),
    )


def equality(items: DataFrame, checks: DataFrame | None = None, reasons=("VALUES_EQUAL", "VALUE_MISMATCH")) -> DataFrame:
    """All values equal the expected one, or the first: (check_id, status, reason, expected, actual, compared_count).

    ``checks`` may give (check_id, expected, has_expected); an expected null differs from none. What is kept of
    a check is its first value, its first value that is off, and counts, however many items it has.
    """
    first = items.groupBy("check_id").agg(
        F.min_by(F.struct("value"), "pos")["value"].alias("first"), F.count(F.lit(1)).alias("compared_count")
    )
    want = F.col("first")
    if checks is not None:
        first = shuffled(first, checks.select("check_id", "expected", "has_expected"), "check_id")
        want = F.when(F.col("has_expected"), F.col("expected")).otherwise(F.col("first"))
    first = first.select("check_id", "first", "compared_count", want.alias("want"))
    off = ~F.col("value").eqNullSafe(F.col("want"))
    per = shuffled(items, first, "check_id").groupBy("check_id").agg(
        F.bool_or(off).alias("bad"), F.min_by(F.struct("value"), F.when(off, F.col("pos")))["value"].alias("other")
    )
    joined = shuffled(first, per, "check_id")
    return joined.select(
        "check_id",
        F.when(F.col("bad"), "fail").otherwise("pass").alias("status"),
        F.when(F.col("bad"), reasons[1]).otherwise(reasons[0]).alias("reason"),
        F.col("want").alias("expected"),
        F.when(F.col("bad"), F.col("other")).otherwise(F.col("first")).alias("actual"),
        "compared_count",
    )


def version_match(items: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """``equality`` of versions, which are texts: an item of another type (``value_type``) or without a value fails.

    A single item without an expected version is no match to make: status ``error``.
    """
    out = equality(items, checks, ("VERSIONS_MATCH", "VERSION_MISMATCH"))
    typed = F.col("value_type").isin("string", "version", "date") if "value_type" in items.columns else F.lit(True)
    per = items.groupBy("check_id").agg(F.bool_and(typed & F.col("value").isNotNull()).alias("texts"))
    joined = shuffled(out, per, "check_id")
    given = F.lit(False)
    if checks is not None:
        joined = shuffled(joined, checks.select("check_id", "has_expected"), "check_id", "left")
        given = F.coalesce("has_expected", F.lit(False))
    lone = (F.col("compared_count") < 2) & ~given
    # Without texts nothing was compared.
    status = F.when(lone, "error").when(~F.col("texts"), "fail").otherwise(F.col("status"))
    reason = F.when(lone, "CHECK_INVALID").when(~F.col("texts"), "VERSION_VALUE_INVALID").otherwise(F.col("reason"))
    bad = lone | ~F.col("texts")
    return joined.select(
        "check_id", status.alias("status"), reason.alias("reason"), "expected",
        F.when(~bad, F.col("actual")).alias("actual"), F.when(~bad, F.col("compared_count")).alias("compared_count"),
    )


def range_reason(value: Column, low: Column, high: Column, low_in: Column, high_in: Column) -> Column:
    """The reason code of a number against bounds that may be open or absent."""
    below = F.when(low_in, value < low).otherwise(value <= low)
    above = F.when(high_in, value > high).otherwise(value >= high)
    return (
        F.when(value.isNull(), "VALUE_NOT_NUMERIC")
        .when(low.isNotNull() & below, "VALUE_BELOW_MINIMUM")
        .when(high.isNotNull() & above, "VALUE_ABOVE_MAXIMUM")
        .otherwise("VALUE_WITHIN_RANGE")
    )


def numeric_range(rows: DataFrame) -> DataFrame:
    """(check_id, status, reason) of (check_id, number, minimum, maximum, minimum_inclusive, maximum_inclusive)."""
    reason = range_reason(*(F.col(c) for c in ("number", "minimum", "maximum", "minimum_inclusive", "maximum_inclusive")))
    out = rows.select("check_id", reason.alias("reason"))
    return out.withColumn("status", F.when(F.col("reason") == "VALUE_WITHIN_RANGE", "pass").otherwise("fail"))


def date_order(items: DataFrame) -> DataFrame:
    """(check_id, status, reason): ISO dates and times that don't fall; a value that is none fails the check.

    Fewer than two items are no order to check, and times with and without a zone aren't comparable: status ``error``.
    """
    rows = items.select("check_id", "pos", iso_instant(F.col("value")).alias("t"))
    past = F.lag("t.micros").over(W.partitionBy("check_id").orderBy("pos"))
    rows = rows.withColumn("past", past)
    out = rows.groupBy("check_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or(F.col("t.micros").isNull()).alias("invalid"),
        (F.min("t.zoned") != F.max("t.zoned")).alias("mixed"),
        F.coalesce(F.bool_and(F.col("past").isNull() | (F.col("past") <= F.col("t.micros"))), F.lit(True)).alias("ordered"),
    )
    reason = (
        F.when(F.col("n") < 2, "CHECK_INVALID")
        .when(F.col("invalid"), "DATE_VALUE_INVALID")
        .when(F.col("mixed"), "DATE_ZONES_MIXED")
        .when(F.col("ordered"), "DATE_ORDER_VALID")
        .otherwise("DATE_ORDER_INVALID")
    )
    out = out.select("check_id", reason.alias("reason"))
    status = F.when(F.col("reason") == "DATE_ORDER_VALID", "pass").when(F.col("reason").isin("CHECK_INVALID", "DATE_ZONES_MIXED"), "error")
    return out.withColumn("status", status.otherwise("fail"))


def type_violations(evidence: DataFrame) -> DataFrame:
    """Evidence whose JSON value (``json``) isn't of its declared ``value_type``, with the reason."""
    text, kind = F.trim("json"), F.col("value_type")
    number = text.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$")
    whole = text.rlike(r"^-?(0|[1-9]\d*)$")
    good = (
        F.when(kind.isin("string", "date", "version"), text.startswith('"'))
        .when(kind == "number", number)
        .when(kind == "integer", whole)
        .when(kind == "boolean", text.isin("true", "false"))
        .when(kind == "null", text == "null")
        .otherwise(False)
    )
    return evidence.filter(~F.coalesce(good, F.lit(False))).select("evidence_id", F.lit("VALUE_TYPE_MISMATCH").alias("reason"))


def repeated(rows: DataFrame, identity: str, reason: str) -> DataFrame:
    """(id, reason): identities that occur more than once."""
    counted = rows.groupBy(identity).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return counted.select(F.col(identity).alias("id"), F.lit(reason).alias("reason"))


def with_confidence(results: DataFrame, items: DataFrame, minimum: float) -> DataFrame:
    """Turn pass into review where an item's confidence is below the minimum; failures stay."""
    low = items.groupBy("check_id").agg(F.min("confidence").alias("least"))
    review = (F.col("least") < minimum) & (F.col("status") == "pass")
    return shuffled(results, low, "check_id").withColumn("status", F.when(review, "review").otherwise(F.col("status"))).drop("least")


def overall(results: DataFrame, key: str) -> DataFrame:
    """The worst status of each group: fail over review over pass."""
    rank = F.when(F.col("status") == "fail", 2).when(F.col("status") == "review", 1).otherwise(0)
    return results.groupBy(key).agg(F.max_by("status", rank).alias("status"), F.count(F.lit(1)).alias("n_checks"))


def verify_bundle(documents: DataFrame, evidence: DataFrame, checks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(errors, results) of a bundle.

    ``documents`` is (document_id, source_sha256, media_type), ``evidence`` (evidence_id, document_id, source_sha256,
    media_type, value_type, json, value, confidence) and ``checks`` (check_id, kind, evidence_ids, expected, has_expected,
    minimum, maximum, minimum_inclusive, maximum_inclusive, minimum_confidence). Errors, (id, reason), are breaches of the
    bundle itself; with any the results mean nothing. Results are (check_id, kind, status, reasons, expected, actual).
    """
    known = documents.select("document_id", F.col("source_sha256").alias("__sha"), F.col("media_type").alias("__media"))
    bound = shuffled(evidence, known, "document_id", "left")
    reason = (
        F.when(F.col("__sha").isNull(), "UNKNOWN_DOCUMENT")
        .when(F.col("__sha") != F.col("source_sha256"), "SOURCE_DIGEST_MISMATCH")
        .when(~F.col("__media").eqNullSafe(F.col("media_type")), "MEDIA_TYPE_MISMATCH")
    )
    few = (F.size("evidence_ids") != 1) | (F.col("minimum").isNull() & F.col("maximum").isNull())
    errors = (
        repeated(documents, "document_id", "DOCUMENT_NOT_UNIQUE")
        .unionByName(repeated(evidence, "evidence_id", "EVIDENCE_NOT_UNIQUE"))
        .unionByName(repeated(checks, "check_id", "CHECK_NOT_UNIQUE"))
        .unionByName(bound.select(F.col("evidence_id").alias("id"), reason.alias("reason")).filter("reason is not null"))
        .unionByName(type_violations(evidence).withColumnRenamed("evidence_id", "id"))
        .unionByName(unknown_evidence(checks, evidence).select(F.col("check_id").alias("id"), F.lit("UNKNOWN_EVIDENCE").alias("reason")))
        .unionByName(checks.filter((F.col("kind") == "numeric_range") & few).select(F.col("check_id").alias("id"), F.lit("CHECK_INVALID").alias("reason")))
    )
    items = check_items(checks.select("check_id", "evidence_ids"), evidence)
    of = lambda kind: shuffled(items, checks.filter(F.col("kind") == kind).select("check_id"), "check_id", "left_semi")
    wanted = checks.select("check_id", "expected", "has_expected")
    single = of("numeric_range").select("check_id", F.when(F.col("value_type").isin("number", "integer"), F.col("value").try_cast("double")).alias("number"))
    ranges = numeric_range(shuffled(single, checks.select("check_id", "minimum", "maximum", "minimum_inclusive", "maximum_inclusive"), "check_id"))
    none = F.lit(None).cast("string")
    results = None
    for found in (
        presence(of("presence")),
        equality(of("equality"), wanted),
        version_match(of("version_match"), wanted),
        ranges,
        date_order(of("date_order")),
    ):
        columns = {c: F.col(c) if c in found.columns else none for c in ("expected", "actual")}
        rows = found.select("check_id", "status", "reason", *(v.cast("string").alias(c) for c, v in columns.items()))
        results = rows if results is None else results.unionByName(rows)
    least = items.groupBy("check_id").agg(F.min("confidence").alias("least"))
    joined = shuffled(shuffled(checks.select("check_id", "kind", "minimum_confidence"), results, "check_id"), least, "check_id", "left")
    low = F.coalesce(F.col("least") < F.col("minimum_confidence"), F.lit(False))
    return errors, joined.select(
        "check_id", "kind",
        F.when(low & (F.col("status") == "pass"), "review").otherwise(F.col("status")).alias("status"),
        F.when(low, F.array("reason", F.lit("CONFIDENCE_BELOW_MINIMUM"))).otherwise(F.array("reason")).alias("reasons"),
        "expected", "actual",
    )
