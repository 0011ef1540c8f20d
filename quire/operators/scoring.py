"""Scores of predicted fields against golden records, reviews and corrections."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.python import nfkc
from quire.functions.text import collapse, plain_float

ACCEPT = 0.95
#: Rename targets of one configuration.
MAX_TARGETS = 1000


def normalized_text(value: Column) -> Column:
    """Text for comparison: compatibility forms (full-width digits and letters, ligatures) as plain ones, white space collapsed; null is empty."""
    return collapse(nfkc(F.coalesce(value, F.lit(""))))


def equal_values(predicted: Column, gold: Column, tolerance: float = 1e-6) -> Column:
    """Scalar texts: as plain numbers within a tolerance, else as normalised text; null is empty."""
    a, b = plain_float(predicted), plain_float(gold)
    return F.coalesce(F.abs(a - b) <= tolerance, normalized_text(predicted) == normalized_text(gold))


def score_fields(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(doc, field, correct, mandatory): every gold field (doc, field, gold, mandatory) with its prediction."""
    joined = gold.join(predicted, ["doc", "field"], "left")
    return joined.select("doc", "field", equal_values(F.col("predicted"), F.col("gold")).alias("correct"), "mandatory")


def hallucinations(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Predicted fields with a value that the golden record doesn't have."""
    some = predicted.filter(normalized_text(F.col("predicted")) != "")
    return some.join(gold.select("doc", "field"), ["doc", "field"], "left_anti")


def acceptance(scored: DataFrame, invented: DataFrame, key: list[str]) -> DataFrame:
    """Accuracies, hallucinations and the verdict of each group; no fields is full accuracy."""
    rate = lambda hit, n: F.when(n > 0, hit / n).otherwise(F.lit(1.0))
    mandatory = F.col("mandatory")
    per = scored.groupBy(*key).agg(
        rate(F.count(F.when(F.col("correct"), 1)), F.count(F.lit(1))).alias("all_accuracy"),
        rate(F.count(F.when(mandatory & F.col("correct"), 1)), F.count(F.when(mandatory, 1))).alias("mandatory_accuracy"),
    )
    extra = invented.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return per.join(extra, key, "left").select(
        *key, "all_accuracy", "mandatory_accuracy", n.alias("hallucination_count"),
        ((F.col("mandatory_accuracy") >= ACCEPT) & (n == 0)).alias("accepted"),
    )


def transformation_compliance(records: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc, compliance): the share of rename targets (target) found in a record's JSON text, case aside, to four places.

    The targets are a configuration of its author, taken to the driver: at most MAX_TARGETS. Without any, it is null.
    """
    names = [r[0] for r in targets.select(F.lower(normalized_text(F.col("target")))).limit(MAX_TARGETS + 1).collect()]
    if len(names) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    low = records.select("doc", F.lower(normalized_text(F.col("json"))).alias("blob"))
    wanted = F.array(*(F.lit(n) for n in names)).cast("array<string>")
    hits = F.size(F.filter(wanted, lambda t: (t != "") & F.contains(F.col("blob"), t)))
    return low.select("doc", F.when(F.size(wanted) > 0, F.bround(hits / F.size(wanted), 4)).alias("compliance"))


def review_rows(fields: DataFrame, provenance: DataFrame, confidence: DataFrame) -> DataFrame:
    """Fields with where they come from and how sure they are, by left joins."""
    return fields.join(provenance, ["doc", "field"], "left").join(confidence, ["doc", "field"], "left")


def commit_review(verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(golden, corrections) from verdicts (doc, field, verdict, extracted, gold_value).

    A correct extraction is its own gold; everything else is a correction to the given value.
    """
    right = F.col("verdict") == "correct"
    gold = F.when(right, F.col("extracted")).otherwise(F.col("gold_value"))
    golden = verdicts.select("doc", "field", gold.alias("gold"))
    return golden, verdicts.filter(~right).select("doc", "field", "extracted", F.col("gold_value").alias("corrected"))
