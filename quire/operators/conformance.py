"""Tables of a candidate document against those of a reference, under a policy of what is protected."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROTECTED = ("table_count", "table_order", "topology", "headers", "merge_ranges", "column_widths", "alignment", "text_direction", "style", "fixed_row_labels")


@dataclass(frozen=True)
class Policy:
    """``matching`` is table_id or ordinal; ``appended_rows`` how many rows a candidate's table may have more."""

    protected: tuple[str, ...] = PROTECTED
    matching: str = "table_id"
    appended_rows: int = 0
    width_tolerance: float = 0.0


_FIELDS = ["table_id", "ordinal", "row_count", "column_count", "merge_ranges", "columns", "fixed_row_labels", "style"]


def template_issues(reference: DataFrame, candidate: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(pair, code, location, expected, actual): every breach; values are JSON texts.

    Both sides are tables as ``quire.sources.tables`` gives them, with ``pair``, the key of the comparison that they belong to.
    """
    if unknown := set(policy.protected) - set(PROTECTED):
        raise ValueError(f"unknown protections {sorted(unknown)}")
    side = lambda df, name: df.select("pair", F.struct(*_FIELDS).alias(name), F.col(policy.matching).alias("key"))
    joined = side(reference, "r").join(side(candidate, "c"), ["pair", "key"], "left")
    r, c = F.col("r"), F.col("c")
    here = c.isNotNull()

    def issue(name: str, off: Column, code: str, place: Column | str, expected: Column, actual: Column) -> Column:
        location = F.concat(r["table_id"], F.lit(place) if isinstance(place, str) else place)
        row = F.struct(F.lit(code).alias("code"), location.alias("location"), as_json(expected).alias("expected"), as_json(actual).alias("actual"))
        return F.when(F.lit(name in policy.protected) & F.coalesce(off, F.lit(False)), row)

    def as_json(value: Column) -> Column:
        # A wrapper gives every type of value its JSON text; null has none.
        return F.when(value.isNotNull(), F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))

    each = lambda side_, field: F.transform(side_["columns"], lambda x: x[field])
    whole = F.array_compact(
        F.array(
            F.when(~here, F.struct(F.lit("TABLE_MISSING").alias("code"), r["table_id"].alias("location"), as_json(r["table_id"]).alias("expected"), F.lit(None).cast("string").alias("actual"))),
            issue("table_order", here & (r["ordinal"] != c["ordinal"]), "TABLE_ORDER_CHANGED", "", r["ordinal"], c["ordinal"]),
            issue("topology", here & ~c["row_count"].between(r["row_count"], r["row_count"] + policy.appended_rows), "ROW_COUNT_MISMATCH", "", r["row_count"], c["row_count"]),
            issue("topology", here & (r["column_count"] != c["column_count"]), "COLUMN_COUNT_MISMATCH", "", r["column_count"], c["column_count"]),
            issue("headers", here & (each(r, "header") != each(c, "header")), "HEADER_CHANGED", "/headers", each(r, "header"), each(c, "header")),
            issue("merge_ranges", here & (r["merge_ranges"] != c["merge_ranges"]), "MERGE_TOPOLOGY_CHANGED", "/merge_ranges", r["merge_ranges"], c["merge_ranges"]),
            issue("alignment", here & (each(r, "alignment") != each(c, "alignment")), "ALIGNMENT_CHANGED", "/columns/alignment", each(r, "alignment"), each(c, "alignment")),
            issue("text_direction", here & (each(r, "text_direction") != each(c, "text_direction")), "TEXT_DIRECTION_CHANGED", "/columns/text_direction",
                  each(r, "text_direction"), each(c, "text_direction")),
            issue("style", here & ~r["style"].eqNullSafe(c["style"]), "STYLE_CHANGED", "/style", r["style"], c["style"]),
        )
    )
    widths = F.transform(
        r["columns"],
        lambda x, i: issue(
            "column_widths",
            here & x["width_points"].isNotNull() & ~F.coalesce(F.abs(x["width_points"] - F.get(c["columns"], i)["width_points"]) <= policy.width_tolerance, F.lit(False)),
            "COLUMN_WIDTH_OUT_OF_TOLERANCE", F.concat(F.lit("/columns/"), i.cast("string"), F.lit("/width_points")), x["width_points"], F.get(c["columns"], i)["width_points"],
        ),
    )
    labels = F.transform(
        r["fixed_row_labels"],
        lambda x: issue("fixed_row_labels", here & ~F.array_contains(c["fixed_row_labels"], x), "REQUIRED_ROW_LABEL_MISSING", "/fixed_row_labels", x, F.lit(None).cast("string")),
    )
    found = joined.select("pair", F.explode(F.concat(whole, F.array_compact(widths), F.array_compact(labels))).alias("i")).select("pair", "i.*")
    if "table_count" not in policy.protected:
        return found
    count = lambda df, name: df.groupBy("pair").agg(F.count(F.lit(1)).alias(name))
    counts = count(reference, "n").join(count(candidate, "m"), "pair", "full_outer").na.fill(0, ["n", "m"]).filter("n <> m")
    code = F.when(F.col("m") < F.col("n"), "TABLE_MISSING").otherwise("UNEXPECTED_TABLE_ADDED")
    totals = counts.select("pair", code.alias("code"), F.lit("tables").alias("location"), F.col("n").cast("string").alias("expected"), F.col("m").cast("string").alias("actual"))
    return totals.unionByName(found)
