"""Ordered analytics: islands, running budgets, boundaries, first and nth matches, ranges with cursors."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def islands(rows: DataFrame, key: list[str], order: str, is_break: Column) -> DataFrame:
    """Number the islands of each key: a row with ``is_break`` begins one. Adds ``island`` from 0."""
    running = W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("island", F.sum(is_break.cast("int")).over(running))


def joined_islands(rows: DataFrame, key: list[str], order: str, text: str, separator: str = "\n") -> DataFrame:
    """One row for each island with its texts in order."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return rows.groupBy(*key, "island").agg(
        F.concat_ws(separator, F.transform(listed, lambda x: x["t"])).alias("text"),
        F.count(F.lit(1)).alias("n"),
        F.min(order).alias("first"),
    )


def running_budget(rows: DataFrame, key: list[str], order: str, size: Column, budget: int) -> DataFrame:
    """What each row may keep of a budget spent in order: ``before``, ``granted``, ``truncated``."""
    past = W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(size).over(past), F.lit(0))
    granted = F.greatest(F.lit(0), F.least(size, F.lit(budget) - before))
    return rows.withColumn("before", before).withColumn("granted", granted).withColumn("truncated", granted < size)


def next_boundary(rows: DataFrame, key: list[str], order: str, is_boundary: Column) -> DataFrame:
    """The order value of the next boundary row after each row, or null."""
    # From the end on: a frame that ends with the partition is added up again for every row.
    after = W.partitionBy(*key).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("next_boundary", F.last(F.when(is_boundary, F.col(order)), ignorenulls=True).over(after))


def nth_match(rows: DataFrame, key: list[str], order: str, matches: Column, n: int = 1) -> DataFrame:
    """The nth row of each key that matches, in order."""
    ranked = rows.filter(matches).withColumn("nth", F.row_number().over(W.partitionBy(*key).orderBy(order)))
    return ranked.filter(F.col("nth") == n).drop("nth")


def in_range(rows: DataFrame, ordinal: str, start: int, limit: int) -> DataFrame:
    """The half-open range [start, start + limit) of an ordinal column; a pushed-down filter, never a bare limit."""
    return rows.filter((F.col(ordinal) >= start) & (F.col(ordinal) < start + limit))


def coverage(rows: DataFrame, key: list[str], ordinal: str, start: int, limit: int) -> DataFrame:
    """For each source: what a range returns, how many rows there are, and where to go on (null at the end)."""
    total = F.count(F.lit(1))
    end = F.least(total, F.lit(start + limit))
    inside = F.count(F.when((F.col(ordinal) >= start) & (F.col(ordinal) < start + limit), 1))
    return rows.groupBy(*key).agg(
        inside.alias("returned"),
        total.alias("known_total"),
        F.when(end < total, end).alias("next_row"),
        F.when(end < total, "partial_known").otherwise("complete").alias("disposition"),
    )


def cursor_chain(rows: DataFrame, key: list[str], ordinal: str, limit: int) -> DataFrame:
    """All ranges that a reader following cursors would make of each source."""
    n = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("total"))
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.col("total") - 1, F.lit(0)), F.lit(limit)))
    chain = n.select(*key, "total", starts.alias("start"))
    end = F.least(F.col("total"), F.col("start") + limit)
    return chain.select(*key, "start", end.alias("end"), F.when(end < F.col("total"), end).alias("next_row"))


def in_order(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Whether the values of each key never fall."""
    past = F.lag(value).over(W.partitionBy(*key).orderBy(order))
    return rows.withColumn("__past", past).groupBy(*key).agg(
        F.coalesce(F.bool_and(F.col("__past").isNull() | (F.col("__past") <= F.col(value))), F.lit(True)).alias("ordered")
    )


def contiguous(rows: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """Whether ordinals run without gap or repeat."""
    return rows.groupBy(*key).agg(
        ((F.max(ordinal) - F.min(ordinal) + 1 == F.count(F.lit(1))) & (F.count_distinct(ordinal) == F.count(F.lit(1)))).alias(
            "contiguous"
        )
    )
