"""Connected components of a graph given as edges, by contraction in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for each vertex of ``edges`` (a, b): the smallest vertex that it reaches.

    In a round each vertex points at its smallest neighbour, or itself, and edges are redrawn
    between what their ends point at, which keeps vertices connected and at least halves those
    of a component. When no edge is left the pointers of the rounds are composed. Every round
    is written, so a lost executor costs part of one round; a vertex with very many edges costs
    a partial minimum, not a list. No edges give no rows; loops and repeats do no harm.
    """
    left = materialize(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    rounds: list[DataFrame] = []
    while True:
        ends = left.select(F.col("a").alias("v"), F.col("b").alias("u")).unionAll(left.select("b", "a"))
        points = materialize(
            ends.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("u", "v").alias("p")), "pointers"
        )
        rounds.append(points)
        moved = (
            left.join(points.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a")
            .join(points.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        left = materialize(moved, "edges")
        if left.isEmpty():
            break
    labels = rounds[0].withColumnRenamed("p", "label")
    for points in rounds[1:]:
        further = points.select(F.col("v").alias("label"), "p")
        labels = labels.join(further, "label", "left").select("v", F.coalesce("p", "label").alias("label"))
    return materialize(labels, "labels")
