"""Connected components of an edge table by contraction to least neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import written


def _doubled(points: DataFrame) -> DataFrame:
    """Pointers of twice as many steps, and whether they lead elsewhere."""
    further = points.select(F.col("node").alias("point"), F.col("point").alias("further"))
    return points.join(further, "point").select("node", F.col("further").alias("point"), (F.col("further") != F.col("point")).alias("moved"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b); the label is the least node it reaches.

    Each round points every node at its least neighbour, follows the pointers to their roots by doubling,
    and keeps the edges between different roots; a star is done in one round, a chain in the
    logarithm of its length. A hub's edges are pre-aggregated before they meet. Nulls and self-loops are ignored.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct())
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = written(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("point")))
        while not _doubled(points).where("moved").isEmpty():
            points = written(_doubled(points).select("node", "point"))
        if labels is None:
            labels = points.select("node", F.col("point").alias("label"))
        else:
            step = points.select(F.col("node").alias("label"), "point")
            labels = written(labels.join(step, "label", "left").select("node", F.coalesce("point", "label").alias("label")))
        left = points.select(F.col("node").alias("a"), F.col("point").alias("pa"))
        right = points.select(F.col("node").alias("b"), F.col("point").alias("pb"))
        rest = edges.join(left, "a").join(right, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        edges = written(rest)
        if edges.isEmpty():
            return labels
