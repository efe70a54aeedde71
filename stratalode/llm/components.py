"""Connected components by repeated contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import keys


def _follow(labels: DataFrame, step: DataFrame) -> DataFrame:
    """labels (v, r) with r replaced by what ``step`` (v, r) says of it."""
    onward = step.select(F.col("v").alias("r"), F.col("r").alias("next"))
    return labels.join(onward, "r", "left").select("v", F.coalesce("next", "r").alias("r"))


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(v, r) for every node of ``edges`` (a, b): r is the smallest node of its component.

    Each round hooks every node to its smallest neighbour, follows that twice, and replaces the ends of the edges
    by what they were hooked to; edges inside a component vanish. Rounds grow with the logarithm of the longest path.
    """
    left = keys.stored(spark, edges.select("a", "b").filter("a != b").distinct())
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = keys.stored(spark, both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("r")))
        hook = keys.stored(spark, _follow(_follow(hook, hook), hook))
        labels = hook if labels is None else keys.stored(spark, _follow(labels, hook))
        moved = left.join(hook.select(F.col("v").alias("a"), F.col("r").alias("x")), "a").join(hook.select(F.col("v").alias("b"), F.col("r").alias("y")), "b")
        left = keys.stored(spark, moved.filter("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    if labels is None:
        return left.select(F.col("a").alias("v"), F.col("b").alias("r"))
    # A node that joined later as a root has followed already; nodes hooked early follow to the end.
    return labels
