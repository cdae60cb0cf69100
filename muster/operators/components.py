"""Connected components by contraction: rounds grow with the logarithm of the longest chain, not with its length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.operators.sizing import settled


def component_labels(links: DataFrame) -> DataFrame:
    """(v, label) for every end of the links (a, b), any comparable type; equal labels are one component.

    A round points each end at the least of itself and its neighbours, moves links to what their ends point at, and
    drops those that have become loops. Labels in no order, such as hashes, at least halve what is left on average.
    """
    links = settled(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = settled(links.select(F.col("a").alias("v")).union(links.select("b")).distinct().withColumn("label", F.col("v")))
    left = links.filter("a != b")
    while not left.isEmpty():
        ends = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = settled(ends.groupBy(F.col("a").alias("_from")).agg(F.least(F.col("_from"), F.min("b")).alias("_to")))
        moved = left.join(points.withColumnsRenamed({"_from": "a", "_to": "x"}), "a").join(points.withColumnsRenamed({"_from": "b", "_to": "y"}), "b")
        left = settled(moved.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        labels = settled(labels.join(points, F.col("label") == F.col("_from"), "left").select("v", F.coalesce("_to", "label").alias("label")))
    return labels
