"""Connected components by joins: the smallest node that links reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsmetrics.llm.tables import materialize


def smallest_reachable(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of the undirected links ``a, b``.

    Large-star and small-star steps in turn: each node hands its larger neighbours, then
    itself and its smaller ones, to the smallest of them. The links shrink to stars
    around the smallest nodes in a number of rounds that grows as the logarithm of the
    longest path. Every round is stored in the shared folder. Hot nodes only ever appear
    as grouped minima and join keys. No links give no rows; repeated links and links of a
    node to itself change nothing.
    """
    edges = materialize(
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = (both.join(least, "u").filter("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(smallest, "u")
                 .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
                         .alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        after = materialize(small)
        stars = after.select(F.col("v").alias("u")).join(after.select("u"), "u", "left_semi")
        many = after.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        edges = after
        if stars.isEmpty() and many.isEmpty():
            break
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(edges.select(F.col("v"), F.col("v"))).distinct())
