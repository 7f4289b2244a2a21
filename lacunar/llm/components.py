"""Connected components of an edge table, in rounds of two grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b long); component: the least node reached.

    Alternating large-star and small-star: each round first links the larger
    neighbours of every node to its least neighbour, then the smaller ones, and
    ends when no edge changes. A node's neighbourhood is only ever reduced to
    its minimum, so that a hub of any degree costs one row for each edge.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:  # nodes of every component get nearer to its least one
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        small = materialize(small)
        same = small.join(now, ["a", "b"], "left_semi").count()
        if same == small.count() == now.count():
            break
        now = small
    return now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
