"""Connected components by alternating star contraction; links and labels stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import drop_stored, stored


def _large(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node with the smallest of the node and its neighbours."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours with the smallest of them. Edges have a > b."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionAll(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with a link; the root is the smallest node reachable. edges: a, b long, any order.

    Rounds grow with the logarithm of the longest chain; each is written to the shared folder. Empty input: no rows.
    """
    spark = edges.sparkSession
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        new = stored(_small(_large(edges)), "links")
        seen = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_stored(spark, edges)
        edges = new
        if seen == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = seen
