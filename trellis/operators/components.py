"""Connected components by large and small stars in turn: the number of rounds grows with the logarithm of the nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.session import discard, materialize


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, cluster`` of the nodes of ``edges (a, b)``; cluster is the smallest node.  An edge to itself makes no node."""
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    print_ = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first())
    now = materialize(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    n = print_(now)
    while n[0]:
        near = both(now)
        least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = materialize(near.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct(), name)
        discard(now)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        now = materialize(small, name)
        discard(large)
        before, n = n, print_(now)
        if before == n:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("cluster")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("cluster"))).distinct()
