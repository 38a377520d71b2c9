"""Connected components of a graph given as pairs of bigint nodes.

Large-star and small-star steps alternate until nothing changes; each rewires every node to the smallest node it knows, so
the number of rounds grows with the logarithm of the longest path. A step is an aggregation and a join; a hub's edges are
pre-aggregated before they are shuffled, and its join can be split. The edges of a round are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge to another; component is the smallest node it reaches."""
    a, b = edges.columns[:2]
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    now, before = saved(now, "edges"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        now = large.join(small, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        now = saved(now, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
