"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.llm.scratch import drop, save


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of longs to (id, component): the least id that each node reaches.

    Large-star links every larger neighbour of a node to the least id around it,
    small-star every smaller one; both are a grouped minimum and a join, so no
    node's neighbours are ever gathered.  Ends when all edges lead to a least id.
    Loops and repeated edges are allowed; nodes without edges, and null ids, are not returned.
    """
    edges = save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        # done when every node has one smaller neighbour and that has none itself
        nodes = edges.select(F.col("u").alias("x"), F.lit(1).alias("below")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("below")))
        open_ = nodes.groupBy("x").agg(F.sum("below").alias("k"), F.min("below").alias("least")).where("k > 1 or (k = 1 and least = 0)")
        if open_.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, edges = edges, save(small)
        drop(before)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
