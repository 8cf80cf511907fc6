"""Connected components of an edge table, by alternating large and small stars; every step is a sum or a join of edges.

The smallest neighbours are written before they are joined, so that Spark can split a vertex with many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortspark.llm.store import stored


def large_star(edges: DataFrame) -> DataFrame:
    """Join each vertex's larger neighbours to the smallest vertex in reach."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Join each vertex and its smaller neighbours to the smallest of them. edges: u > v."""
    edges = stored(edges)
    least = stored(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each vertex that is not the smallest of its component, and the smallest. edges: (u, v), u <> v, any order."""
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        edges = stored(small_star(large_star(edges)))
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (now.n, now.x) == state:
            return edges
        state = (now.n, now.x)
