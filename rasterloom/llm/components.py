"""Connected components of a graph given by its edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _large(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node are tied to its least one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and itself, are tied to the least one."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the least node of its component) for each node of edges (u, v, any comparable type) that isn't the least itself."""
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    before = None
    while True:
        edges, old = written(_small(_large(edges)), "edges"), edges
        dropped(old)
        # Unchanged edges are stars; the sum of hashes tells, and each node then has one edge.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if now[:2] == before and now[0] == now[2]:
            found = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
            found.scratch = edges.scratch
            return found
        before = now[:2]
