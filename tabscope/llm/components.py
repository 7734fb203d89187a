"""Connected components by alternating large-star and small-star steps.

Each step links every node to the least label around it.  The least label comes
from a partially aggregated ``min``, so a hub's edges are never gathered; every
step's edges are written to the shared folder, which ends the lineage there.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select("b", "a"))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if large:
        joined = joined.where("v > u")
    links = joined.select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        links = links.union(least.select("u", "m"))
    return links.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges``: (a, b) of one orderable type.  One row (node, label) for every node that
    is not the least of its component; ``label`` is that least node.  No edges: no rows."""
    edges = written(edges.where("a != b").select("a", "b").distinct())
    mark = None
    while True:
        edges = written(_star(written(_star(edges, True)), False))
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == mark or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
        mark = now
