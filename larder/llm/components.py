"""Connected components of an edge table, by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, stored


def _least(edges: DataFrame) -> DataFrame:
    """``u, m``: the smallest of ``u`` and its neighbours, combined map-side, so a hub costs one row per task."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """``vertex, component`` (the smallest vertex reachable) of every vertex of ``edges(a, b)``.

    Each round links every vertex to the smallest vertex near it, first over all neighbours, then over smaller ones only;
    the number of rounds grows with the logarithm of the longest path. No neighbourhood is gathered: rounds are
    aggregations and joins, which Spark may split at a hub. Edges are written to the shared folder between rounds.
    """
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                   "edges")
    before = None
    while True:
        # large star: every larger neighbour of u joins u's minimum
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (both.join(_least(edges), F.col("a") == F.col("u")).filter("b > u")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = stored(large.filter("a <> b").distinct(), "edges")
        # small star: u and its smaller neighbours join the smallest of them
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = (large.join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))))
        done = (edges, large)
        edges = stored(small.filter("a <> b").distinct(), "edges")
        dropped(*done)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(roots)
