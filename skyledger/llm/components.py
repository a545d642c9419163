"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of every node are tied to its least neighbour."""
    ways = _both_ways(edges)
    least = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return ways.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return tied.unionByName(own).where("a <> b")


def _state(edges: DataFrame) -> tuple:
    """What tells two sets of edges apart: their number and a sum of hashes."""
    mixed = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), mixed).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every node that has an edge, but the least of its component, with that least.

    ``edges`` has integer columns a and b. Every round is written to the shared
    folder; minima are partially aggregated, so a node with very many neighbours
    is no large group. Rounds grow with the logarithm of the longest path.
    """
    current = stored(edges.where("a <> b").distinct(), "edges")
    before, now = None, _state(current)
    while now != before:
        large = _large_star(current).distinct()
        current = stored(_small_star(large).distinct(), "edges")
        before, now = now, _state(current)
    return current
