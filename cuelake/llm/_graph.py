"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import discard, staged


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame) -> DataFrame:
    """edges (u, v) with `m`, the smallest of u and its neighbours. The minima are pre-aggregated, and written before they are
    joined, so that Spark can split the join of a node with many neighbours."""
    least = staged(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    return edges.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (u, v: long), root being the smallest node of its component, itself left out.

    Alternating stars: every node ties its larger neighbours, then itself and its smaller ones, to its smallest
    neighbour, until nothing changes. No task holds a node's neighbours.
    """
    edges = staged(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(edges)
    while before[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = staged(large.distinct(), "large")
        tied = _with_least(large)
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(tied.select("u", F.col("m").alias("v")))
        old, edges = edges, staged(small.where("u <> v").distinct(), "edges")
        discard(old)
        discard(large)
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
