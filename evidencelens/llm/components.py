"""Connected components of an edge table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def _mins(edges: DataFrame, small: bool) -> DataFrame:
    """One star step: the neighbours of every node are tied to its smallest neighbour instead."""
    lowest = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = edges.join(lowest, "u")
    if small:
        ties = joined.select(F.col("v").alias("a"), "m").union(joined.select(F.col("u").alias("a"), "m"))
    else:
        ties = joined.filter("v > u").select(F.col("v").alias("a"), "m")
    return ties.filter("a <> m").select(F.col("a").alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (u, v); the component is its smallest node.

    Large-star and small-star steps alternate until the edges stay the same, when every node is tied to its smallest. Each round is
    written to the shared folder, so a lost executor repeats one round; only a count and a checksum reach the driver.
    """
    check = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    edges = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    before = check(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialise(_mins(both, small=False), "edges")
        edges = materialise(_mins(large, small=True), "edges")
        now = check(edges)
        if now == before:
            break
        before = now
    tied = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return tied.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
