"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabsift.llm.common import cut_lineage


def _smallest(edges: DataFrame) -> DataFrame:
    """Each node of directed edges (u, v) with the smallest of itself and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether no node has two links down, and none has links both down and up."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    return not ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or (down = 1 and up = 1)").take(1)


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of the links; component is the smallest node that can be reached.

    Each round replaces links by links to a smaller node, so a component becomes a star around its smallest node after a number
    of rounds that grows with the logarithm of its size. Every round is written to the shared folder. Nothing is gathered: a node
    with many links is an aggregate and a join, which Spark can split. Null or equal ends link nothing; no links give no rows.
    """
    pair = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull().alias("x"), F.col(b).isNotNull().alias("y"))
    edges = cut_lineage(pair.filter("x and y and u != v").select("u", "v").distinct())
    while not _are_stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_smallest(both), "u").filter("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = _smallest(large)
        small = (large.join(down, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(down.select("u", F.col("m").alias("v"))).distinct())
        edges = cut_lineage(small)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
