"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import drop_scratch, materialise


#: Links from which the least neighbours are written before they are joined back. Both sides of the join are then plain
#: tables, so Spark can split the rows of a node that has a large part of all links; fewer links fit one task anyway.
LARGE = 2_000_000


def _settled(least: DataFrame, links: int) -> DataFrame:
    return materialise(least, "least") if links >= LARGE else least


def _large_star(edges: DataFrame, links: int) -> DataFrame:
    """Every node joins its larger neighbours to the least of its neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = _settled(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), links)
    return both.where("v > u").join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a")).where("a <> b").distinct()


def _small_star(edges: DataFrame, links: int) -> DataFrame:
    """Every node joins itself and its smaller neighbours to the least of them."""
    least = _settled(edges.groupBy("b").agg(F.min("a").alias("m")), links)
    moved = edges.join(least, "b").select(F.col("a").alias("b"), F.col("m").alias("a"))
    return moved.unionByName(least.select("b", F.col("m").alias("a"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of links (a, b) can reach; nodes without a link are left out.

    Stops when a round leaves the links as they are; each round is a written table. The number of rounds grows with the
    logarithm of the longest path.
    """
    edges = materialise(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    while state[0]:
        last, before = state, edges
        large = _large_star(edges, state[0])
        edges = materialise(_small_star(materialise(large, "links") if state[0] >= LARGE else large, state[0]), "links")
        drop_scratch(before)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
