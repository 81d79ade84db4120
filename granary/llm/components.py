"""Connected components of a table of links, by alternating stars, wholly on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, swept


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node in ``links`` (a, b: long); root is the smallest node that can be reached.

    Large star: each node hands its larger neighbours to its smallest one; small star: likewise the smaller ones. Rounds grow
    with the logarithm of the longest chain. A hub's rows never meet in one task: minima are summed before the shuffle and
    joined back, where adaptive execution splits a hub's rows. Links from a node to itself and null ends are left out.
    """
    edges = kept(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(edges)
    for _ in range(rounds):
        if state[0] == 0:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = kept(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        edges, before, state = new, state, _state(new)
        if state == before:
            break
    else:
        raise RuntimeError(f"the components did not settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))


def _state(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges, but for a chance of about 2^-64."""
    with swept(edges.sparkSession):
        n, x = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return n, x
