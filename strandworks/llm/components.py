"""Connected components of a graph held as a table of edges, with ids as labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rounds are logarithmic in the longest path; this many would do for any graph that fits a cluster.
MOST_ROUNDS = 64


def _to_smallest(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Links each node's neighbours to the smallest of the node and its neighbours.

    edges: (a, b), each pair once. Neighbours are the larger ones (large-star) or the smaller ones and the node itself (small-star).
    The smallest is a partial aggregate, and the join brings it back to rows of single links, so a hub's rows never meet in one task's memory.
    """
    if larger_only:
        links = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = links.where("v > u").join(least, "u")
    else:
        links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        out = links.join(least, "u").select("v", "m").union(least.select(F.col("u").alias("v"), "m"))
    return out.where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node of edges (a, b): the smallest node that can be reached. Nodes are integers; loops and repeats do no harm.

    Alternating large-star and small-star rounds; each round's links are a table in the shared folder. Ends when a round changes no link, found by comparing
    the count and two hashes' sums of the links, which are all that comes to the driver.
    """

    def state(df: DataFrame):
        h = F.xxhash64("a", "b")
        return df.agg(F.count("*"), F.sum(F.shiftright(h, 32)), F.sum(h.bitwiseAND(0xFFFFFFFF))).first()

    links = common.stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = state(links)
    for _ in range(MOST_ROUNDS):
        if not before[0]:
            break
        old, links = links, common.stored(_to_smallest(_to_smallest(links, True), False), name)
        common.discard(old)
        now = state(links)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components didn't settle")
    # now stars: each node once, linked to its component's smallest
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
