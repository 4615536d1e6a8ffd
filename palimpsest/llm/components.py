"""Connected components of a graph held as a DataFrame of edges, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import settle


def _least_neighbours(edges: DataFrame) -> DataFrame:
    """(node, least) with the least of each node and its neighbours; summed up before the shuffle, so a hub costs no more than others."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; a component is named by its least node.

    Large-star links the larger neighbours of a node to its least neighbour,
    small-star the smaller ones; the stars that remain when nothing changes are
    the components. The number of edges never grows, each round is a grouping
    and a join, and each is checkpointed. Loops and repeated edges are allowed;
    null ends are ignored. An empty table gives an empty result.
    """
    edges = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(most_rounds):
        both = _both_ways(edges)
        large = both.join(_least_neighbours(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        low = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = low.groupBy("u").agg(F.min("v").alias("least"))
        small = low.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("least").alias("v")), F.struct("u", F.col("least").alias("v")))).alias("e")).select("e.u", "e.v")
        after = settle(small.where("u <> v").distinct())
        # stars: no node has two centres, and no centre has one of its own
        two = after.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        if not two and not after.select(F.col("v").alias("u")).distinct().join(after, "u", "left_semi").limit(1).count():
            edges = after
            break
        edges = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
