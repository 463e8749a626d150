"""Distributed connected components by alternating large-star and small-star steps.

The state is an edge table; a step replaces each node's neighbours by links to the smallest of
them. Minima are ordinary aggregates (combined map-side, so a node with very many neighbours is no
hot group) and are joined back to the edges, where one side has a row per node and adaptive
execution splits the other side of a hot node. Edges are checkpointed each round in the shared
folder; nothing but two counters reaches the driver. Rounds grow with the logarithm of the longest
path."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node links to the node's smallest neighbour (or itself)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return (both.where("b > a").join(low, "a").where("b <> low")
            .select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, link to the smallest of them (a > b here)."""
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    moved = edges.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(low.select("a", F.col("low").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a and b, of one orderable type), where root
    is the smallest node reachable. Self links and rows with a null end are ignored; nodes without
    a link are not listed."""
    state = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(state)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        state = cut(_small_star(_large_star(state)))
        after = _state(state)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = state.select(F.col("b").alias("node")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        roots.select("node", F.col("node").alias("root")))
