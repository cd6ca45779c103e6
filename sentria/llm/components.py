"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentria.llm.common import staged


def _minimum(edges: DataFrame, key: str, other: str) -> DataFrame:
    """Smallest neighbour per node; written, so that the join with it can split a hub's rows."""
    return staged(edges.groupBy(key).agg(F.min(other).alias("m")), "star-min")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of node and neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _minimum(both, "a", "b")
    tied = both.join(low, "a").where("b > a")
    return tied.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """The smaller neighbours of a node, and the node, are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = _minimum(down, "a", "b")
    moved = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of (a, b) is connected with.

    Edges have no direction; loops and nulls are dropped. Nodes without another
    node do not occur in the result. It runs until nothing changes; each round at
    least halves the depth of the trees, in practice.
    """
    now = staged(edges.where("a <> b").select("a", "b").distinct(), "edges")
    state = _state(now)
    while state[0]:
        now = staged(_small_star(staged(_large_star(now), "large-star")), "small-star")
        new = _state(now)
        if new == state:
            break
        state = new
    labelled = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labelled.union(now.select(F.col("b"), F.col("b"))).distinct()
