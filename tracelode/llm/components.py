"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.session import materialize


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``; the root is the least node of the component.

    Each round moves every node's larger neighbours, then its smaller ones, to its least neighbour; a chain of n nodes
    needs about log2(n) rounds.  Links are never collected; a node of any degree is pre-aggregated to its least neighbour
    and joined back."""
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    seen = _state(edges)
    for _ in range(rounds):
        edges = materialize(_small_star(_large_star(edges)))
        state = _state(edges)
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` hold a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a")
    return moved.select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("least").alias("b"))).distinct()
