"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import stage, unstage


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node reachable.

    Each round writes the edges to the staging folder, so lineage stays short
    and lost executors cost one round. Neighbourhoods are never gathered: a
    node contributes a minimum, aggregated before the shuffle, and a join whose
    large keys adaptive execution splits. The rounds grow with the logarithm of
    the longest chain. Null ends are ignored; loops are nodes of their own.
    """
    plain = stage(edges.where("a is not null and b is not null").select("a", "b"), "links")
    nodes = plain.select(F.col("a").alias("node")).union(plain.select("b")).distinct()
    current = stage(
        plain.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    # Stars around their smallest node stay as they are, so often one round will do.
    seen = _state(current)
    for _ in range(max_rounds):
        before, current = current, stage(_small_star(_large_star(current)), "edges")
        unstage(before)
        if (state := _state(current)) == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(current.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root")
    )


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of its neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = both.where("v > u").join(least, "u").where("v <> m")
    return tied.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select("a", F.col("m").alias("b"))).distinct()
