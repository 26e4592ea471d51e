"""Connected components by alternating stars, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedloom.sources.staging import stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    low = low.select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    digest = F.xxhash64("u", "v").cast("decimal(20,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(digest)).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``; the root is the smallest node.

    Each round links the neighbours of a node to the smallest of them, larger
    ones first and then smaller ones, until every node points at its root. A
    round moves edges only, in aggregates and joins; none gathers a component.
    Rounds grow with the logarithm of the longest chain. Each is written to the
    shared folder, which cuts the lineage and outlives its executors.
    """
    at = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    at = stage(at.distinct(), "edges")
    state = _state(at)
    while state[0]:
        after = _small_star(_large_star(at)).distinct()
        at = stage(after, "edges")
        before, state = state, _state(at)
        if state == before:
            break
    leaves = at.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = at.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return leaves.unionByName(roots)
