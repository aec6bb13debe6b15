"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.native import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: link every larger neighbour to the least of the neighbourhood; small: the smaller ones and the node itself."""
    if large:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``; the root is the least node of its component.

    Each step is a written table, so lineage stays short and lost executors cost one step. An empty edge table gives an
    empty result; loops and repeated edges do no harm.
    """
    steps = Scratch()
    current = steps.stored(edges.filter("a <> b").distinct(), "edges")
    state = _state(current)
    while state[0]:
        current = steps.stored(_star(_star(current, True), False), "edges")
        steps.drop(keep_last=1)
        before, state = state, _state(current)
        if state == before:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
