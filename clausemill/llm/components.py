"""Connected components of an edge table, by stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.common import saved


def _to_smallest(arcs: DataFrame) -> DataFrame:
    """``arcs`` (a, b) with the smallest ``b`` of each ``a``; the aggregate combines before the shuffle."""
    return arcs.join(arcs.groupBy("a").agg(F.min("b").alias("least")), "a")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (``a``, ``b``); the root is the smallest node that can be reached.

    Large-star steps hang the larger neighbours of a node below its smallest
    neighbour, small-star steps the smaller ones; both shorten all paths until
    every component is a star. No step gathers a component: nodes are joined
    with one smallest neighbour each, and edges are written between rounds.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _to_smallest(both).where("b > a").select(F.col("b").alias("a"), F.least("least", "a").alias("b"))
        large = large.unionByName(_kept(both)).distinct()
        down = _to_smallest(large)
        small = down.select("a", F.col("least").alias("b")).unionByName(
            down.where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        )
        now, before = saved(small.distinct(), "edges"), mark
        mark = _mark(now)
        if mark == before:
            break
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select(F.col("b").alias("node"), F.col("b").alias("root"))
    )


def _kept(both: DataFrame) -> DataFrame:
    """The link of each node to its smallest smaller neighbour, so that no node falls out."""
    least = both.groupBy("a").agg(F.min("b").alias("b"))
    return least.where("b < a")


def _mark(edges: DataFrame) -> tuple:
    """Changes when the edges change; one row."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 40)).alias("h")).first()
    return (row.n, row.h)
