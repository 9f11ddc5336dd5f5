"""Connected components of an edge table by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilia.llm import common


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step on edges (a, b), a < b. Large: every larger neighbour of a node moves to the least of its
    neighbourhood; small: the node and its smaller neighbours do."""
    both = edges.select(F.col("b").alias("node"), F.col("a").alias("other"))
    if not small:
        both = both.unionByName(edges.select(F.col("a").alias("node"), F.col("b").alias("other")))
    least = both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("least"))
    moved = both.filter("other > node") if not small else both
    out = moved.join(least, "node").select(F.col("least").alias("a"), F.col("other").alias("b"))
    if small:
        out = out.unionByName(least.select(F.col("least").alias("a"), F.col("node").alias("b")))
    return out.filter("a < b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), a < b; root is the component's least node.

    Each round is checkpointed in the shared folder; the loop ends when a round leaves the edges as they were (then
    they are stars around each component's least node). Only two sums per round reach the driver."""
    edges, before = common.write_cut(edges.select("a", "b")), None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        edges = common.write_cut(_star(_star(edges, small=False), small=True))
    nodes = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return nodes.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
