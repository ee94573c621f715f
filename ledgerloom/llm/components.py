"""Distributed union-find: connected components by alternating star steps.

Large-star connects every larger neighbour of a node to the smallest node of
its neighbourhood, small-star does the same with the smaller ones; repeated,
they turn every component into a star around its smallest node. The smallest
neighbour comes from an aggregate with partial sums, and edges meet it in an
equi-join that adaptive execution may split, so a hub with a third of all
edges is never one task's work. Each round is written to the shared folder
(no lineage to recompute, nothing kept on one executor).

Nodes are of any one orderable type; self-loops and repeated edges are
harmless; nodes without an edge are not returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import written


def _star(pairs: DataFrame) -> DataFrame:
    """(a, least): for each node a, the smallest of itself and its partners."""
    return pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node reachable."""
    big, small = F.greatest(a, b), F.least(a, b)
    edges = written(edges.where(F.col(a) != F.col(b)).select(big.alias("a"), small.alias("b")).distinct(), "cc")
    while not edges.isEmpty():
        # large-star: all neighbours v > u of u go to the least of u's neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (both.join(_star(both), "a").where(F.col("b") > F.col("a"))
                 .select(F.col("b").alias("a"), F.col("least").alias("b")))
        large = large.where("a <> b").distinct()
        # small-star: u and its smaller neighbours go to the least of them
        down = _star(large)
        small = (large.join(down, "a").where(F.col("b") != F.col("least"))
                 .select(F.col("b").alias("a"), F.col("least").alias("b")))
        step = written(small.unionByName(down.select("a", F.col("least").alias("b"))).distinct(), "cc")
        # a star forest: no node is both a member and a centre, no member has two centres
        again = step.select(F.col("b").alias("a")).join(step, "a", "left_semi").isEmpty() and \
            step.groupBy("a").count().where("count > 1").isEmpty()
        edges = step
        if again:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
