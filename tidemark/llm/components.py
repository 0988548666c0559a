"""Connected components of a distributed edge list, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def components(edges: DataFrame, most: int = 50) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge. edges: a, b.

    A large star links a node's larger neighbours to the smallest around it, a small star its
    smaller ones; edges never grow in number, and after about log(nodes) rounds each node is
    linked to its smallest. Edges are stored after each round; only two sums meet the driver.
    """
    now = stored(_distinct(edges), "edges")
    mark = _mark(now)
    for _ in range(most):
        now = stored(_distinct(_star(_distinct(_star(now, True)), False)), "edges")
        if (new := _mark(now)) == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def _distinct(edges: DataFrame) -> DataFrame:
    """Each edge once, the smaller node first."""
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    both = around.join(least, "u")
    if large:
        return both.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return both.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
