"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import checkpointed
from inkspan.llm.skew import salted_join

MAX_ROUNDS = 60


def least_neighbours(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("__n"))


def large_star(edges: DataFrame, count: int, most: int) -> DataFrame:
    """Each larger neighbour of a node is linked to the least of the node's neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = salted_join(both, least_neighbours(both), "u", "__n", "v", 2 * count, most)
    return joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u != v")


def small_star(edges: DataFrame, count: int, most: int) -> DataFrame:
    """Each smaller neighbour of a node, and the node, is linked to the least of them. Edges run from larger to smaller."""
    least = least_neighbours(edges)
    rest = salted_join(edges, least, "u", "__n", "v", count, most).filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge, root being the least node of its component.

    `edges` has columns u and v of one orderable type; loops and repeats are
    allowed. Groups meet by partial minima and joins, never in one task: the
    edges of a node with many are dealt out. Each round is cut off by a
    checkpoint; the rounds end when all edges are stars: no node has two edges
    to smaller ones, or one to a smaller and one to a larger.
    """
    edges = checkpointed(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(MAX_ROUNDS):
        ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("down")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("down")))
        degrees = ends.groupBy("n").agg(F.sum("down").alias("down"), F.count("*").alias("all"))
        now = degrees.agg(F.sum("down").alias("edges"), F.max("all").alias("most"), F.count(F.when((F.col("down") > 0) & (F.col("all") > 1), 1)).alias("open")).first()
        if not now.open:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        edges = checkpointed(small_star(large_star(edges, now.edges, now.most), now.edges, now.most))
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
