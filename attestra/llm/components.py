"""Connected components by alternating stars, with edges stored after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm.common import cut, in_few_tasks


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Stored apart, so that the join is free to split the neighbours of a hub. The other step groups
    # by the larger id of an edge, which is never a hub.
    least = in_few_tasks(cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))), n)
    return (
        both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Points the smaller neighbours of a node, and the node itself, at the smallest of them."""
    least = edges.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    # The edge to the smallest neighbour is kept; it stands for the node itself.
    node = F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b"))
    return least.select(node.alias("a"), F.col("m").alias("b"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether no node has several smaller neighbours, or both smaller and larger ones."""
    down = edges.select(F.col("a").alias("id"), F.lit(1).alias("down"))
    ends = down.unionByName(edges.select(F.col("b").alias("id"), F.lit(0).alias("down")))
    nodes = ends.groupBy("id").agg(F.sum("down").alias("down"), F.min("down").alias("least"))
    inner = (F.col("down") > 1) | ((F.col("down") == 1) & (F.col("least") == 0))
    return nodes.agg(F.count(F.when(inner, 1))).first()[0] == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, group) for every id in ``edges`` (a, b); the group is the smallest id of a component.

    Each round points every node at the smallest neighbour it knows, so a path of n nodes takes about
    log n rounds. Edges that are stars around their smallest ids take none.
    """
    edges = edges.filter(F.col("a") != F.col("b"))
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n = edges.count()
    edges = in_few_tasks(edges, n)
    while not _are_stars(edges):
        # All edges lead from larger to smaller ids; no round adds any.
        edges = in_few_tasks(cut(_small_star(_large_star(edges, n).distinct()).distinct()), n)
    roots = edges.select(F.col("b").alias("id")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("group")).unionByName(
        roots.select("id", F.col("id").alias("group"))
    )
