"""Connected components as Spark jobs, by alternating large-star and small-star steps.

A hub may have any number of neighbours. Its smallest one is found with map-side combining and written as a table of its own,
so that the join with the hub's edges is one of two tables as read, whose large partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import written


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Of undirected edges (a long, b long): node, root (the smallest node of its component), for every node with an edge.

    Rounds grow with the logarithm of a component's width; after ``most_rounds`` an error is raised, never a wrong result. Each
    round is written to the shared folder; only a count and a checksum of the edges reach the driver. Loops and
    repeated edges do no harm; no edges give no rows.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _checksum(edges)
    if not before[0]:
        return _rooted(edges)
    for _ in range(most_rounds):
        edges = written(_small_star(_large_star(edges)))
        after = _checksum(edges)
        if after == before:
            return _rooted(edges)
        before = after
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _rooted(stars: DataFrame) -> DataFrame:
    """Nodes with their roots; the roots, which no edge begins with, too."""
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _checksum(edges: DataFrame) -> tuple[int, int | None]:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _smallest(edges: DataFrame) -> DataFrame:
    """Of each larger end of an edge the smallest neighbour."""
    return written(edges.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "hub"))


def _distinct(edges: DataFrame) -> DataFrame:
    """Distinct edges; the exchange of their own leaves the join before it free to be split."""
    return edges.repartition("a", "b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    smallest = _smallest(edges)
    joined = edges.join(smallest, edges.b == smallest.hub, "left")
    return written(_distinct(joined.select("a", F.coalesce("low", "b").alias("b"))))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    smallest = _smallest(edges)
    joined = edges.join(smallest, edges.a == smallest.hub).select("a", "b", "low")
    both = F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")
    return _distinct(joined.select(both).select("e.a", "e.b").where("a <> b"))
