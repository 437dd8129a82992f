"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two aggregations and two joins on the edge table; the rounds needed grow with the logarithm of
the largest component.  Each round's edges are written to the shared folder, so neither lineage nor driver
memory grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import written

c = F.col


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour (or the node itself)."""
    both = edges.select("u", "v").union(edges.select(c("v").alias("u"), c("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where(c("v") > c("u")).join(low, "u").select(c("v").alias("u"), c("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to its smallest neighbour."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(low, "u").select(c("v").alias("u"), c("m").alias("v"))
    return tied.union(low.select("u", c("m").alias("v"))).where("u <> v").distinct()


def _mark(edges: DataFrame):
    """Order-free digest of an edge table; it stays the same once nothing moves."""
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return edges.agg(F.count("*"), F.sum(h)).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge; ``edges`` has long columns u and v, loops are ignored.

    The component is the smallest node reachable.  Null ends are ignored; an empty table gives an empty table.
    """
    now = written(edges.select("u", "v").where("u <> v").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        now = written(_small_star(_large_star(now)), "edges")
        after = _mark(now)
        if after == mark:
            break
        mark = after
    roots = now.select(c("v").alias("node")).distinct()
    return now.select(c("u").alias("node"), c("v").alias("component")).unionByName(
        roots.select("node", c("node").alias("component")))
