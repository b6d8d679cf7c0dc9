"""Connected components of a large graph: alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step on edges (u, v) with u > v: neighbours hook to the least node around them.

    small: each node's smaller neighbours and the node itself; large: its larger neighbours. Nodes of many edges are only ever
    aggregated and joined, never collected.
    """
    around = edges.select("u", "v") if small else edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = around.join(least, "u")
    if small:
        made = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        made = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return made.where("u <> v").distinct()


def components(edges: DataFrame, most: int = 50) -> DataFrame:
    """(u, v) -> (node, least): the least node of each node's component, for all nodes but the least ones themselves.

    Rounds grow with the logarithm of the size; labels that haven't settled after `most` rounds are an error.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    said = None
    for _ in range(most):
        edges = written(_star(_star(edges, False), True), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == said:
            break
        said = tuple(now)
    else:
        raise RuntimeError(f"components haven't settled after {most} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("least"))
