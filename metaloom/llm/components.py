"""Connected components of a graph held as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step of star contraction: neighbours above a node (large) or at most it (small) point to its least one."""
    pairs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).withColumn("least", F.least("node", "least"))
    least = stored(least, "least")  # so that the join can split the edges of a node with very many
    joined = pairs.join(least, pairs["a"] == least["node"])
    if large:
        return joined.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a != b").distinct()
    return joined.select("b", "least").unionByName(joined.select(F.col("a").alias("b"), "least")).filter("b != least").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: each node points to one other, which points to none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in")).filter("out > 1 OR (out = 1 AND in = 1)").isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Nodes of edges (a, b), of any one type with an order, with the smallest node of their component: node, component.

    Rounds of large and small stars until only stars are left; each is written to the shared folder. Loops and nulls are
    ignored, repeated edges count once. No node's neighbours ever stand in one row.
    """
    now = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most_rounds):
        if _settled(now):
            break
        now = stored(_stars(_stars(now, True), False), "edges")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
