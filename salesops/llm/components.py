"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesops.llm.common import stored


def _least(edges: DataFrame) -> DataFrame:
    """Edges ``u, v`` with each u's least neighbour or itself, ``m``."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("least")), "u").withColumn("m", F.least("u", "least"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` of every node of ``edges`` (longs ``a, b``); component: its least node.

    Large star: every neighbour above u is tied to the least of u's
    neighbourhood. Small star: u and its lower neighbours are tied to the
    least of them. Neighbourhoods are never collected: each step is a grouped
    minimum and a join. Rounds grow with the logarithm of a component's size.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        starred = _least(low)
        small = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(starred.select("u", F.col("m").alias("v")))
        now = stored(small.where("u <> v").distinct(), "edges")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    # Settled: every edge ties a node to its component's least node.
    least = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(least)
