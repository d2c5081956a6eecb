"""Settling a batch as if its rows came one by one, where one row's outcome decides the next one's.

Whether a row is accepted can depend on a chain through all rows before it
that share a key with it, so rows that no chain of keys connects are settled
apart: connected components of the keys are found in a number of rounds that
grows with the logarithm of a component's size, and each component is walked
in order by one task. A component of more than ``PIECE_ROWS`` rows is walked in
pieces of that size, one after the other, so no task holds more; what earlier
pieces decided comes to the next one as a table, cut down to its keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesops.plans.numbering import number_within
from salesops.sources.files import written

PIECE_ROWS = 500_000


def node(kind: str, *cols: str) -> Column:
    """A key as a graph node; two keys that meet by chance only share a walk."""
    return F.xxhash64(F.lit(kind), *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols])


def _to_least(pairs: DataFrame) -> DataFrame:
    """``x, y, low``: each pair with the least of x and all of its partners."""
    low = pairs.groupBy("x").agg(F.min("y").alias("_y"))
    return pairs.join(low, "x").select("x", "y", F.least("x", "_y").alias("low"))


def components(edges: DataFrame, max_rounds: int = 80) -> DataFrame:
    """``node, group`` of every node of ``edges`` (longs ``x, y``); the group is its least node.

    Every round ties all partners above a node to the least of its
    neighbourhood, then a node and its lower partners to the least of these,
    until each edge leads from a node to its group's least one. A
    neighbourhood is reduced to its minimum, never gathered.
    """
    down = lambda df: df.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    now, seen = written(down(edges.select("x", "y")), "edges"), None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        up = down(_to_least(both).where("y > x").select(F.col("y").alias("x"), F.col("low").alias("y")))
        tied = _to_least(up)
        now = written(down(tied.select(F.col("y").alias("x"), F.col("low").alias("y")).unionByName(tied.select("x", F.col("low").alias("y")))), "edges")
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")).alias("s")).first()
        if mark == seen:
            roots = now.select(F.col("y").alias("node")).distinct().withColumn("group", F.col("node"))
            return now.select(F.col("x").alias("node"), F.col("y").alias("group")).unionByName(roots)
        seen = mark
    raise RuntimeError("components did not settle")


def walk(rows: DataFrame, order: list[str], step: Callable[[DataFrame, DataFrame | None], DataFrame], piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``step(rows of a piece, outcomes so far)`` for each piece of the rows' groups, in order; all outcomes.

    ``rows`` has a ``group``; ``step`` returns a frame with a ``group`` walk's outcomes.
    """
    rows = written(rows, "walk-rows")
    largest = rows.groupBy("group").count().agg(F.max("count")).first()[0] or 0
    if largest <= piece_rows:
        return written(step(rows, None), "walk")
    placed = written(number_within(rows, ["group"], order, "_place").withColumn("_piece", F.floor((F.col("_place") - 1) / piece_rows)), "walk-pieces")
    done = None
    for p in range(-(-largest // piece_rows)):
        out = written(step(placed.where(F.col("_piece") == p).drop("_place", "_piece"), done), "walk")
        done = out if done is None else done.unionByName(out)
    return done
