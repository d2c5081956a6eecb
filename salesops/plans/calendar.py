"""Calendar grids for zero-filling.

A grid has a proven size bound (12 months, ≤ 31 days, ≤ 31 × 3 cells), and so
does the aggregate it is joined with: its keys come from the same calendar.
So both may be broadcast; the lines themselves are never joined here, only
their aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesops.constants import BUCKETS
from salesops.functions.dates import days_in_month


def month_grid(spark: SparkSession) -> DataFrame:
    """month 1..12"""
    return spark.range(1, 13, numPartitions=1).select(F.col("id").cast("int").alias("month"))


def day_grid(spark: SparkSession, year: int, month: int) -> DataFrame:
    """day 1..days-in-month"""
    n = days_in_month(year, month)
    return spark.range(1, n + 1, numPartitions=1).select(F.col("id").cast("int").alias("day"))


def day_bucket_grid(spark: SparkSession, year: int, month: int) -> DataFrame:
    """every (day, bucket) of a month, with the bucket's position 0..2"""
    return day_grid(spark, year, month).select(
        "day",
        F.posexplode(F.array(*[F.lit(b) for b in BUCKETS])).alias("bucket_pos", "bucket"),
    )


def zero_fill(grid: DataFrame, agg: DataFrame, keys, fill: dict) -> DataFrame:
    """Left join a bounded aggregate onto a bounded grid; missing measures → 0."""
    joined = grid.join(F.broadcast(agg), on=list(keys), how="left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})
