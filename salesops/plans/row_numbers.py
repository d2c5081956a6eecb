"""Row numbers of plain text files, as they stand in the files.

A table has no row order, but a file has. Spark reads a large file in splits;
the hidden ``_metadata`` column tells a row's file and where its split starts,
and rows of one split come in order within one task. So a row's place in its
split is the distance of its running id from the split's first one, and the
rows of all splits before it are a running sum over one small row per split.

The files are parsed once, by tasks that take many small splits one after the
other (a split keeps its own running ids), and written with their ids below
the shared checkpoint folder. No rows are shuffled, but joined with the splits'
table, which is written too, so the join is planned by its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesops.sources.files import written

TASK_BYTES = 128 * 1024 * 1024  # splits that one task reads
TASK_SPLITS = 32  # and no more of them: a reader keeps its buffers (2 MB of a CSV parser) until the task ends
TASKS_PER_CORE = 3  # no fewer tasks than that


def _few_tasks(marked: DataFrame) -> DataFrame:
    """Small splits read by one task in turn, so there are fewer tasks than splits; a task's memory is bounded by its splits."""
    spark = marked.sparkSession
    splits = marked.rdd.getNumPartitions()
    held = min(TASK_SPLITS, max(1, TASK_BYTES // spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()))
    tasks = max(-(-splits // held), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    return marked.coalesce(tasks) if tasks < splits else marked


def with_row_numbers(rows: DataFrame, row_col: str = "row_number", file_col: str = "file", position_col: str = "position", first: int = 1) -> DataFrame:
    """Adds the file's path, a row's number in it (from ``first``; 2 counts a header
    line as in a sheet) and ``position_col``, its place over all files in path order, from 1.

    ``rows`` is a plain scan of files (``spark.read.csv`` and the like; columns
    may be selected, rows not yet filtered).
    """
    names = rows.columns
    marked = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    marked = written(_few_tasks(marked), "marked")
    splits = written(_few_tasks(marked).groupBy("_file", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows")), "splits")
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file: the running sum over files is over their count, not their rows.
    files = splits.groupBy("_file").agg(F.sum("_rows").alias("_held"))
    files = files.withColumn("_earlier", F.coalesce(F.sum("_held").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_held")
    splits = splits.withColumn("_above", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    places = written(splits.join(files, "_file").drop("_rows"), "places")
    joined = marked.join(places, ["_file", "_start"])
    at = F.col("_id") - F.col("_first") + F.col("_above")
    return joined.select(F.col("_file").alias(file_col), (at + first).cast("bigint").alias(row_col), (at + F.col("_earlier") + 1).cast("bigint").alias(position_col), *names)
