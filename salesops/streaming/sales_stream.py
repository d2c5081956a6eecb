"""Sale requests arriving as a stream, recorded batch by batch.

Each micro-batch runs the batch pipeline — validate (E3), number orders per
dataset after the last number (E2), one row per item (E1), append (S5):

* the per-dataset counters have one version per batch, of the datasets that
  changed in it (``counters/batch_id=<n>``); a batch reads each dataset's newest
  version before it, or the catalog's counter;
* sales rows are written under ``batch_id=<n>`` with dynamic partition
  overwrite, so a batch that is retried after a failure replaces its own
  output instead of adding it twice.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesops.constants import SALES_COLUMNS
from salesops.operators import records
from salesops.sources.files import path_exists, scratch_path

FILES_PER_TRIGGER = 64  # bounds a micro-batch

REQUEST_SCHEMA = (
    "dataset_id long, request_id long, ts timestamp_ntz, payment_type string, "
    "items array<struct<item: string, quantity: int, price: decimal(10,2), category: string>>"
)


def _latest_counters(spark: SparkSession, counters_path: str, before: int, datasets: DataFrame | None) -> DataFrame:
    """Each dataset's last order number: the newest version before this batch, else the catalog's.

    Only the absence of the folder means that nothing was counted yet; any
    other failure to read it fails the batch, as numbering would start again.
    """
    counted = spark.range(0).select(F.col("id").alias("dataset_id"), F.col("id").alias("last_order_number"))  # no Python workers for no rows
    if path_exists(spark, counters_path):
        versions = spark.read.schema("dataset_id long, last_order_number long, batch_id long").parquet(counters_path).where(F.col("batch_id") < before)
        counted = versions.groupBy("dataset_id").agg(F.max_by("last_order_number", "batch_id").alias("last_order_number"))
    if datasets is None:
        return counted
    known = datasets.select("dataset_id", "last_order_number").join(counted, "dataset_id", "left_anti")
    return counted.unionByName(known)


def record_batch(batch: DataFrame, batch_id: int, sales_path: str, counters_path: str, datasets: DataFrame | None = None) -> None:
    spark = batch.sparkSession
    batch = batch.persist()  # read by validation, numbering, rows and counters
    numbered = None
    try:
        headers = batch.select("dataset_id", "request_id", "ts", "payment_type")
        lines = batch.select("request_id", F.posexplode("items").alias("line", "it")).select(
            "request_id", "line", "it.item", "it.quantity", "it.price", "it.category"
        )
        counters = _latest_counters(spark, counters_path, batch_id, datasets)
        ok = records.validate_sales(headers, lines).where("is_valid").select("request_id")
        valid = headers.join(ok, "request_id", "left_semi")
        numbered = records.assign_order_ids(valid, counters).persist()  # read by rows and counters
        # Requests are joined whole: a quarter of the rows to shuffle and sort, if a request has four items.
        rows = records.sale_rows(numbered, batch.select("request_id", "items")).select("request_id", "line", *SALES_COLUMNS)
        changed = numbered.groupBy("dataset_id").agg(F.max("order_number").alias("last_order_number"))  # of this batch only
        for out, path in ((rows, sales_path), (changed, counters_path)):
            (out.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))
    finally:
        if numbered is not None:
            numbered.unpersist()
        batch.unpersist()


def run_sales_stream(
    spark: SparkSession,
    requests_path: str,
    out_root: str | None = None,
    max_files_per_trigger: int = FILES_PER_TRIGGER,
    datasets: DataFrame | None = None,
) -> tuple[str, str]:
    """Record every request file under ``requests_path`` (JSON lines in the
    REQUEST_SCHEMA layout) to the end; return (sales_path, counters_path).
    ``datasets`` is the catalog, whose counters hold until a batch moves them on."""
    root = out_root or scratch_path(spark, "sales-stream")
    sales_path, counters_path = os.path.join(root, "sales"), os.path.join(root, "counters")
    reader = spark.readStream.schema(REQUEST_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
    q = (
        reader.json(requests_path)
        .writeStream.foreachBatch(lambda df, i: record_batch(df, i, sales_path, counters_path, datasets))
        .option("checkpointLocation", os.path.join(root, "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return sales_path, counters_path
