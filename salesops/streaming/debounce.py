"""T1 as a Structured Streaming job: per-device state in the state store.

Each micro-batch holds a bounded slice of the stream (``maxFilesPerTrigger`` /
``maxOffsetsPerTrigger``); a device's scans in that slice are sorted by time
and folded against the device's state ``(last_code, last_us)``, which the
state store keeps (and checkpoints) between batches. Scans that arrive late
are applied in arrival order, as a live scanner would see them.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupStateTimeout

from salesops.constants import PY_WHITESPACE, SCAN_REPEAT_MS
from salesops.sources.files import scratch_path

FILES_PER_TRIGGER = 64  # bounds a micro-batch, and so a device's slice of it
OUT_SCHEMA = "device long, ts timestamp_ntz, code string, scan_id long"
STATE_SCHEMA = "last_code string, last_us long"


def _fold(repeat_ms: int):
    limit = int(repeat_ms) * 1000

    def fn(key, pdfs, state):
        if state.exists:
            last_code, last_us = state.get
        else:
            last_code, last_us = None, None
        batch = pd.concat(list(pdfs), ignore_index=True)
        batch["code"] = batch["code"].astype("string").str.strip(PY_WHITESPACE)
        batch = batch[batch["code"].notna() & (batch["code"] != "")]
        batch = batch.sort_values(["ts", "scan_id"], kind="mergesort")
        us = batch["ts"].astype("datetime64[us]").astype("int64").to_numpy()
        codes = batch["code"].to_numpy()
        keep = []
        for i in range(len(batch)):  # the rule chains on the last accepted scan
            if last_code is None or codes[i] != last_code or us[i] - last_us > limit:
                last_code, last_us = codes[i], int(us[i])
                keep.append(i)
        if last_code is not None:
            state.update((last_code, last_us))
        out = batch.iloc[keep][["device", "ts", "code", "scan_id"]]
        yield out

    return fn


def debounce_stream(scans: DataFrame, repeat_ms: int = SCAN_REPEAT_MS) -> DataFrame:
    """A streaming DataFrame of accepted scans (append mode)."""
    return scans.groupBy("device").applyInPandasWithState(
        _fold(repeat_ms), OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout
    )


def run_debounce(
    spark: SparkSession,
    source_path: str,
    repeat_ms: int = SCAN_REPEAT_MS,
    max_files_per_trigger: int = FILES_PER_TRIGGER,
    out_path: str | None = None,
    name_glob: str | None = None,
) -> DataFrame:
    """Run the stream over the Parquet files in the folder ``source_path``
    (events layout; ``name_glob`` picks files) to the end (``availableNow``)
    into Parquet; return the written result."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    src = reader.parquet(source_path).selectExpr("user_id AS device", "ts", "event_type AS code", "event_id AS scan_id")
    out = out_path or scratch_path(spark, "debounce")
    q = (
        debounce_stream(src, repeat_ms)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", os.path.join(out + "-checkpoint"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(OUT_SCHEMA).parquet(out)
