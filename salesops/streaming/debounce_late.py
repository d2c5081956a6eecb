"""T1 on scans that arrive late: the stream gives what the batch gives, whatever the arrival order.

Devices are dealt by hash into a fixed number of buckets, each with one state:
its devices' last accepted scans and its waiting scans. A scan waits until the
watermark has passed it; then no earlier scan can still come. A bucket is
called when it has new scans, and by an event-time timeout after its latest
waiting one; it takes the waiting scans up to the watermark in order (time,
then id) and applies the rule of their device's last accepted scan. So a batch
calls Python once for a bucket, not several times for each device. Scans older
than the watermark when they arrive are dropped, as everywhere in event-time
streams.

A bucket's waiting scans are those of the watermark's delay and one batch.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from salesops.constants import PY_WHITESPACE, SCAN_REPEAT_MS
from salesops.sources.files import scratch_path

OUT_SCHEMA = "device long, us long, code string, scan_id long"
STATE_SCHEMA = "devices array<string>, codes array<string>, last array<long>, us array<long>, scan_ids array<long>, of array<string>, waiting array<string>"
BUCKETS = 2048  # fixed for a checkpoint's life
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _late(repeat_ms: int):
    limit = int(repeat_ms) * 1000

    def fn(key, pdfs, state):
        last, waiting = {}, []
        if state.exists:
            devices, codes, us, *held = state.get
            last = dict(zip(devices, zip(codes, us, strict=True), strict=True))
            waiting = list(zip(*held, strict=True))
        for batch in pdfs:
            columns = [batch[c].tolist() for c in ("us", "scan_id", "device", "code")]
            for u, i, d, c in zip(*columns, strict=True):
                if isinstance(c, str) and (c := c.strip(PY_WHITESPACE)):
                    waiting.append((int(u), int(i), d, c))
        upto = state.getCurrentWatermarkMs() * 1000
        waiting.sort(key=lambda s: s[:2])
        accepted, n = [], 0
        for us, scan_id, device, code in waiting:
            if us > upto:
                break
            n += 1
            before = last.get(device)
            if before is None or code != before[0] or us - before[1] > limit:
                last[device] = (code, us)
                accepted.append((device, us, code, scan_id))
        rest = waiting[n:]
        if rest or last:
            state.update((list(last), *([x[k] for x in last.values()] for k in range(2)), *([s[k] for s in rest] for k in range(4))))
        if rest:
            state.setTimeoutTimestamp(rest[-1][0] // 1000 + 1)
        if accepted:
            out = pd.DataFrame(accepted, columns=["device", "us", "code", "scan_id"])
            out["device"] = pd.array([None if d is None else int(d) for d in out["device"]], dtype="Int64")
            yield out

    return fn


def debounce_late(scans: DataFrame, repeat_ms: int = SCAN_REPEAT_MS, delay: str = "1 hour") -> DataFrame:
    """Accepted scans (device, us, code, scan_id) of a stream (device, ts, code, scan_id), once ``delay`` has passed them."""
    timed = scans.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("us", F.unix_micros("ts"))
    timed = timed.withWatermark("ts", delay).select("ts", "us", "scan_id", F.col("device").cast("string").alias("device"), "code")  # as text, a missing device stays one
    timed = timed.withColumn("bucket", F.pmod(F.xxhash64("device"), F.lit(BUCKETS)))
    return timed.groupBy("bucket").applyInPandasWithState(_late(repeat_ms), OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)


def run_debounce_late(spark: SparkSession, source_path: str, repeat_ms: int, delay: str, out_path: str | None = None, files_per_trigger: int = 1) -> DataFrame:
    """Run the stream over all files of a folder (events layout) into Parquet; (device, ts, code, scan_id) so far."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string"
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source_path)
    src = src.selectExpr("user_id AS device", "ts", "event_type AS code", "event_id AS scan_id")
    out = out_path or scratch_path(spark, "debounce-late")
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, STATE_PROVIDER)  # waiting scans are kept on disk
    try:
        q = debounce_late(src, repeat_ms, delay).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-checkpoint").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)
    back = spark.read.schema(OUT_SCHEMA).parquet(out)
    return back.select("device", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), "code", "scan_id")
