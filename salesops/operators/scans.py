"""Drop repeated barcode scans (batch form).

Rule, per device and in time order: a scan (code trimmed, non-empty) is
accepted when its code differs from the *last accepted* code or more than
``repeat_ms`` passed since the last accepted scan. The rule chains on
accepted scans, so it is not a ``lag`` or a watermark dedupe.

One shuffle: scans are range-partitioned and sorted by (device, time, id) and
materialised, so a device with a third of all scans spans many pieces. Each
piece is then walked in order, twice, with constant state:

1. a first pass tells how a piece turns the state it is entered with into the
   one it is left with. That is a fixed state as soon as another device, code
   or a pause longer than the limit occurs in the piece (the scan there is
   accepted whatever came before); otherwise it depends on the time of the
   last accepted scan, through the scans of the piece's first ``repeat_ms``
   only, and the pass returns that table, with one step for each exit it has;
2. the pieces' tables, one row each, are chained into every piece's entry
   state, and a second pass emits the accepted scans.

A null device is a device like any other.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesops.constants import SCAN_REPEAT_MS
from salesops.functions.text import py_strip
from salesops.session import checkpoint_dir


def next_accepted_exits(times: list[int], limit: int) -> list[int]:
    """For each scan of one unbroken run of a code: the last scan accepted if it is accepted itself."""
    out = list(times)
    for i in range(len(times) - 1, -1, -1):
        j = bisect_right(times, times[i] + limit, i)
        if j < len(times):
            out[i] = out[j]
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(b.column("device").to_pylist(), b.column("code").to_pylist(), b.column("us").to_pylist(), strict=True)


def summarise_piece(rows: Iterator[tuple], limit: int) -> dict | None:
    """How a piece's entry state becomes its exit state; None for an empty piece.

    ``state``: the exit state (device, code, time) where it does not depend on
    the entry. Where it does (the piece is one unbroken run of one code),
    ``window``/``exits``: scans within the limit of the first, and the time of
    the last accepted scan if the chain starts there, as steps of equal exits.
    """
    first = last = state = None
    run: list[int] = []  # the first unbroken run; only its times may depend on the entry
    for device, code, us in rows:
        if first is None:
            first = (device, code)
        elif state is None and ((device, code) != first or us - last > limit):
            state = (device, code, us)
        elif state is not None and ((device, code) != state[:2] or us - state[2] > limit):
            state = (device, code, us)
        if state is None:
            run.append(us)
        last = us
    if first is None:
        return None
    if state is not None:  # the entry does not matter
        return {"device": first[0], "code": first[1], "window": [], "exits": [], "state": state}
    n = bisect_right(run, run[0] + limit) + 1
    exits = next_accepted_exits(run, limit)[:n]
    # Starts with the same exit are one step of the table; its last one stands for them.
    ends = [i for i in range(len(exits)) if i + 1 == len(exits) or exits[i + 1] != exits[i]]
    return {"device": first[0], "code": first[1], "window": [run[i] for i in ends], "exits": [exits[i] for i in ends], "state": None}


def exit_state(piece: dict, entry: tuple | None, limit: int) -> tuple:
    if piece["state"] is not None:
        return piece["state"]
    own = (piece["device"], piece["code"])
    if entry is None or entry[:2] != own:
        return (*own, piece["exits"][0])
    i = bisect_right(piece["window"], entry[2] + limit)
    return (*own, piece["exits"][i]) if i < len(piece["exits"]) else entry


def debounce_scans(scans: DataFrame, repeat_ms: int = SCAN_REPEAT_MS) -> DataFrame:
    """Accepted scans: (device, ts, code, scan_id); ``scan_id`` breaks time ties."""
    spark, limit = scans.sparkSession, int(repeat_ms) * 1000
    s = scans.select("device", "ts", py_strip(F.col("code")).alias("code"), "scan_id").where(
        F.col("code").isNotNull() & (F.col("code") != "")
    )
    s = s.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    checkpoint_dir(spark)
    order = ["device", "us", "scan_id"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = s.repartitionByRange(n, *order).sortWithinPartitions(*order).checkpoint(eager=True)
    device = f"device {pieces.schema['device'].dataType.simpleString()}, code string"

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = summarise_piece(_rows(batches), limit)
        if p:
            rows = [{**p, "piece": TaskContext.get().partitionId(), "state": p["state"] and dict(zip(("device", "code", "us"), p["state"], strict=True))}]
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    summary = f"piece int, {device}, window array<long>, exits array<long>, state struct<{', '.join(x.replace(' ', ':', 1) for x in device.split(', '))},us:long>"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    shape = to_arrow_schema(StructType.fromDDL(summary))
    entries: dict[int, tuple | None] = {}
    state = None
    found = pieces.select("device", "code", "us").mapInArrow(summarise, summary).orderBy("piece").collect()  # one row per piece
    for r in found:
        entries[r["piece"]] = state
        state = exit_state({"device": r["device"], "code": r["code"], "window": r["window"], "exits": r["exits"], "state": r["state"] and tuple(r["state"])}, state, limit)

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = entries.get(TaskContext.get().partitionId())
        for b in batches:
            keep = []
            for device, code, us in _rows([b]):
                ok = now is None or now[:2] != (device, code) or us - now[2] > limit
                if ok:
                    now = (device, code, us)
                keep.append(ok)
            yield b.filter(pa.array(keep, pa.bool_()))

    return pieces.mapInArrow(accept, pieces.schema).select("device", "ts", "code", "scan_id")
