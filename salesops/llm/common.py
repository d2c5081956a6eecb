"""Shared helpers: table reading, stored intermediates, word hashing."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesops.session import checkpoint_dir

# Words are separated by these six ASCII characters only.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
# Texts are hashed in slices of about this many bytes, cut at white space, so
# memory is bounded however long a text is.
SLICE_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage: a lost executor costs a re-read, and values that must stay
    the same in every later use (row ids, samples) are fixed.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``stored`` and the path, for a table that is given up with ``forget``."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Delete a stored table that a later one, already written, stands in for."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def tree_merge(parts: DataFrame, keys: list[str], merge: Callable, name: str, fan_in: int = 16) -> DataFrame:
    """One row per ``keys``: rows with neighbouring ``place`` (an int, unique within the keys) merged, round by round.

    ``merge(key, table)`` gives one Arrow row for at most ``fan_in`` of them, sorted
    by place, so no task holds more, however many partitions there were.
    """
    parts = stored(parts, name)
    last = parts.agg(F.max("place")).first()[0] or 0

    def run(key, table):
        return merge(key, table.sort_by("place"))

    while last > 0:
        up = parts.withColumn("up", F.floor(F.col("place") / fan_in).cast("int"))
        merged = up.groupBy(*keys, "up").applyInArrow(run, up.schema)
        parts = stored(merged.withColumn("place", F.col("up")).drop("up"), name)
        last //= fan_in
    return parts


def vector_column(df: DataFrame, name: str) -> Column:
    """A list column as floats or doubles; these two pass as they are."""
    kind = df.select(F.col(name)).schema[0].dataType.simpleString()
    return F.col(name) if kind in ("array<float>", "array<double>") else F.col(name).cast("array<double>")


def finite_by_length(column: pa.Array, limit: float = float("inf")) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix of doubles) of each length above 0 in an Arrow list column.

    Rows that are null or hold a null or non-finite entry, or one of ``limit`` or more, are left out.
    """
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for d in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == d)
        flat = column.take(pa.array(at)).flatten() if len(at) < len(sizes) else column.flatten()
        m = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), int(d))  # nulls become NaN
        ok = (np.abs(m) < limit).all(axis=1)
        if ok.any():
            yield int(d), at[ok], m[ok]


def small(batches: Iterator, rows: int = 500) -> Iterator:
    """Arrow batches cut into smaller ones, so that few texts are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def release_tokens() -> None:
    """Drop the tokenizer and the remembered chunks that an earlier stage left in this worker.

    Spark's Python workers serve one stage after another, so what one keeps for
    its next task stands beside the next stage's memory.
    """
    if (tokens := sys.modules.get("salesops.llm.tokens")) and tokens._LOADED:
        tokens._LOADED.clear()
        give_back()


def give_back() -> None:
    """Return freed memory to the system, which Arrow's pool and the C library otherwise keep for later."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` of one partition, and ``give_back`` at its end: an idle worker stands beside what the executor does next."""

    @wraps(run)
    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return whole


def unused(name: str, columns: list[str]) -> str:
    """``name`` or the first of its longer forms that is no column yet."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def valid_vector(v: Column) -> Column:
    """Not null and every component present and finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return v.isNotNull() & ~F.coalesce(F.exists(v.cast("array<double>"), bad), F.lit(True))


def lists_to_matrix(column) -> np.ndarray:
    """An Arrow list column of equal lengths as a 2-d array."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    if hasattr(column, "chunks"):
        column = column.chunk(0)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    n = len(column)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


# --- words as 64-bit hashes -------------------------------------------------

_MULT = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64."""
    if len(_POWERS.get("p", ())) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        inverse = pow(_MULT, -1, 1 << 64)
        for key, base in (("p", _MULT), ("i", inverse)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _POWERS[key] = np.multiply.accumulate(a)
    return _POWERS["p"], _POWERS["i"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(data: bytes) -> Iterator[bytes]:
    """Cut at white space into slices of about SLICE_BYTES."""
    at = 0
    while len(data) - at > SLICE_BYTES:
        end = at + SLICE_BYTES
        window = np.frombuffer(data, np.uint8, end - at, at)
        spaces = np.flatnonzero(_IS_SPACE[window[-65536:]])
        if len(spaces):
            end = end - 65536 + int(spaces[-1])
        else:  # a word of over 64 KiB: go on to its end
            rest = np.frombuffer(data, np.uint8, len(data) - end, end)
            stop = np.flatnonzero(_IS_SPACE[rest])
            end = end + int(stop[0]) if len(stop) else len(data)
        yield data[at:end]
        at = end
    yield data[at:]


def hash_slice(data: bytes, apart: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte) of each word; ``apart``: which bytes separate words."""
    raw = np.frombuffer(data, np.uint8)
    solid = ~apart[raw]
    edge = np.diff(np.concatenate(([0], solid.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, np.uint64), start, end
    power, inverse = _powers(len(raw))
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
    return mix64((total[end] - total[start]) * inverse[start]), start, end


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the lower-cased words of one whole text."""
    if not text:
        return np.empty(0, np.uint64)
    parts = [hash_slice(x)[0] for x in slices(text.encode("utf-8", "surrogatepass"))]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def batch_word_hashes(texts: list[str | None]) -> Iterator[np.ndarray]:
    """``word_hashes`` of each text; short texts are hashed together."""
    group: list[bytes] = []
    held = 0

    def flush():
        if not group:
            return
        sizes = np.fromiter(map(len, group), np.int64, len(group)) + 1
        h, start, _ = hash_slice(b"\n".join(group))
        cuts = np.searchsorted(start, np.cumsum(sizes))
        at = 0
        for c in cuts:
            yield h[at:c]
            at = c
        group.clear()

    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if held + len(data) > SLICE_BYTES:
            yield from flush()
            held = 0
        if len(data) > SLICE_BYTES:
            yield word_hashes(text)
        else:
            group.append(data)
            held += len(data) + 1
    yield from flush()
