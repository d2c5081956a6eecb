"""Dense numbering within groups, without putting a group in one task.

``row_number() OVER (PARTITION BY key ORDER BY …)`` sends every row of a key
to one task; with a key holding a third of the data that task is the job.
Here a key's rows are spread over range partitions instead, with one shuffle:

1. range-partition on (key, order) — a hot key spans many partitions — sort
   inside each and write that once, with each row's piece and place, below the
   shared checkpoint folder, so they stay fixed even if executors are lost;
2. a row's place in its partition is known from there on; the first place and
   the number of rows of each (key, partition) are one small aggregate, at most
   #partitions rows per key;
3. a running sum of the counts gives each piece's offset; one join on (key,
   partition) adds it (AQE broadcasts that side when its measured size allows).

Keys may be null: null is a key like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesops.sources.files import written


def _ranged(df: DataFrame, keys, order, partitions: int | None) -> DataFrame:
    """Range-partitioned and sorted on keys + order, with ``_part`` and the place ``_at``, materialised once."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c) for c in [*keys, *order]]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumns({"_part": F.spark_partition_id(), "_at": place})
    return written(ranged, "ranged")


def _before(keys):
    return Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def _join_pieces(rows: DataFrame, pieces: DataFrame, keys) -> DataFrame:
    """Join per-(key, piece) values; null keys meet null keys."""
    pieces = written(pieces, "pieces")  # so the join is planned by its size: the rows are not shuffled again
    p = pieces.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in pieces.columns if c not in [*keys, "_part"]])
    on = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(p, on).drop("_p", *[f"_k{i}" for i in range(len(keys))])


def number_within(
    df: DataFrame, keys, order, name: str = "n", partitions: int | None = None, keep_part: bool = False,
    after: DataFrame | None = None, start: int = 0,
) -> DataFrame:
    """Add ``name`` = 1, 2, … per ``keys`` group, in ``order`` (must be a total order).

    With ``keep_part`` the range piece id and place stay as ``_part`` and
    ``_at``, so a later step in the same order can reuse the pieces. A group
    goes on from its ``last`` in ``after`` (keys, last), or from ``start``: that
    is joined to the pieces, not to the rows."""
    keys, order = list(keys), list(order)
    ranged = _ranged(df, keys, order, partitions)
    pieces = ranged.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_cnt"))
    pieces = pieces.withColumn("_off", F.coalesce(F.sum("_cnt").over(_before(keys)), F.lit(0)) - F.col("_first") + 1).drop("_first", "_cnt")
    if after is not None:
        pieces = pieces.join(after, keys, "left").withColumn("_off", F.col("_off") + F.coalesce("last", F.lit(start))).drop("last")
    out = _join_pieces(ranged, pieces, keys).withColumn(name, (F.col("_off") + F.col("_at")).cast("bigint")).drop("_off")
    return out if keep_part else out.drop("_part", "_at")


def running_max_within(df: DataFrame, keys, order, value: str, name: str, partitions: int | None = None) -> DataFrame:
    """Add ``name`` = max of ``value`` over the key's rows up to this one (in
    ``order``); nulls are skipped. Same layout as :func:`number_within`: a
    local running max per range piece plus the carry of earlier pieces.

    If ``df`` already has ``_part`` from :func:`number_within` over the same
    keys and an equivalent order, those pieces are reused (no new shuffle)."""
    keys, order = list(keys), list(order)
    ranged = df if "_part" in df.columns else _ranged(df, keys, order, partitions)
    upto = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_lmax", F.max(value).over(upto))
    piece = ranged.groupBy(*keys, "_part").agg(F.max(value).alias("_pmax"))
    carry = piece.withColumn("_carry", F.max("_pmax").over(_before(keys))).drop("_pmax")
    out = _join_pieces(local, carry, keys)
    return out.withColumn(name, F.greatest("_lmax", "_carry")).drop("_part", "_at", "_lmax", "_carry")
