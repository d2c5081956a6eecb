"""Best-fit packing with certified bin counts.

Documents become pieces of at most ``capacity`` tokens (only longer ones are
cut). Pieces are dealt by row into partitions of bounded size and each
partition is packed by best-fit decreasing. Dual-feasible functions give a
lower bound on the bins a partition needs; when its count equals the bound the
partition is certified optimal. Partitions with a gap, and the loosest bin of
every certified one, exchange their pieces: they are dealt anew into fewer
partitions and packed again, until one partition remains, nothing is gained or
``max_rounds`` have run.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesops.llm.common import giving_back, small, stored
from salesops.llm.tokens import REMEMBERED, default_tokenizer, encode_ids, encoder

CAPACITY = 4096
# Pieces packed together by one task.
PARTITION_PIECES = 16384
MAX_ROUNDS = 5

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 1, capacity: int = CAPACITY, remembered: int = REMEMBERED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each whole document (``PIECES``).

    ``remembered``: chunks whose ids a worker keeps, twice; fewer take less memory and more time.
    """
    path = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(path, remembered)
        for b in small(batches):
            rows: list[tuple] = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                own = encode_ids(ids, text.as_py(), end_id)
                for p, s in enumerate(range(0, len(own), capacity)):
                    part = own[s : s + capacity]
                    rows.append((doc, p, s, len(part), zlib.crc32(part.tobytes())))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(giving_back(cut), PIECES)


def bin_bound(lengths: np.ndarray, capacity: int) -> int:
    """Largest lower bound on the bins needed, over two families of dual-feasible functions."""
    if not len(lengths):
        return 0
    sizes, counts = np.unique(lengths, return_counts=True)
    best = -(-int(lengths.sum()) // capacity)
    # Pieces over capacity - t count as a whole bin, those under t as nothing.
    for t in sizes[sizes * 2 <= capacity]:
        value = np.where(sizes > capacity - t, capacity, np.where(sizes < t, 0, sizes))
        best = max(best, -(-int((value * counts).sum()) // capacity))
    # A piece counts by how many (k+1)-ths of a bin it fills.
    for k in range(1, 33):
        share = (k + 1) * sizes
        whole = share % capacity == 0
        value = np.where(whole, k * sizes, share // capacity * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each piece and the number of bins.

    Open bins are kept by the room they have left; a bit mask of the rooms in
    use finds the smallest that fits.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                mask ^= 1 << left
        else:
            left, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - left
        left -= size
        if left:
            room[left].append(b)
            mask |= 1 << left
    return bins, offsets, n


def pack_partition(capacity: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("row")
        lengths = t["length"].to_numpy()
        bins, offsets, n = best_fit_decreasing(lengths, capacity)
        bound = bin_bound(lengths, capacity)
        used = np.bincount(bins, lengths, minlength=n)
        new = {"bin": pa.array(bins), "offset": pa.array(offsets), "gap": pa.array(np.full(len(bins), n - bound)), "loosest": pa.array(bins == used.argmin())}
        for name, values in new.items():
            t = t.append_column(name, values)
        return t

    return run


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """All columns of ``pieces`` plus ``sequence_id`` and ``offset``.

    ``pieces.length`` must be from 1 to ``capacity``; every row is placed once.
    """
    names = pieces.columns
    left = stored(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    done: list[DataFrame] = []
    before = math.inf
    for r in range(max_rounds):
        n = left.count()
        parts = max(1, math.ceil(n / partition_pieces))
        dealt = left.withColumn("part", F.pmod(F.xxhash64("row", F.lit(r)), F.lit(parts)).cast("int"))
        schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in dealt.schema)}, bin long, offset long, gap long, loosest boolean"
        packed = stored(dealt.groupBy("part").applyInArrow(pack_partition(capacity), schema), f"packed-{r}")
        packed = packed.withColumn("sequence_id", F.lit(r << 58) + F.col("part").cast("long") * (1 << 26) + F.col("bin"))
        last = parts == 1 or n >= before or r == max_rounds - 1
        again = (F.col("gap") > 0) | F.col("loosest")
        done.append((packed if last else packed.where(~again)).select(*names, "sequence_id", "offset"))
        if last:
            break
        left, before = packed.where(again).select(*names, "row"), n
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(docs: DataFrame, *, capacity: int = CAPACITY, tokenizer: str | None = None, remembered: int = REMEMBERED, **options) -> DataFrame:
    """Tokenise, cut and pack whole documents.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Defined cases: a null or empty text is its end id alone; repeated rows and
    rows with the same or a null id are packed as documents of their own; an
    empty table gives an empty result. Other columns are ignored.
    """
    return pack(token_pieces(docs, tokenizer=tokenizer, capacity=capacity, remembered=remembered), capacity=capacity, **options)
