"""Vector codes: product quantisation by k-means, with norm-of-sum bounds.

Each of ``parts`` consecutive parts of a vector is coded by the nearest of ``k``
entries of that part's codebook. Rounds of k-means are exact; most distances
are never computed:

- The codebooks of all rounds are kept. For each row, part and group of
  entries, the state has a lower bound on the distance to the group's entries
  (but the row's own) and a stamp: the round in which it was measured.
- In a later round the bound loses the largest *net* displacement of a group's
  entries since its stamp, the norm of the summed moves. An accumulated drift,
  the sum of the norms round by round, is never smaller (an entry that swings
  back has moved far but is displaced little).
- Only where that bound does not exceed the exact distance to the row's own
  entry is the group scanned again, exactly; its bound and stamp are then new.

Rows are packed into blocks (whole numbers in as few bytes as they need) that
carry their state from round to round in a stored table; the one before is
deleted once the next is written. Each task adds up its rows' sums and counts,
which are merged a few at a time; a codebook is of fixed size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesops.llm.common import finite_by_length, forget, small, stored, stored_at, tree_merge, unused, vector_column

PARTS, ENTRIES, ROUNDS, GROUPS = 4, 256, 4, 8
SCALE = 1024
BLOCK_ROWS = 4096
LIMIT = 2.0**42  # floor(1024 * x) is exact below it
BROADCAST_LABELS = 10_000
SALTS = 16
_UP = 1 + 1e-12


def part_edges(dims: int, parts: int) -> list[tuple[int, int]]:
    """Equal consecutive parts; the first ones are longer by one where they can't be equal."""
    edges = np.cumsum([0] + [dims // parts + (p < dims % parts) for p in range(parts)])
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows by entries, in the first type that holds them."""
    big = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    bound = 4 * max(x.shape[1], 1) * big * big
    kind = np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object
    x, c = x.astype(kind), c.astype(kind)
    return (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T)


def own_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row."""
    y = x - c
    if 4 * max(x.shape[1], 1) * int(np.abs(y).max(initial=0)) ** 2 >= 2**53:
        y = y.astype(object)
    return (y * y).sum(1)


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


def _down32(x: np.ndarray) -> np.ndarray:
    """As float32, never above x."""
    out = x.astype(np.float32)
    return np.where(out.astype(np.float64) > x, np.nextafter(out, np.float32(-np.inf)), out)


def entry_groups(c: np.ndarray, groups: int = GROUPS) -> list[np.ndarray]:
    """Entries dealt into groups of neighbours, by a small k-means of the codebook itself."""
    n = max(1, min(groups, len(c) // 4))
    x = c.astype(np.float64)
    picked = [0]
    far = ((x - x[0]) ** 2).sum(1)
    for _ in range(n - 1):  # farthest first
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[picked[-1]]) ** 2).sum(1))
    centres = x[picked]
    for _ in range(5):
        near = ((x[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        for g in range(n):
            if (near == g).any():
                centres[g] = x[near == g].mean(0)
    return [np.flatnonzero(near == g) for g in range(n) if (near == g).any()]


def first_assignment(x: np.ndarray, c: np.ndarray, groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(entry, squared distance, lower bounds, stamps) by a full scan."""
    d = squared_distances(x, c)
    label = d.argmin(1)
    rows = np.arange(len(x))
    best = d[rows, label]
    apart = _root(d)
    apart[rows, label] = np.inf
    lower = np.stack([_down32(apart[:, g].min(1)) for g in groups], axis=1)
    return label, best, lower, np.zeros(lower.shape, np.uint8)


def net_moves(history: list[np.ndarray], groups: list[np.ndarray]) -> np.ndarray:
    """(stamp, group): largest net displacement of a group's entries from that round's codebook to the last one."""
    now = history[-1].astype(np.float64)
    moved = [np.sqrt(((now - then) ** 2).sum(1)) * _UP for then in history[:-1]]
    return np.array([[m[g].max() for g in groups] for m in moved])


def assign_again(x: np.ndarray, history: list[np.ndarray], groups: list[np.ndarray], label: np.ndarray, lower: np.ndarray, stamp: np.ndarray):
    """The last codebook's (entry, squared distance, lower bounds, stamps, groups scanned) from the state of earlier rounds."""
    now, t, rows = history[-1], len(history) - 1, np.arange(len(x))
    own = own_distances(x, now[label])
    reach = _root(own) * _UP
    held = lower.astype(np.float64) - net_moves(history, groups)[stamp, np.arange(len(groups))] * _UP
    scan = ~(held > reach[:, None])  # an equal distance may belong to a lower index
    best, chosen = own.copy(), label.copy()
    lower, stamp = lower.copy(), stamp.copy()
    found = {}
    for g, members in enumerate(groups):
        at = np.flatnonzero(scan[:, g])
        if not len(at):
            continue
        d = squared_distances(x[at], now[members])
        near = d.argmin(1)  # members ascend, so ties go to the lower index
        least = d[np.arange(len(at)), near]
        better = (least < best[at]) | ((least == best[at]) & (members[near] < chosen[at]))
        best[at[better]], chosen[at[better]] = least[better], members[near[better]]
        found[g] = at, d
    # An entry given up in a group that was not scanned is one of the group's others now.
    left = chosen != label
    home = np.empty(len(now), np.int64)
    for g, members in enumerate(groups):
        home[members] = g
    old = home[label]
    at = rows[left & ~scan[rows, old]]
    lower[at, old[at]] = _down32(np.minimum(held[at, old[at]], reach[at] / _UP / _UP))
    stamp[at, old[at]] = t
    for g, (at, d) in found.items():
        apart = _root(d)
        apart[groups[g][None, :] == chosen[at][:, None]] = np.inf
        lower[at, g], stamp[at, g] = _down32(apart.min(1)), t
    return chosen, best, lower, stamp, int(scan.sum())


class State:
    """Entries, bounds and stamps of one block, as bytes."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.parts = parts

    def pack(self) -> bytes:
        return b"".join(label.astype(np.uint8).tobytes() + lower.tobytes() + stamp.tobytes() for label, lower, stamp in self.parts)

    @classmethod
    def unpack(cls, data: bytes, n: int, groups: list[list[np.ndarray]]) -> State:
        parts, at = [], 0
        for g in groups:
            cells = n * len(g)
            label = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
            lower = np.frombuffer(data, np.float32, cells, at + n).reshape(n, -1)
            stamp = np.frombuffer(data, np.uint8, cells, at + n + 4 * cells).reshape(n, -1)
            parts.append((label, lower, stamp))
            at += n + 5 * cells
        return cls(parts)


def pack_whole(x: np.ndarray) -> tuple[int, bytes]:
    big = int(np.abs(x).max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if big < 1 << (8 * w - 1))
    return width, x.astype(f"<i{width}").tobytes()


def unpack_whole(data: bytes, width: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{width}").astype(np.int64).reshape(-1, dims)


def _list_of(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _block(dims: int, ids: pa.Array, labels: pa.Array, width: int, data: bytes, state: bytes | None) -> pa.RecordBatch:
    cols = [pa.array([None], pa.int32()), pa.array([dims], pa.int32()), _list_of(ids), _list_of(labels), pa.array([width], pa.int32()), pa.array([data], pa.binary()), pa.array([state], pa.binary()), pa.array([None], pa.binary())]
    return pa.record_batch(cols, names=["place", "dims", "ids", "labels", "width", "data", "state", "partial"])


def _partial(dims: int, payload: np.ndarray, label_type: pa.DataType) -> pa.RecordBatch:
    cols = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([dims], pa.int32()), pa.array([None], pa.list_(pa.int64())), pa.array([None], pa.list_(label_type)), pa.array([None], pa.int32()), pa.array([None], pa.binary()), pa.array([None], pa.binary()), pa.array([payload.tobytes()], pa.binary())]
    return pa.record_batch(cols, names=["place", "dims", "ids", "labels", "width", "data", "state", "partial"])


def _merge_partials(combine):
    def merge(key, table: pa.Table) -> pa.Table:
        whole = combine(key[0].as_py(), [np.frombuffer(x, np.int64) for x in table["partial"].to_pylist()])
        return pa.table({"place": pa.array([0], pa.int32()), "dims": pa.array([key[0].as_py()], pa.int32()), "partial": pa.array([whole.tobytes()], pa.binary()), "up": pa.array([key[1].as_py()], pa.int32())})

    return merge


def collected(table: DataFrame, combine, name: str) -> dict[int, np.ndarray]:
    """The tasks' partial results of each vector length, merged."""
    parts = tree_merge(table.where("place is not null").select("place", "dims", "partial"), ["dims"], _merge_partials(combine), name)
    return {r["dims"]: np.frombuffer(bytes(r["partial"]), np.int64) for r in parts.collect()}


def smallest(rows: np.ndarray, k: int) -> np.ndarray:
    """The k least rows by (id is null, id, vector)."""
    if len(rows) > k:
        place = rows[:, 1].astype(np.float64) + np.where(rows[:, 0] > 0, np.inf, 0.0)
        rows = rows[place <= np.partition(place, k - 1)[k - 1]]
    return rows[np.lexsort(rows.T[::-1])][:k]


def totals(label: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Counts and sums of each entry's parts: k rows of (count, low sums, high sums); no sum leaves 64 bits."""
    order = np.argsort(label, kind="stable")
    used, at = np.unique(label[order], return_index=True)
    out = np.zeros((k, 1 + 2 * x.shape[1]), np.int64)
    out[used, 0] = np.diff(np.append(at, len(label)))
    if x.shape[1]:
        y = x[order]
        out[used, 1:] = np.add.reduceat(np.hstack([y & 0x7FFFFFFF, y >> 31]), at, axis=0)
    return out


def moved(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The next codebook: floor(sum / count) of each used entry; unused entries stay."""
    w = c.shape[1]
    out = c.copy()
    for j in np.flatnonzero(t[:, 0]):
        out[j] = [(int(a) + (int(b) << 31)) // int(t[j, 0]) for a, b in zip(t[j, 1 : 1 + w], t[j, 1 + w :], strict=True)]
    return out


def encode(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block_rows: int = BLOCK_ROWS, broadcast_labels: int = BROADCAST_LABELS, stats: list | None = None) -> DataFrame:
    """Codes and errors of all vectors under codebooks trained on all of them.

    Components are ``floor(1024 * x)``. A part position's codebook starts as
    that part of the vectors with the ``entries`` smallest ids; each round
    assigns every part to the nearest entry (squared Euclidean distance, ties
    to the lower index) and moves each used entry to floor(sum / count).
    Returns ``vec_id, label, code`` (two hex digits a part), ``error`` (decimal:
    squared distances after the last round, summed over the parts),
    ``label_error`` (decimal: error summed over equal labels, nulls together)
    and ``codebooks_sha256`` (the final entries' components, comma-joined).
    ``stats`` gets (round, groups scanned, groups in all) of each assignment.

    Defined cases: vectors that are null, empty or hold null or non-finite
    components, or components of 2^42 or more, are dropped. Null ids come after
    all others; equal ids are ordered by their vectors, so repeated rows start
    equal entries, of which the lower index is used. Fewer rows than entries
    give fewer entries. A length that the parts don't divide makes the first
    parts longer by one; parts may be empty. Vectors of another length have
    codebooks of their own. An empty table gives an empty result. Other columns
    are ignored, and a table without the label column has null labels.
    """
    if not (1 <= entries <= 256 and rounds < 256):
        raise ValueError("a part's code is one byte")
    spark = vectors.sparkSession
    label = F.col(label_col) if label_col in vectors.columns else F.lit(None).cast("int")
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector_column(vectors, vector_col).alias("v"), label.alias("label"))
    kind = source.schema["label"].dataType.simpleString()
    schema = f"place int, dims int, ids array<long>, labels array<{kind}>, width int, data binary, state binary, partial binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[int, np.ndarray] = {}
        label_type = pa.null()
        for b in batches:
            ids, labels = b.column("vec_id"), b.column("label")
            label_type = labels.type
            for dims, at, m in finite_by_length(b.column("v"), LIMIT):
                x = np.floor(m * SCALE).astype(np.int64)
                for s in range(0, len(x), block_rows):
                    cut = pa.array(at[s : s + block_rows])
                    yield _block(dims, ids.take(cut), labels.take(cut), *pack_whole(x[s : s + block_rows]), None)
                own = ids.take(pa.array(at))
                keyed = np.column_stack([own.is_null().to_numpy(zero_copy_only=False), own.fill_null(0).to_numpy(zero_copy_only=False), x]).astype(np.int64)
                first[dims] = smallest(np.vstack([first[dims], keyed]) if dims in first else keyed, entries)
        for dims, rows in first.items():
            yield _partial(dims, rows, label_type)

    now, path = stored_at(source.mapInArrow(pack, schema), "codes-blocks")
    start = collected(now, lambda dims, found: smallest(np.vstack([f.reshape(-1, dims + 2) for f in found]), entries), "codes-first")
    # history[dims][part]: the codebook of each round.
    history = {d: [[rows.reshape(-1, d + 2)[:, 2:][:, a:b]] for a, b in part_edges(d, parts)] for d, rows in start.items()}
    groups = {d: [entry_groups(h[0]) for h in hist] for d, hist in history.items()}

    def assign_block(dims: int, width: int, data: bytes, state: bytes | None, books: dict):
        x = unpack_whole(data, width, dims)
        before = State.unpack(state, len(x), groups[dims]).parts if state is not None else [None] * parts
        out, d_sum, scanned, cells = [], None, 0, 0
        for (a, b), book, group, old in zip(part_edges(dims, parts), books[dims], groups[dims], before, strict=True):
            if old is None:
                chosen, d, lower, stamp = first_assignment(x[:, a:b], book[-1], group)
                n = len(x) * len(group)
            else:
                chosen, d, lower, stamp, n = assign_again(x[:, a:b], book, group, *old)
            out.append((chosen, lower, stamp))
            d_sum = d if d_sum is None else d_sum + d
            scanned, cells = scanned + n, cells + len(x) * len(group)
        return x, out, d_sum, scanned, cells

    def round_of(books: dict):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            label_type = pa.null()
            for b in small(batches, 1):
                dims, width, data, state = (b.column(c)[0].as_py() for c in ("dims", "width", "data", "state"))
                ids, labels = b.column("ids")[0].values, b.column("labels")[0].values
                label_type = labels.type
                x, out, _, scanned, cells = assign_block(dims, width, data, state, books)
                yield _block(dims, ids, labels, width, data, State(out).pack())
                k = len(books[dims][0][-1])
                mine = [totals(chosen, x[:, p:q], k).ravel() for (chosen, _, _), (p, q) in zip(out, part_edges(dims, parts), strict=True)]
                mine = np.concatenate([*mine, [scanned, cells]])
                sums[dims] = sums.get(dims, 0) + mine
            for dims, s in sums.items():
                yield _partial(dims, s, label_type)

        return run

    for _ in range(rounds if start else 0):
        books = {d: [list(h) for h in hist] for d, hist in history.items()}
        new, new_path = stored_at(now.where("place is null").mapInArrow(round_of(books), schema), "codes-blocks")
        added = collected(new, lambda dims, found: sum(found), "codes-sums")
        forget(spark, path)
        now, path = new, new_path
        for d, total in added.items():
            at = 0
            for (a, b), book in zip(part_edges(d, parts), history[d], strict=True):
                size = len(book[-1]) * (1 + 2 * (b - a))
                book.append(moved(book[-1], total[at : at + size].reshape(len(book[-1]), -1)))
                at += size
            if stats is not None:
                stats.append((len(book) - 2, int(total[-2]), int(total[-1])))

    digest = {d: hashlib.sha256(",".join(str(v) for h in hist for v in h[-1].ravel().tolist()).encode()).hexdigest() for d, hist in history.items()}
    digits = np.array([f"{i:02x}" for i in range(256)])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 1):
            dims, width, data, state = (b.column(c)[0].as_py() for c in ("dims", "width", "data", "state"))
            x, out, d, _, _ = assign_block(dims, width, data, state, history)
            code = digits[out[0][0]]
            for chosen, _, _ in out[1:]:
                code = np.char.add(code, digits[chosen])
            error = pa.array([Decimal(int(e)) for e in d.tolist()], pa.decimal128(38, 0))
            yield pa.record_batch([b.column("ids")[0].values, b.column("labels")[0].values, pa.array(code), error, pa.array([digest[dims]] * len(x))], names=["vec_id", "label", "code", "error", "codebooks_sha256"])

    done = stored(now.where("place is null").mapInArrow(finish, f"vec_id long, label {kind}, code string, error decimal(38,0), codebooks_sha256 string"), "codes")
    forget(spark, path)
    return _with_label_errors(done, broadcast_labels).select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")


def _with_label_errors(rows: DataFrame, broadcast_labels: int) -> DataFrame:
    """``label_error``: few labels are broadcast; more are joined with each label dealt over salts."""
    own, salt = (unused(c, rows.columns) for c in ("own", "salt"))
    by_label = stored(rows.groupBy(F.col("label").alias(own)).agg(F.sum("error").cast("decimal(38,0)").alias("label_error")), "codes-labels")
    same = F.col("label").eqNullSafe(F.col(own))
    if by_label.count() <= broadcast_labels:
        return rows.join(F.broadcast(by_label), same).drop(own)
    dealt = by_label.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("at", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return salted.join(dealt.hint("merge"), same & (F.col("at") == F.col(salt))).drop(own, salt, "at")
