"""Approximate nearest neighbours with a hierarchical k-means tree.

1. A tree of k-means splits is fitted on a bounded sample (``SAMPLE`` rows,
   chosen by hash); every row is then indexed into its leaf.
2. Calibration: for a bounded set of queries the exact neighbours are found by
   brute force over all rows. Best-bin-first traversal (a priority queue of
   tree nodes ordered by the query's inner product with the node centre) is
   widened leaf by leaf until the share of true neighbours met reaches
   ``target_recall`` on half of them; that number of leaves is used for every
   query, and the recall reported is the other half's. A query goes on popping
   until its leaves hold k other rows of its length.
3. Search: leaves are laid end to end in tree order and cut into blocks of
   bounded size (a hot leaf spans many blocks). A query travels once to each
   block that holds one of its leaves, with the list of those leaves, and the
   block returns its best k. Scores are exact double inner products.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesops.llm.common import stored, valid_vector

SAMPLE = 32768
CALIBRATION_QUERIES = 256
BRANCHING = 16
LEAF_SAMPLE = 64
BLOCK_ROWS = 4096
QUERY_BLOCK = 2048


def padded(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """A list column as a float64 matrix; shorter rows end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if n and (sizes == dims).all():
        return flat.reshape(n, dims)
    out = np.zeros((n, dims))
    at = np.repeat(np.arange(n), sizes)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


@dataclass
class Tree:
    """Nodes in depth-first order; leaves are numbered in that order."""

    centers: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = nearest(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=k)
        full = counts > 0
        centers[full] = sums[full] / counts[full, None]
    return centers


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(1) - 2 * (x @ centers.T)).argmin(1)


def fit_tree(x: np.ndarray, seed: int = 7, branching: int = BRANCHING, leaf_sample: int = LEAF_SAMPLE) -> Tree:
    tree, rng = Tree(), np.random.default_rng(seed)

    def grow(rows: np.ndarray) -> int:
        me = len(tree.centers)
        tree.centers.append(x[rows].mean(0) if len(rows) else np.zeros(x.shape[1]))
        tree.children.append([])
        tree.leaf.append(-1)
        k = min(branching, -(-len(rows) // leaf_sample))
        if k > 1:
            near = nearest(x[rows], kmeans(x[rows], k, rng))
            parts = [rows[near == j] for j in range(k) if (near == j).any()]
            if len(parts) > 1:
                tree.children[me] = [grow(p) for p in parts]
                return me
        tree.leaf[me] = tree.leaves
        tree.leaves += 1
        return me

    grow(np.arange(len(x)))
    return tree


def assign(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each row: the nearest centre at every level."""
    out = np.zeros(len(x), np.int32)
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        kids = tree.children[node]
        if not kids:
            out[rows] = tree.leaf[node]
            continue
        near = nearest(x[rows], np.array([tree.centers[c] for c in kids]))
        todo += [(c, rows[near == j]) for j, c in enumerate(kids) if (near == j).any()]
    return out


def best_bin_first(tree: Tree, scores: np.ndarray, visits: int, rows: np.ndarray | None = None, enough: int = 0) -> list[int]:
    """Leaves in the order a priority queue meets them; ``scores``: of all nodes.

    Beyond ``visits`` leaves the queue is popped on until the leaves met hold
    ``enough`` of the ``rows`` (counts per leaf).
    """
    queue, order, met = [(-scores[0], 0)], [], 0
    while queue and (len(order) < visits or (rows is not None and met < enough)):
        _, node = heapq.heappop(queue)
        if tree.children[node]:
            for c in tree.children[node]:
                heapq.heappush(queue, (-scores[c], c))
        else:
            order.append(tree.leaf[node])
            met += 0 if rows is None else int(rows[tree.leaf[node]])
    return order


def top_rows(q: np.ndarray, c: np.ndarray, ids: np.ndarray, rows: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Best k of ``allowed`` by (score desc, id, row); equal vectors get equal scores."""
    at = np.flatnonzero(allowed)
    if not len(at):
        return at, np.empty(0)
    rough = c[at] @ q if len(at) < len(c) else c @ q
    if len(at) > k:
        slack = 1e-9 * (1.0 + np.abs(rough).max())
        at = at[rough >= np.partition(rough, len(at) - k)[len(at) - k] - slack]
    score = (c[at] * q).sum(axis=1)
    best = np.lexsort((rows[at], ids[at], -score))[:k]
    return at[best], score[best]


HITS = "q_row long, query_id long, row long, vec_id long, score double, leaf int"


def _table(parts: list[tuple]) -> pa.Table:
    names, kinds = ("q_row", "query_id", "row", "vec_id", "score", "leaf"), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32())
    cols = zip(*parts, strict=True) if parts else [[] for _ in names]
    return pa.table({n: pa.array(np.concatenate(v) if len(v) else [], t) for n, t, v in zip(names, kinds, cols, strict=True)})


def calibrate(rows: DataFrame, queries: list, tree: Tree, dims: int, k: int, target_recall: float) -> tuple[int, float]:
    """Leaf visits at which best-bin-first meets the target on every other query, and the recall there on the rest."""
    if not queries:
        return tree.leaves, 1.0
    q_row = np.array([r["row"] for r in queries])
    q_dims = np.array([len(r["v"]) for r in queries])
    qm = np.zeros((len(queries), dims))
    for i, r in enumerate(queries):
        qm[i, : len(r["v"])] = r["v"]

    def scan(batches):
        held: dict[int, tuple] = {}
        for b in batches:
            c, ids, rws, dm, leaf = padded(b["v"], dims), b["vec_id"].to_numpy(), b["row"].to_numpy(), b["dims"].to_numpy(), b["leaf"].to_numpy()
            for i in range(len(qm)):
                at, s = top_rows(qm[i], c, ids, rws, (rws != q_row[i]) & (dm == q_dims[i]), k)
                new = (rws[at], ids[at], s, leaf[at])
                if i in held:
                    both = [np.concatenate(p) for p in zip(held[i], new, strict=True)]
                    best = np.lexsort((both[0], both[1], -both[2]))[:k]
                    new = tuple(p[best] for p in both)
                held[i] = new
        out = _table([(np.full(len(h[0]), i), np.full(len(h[0]), i), *h) for i, h in held.items()])
        yield from out.to_batches()

    w = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id", "row")
    truth = rows.select("row", "vec_id", "v", "dims", "leaf").mapInArrow(scan, HITS).withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).select("q_row", "leaf").collect()
    centers = np.array(tree.centers)
    place = {}
    for i in range(len(qm)):
        place[i] = {leaf: n for n, leaf in enumerate(best_bin_first(tree, centers @ qm[i], tree.leaves))}
    needed = np.array([place[r["q_row"]][r["leaf"]] for r in truth])
    chosen = np.array([r["q_row"] % 2 == 0 for r in truth], bool)
    if not len(needed):
        return 1, 1.0
    fitted, other = needed[chosen], needed[~chosen]
    visits = 1
    while visits < tree.leaves and (fitted < visits).mean() < target_recall:
        visits += 1
    return visits, float((other < visits).mean()) if len(other) else float((fitted < visits).mean())


def search_block(k: int, dims: int):
    def run(key, members: pa.Table, quer: pa.Table) -> pa.Table:
        c, ids, rows = padded(members["v"], dims), members["vec_id"].to_numpy(), members["row"].to_numpy()
        leaf, dm = members["leaf"].to_numpy(), members["dims"].to_numpy()
        q = padded(quer["v"], dims)
        parts = []
        for i, (row, qid, d, visited) in enumerate(zip(quer["row"].to_numpy(), quer["vec_id"].to_numpy(), quer["dims"].to_numpy(), quer["visited"].to_pylist(), strict=True)):
            allowed = np.isin(leaf, visited) & (rows != row) & (dm == d)
            at, s = top_rows(q[i], c, ids, rows, allowed, k)
            parts.append((np.full(len(at), row), np.full(len(at), qid), rows[at], ids[at], s, leaf[at]))
        return _table(parts)

    return run


def approximate_neighbours(vectors: DataFrame, is_query: Column, k: int = 20, *, target_recall: float = 0.97, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, calibration_queries: int = CALIBRATION_QUERIES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k rows of largest inner product found for each query row.

    Returns ``query_id, rank, vec_id, score, leaf_visits, calibrated_recall``;
    ties go to the smaller id.

    Defined cases: vectors that are null, all zero or hold null or non-finite
    components, and rows with a null id (nothing could name them), take no
    part. Repeated rows are separate candidates; a query skips its own row
    only. Vectors meet those of their own length only. An empty table gives an
    empty result. Other columns are ignored. ``sample`` bounds the rows the
    tree is fitted on and ``calibration_queries`` the queries whose exact
    neighbours are found; every row is indexed and every query searched.
    """
    v = F.col(vector_col)
    raw = vectors.where(valid_vector(v) & F.exists(v, lambda x: x != 0) & F.col(id_col).isNotNull())
    based = stored(raw.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("dims"), F.coalesce(is_query, F.lit(False)).alias("is_query"), F.monotonically_increasing_id().alias("row")), "ann-rows")
    dims = based.agg(F.max("dims")).first()[0] or 1
    picked = based.orderBy(F.xxhash64("row"), "row").limit(sample).select("v").toArrow()
    tree = fit_tree(padded(picked["v"], dims)) if picked.num_rows else fit_tree(np.zeros((1, dims)))

    def index(batches):
        for b in batches:
            leaf = assign(tree, padded(b["v"], dims))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int32())], [*b.schema.names, "leaf"])

    rows = stored(based.mapInArrow(index, based.withColumn("leaf", F.lit(0)).schema), "ann-leaves")
    asked = rows.where("is_query").orderBy(F.xxhash64("row", F.lit(1)), "row").limit(calibration_queries).select("row", "v").collect()
    visits, recall = calibrate(rows, asked, tree, dims, k, target_recall)
    centers = np.array(tree.centers)
    # Rows of each length in each leaf: what a query of that length can meet there.
    held: dict[int, np.ndarray] = {}
    for r in rows.groupBy("leaf", "dims").agg(F.count("*").alias("n")).collect():
        held.setdefault(r["dims"], np.zeros(tree.leaves, np.int64))[r["leaf"]] = r["n"]

    # Leaves end to end in tree order: block of a row = its place // block_rows.
    # One row per leaf; the tree's size bounds it (at most `sample` leaves).
    count = np.zeros(tree.leaves + 1, np.int64)
    for own in held.values():
        count[1:] += own
    offset = np.cumsum(count)
    leaf_table = rows.sparkSession.createDataFrame([(i, int(offset[i]), int(count[i + 1])) for i in range(tree.leaves)], "leaf int, leaf_at long, leaf_n long")
    share = F.pmod(F.xxhash64("row"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    members = rows.join(F.broadcast(leaf_table), "leaf").withColumn("block", F.floor((F.col("leaf_at") + F.floor(share * F.col("leaf_n"))) / F.lit(block_rows))).select("block", "row", "vec_id", "v", "dims", "leaf")

    def visit(batches):
        first, last = offset[:-1] // block_rows, np.maximum(offset[1:] - 1, offset[:-1]) // block_rows
        for b in batches:
            node_scores = padded(b["v"], dims) @ centers.T
            pick, block, seen = [], [], []
            lengths = b["dims"].to_numpy()
            for i, s in enumerate(node_scores):
                by_block: dict[int, list[int]] = {}
                for leaf in best_bin_first(tree, s, visits, held[lengths[i]], k + 1):  # k others and the query's own row
                    if count[leaf + 1]:
                        for x in range(first[leaf], last[leaf] + 1):
                            by_block.setdefault(x, []).append(leaf)
                pick += [i] * len(by_block)
                block += by_block
                seen += by_block.values()
            taken = b.select(["row", "vec_id", "v", "dims"]).take(pa.array(pick, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(block, pa.int64()), pa.array(seen, pa.list_(pa.int32()))], ["row", "vec_id", "v", "dims", "block", "visited"])

    kind = rows.schema["v"].dataType.simpleString()
    visited = stored(rows.where("is_query").select("row", "vec_id", "v", "dims").mapInArrow(visit, f"row long, vec_id long, v {kind}, dims int, block long, visited array<int>"), "ann-visits")
    load = visited.groupBy("block").agg(F.ceil(F.count("*") / F.lit(QUERY_BLOCK)).cast("int").alias("h_n"))
    quer = visited.join(load, "block").withColumn("h", F.pmod(F.xxhash64("row"), F.col("h_n")).cast("int")).drop("h_n")
    members = members.join(load, "block").withColumn("h", F.explode(F.sequence(F.lit(0), F.col("h_n") - 1))).drop("h_n")
    hits = members.groupBy("block", "h").cogroup(quer.groupBy("block", "h")).applyInArrow(search_block(k, dims), HITS)
    w = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", F.lit(visits).alias("leaf_visits"), F.lit(recall).alias("calibrated_recall"))
