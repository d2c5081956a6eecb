"""Exact top-k search by columnar branch-and-bound.

Vectors are laid out vertically (one row per dimension). For each query the
inner product is accumulated one block of dimensions at a time; the mass that
a query and a candidate have left in the dimensions not yet read bounds what
the sum can still become (Cauchy-Schwarz). Candidates whose upper bound is
below the k-th best lower bound are compacted away; the survivors end with
their exact score, so nothing is approximated.

Distribution: candidates and queries are dealt into blocks of bounded size
by row, not by value, and every query block meets every candidate block once
in one task (a stated query set against all rows, in blocks). Each cell
returns at most k rows per query and a window keeps the best k.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesops.llm.common import lists_to_matrix, stored, valid_vector

CANDIDATE_BLOCK = 4096
QUERY_BLOCK = 1024
DIMENSION_BLOCK = 8
# int64 holds every sum whose bound is below this; float64 holds integers to 2**53.
_EXACT_FLOAT = 2.0**53

CELL_SCHEMA = "q_row long, query_id long, row long, vec_id long, score long"


def bond_top_k(query: np.ndarray, columns: np.ndarray, rest: np.ndarray, k: int, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and exact scores of all candidates that can be among the best k.

    ``columns``: dimensions x candidates; ``rest[b]``: norm of each candidate
    over the blocks from b on; ``skip``: candidates that are not the query's.
    """
    dims, n = columns.shape
    alive = np.flatnonzero(~skip)
    score = np.zeros(len(alive), columns.dtype)
    starts = range(0, dims, DIMENSION_BLOCK)
    q_rest = np.sqrt(np.append(np.cumsum((query.astype(np.float64) ** 2)[::-1])[::-1], 0.0))
    for b, s in enumerate(starts):
        part = columns[s : s + DIMENSION_BLOCK]
        part = part if len(alive) == n else part[:, alive]
        score = score + query[s : s + DIMENSION_BLOCK] @ part
        if len(alive) > k and s + DIMENSION_BLOCK < dims:
            left = q_rest[s + DIMENSION_BLOCK] * rest[b + 1][alive] * (1 + 1e-9) + 1e-6
            floor = np.partition(score - left, len(alive) - k)[len(alive) - k]
            keep = score + left >= floor
            if not keep.all():
                alive, score = alive[keep], score[keep]
    return alive, score


def search_cell(k: int):
    """One block of candidates against one block of queries, as Arrow tables."""

    def run(key, cand: pa.Table, quer: pa.Table) -> pa.Table:
        out: dict[str, list[np.ndarray]] = {n: [] for n in ("q_row", "query_id", "row", "vec_id", "score")}
        for dims in np.unique(quer["dims"].to_numpy()):
            c, q = cand.filter(pa.compute.equal(cand["dims"], dims)), quer.filter(pa.compute.equal(quer["dims"], dims))
            if not c.num_rows:
                continue
            cm, qm = lists_to_matrix(c["v"]), lists_to_matrix(q["v"])
            big = float(np.abs(cm.astype(np.float64)).max(initial=0)) * float(np.abs(qm.astype(np.float64)).max(initial=0)) * max(int(dims), 1)
            dtype = np.float64 if big < _EXACT_FLOAT else np.int64
            columns = np.ascontiguousarray(cm.T.astype(dtype))
            squares = columns.astype(np.float64) ** 2
            edges = range(0, int(dims), DIMENSION_BLOCK)
            mass = np.array([squares[s : s + DIMENSION_BLOCK].sum(axis=0) for s in edges]).reshape(-1, len(cm))
            rest = np.sqrt(np.cumsum(mass[::-1], axis=0)[::-1])
            c_row, c_id = c["row"].to_numpy(), c["vec_id"].to_numpy()
            for row, qid, vec in zip(q["row"].to_numpy(), q["vec_id"].to_numpy(), qm.astype(dtype)):
                alive, score = bond_top_k(vec, columns, rest, k, c_row == row)
                score = score.astype(np.int64)
                best = np.lexsort((c_row[alive], c_id[alive], -score))[:k]
                hit = alive[best]
                out["q_row"].append(np.full(len(hit), row))
                out["query_id"].append(np.full(len(hit), qid))
                out["row"].append(c_row[hit])
                out["vec_id"].append(c_id[hit])
                out["score"].append(score[best])
        return pa.table({n: np.concatenate(v).astype(np.int64) if v else np.empty(0, np.int64) for n, v in out.items()})

    return run


def cells(candidates: DataFrame, queries: DataFrame, n_candidates: int, n_queries: int, *, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK):
    """Both sides dealt into blocks by row; each (g, h) is one pair of blocks."""
    g, h = max(1, math.ceil(n_candidates / candidate_block)), max(1, math.ceil(n_queries / query_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = candidates.withColumn("g", F.pmod(F.xxhash64("row"), F.lit(g)).cast("int")).withColumn("h", every(h))
    q = queries.withColumn("h", F.pmod(F.xxhash64("row"), F.lit(h)).cast("int")).withColumn("g", every(g))
    return c.groupBy("g", "h").cogroup(q.groupBy("g", "h"))


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, *, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """The k rows with the largest integer inner product for each query row.

    Components become ``floor(scale * x)``. Ties go to the smaller id.
    Returns ``query_id, rank, vec_id, score``.

    Defined cases: vectors that are null or hold null or non-finite
    components, and rows with a null id (nothing could name them), take no
    part. Repeated rows are separate candidates; a query skips its own row
    only. Vectors meet those of their own length only. Scores are exact while
    they fit a 64-bit integer. An empty table gives an empty result. Other
    columns are ignored.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = stored(
        vectors.where(valid_vector(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
            F.col(id_col).cast("long").alias("vec_id"),
            F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v"),
            F.size(v).alias("dims"),
            F.coalesce(is_query, F.lit(False)).alias("is_query"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "topk-rows",
    )
    n, nq = rows.agg(F.count("*"), F.count_if("is_query")).first()
    hits = cells(rows.drop("is_query"), rows.where("is_query").drop("is_query"), n, nq, candidate_block=candidate_block).applyInArrow(search_cell(k), CELL_SCHEMA)
    w = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
