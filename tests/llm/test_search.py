import numpy as np
import pyspark.sql.functions as F
import pyspark.sql.types as T
import pytest

from salesops.llm.ann import approximate_neighbours, best_bin_first, fit_tree
from salesops.llm.exact_topk import bond_top_k, exact_top_k

VEC = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("score", T.StringType()), T.StructField("row", T.StringType())])


def brute(ids, m, is_query, k, score):
    out = []
    for i in np.flatnonzero(is_query):
        s = score(m, m[i])
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out += [(int(ids[i]), n + 1, int(ids[j]), s[j]) for n, j in enumerate(order)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(400, 20)).astype(np.float32)
    m[50:90] = m[50]  # ties
    m[200:260] = m[200] + rng.normal(scale=0.01, size=(60, 20))
    return m, spark.createDataFrame([(i, [float(x) for x in v], "clash", "clash") for i, v in enumerate(m)], VEC).repartition(3)


def test_exact_top_k_equals_brute_force(vectors):
    m, df = vectors
    whole = np.floor(m.astype(np.float64) * 256).astype(np.int64)
    got = exact_top_k(df, F.col("vec_id") % 10 == 0, 5, candidate_block=64).collect()
    want = brute(np.arange(400), whole, np.arange(400) % 10 == 0, 5, lambda a, b: a @ b)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want


def test_branch_and_bound_keeps_the_best_and_drops_others():
    rng = np.random.default_rng(1)
    c = rng.integers(-50, 50, (500, 32)).astype(np.float64)
    c[:, :8] *= 40  # most of the mass lies in the first block
    columns = np.ascontiguousarray(c.T)
    rest = np.sqrt(np.cumsum(np.array([(c[:, s : s + 8] ** 2).sum(1) for s in range(0, 32, 8)])[::-1], axis=0)[::-1])
    for q in c[:10]:
        alive, score = bond_top_k(q, columns, rest, 5, np.zeros(500, bool))
        full = c @ q
        assert set(np.argsort(-full)[:5]) <= set(alive) and (score == full[alive]).all()
        assert len(alive) < 250


@pytest.mark.parametrize("search", [exact_top_k, approximate_neighbours])
def test_defined_cases(spark, search):
    rows = [(0, [1.0, 0.0], "", ""), (20, [1.0, 0.5], "", ""), (0, [1.0, 0.0], "", ""), (40, None, "", ""), (60, [float("nan"), 1.0], "", ""), (80, [None, 1.0], "", ""), (100, [float("inf"), 1.0], "", ""), (None, [1.0, 1.0], "", ""), (120, [1.0, 2.0, 3.0], "", "")]
    got = search(spark.createDataFrame(rows, VEC), F.col("vec_id") % 20 == 0, 5).collect()
    assert {r.query_id for r in got} == {0, 20}  # nothing else has a candidate of its length
    assert sorted((r["rank"], r.vec_id) for r in got if r.query_id == 20) == [(1, 0), (2, 0)]
    assert sorted(r.vec_id for r in got if r.query_id == 0) == [0, 0, 20, 20]  # the repeated row is a candidate
    assert search(spark.createDataFrame([], VEC), F.col("vec_id") % 20 == 0, 5).collect() == []


def test_tree_search_recall_scores_and_ties(vectors):
    m, df = vectors
    got = approximate_neighbours(df, F.col("vec_id") % 10 == 0, 10, block_rows=64, sample=300).collect()
    want = brute(np.arange(400), m.astype(np.float64), np.arange(400) % 10 == 0, 10, lambda a, b: a @ b)
    best = {(q, v) for q, _, v, _ in want}
    assert len({(r.query_id, r.vec_id) for r in got} & best) >= 0.9 * len(best)
    for r in got:
        assert r.score == pytest.approx(float(m[r.vec_id].astype(np.float64) @ m[r.query_id].astype(np.float64)), abs=1e-9)
        assert r.vec_id != r.query_id
    tied = [r for r in got if r.query_id == 50 and r["rank"] <= 5]
    assert [r.vec_id for r in sorted(tied, key=lambda r: r["rank"])] == [51, 52, 53, 54, 55]


def test_best_bin_first_meets_every_leaf_once():
    x = np.random.default_rng(2).normal(size=(2000, 8))
    tree = fit_tree(x)
    order = best_bin_first(tree, np.array(tree.centers) @ x[0], tree.leaves)
    assert sorted(order) == list(range(tree.leaves)) and tree.leaves > 16


def test_zero_vectors_take_no_part_in_tree_search(spark):
    rows = [(0, [0.0, 0.0], "", ""), (20, [1.0, 0.0], "", ""), (21, [0.5, 0.0], "", "")]
    got = approximate_neighbours(spark.createDataFrame(rows, VEC), F.col("vec_id") % 20 == 0, 5).collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(20, 21)]


def test_a_query_goes_on_until_it_has_met_k_rows(spark):
    """Small leaves far from all others, and a rare length among many vectors."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.append(rng.normal(scale=0.05, size=7), 1.0)], "", "") for i in range(600)]
    rows += [(1000 + 20 * i, [float(x) for x in 50 * np.eye(8)[i]], "", "") for i in range(6)]  # lone outliers
    rows += [(2000 + i, [float(x) for x in rng.normal(size=5)], "", "") for i in range(25)]
    got = approximate_neighbours(spark.createDataFrame(rows, VEC), F.col("vec_id") % 20 == 0, 20, target_recall=0.3, sample=300).collect()
    found = {}
    for r in got:
        found[r.query_id] = found.get(r.query_id, 0) + 1
    asked = [i for i, *_ in rows if i % 20 == 0]
    assert found == dict.fromkeys(asked, 20)
    assert all((r.vec_id >= 2000) == (r.query_id >= 2000) for r in got)
