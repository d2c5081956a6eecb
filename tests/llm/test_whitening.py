import decimal

import numpy as np
import pyspark.sql.functions as F
import pyspark.sql.types as T
import pytest

from salesops.llm.whitening import Centre, Spectrum, rank_one, secular, whiten

VEC = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("component", T.StringType()), T.StructField("n", T.StringType()), T.StructField("v", T.StringType())])


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "c", "c", "c") for i, v in rows], VEC).repartition(parts)


def test_secular_roots_lie_between_their_poles():
    rng = np.random.default_rng(0)
    for m in (1, 2, 3, 10, 64):
        d, z2 = np.sort(rng.uniform(0, 10, m)), rng.uniform(1e-8, 1, m)
        roots, apart = secular(d, z2)
        assert (roots > d).all() and (roots[:-1] < d[1:]).all() and roots[-1] <= d[-1] + z2.sum() * (1 + 1e-12)
        assert np.allclose(np.sort(roots), np.linalg.eigvalsh(np.diag(d) + np.outer(np.sqrt(z2), np.sqrt(z2))), rtol=1e-12, atol=1e-12)
        assert np.allclose(apart, d[None, :] - roots[:, None])


@pytest.mark.parametrize("case", ["plain", "no weight", "equal", "all equal", "zero update", "tiny gaps"])
def test_rank_one_update_with_deflation(case):
    rng = np.random.default_rng(5)
    d, v = np.sort(rng.uniform(0, 5, 12)), rng.normal(size=12)
    q = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    if case == "no weight":
        v = q[:, [2, 5, 9]].sum(1)
    elif case == "equal":
        d[3:7] = d[3]
    elif case == "all equal":
        d[:] = 0.0
    elif case == "zero update":
        v[:] = 0.0
    elif case == "tiny gaps":
        d = 1.0 + np.arange(12) * 1e-15
    values, basis = rank_one(d, q, v, 0.7)
    want = q @ np.diag(d) @ q.T + 0.7 * np.outer(v, v)
    assert np.allclose(basis @ np.diag(values) @ basis.T, want, atol=1e-12)
    assert np.allclose(basis.T @ basis, np.eye(12), atol=1e-13) and (np.diff(values) >= 0).all()


@pytest.mark.parametrize("block", [1, 7, 64, 1000])
def test_spectrum_of_folded_and_combined_rows(block):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 10)) @ rng.normal(size=(10, 10)) + 1000
    x[100:140] = x[100]
    parts = []
    for rows in (x[:1], x[1:250], x[250:]):
        s = Spectrum(10)
        for at in range(0, len(rows), block):
            s.fold(rows[at : at + block])
        parts.append(Spectrum.unpack(10, s.n, s.pack()))
    for other in parts[1:]:
        parts[0].combine(other)
    got, c = parts[0], x - x.mean(0)
    assert got.n == 600 and np.allclose(got.mean, x.mean(0))
    assert np.allclose(got.values, np.linalg.eigvalsh(c.T @ c), rtol=1e-9)


def brute(m, components=8):
    x = np.floor(m.astype(np.float32).astype(np.float64) * 1024).astype(np.int64) + 100000
    n, s = len(x), x.sum(0)
    c = x - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    deviation = [sum(int(v) ** 2 for v in r) for r in n * x - s]
    return n, deviation, c @ u / np.sqrt(e), e / np.trace(c.T @ c / n)


@pytest.mark.parametrize("fold_rows", [1, 2048])
def test_whitening_equals_brute_force(spark, fold_rows):
    rng = np.random.default_rng(2)
    m = (rng.normal(size=(300, 12)) * np.linspace(0.2, 2, 12)) @ np.linalg.qr(rng.normal(size=(12, 12)))[0]
    m[20:60] = m[20]  # repeated rows
    got = whiten(frame(spark, list(enumerate(m)), 20), fold_rows=fold_rows).collect()
    n, deviation, want, share = brute(m)
    assert len(got) == 300 * 8 and {r.n for r in got} == {n}
    sign = {c: np.sign(want[0, c]) * np.sign(next(r.whitened for r in got if r.vec_id == 0 and r.component == c + 1)) for c in range(8)}
    for r in got:
        c = r.component - 1
        assert r.whitened == pytest.approx(sign[c] * want[r.vec_id, c], abs=1e-9)
        assert r.explained == pytest.approx(share[c], rel=1e-9) and r.identity_error < 1e-9
        assert int(r.deviation) == deviation[r.vec_id]


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (None, [2.0, 1.0]), (1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [inf, 1.0]), (6, []), (7, [1e30, 0.0]), (8, [1.0, 1.0, 1.0])]
    got = whiten(frame(spark, rows)).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component, r.n) for r in got) == [(False, 0, 1, 4), (False, 0, 2, 4), (False, 1, 1, 4), (False, 1, 1, 4), (False, 1, 2, 4), (False, 1, 2, 4), (False, 8, 1, 1), (False, 8, 2, 1), (False, 8, 3, 1), (True, 0, 1, 4), (True, 0, 2, 4)]
    assert all((r.whitened is None) == (r.vec_id == 8) for r in got)  # one row has no spread
    assert {r.explained for r in got if r.vec_id == 8} == {0.0}
    # A dimension without spread.
    flat = whiten(frame(spark, [(i, [float(i), 3.0]) for i in range(10)])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat) and flat[0].identity_error < 1e-12
    assert whiten(spark.createDataFrame([], VEC)).collect() == []


def test_deviation_is_exact_beyond_64_bits():
    big = Centre(10**9, [7 * 10**9 + 100000 * 10**9 + 3, 100000 * 10**9])
    x = np.array([[10**6, -5], [7, 0]])
    assert big.deviation(x) == [(10**9 * (10**6 - 7) - 3) ** 2 + (10**9 * 5) ** 2, 9]
    assert Centre(4, [400000 + 6, 400000]).deviation(np.array([[2, 1]])) == [4 + 16]
    assert decimal.Decimal(big.deviation(x)[0]) < decimal.Decimal(10) ** 38


def test_query_on_the_small_table(spark):
    from salesops.llm.queries import op13_whitening

    out = op13_whitening(spark, "/root/testdata/sf0.001")
    assert [f.dataType.simpleString() for f in out.schema][:7] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    m = np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()])
    n, deviation, want, share = brute(m)
    got = out.orderBy("component", "vec_id").collect()
    assert [r.deviation for r in got[:n]] == deviation and len(got) == 8 * n
    w = np.array([r.whitened for r in got]).reshape(8, n).T
    assert np.abs(np.abs(w) - np.abs(want)).max() < 1e-8 and got[0].identity_error < 1e-9
    assert out.where(F.abs(F.col("explained") - F.lit(float(share[0]))) < 1e-9).count() == n
