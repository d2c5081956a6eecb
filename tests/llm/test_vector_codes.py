import hashlib

import numpy as np
import pyspark.sql.types as T
import pytest

from salesops.llm import vector_codes as V

VEC = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.StringType()), T.StructField("code", T.StringType()), T.StructField("error", T.StringType())])


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, "c", "c") for i, v, label in rows], VEC).repartition(parts)


def brute(ids, m, labels, entries, rounds, parts=4):
    """Plain k-means with whole numbers; rows by id."""
    x = np.floor(m.astype(np.float32).astype(np.float64) * 1024).astype(np.int64)
    order = sorted(range(len(x)), key=lambda i: (ids[i] is None, ids[i] or 0, x[i].tolist()))
    edges = V.part_edges(x.shape[1], parts)
    codes, books, errors = [], [], np.zeros(len(x), np.int64)
    for a, b in edges:
        c = x[order[:entries], a:b].copy()
        near = lambda: ((x[:, None, a:b] - c[None]) ** 2).sum(2)  # noqa: B023, E731
        for _ in range(rounds):
            own = near().argmin(1)
            for j in np.unique(own):
                c[j] = [int(s) // int((own == j).sum()) for s in x[own == j, a:b].sum(0)]
        d = near()
        codes.append(d.argmin(1))
        errors += d.min(1)
        books.append(c)
    by_label = {}
    for e, g in zip(errors, labels, strict=True):
        by_label[g] = by_label.get(g, 0) + int(e)
    digest = hashlib.sha256(",".join(str(v) for c in books for v in c.ravel()).encode()).hexdigest()
    return sorted((i is None, i or 0, "".join(f"{c[n]:02x}" for c in codes), int(errors[n]), by_label[g], digest) for n, (i, g) in enumerate(zip(ids, labels, strict=True)))


def rows_of(df):
    return sorted((r.vec_id is None, r.vec_id or 0, r.code, int(r.error), int(r.label_error), r.codebooks_sha256) for r in df.collect())


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(4)
    m = (rng.normal(size=(40, 16))[rng.integers(0, 40, 900)] + rng.normal(scale=0.15, size=(900, 16))).astype(np.float32)
    m[30:60] = m[30]  # repeated rows and ties
    return m, [None if i % 7 == 0 else f"l{i % 3}" for i in range(900)]


@pytest.mark.parametrize("entries,block,labels_", [(32, 100, 10), (256, 4096, 10), (32, 300, 1)])
def test_codes_equal_brute_force(spark, clustered, entries, block, labels_):
    m, labels = clustered
    stats = []
    got = V.encode(frame(spark, list(zip(range(900), m, labels, strict=True)), 5), entries=entries, block_rows=block, broadcast_labels=labels_, stats=stats)
    assert rows_of(got) == brute(list(range(900)), m, labels, entries, 4)
    assert stats[0][1] == stats[0][2] and len(stats) == 4
    assert stats[-1][1] < 0.8 * stats[-1][2]  # bounds spare scans


def test_bounds_never_change_an_assignment():
    rng = np.random.default_rng(8)
    x = rng.integers(-300, 300, (500, 4))
    x[100:200] = x[100]
    c = [rng.integers(-300, 300, (24, 4))]
    c[0][5] = c[0][2]  # equal entries
    groups = V.entry_groups(c[0])
    assert sorted(np.concatenate(groups).tolist()) == list(range(24))
    label, _, lower, stamp = V.first_assignment(x, c[0], groups)
    spared = 0
    for t in range(1, 12):
        c.append(c[-1] + rng.integers(-40, 41, c[-1].shape) * (rng.random((24, 1)) < 0.6) if t % 3 else c[-2].copy())  # entries that swing back too
        label, best, lower, stamp, scanned = V.assign_again(x, c, groups, label, lower, stamp)
        d = V.squared_distances(x, c[-1])
        assert (label == d.argmin(1)).all() and (best == d.min(1)).all()
        spared += lower.size - scanned
        apart = np.sqrt(d)
        apart[np.arange(500), label] = np.inf
        true = np.stack([apart[:, g].min(1) for g in groups], axis=1)
        moved = V.net_moves(c + [c[-1]], groups)[stamp, np.arange(len(groups))]
        assert (lower - moved <= true + 1e-9).all()
    assert spared > 0


def test_net_moves_are_no_more_than_drifts():
    rng = np.random.default_rng(9)
    c = [rng.normal(size=(16, 3)) for _ in range(5)]
    groups = [np.arange(0, 8), np.arange(8, 16)]
    net = V.net_moves(c, groups)
    steps = [np.sqrt(((b - a) ** 2).sum(1)) for a, b in zip(c[:-1], c[1:], strict=True)]
    for t in range(4):
        drift = sum(steps[t:])
        assert all(net[t, g] <= drift[m].max() * (1 + 1e-9) for g, m in enumerate(groups))
    back = V.net_moves([c[0], c[1], c[0]], groups)
    assert (back[0] == 0).all() and (back[1] > 0).all()


@pytest.mark.parametrize("big", [10, 2**27, 2**40])
def test_distances_are_exact_at_every_size(big):
    rng = np.random.default_rng(1)
    x, c = rng.integers(-big, big, (20, 5)), rng.integers(-big, big, (6, 5))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True)) for q in c] for p in x]
    assert [[int(v) for v in r] for r in V.squared_distances(x, c)] == want
    assert [int(v) for v in V.own_distances(x, c[np.zeros(20, int)])] == [r[0] for r in want]


def test_totals_and_floors():
    x = np.array([[-3, 2**45], [-4, 2**45], [5, -1]])
    t = V.totals(np.array([1, 1, 0]), x, 4)
    assert V.moved(np.full((4, 2), 9), t).tolist() == [[5, -1], [-4, 2**45], [9, 9], [9, 9]]


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(3, [1.0, 2.0, -1.0, 0.5, 0.25], "a"), (1, [0.0] * 5, None), (1, [0.0] * 5, None), (None, [0.1] * 5, "a"), (4, None, "a"), (5, [nan] + [0.0] * 4, "a"), (6, [None] + [1.0] * 4, "a"), (7, [inf] * 5, "a"), (8, [], "a"), (9, [-0.5, 7.0], "b")]
    got = V.encode(frame(spark, rows), entries=4)
    five = [r for r in rows if r[1] and len(r[1]) == 5 and r[0] in (3, 1, None)]
    want = brute([r[0] for r in five], np.array([r[1] for r in five]), [r[2] for r in five], 4, 4) + brute([9], np.array([[-0.5, 7.0]]), ["b"], 4, 4)
    assert rows_of(got) == sorted(want)
    assert {r.code for r in got.collect() if r.vec_id == 1} == {"00000000"}  # of equal entries the first
    no_label = V.encode(frame(spark, rows[:1]).drop("label"))
    assert [(r.label, int(r.error)) for r in no_label.collect()] == [(None, 0)]
    assert V.encode(spark.createDataFrame([], VEC)).collect() == []
