import re

import numpy as np
import pytest
import xxhash

from salesops.llm import simhash as S
from salesops.llm.common import SLICE_BYTES


def plain_fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(rows, radius=2):
    """(doc_id, fingerprint, component) of (doc_id, fingerprint) rows by comparing all of them."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(b)] = find(a)
    least = {}
    for d, f in rows:
        g = find(f)
        least[g] = min((x for x in (least.get(g), d) if x is not None), default=None)
    return sorted(((d is None, d or 0), f, (least[find(f)] is None, least[find(f)] or 0)) for d, f in rows)


def result(df):
    return sorted(((r.doc_id is None, r.doc_id or 0), r.fp % (1 << 64), (r.component_id is None, r.component_id or 0)) for r in df.collect())


def test_fingerprints_of_edge_texts(edge):
    for _, t in edge:
        assert S.fingerprint(None if t is None else t.encode()) % (1 << 64) == plain_fingerprint(t)


@pytest.mark.parametrize("words", [1, 2, 3, 4, 127, 130, 131, 500])
def test_fingerprints_of_many_sizes(words):
    rng = np.random.default_rng(words)
    t = "  ".join(f"W{i}é" for i in rng.integers(0, 50, words))
    assert S.fingerprint(t.encode()) % (1 << 64) == plain_fingerprint(t)


def test_fingerprint_of_a_text_over_many_slices():
    rng = np.random.default_rng(0)
    t = " ".join(f"w{i}" for i in rng.integers(0, 300_000, 250_000)) + " " + "x" * 200_000 + " end"
    assert len(t) > 3 * SLICE_BYTES
    assert S.fingerprint(t.encode()) % (1 << 64) == plain_fingerprint(t)


def near_prints(n, seed):
    """Random fingerprints, and clusters and chains of near ones."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
    more = [base]
    for f in base[: n // 10]:
        x = f
        for _ in range(8):  # a chain: each differs in a bit or two from the one before
            x = x ^ (np.uint64(1) << np.uint64(rng.integers(0, 64))) ^ (np.uint64(1) << np.uint64(rng.integers(0, 64)))
            more.append(np.array([x]))
    return np.unique(np.concatenate([*more, [np.uint64(0), np.uint64(3), np.uint64(2**64 - 1)]]))


def insert(tree, fp):
    """A BK-tree as nested dictionaries."""
    while True:
        d = (int(tree["fp"]) ^ int(fp)).bit_count()
        if d not in tree["kids"]:
            tree["kids"][d] = {"fp": fp, "kids": {}}
            return
        tree = tree["kids"][d]


def test_tree_is_that_of_inserting_one_by_one():
    fps = np.random.default_rng(3).permutation(near_prints(200, 3))
    tree = S.BKTree.build(fps)
    plain = {"fp": fps[0], "kids": {}}
    for f in fps[1:]:
        insert(plain, f)
    todo = [(0, plain)]
    seen = 0
    while todo:
        at, node = todo.pop()
        seen += 1
        kids = range(tree.first[at], tree.first[at] + tree.count[at])
        assert tree.fps[at] == node["fp"] and [int(tree.key[c]) for c in kids] == sorted(node["kids"])
        todo += [(c, node["kids"][int(tree.key[c])]) for c in kids]
    assert seen == len(fps)
    again = S.BKTree.unpack(tree.pack())
    assert (again.fps == tree.fps).all() and (again.count == tree.count).all()


@pytest.mark.parametrize("radius", [0, 1, 2, 5])
def test_tree_search_equals_brute_force(radius, monkeypatch):
    monkeypatch.setattr(S, "FRONTIER", 500)
    fps = np.random.default_rng(3).permutation(near_prints(300, 4))
    tree = S.BKTree.build(fps)
    got = {(int(a), int(b)) for q, n in tree.within(fps, radius) for a, b in zip(fps[q], tree.fps[n], strict=True)}
    assert got == {(int(a), int(b)) for a in fps for b in fps if (int(a) ^ int(b)).bit_count() <= radius}


def test_few_nodes_are_visited():
    fps = np.random.default_rng(6).integers(0, 2**63, 20000, dtype=np.uint64)
    tree, visits = S.BKTree.build(np.unique(fps)), []
    plain = S.distance
    S.distance = lambda a, b: visits.append(len(a)) or plain(a, b)
    try:
        list(tree.within(fps[:100], 2))
    finally:
        S.distance = plain
    assert sum(visits) < 0.2 * 100 * len(tree.fps)


@pytest.mark.parametrize("shard_rows,query_block", [(1 << 18, 1 << 15), (40, 64), (3, 7)])
def test_groups_equal_brute_force(spark, shard_rows, query_block, monkeypatch):
    fps = near_prints(150, 7)
    rng = np.random.default_rng(1)
    rows = [(int(i), int(f)) for i, f in enumerate(rng.permutation(np.concatenate([fps, fps[:60], fps[:20]])))]
    prints = spark.createDataFrame([(d, f - (1 << 64) if f >> 63 else f) for d, f in rows], "doc_id long, fp long").repartition(3)
    monkeypatch.setattr(S, "fingerprints", lambda docs, size: prints)
    docs = spark.createDataFrame([], "doc_id long, text string")
    got = S.simhash_duplicates(docs, shard_rows=shard_rows, query_block=query_block)
    assert result(got) == plain_groups(rows)


def test_documents_equal_brute_force(spark, make_docs, edge):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{j}" for j in rng.integers(0, 40, n)) for n in rng.integers(20, 400, 30)]
    pairs = list(edge) + [(100 + i, t) for i, t in enumerate(texts)] + [(200 + i, t + " more") for i, t in enumerate(texts)] + [(300, None), (7, texts[0].upper())]
    docs = make_docs(pairs).withColumnsRenamed({"lang": "fp", "source": "component_id"})
    got = S.simhash_duplicates(docs, shard_rows=16, query_block=8)
    assert result(got) == plain_groups([(d, plain_fingerprint(t)) for d, t in pairs])
    assert S.simhash_duplicates(make_docs([])).collect() == []


def test_query_on_the_small_table(spark):
    from salesops.llm.queries import op12_simhash

    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = op12_simhash(spark, "/root/testdata/sf0.001").collect()
    want = {d: (f"{f:016x}", c[1]) for (_, d), f, c in plain_groups(rows)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want and len(got) == len(rows)
