import math
import random
import re
import resource
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import pytest

import corpus_pipeline
from salesops.llm import common, tokens
from salesops.llm import pitman_yor as P
from salesops.llm.components import components
from salesops.llm.mixing import leaf_budgets, mix_to_weights
from salesops.llm.near_dup import BANDS, SAMPLES, SKETCH_BITS, band_hashes, drop_near_duplicates, minhash, multipliers, near_duplicates, sketches


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, size):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()


def brute_groups(docs, size, percent=80):
    """(doc_id or None, set, least id) by comparing all pairs."""
    sets = [shingles(t, size) for _, t in docs]
    at = list(range(len(docs)))

    def top(x):
        while at[x] != x:
            x = at[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                at[top(i)] = top(j)
    groups = defaultdict(list)
    for i in range(len(docs)):
        groups[top(i)].append(docs[i][0])
    least = {g: min((d for d in v if d is not None), default=None) for g, v in groups.items()}
    return [(d, len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(docs)]


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, n = [], 1000
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        for edits in (0, 0, 1, 2, 3, 5, 8, 12):
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            n -= rng.randint(1, 5)
            docs.append((n, " ".join(own)))
    base = [rng.choice(vocabulary) for _ in range(60)]
    for i in range(80):  # a large group of near copies
        own = list(base)
        for _ in range(rng.randint(1, 7)):
            own[rng.randrange(60)] = rng.choice(vocabulary)
        docs.append((2000 + i, " ".join(own)))
    return docs


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(make_docs, copies, edge, size):
    docs = [*copies, *edge]
    got = near_duplicates(make_docs(docs).withColumn("node", F.lit("clash")), size=size).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute_groups(docs, size))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_document_of_each_group_stays(make_docs, copies, edge):
    docs = [*copies, *edge]
    left = drop_near_duplicates(make_docs(docs).withColumn("text_hash", F.lit(1)), size=5)
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars", "text_hash"]
    got = Counter((r.doc_id, r.text) for r in left.collect())
    groups = brute_groups(docs, 5)
    assert len([1 for k in got if words(k[1])]) == len({g for (d, n, g), (_, t) in zip(groups, docs, strict=True) if n})
    assert sum(v for (d, t), v in got.items() if not words(t)) == sum(not words(t) for _, t in docs)
    assert drop_near_duplicates(make_docs(docs).where("doc_id < 0")).collect() == []


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(3)
    a = multipliers()
    for share in (0.6, 0.8, 0.95):
        errors = []
        for _ in range(30):
            n = 400
            common = rng.integers(0, 2**63, int(n * share), dtype=np.uint64)
            pair = [np.unique(np.concatenate([common, rng.integers(0, 2**63, (n - len(common)) // 2, dtype=np.uint64)])) for _ in range(2)]
            true = len(np.intersect1d(*pair)) / len(np.union1d(*pair))
            m = np.array([minhash(s, a) for s in pair])
            x = sketches(m).view(np.uint64)
            odd = int(np.bitwise_count(x[0] ^ x[1]).sum())
            apart = -SKETCH_BITS / 2 * math.log(1 - 2 * odd / SKETCH_BITS)
            errors.append(1 - apart / (2 * SAMPLES) - true)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06
    assert band_hashes(m).shape == (2, BANDS)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (200, 200), (7, 3), (3, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 103: 100}


def test_budgets_go_to_siblings_first(spark):
    rows = [("a", "en", "s1", 100), ("a", "en", "s2", 10), ("a", "de", "s1", 1000), ("b", "en", "s1", 20), ("b", "de", "s1", 0)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    one = {n: F.lit(1) for n in ("domain", "lang", "source")}
    got = {(r.domain, r.lang, r.source): r.leaf_budget for r in leaf_budgets(leaves, F.lit(400), one, 2).collect()}
    # b can use 40 of its 200; a gets 360: 180 for each language; s2 holds 20, so s1 of en gets 160.
    assert got == {("a", "en", "s1"): 160, ("a", "en", "s2"): 20, ("a", "de", "s1"): 180, ("b", "en", "s1"): 40, ("b", "de", "s1"): 0}


def test_mixture_prefix_and_epochs(make_docs, edge):
    import hashlib

    docs = [(i, " ".join(["word"] * (i % 13))) for i in range(300)] + edge
    mixed = mix_to_weights(make_docs(docs).withColumn("leaf", F.lit("clash")), budget_percent=130).collect()
    rows = defaultdict(list)
    for i, (d, t) in enumerate(docs):
        source = ["src0", "src1", "src5", None][i % 4] or "unknown"
        domain = "other" if source == "unknown" else f"domain{int(source[-1]) % 4}"
        rows[(domain, ["en", "de", None][i % 3] or "unknown", source)].append((d, len(words(t))))
    budget = {(r.mix.domain, r.mix.lang, r.mix.source): (r.mix.leaf_budget, r.mix.leaf_tokens) for r in mixed}
    want = Counter()
    for leaf, own in rows.items():
        total = sum(n for _, n in own)
        if leaf not in budget:
            continue
        assert budget[leaf][1] == total
        epochs, rest = divmod(budget[leaf][0], total)
        key = lambda d: (hashlib.md5(f"20:{epochs}:{'null' if d is None else d}".encode()).hexdigest(), "null" if d is None else str(d))  # noqa: B023, E731
        for d, n in own:
            want.update((leaf, d, e) for e in range(epochs))
            if rest and sum(m for x, m in own if key(x) <= key(d)) <= rest:
                want[(leaf, d, epochs)] += 1
    assert Counter(((r.mix.domain, r.mix.lang, r.mix.source), r.doc_id, r.mix.epoch) for r in mixed) == want
    assert sum(budget[x][0] for x in budget) <= 1.3 * sum(len(words(t)) for _, t in docs)
    assert mix_to_weights(make_docs(docs).where("doc_id < 0")).collect() == []


def test_base_scores_and_counts(make_docs, edge):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice("the of to a big small red blue Cat DOG".split()) for _ in range(rng.randint(0, 40)))) for i in range(200)] + edge
    held = F.col("doc_id") % 10 == 0
    got = P.score_documents(make_docs(docs).withColumn("train", F.lit("clash")), held_out=held, block_tokens=500, bucket_items=300).collect()
    tokens = [(d, [*words(t), None]) for d, t in docs]
    count = Counter(w for d, ws in tokens if d is None or d % 10 for w in ws)
    n, v = sum(count.values()), len(count)
    base = lambda ws: sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
    want = sorted((d or -1, d is not None and d % 10 == 0, len(ws), sum(count[w] > 0 for w in ws), n, round(base(ws), 6)) for d, ws in tokens)
    assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert P.score_documents(make_docs(docs).where("doc_id < 0"), held_out=held).collect() == []


def test_model_learns_word_order(make_docs):
    pairs = [("red", "cat"), ("blue", "dog"), ("green", "fox"), ("white", "owl")]
    rng = random.Random(4)
    docs = [(i, " ".join(x for _ in range(15) for x in rng.choice(pairs))) for i in range(300)]
    got = P.score_documents(make_docs(docs), held_out=F.col("doc_id") % 10 == 0).collect()
    held = [r for r in got if r.held_out]
    # After a colour its animal is certain; so half of the tokens cost next to nothing.
    assert sum(r.score for r in held) > 0.65 * sum(r.base_score for r in held)


def test_predictive_probabilities_sum_to_one():
    rng = np.random.default_rng(8)
    v, d, d0 = 50, 0.6, 0.5
    customers = rng.integers(1, 30, v)
    root = np.minimum(customers, rng.integers(1, 4, v))
    parent = P.parent_probability(customers, root, d0, v, customers.sum(), root.sum())
    unknown = P.parent_probability(0, 0, d0, v, customers.sum(), root.sum())
    assert parent.sum() + unknown == pytest.approx(1)
    c = rng.integers(0, 9, v)
    t = np.minimum(c, 2)
    theta = P.THETA
    chance = (c - d * t + (theta + d * t.sum()) * parent) / (theta + c.sum())
    assert chance.sum() + (theta + d * t.sum()) * unknown / (theta + c.sum()) == pytest.approx(1)


def test_table_sampler_follows_its_conditional():
    d, theta, rest, parent = 0.5, 1.0, 3.0, 0.2
    table, rng = P.log_stirling(d), np.random.default_rng(1)
    n = 20000
    got = P.sample_tables(np.full(n, 4), np.full(n, rest), np.full(n, parent), theta, d, rng, table)
    weight = np.array([math.exp(table[4, t]) * np.prod([theta + d * (rest + k) for k in range(t)]) * parent**t for t in range(1, 5)])
    assert np.abs(np.bincount(got, minlength=5)[1:] / n - weight / weight.sum()).max() < 0.02
    big = P.sample_tables(np.full(50, 5000), np.full(50, rest), np.full(50, parent), theta, d, rng, table)
    assert (big >= 1).all() and (big <= 5000).all() and 1 < big.mean() < 500
    assert math.exp(table[3, 1]) == pytest.approx((1 - d) * (2 - d)) and math.exp(table[3, 2]) == pytest.approx(3 * (1 - d))


def test_packed_arrays():
    arrays = [np.array([], np.int64), np.arange(300), np.array([2**40, 3]), np.zeros(5, np.int64)]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(arrays, P.unpack(P.pack(*arrays)), strict=True))


def test_packed_pairs():
    rng = np.random.default_rng(1)
    u, w = rng.integers(0, 40, 500), rng.integers(0, 2**33, 500)
    order = np.lexsort((w, u))
    got = P.unpack_pairs(P.pack_pairs(u[order], w[order], u[order] + 1))
    assert all((a == b).all() for a, b in zip(got, (u[order], w[order], u[order] + 1), strict=True))


def test_pipeline_stages(spark, make_docs, copies, edge, tmp_path):
    docs = make_docs([*copies, *edge]).withColumn("mix", F.lit("clash")).withColumn("quality_score", F.lit("clash"))
    labels = spark.createDataFrame([(d, 1, 0) for d, _ in copies[:50]], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        before, now = now, spark.read.parquet(f"{tmp_path}/{name}")
        if i < 3:
            assert now.columns == columns
            assert now.select("doc_id", "text").exceptAll(before.select("doc_id", "text")).count() == 0 or name == "mix"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dup", "mix", "pack"]
    assert now.count() > 0 and {"sequence_id", "offset"} <= set(now.columns)


def test_pipeline_on_an_empty_table(spark, make_docs, tmp_path):
    make_docs([(1, "x")]).where("doc_id < 0").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_send_texts_in_batches_bounded_by_bytes(spark, make_docs):
    """Four rows of 1 MB and one of 5 MB: none is lost, and no batch holds much over 2 MB but the long row's."""
    docs = make_docs([*((i, "x" * (1 << 20)) for i in range(4)), (4, "y" * (5 << 20)), (5, None)], 1).coalesce(1)

    def measure(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], names=["rows", "bytes"])

    for _, stage in corpus_pipeline.STAGES[2:]:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        stage(spark, docs.limit(0), "")
        got = docs.mapInArrow(measure, "rows long, bytes long").collect()
        assert sum(r["rows"] for r in got) == 6 and len(got) >= 3
        assert all(r["bytes"] < 3.5 * (1 << 20) or r["bytes"] < 7 * (1 << 20) and r["rows"] <= 2 for r in got)


def resident_mb():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * resource.getpagesize() >> 20


def test_a_partition_gives_its_memory_back(monkeypatch):
    """Freed blocks below one that is still held stay with the process unless they are given back."""
    held = []

    def run(batches):
        blocks = [np.ones(4096) for _ in range(3000)]  # 32 KB each
        held.append(blocks[-1])
        yield from batches

    before = resident_mb()
    assert list(common.giving_back(run)(iter([1, 2]))) == [1, 2]
    assert resident_mb() - before < 40
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    monkeypatch.setattr(tokens, "_LOADED", {"path": object()})
    common.release_tokens()
    common.release_tokens()
    assert tokens._LOADED == {} and calls == [1]
