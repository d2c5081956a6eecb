"""The model's own scores against a plain sequential sampler; tables of dishes against their exact distribution."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyspark.sql.functions as F
import pytest

from salesops.llm import pitman_yor as P

START, END = "<start>", "<end>"


def corpus(seed: int = 6) -> list[tuple[int, str]]:
    """Skewed words, some of which mostly follow others; pairs are seen once to some hundred times."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    weight = [1 / (i + 1) for i in range(40)]
    docs = []
    for i in range(150):
        text = []
        for _ in range(rng.randint(3, 25)):
            text.append("w1" if text and text[-1] == "w0" and rng.random() < 0.8 else rng.choices(words, weight)[0])
        if rng.random() < 0.3:
            text.append(f"rare{rng.randint(0, 60)}")
        docs.append((i, " ".join(text)))
    return docs


def steps(text: str) -> list[tuple[str, str]]:
    words = [START, *text.split(), END]
    return list(zip(words, words[1:], strict=False))


class Seating:
    """Restaurants with every table listed; customers leave and come back one at a time."""

    def __init__(self, pairs: list[tuple[str, str]], d: float, d0: float, vocabulary: int, rng: random.Random):
        self.d, self.d0, self.v, self.rng = d, d0, vocabulary, rng
        self.tables: dict = defaultdict(list)  # (context, word) -> sizes
        self.n_tables, self.customers = Counter(), Counter()  # by context
        self.root: dict = defaultdict(list)
        self.root_n = self.root_t = 0
        for u, w in pairs:
            self.enter(u, w)

    def parent(self, w: str) -> float:
        own = self.root.get(w, ())
        return (sum(own) - self.d0 * len(own) + (P.ROOT_THETA + self.d0 * self.root_t) / (self.v + 1)) / (P.ROOT_THETA + self.root_n)

    def chance(self, u: str, w: str) -> float:
        own = self.tables.get((u, w), ())
        return (sum(own) - self.d * len(own) + (P.THETA + self.d * self.n_tables[u]) * self.parent(w)) / (P.THETA + self.customers[u])

    def sit(self, sizes: list[int], d: float, new: float) -> bool:
        at = self.rng.choices(range(len(sizes) + 1), [*(s - d for s in sizes), new])[0]
        if at < len(sizes):
            sizes[at] += 1
            return False
        sizes.append(1)
        return True

    def rise(self, sizes: list[int]) -> bool:
        at = self.rng.choices(range(len(sizes)), sizes)[0]
        sizes[at] -= 1
        if sizes[at]:
            return False
        sizes.pop(at)
        return True

    def enter(self, u: str, w: str) -> None:
        if self.sit(self.tables[u, w], self.d, (P.THETA + self.d * self.n_tables[u]) * self.parent(w)):
            self.n_tables[u] += 1
            if self.sit(self.root[w], self.d0, (P.ROOT_THETA + self.d0 * self.root_t) / (self.v + 1)):
                self.root_t += 1
            self.root_n += 1
        self.customers[u] += 1

    def leave(self, u: str, w: str) -> None:
        if self.rise(self.tables[u, w]):
            self.n_tables[u] -= 1
            self.root_t -= self.rise(self.root[w])
            self.root_n -= 1
        self.customers[u] -= 1


def sequential_scores(docs: list[tuple[int, str]], burn_in: int = 15, samples: int = 40) -> dict[int, float]:
    pairs = [p for i, t in docs if i % 10 for p in steps(t)]
    of_pairs, of_words = Counter(pairs), Counter(w for _, w in pairs)
    share = lambda c: min(max(c[1] / (c[1] + 2 * c[2]), 0.1), 0.9)
    d, d0 = share(Counter(of_pairs.values())), share(Counter(of_words.values()))
    state = Seating(pairs, d, d0, len(of_words), random.Random(3))
    asked = {p for _, t in docs for p in steps(t)}
    chance = Counter()
    for k in range(burn_in + samples):
        for u, w in pairs:
            state.leave(u, w)
            state.enter(u, w)
        if k >= burn_in:
            for p in asked:
                chance[p] += state.chance(*p) / samples
    return {i: sum(math.log10(chance[p]) for p in steps(t)) for i, t in docs}


def test_scores_equal_those_of_a_sequential_sampler(make_docs):
    """Two kept sweeps in parallel give the scores of a long chain of single customers."""
    docs = corpus()
    assert max(Counter(p for i, t in docs if i % 10 for p in steps(t)).values()) > 200
    want = sequential_scores(docs)
    totals = {True: sum(s for i, s in want.items() if i % 10 == 0), False: sum(s for i, s in want.items() if i % 10)}
    for seed in (5, 6):
        rows = P.score_documents(make_docs(docs), held_out=F.col("doc_id") % 10 == 0, block_tokens=400, bucket_items=300, seed=seed).collect()
        got = {r.doc_id: r.score for r in rows}
        for held, total in totals.items():
            own = sum(s for i, s in got.items() if (i % 10 == 0) == held)
            print("held out" if held else "training", own, total, own / total - 1)
            assert own == pytest.approx(total, rel=0.01)
        apart = [abs(got[i] - want[i]) / (len(docs[i][1].split()) + 1) for i in got]
        print("log10 apart a token: mean", np.mean(apart), "most", max(apart))
        assert np.mean(apart) < 0.02 and max(apart) < 0.15


def exact_mean(d: float, c: int, rest: float, parent: float, table: np.ndarray) -> float:
    weight = np.cumsum(np.log(P.THETA + d * (rest + np.arange(c))) + math.log(parent)) + table[c, 1 : c + 1]
    p = np.exp(weight - weight.max())
    return float((np.arange(1, c + 1) * p).sum() / p.sum())


@pytest.mark.parametrize("d", [0.5, 0.8])
def test_tables_of_dishes_of_all_sizes(d):
    """Mean tables against the exact distribution: equal up to MAX_EXACT customers, close to it above."""
    rng, large = np.random.default_rng(2), 3 * P.MAX_EXACT
    whole, n = P.log_stirling(d, large), 3000
    for rest, parent in ((0.0, 0.3), (20.0, 0.05), (200.0, 0.01), (1000.0, 0.001)):
        # One call for all sizes: dishes of several sizes are sampled together.
        sizes = np.array([2, 3, 65, 150, 400, P.MAX_EXACT, P.MAX_EXACT + 500, large])
        c = np.tile(sizes, n)
        got = P.sample_tables(c, np.full(len(c), rest), np.full(len(c), parent), P.THETA, d, rng, P.log_stirling(d))
        assert (got >= 1).all() and (got <= c).all()
        for size in sizes.tolist():
            mean, want = got[c == size].mean(), exact_mean(d, size, rest, parent, whole)
            # What the tables change: a dish's share of its restaurant, d * tables of c customers.
            print(d, size, rest, parent, "exact", round(want, 2), "sampled", round(mean, 2), "share", round(d * abs(mean - want) / size, 5))
            if size <= P.MAX_EXACT:
                assert mean == pytest.approx(want, abs=0.15)
            else:
                assert d * abs(mean - want) / size < 0.002
