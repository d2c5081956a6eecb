"""Language-model scores from a hierarchical Pitman-Yor model of word pairs.

Restaurants: one for each context (the word before, or the start of a text),
all sharing one parent, the unigram restaurant, whose base is uniform over the
known words and one unknown word. The state of a dish in a restaurant is its
customers c and tables t; every table sends one customer to the parent.
Gibbs sweeps draw each t from its conditional given the tables of the other
dishes (``S(c, t) * prod(theta + d * (rest + k)) * parent ** t``, S: generalised
Stirling numbers, the seatings summed out); of dishes with more than ``MAX_EXACT``
customers so many are seated in this way and the others follow one by one, in
growing blocks, which opens a few tables too many (measured in the tests). After
the burn-in the predictive probabilities of the kept sweeps are averaged.

Distribution. Texts are cut into blocks of whole documents. A block knows its
own distinct words and word pairs, so counts are summed before anything moves:

* words go to buckets by hash, which number them and sum their counts;
* pairs go to buckets by context; contexts that are more than a bucket's work
  are dealt over several by the second word, so a hot word is split;
* pairs seen once have one table, always; only those seen more often are kept
  as state and sampled. Each sweep exchanges table counts between pair buckets
  and word buckets and nothing else;
* at the end both kinds of bucket answer each block for its own words and
  pairs, and the block scores its documents.

Lists travel as packed arrays: a row is a (block, bucket) pair, not a token.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesops.llm.common import batch_word_hashes, mix64, shared_path, small, stored

BLOCK_TOKENS = 1_000_000
BUCKET_ITEMS = 400_000
BURN_IN, SAMPLES = 1, 2
THETA, ROOT_THETA = 1.0, 1.0
MAX_EXACT = 1024
SMOOTH = 0.1
END, START = np.uint64(1), np.uint64(2)  # the token after the last word; the context before the first

BLOCKS = "block long, n_words long, n_tokens long, doc_ids array<long>, sizes array<long>, train array<boolean>, tokens binary, words binary, counts binary"
MAIL = "bucket int, block long, payload binary"


# --- packed arrays -----------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Non-negative integer arrays in as few bytes as their values need, compressed."""
    parts = []
    for x in arrays:
        top = int(x.max()) if len(x) else 0
        width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
        body = np.ascontiguousarray(x.astype(f"<u{width}")).view(np.uint8).reshape(-1, width).T.tobytes()
        parts.append(np.array([len(x), width], "<u8").tobytes() + body)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = memoryview(zstandard.ZstdDecompressor().decompress(data))
    out, at = [], 0
    while at < len(raw):
        n, width = np.frombuffer(raw, "<u8", 2, at).astype(np.int64).tolist()
        body = np.frombuffer(raw, np.uint8, n * width, at + 16).reshape(width, n).T
        out.append(np.ascontiguousarray(body).view(f"<u{width}").reshape(-1).astype(np.uint64))
        at += 16 + n * width
    return out


def mail(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["bucket", "block", "payload"])


def deal(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its items in order) of every bucket that has any."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in range(n):
        if edges[b + 1] > edges[b]:
            yield b, order[edges[b] : edges[b + 1]]


def word_bucket(words: np.ndarray, n: int) -> np.ndarray:
    return ((words >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


# --- sampling ----------------------------------------------------------------


@lru_cache(maxsize=4)
def log_stirling(d: float, n: int = MAX_EXACT) -> np.ndarray:
    """Logarithms of generalised Stirling numbers S(c, t), c and t up to n."""
    s = np.full((n + 1, n + 1), -np.inf)
    s[0, 0] = 0.0
    for c in range(n):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            s[c + 1, 1 : c + 2] = np.logaddexp(s[c, :-1][: c + 1], np.log(np.maximum(c - d * t, 0)) + s[c, 1:][: c + 1])
    return s


def sample_tables(c: np.ndarray, rest: np.ndarray, parent: np.ndarray, theta: float, d: float, rng: np.random.Generator, table: np.ndarray) -> np.ndarray:
    """Tables of each dish, from ``c`` customers, ``rest`` tables of other dishes and the parent's probability."""
    out = np.ones(len(c), np.int64)
    exact = np.minimum(c, MAX_EXACT)
    order = np.argsort(exact, kind="stable")
    low, top = int(np.searchsorted(exact[order], 2)), 2
    while low < len(order):
        # Dishes of about as many customers together; of more tables than customers there are no seatings.
        high = int(np.searchsorted(exact[order], top, side="right"))
        for s in range(low, high, max(1, 1_000_000 // top)):
            at = order[s : min(high, s + max(1, 1_000_000 // top))]
            logit = np.cumsum(np.log(theta + d * (rest[at, None] + np.arange(top))) + np.log(parent[at])[:, None], axis=1) + table[exact[at], 1 : top + 1]
            out[at] = 1 + (logit + rng.gumbel(size=logit.shape)).argmax(axis=1)
        low, top = high, min(MAX_EXACT, max(top + 1, top * 5 // 4))
    big = np.flatnonzero(c > MAX_EXACT)
    if len(big):
        t, j = out[big].astype(np.float64), np.full(len(big), float(MAX_EXACT))
        while True:
            left = c[big] - j
            if not (left > 0).any():
                break
            step = np.minimum(np.maximum(1, j // 16), np.maximum(left, 0))
            open_new = (theta + d * (rest[big] + t)) * parent[big]
            p = open_new / (open_new + np.maximum(j + (step - 1) / 2 - d * t, 1e-12))
            t += rng.binomial(step.astype(np.int64), np.clip(p, 0, 1))
            j += step
        out[big] = np.minimum(t, c[big]).astype(np.int64)
    return out


# --- blocks and words --------------------------------------------------------


def token_blocks(docs: DataFrame, block_tokens: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        ids: list = []
        train: list = []
        held: list[np.ndarray] = []
        size = 0

        def row() -> pa.RecordBatch:
            words, place = np.unique(np.concatenate([*held, np.array([END, START])]), return_inverse=True)
            place = place[:-2]
            sizes = np.array([len(h) for h in held], np.int64)
            counts = np.bincount(place[np.repeat(np.array(train, bool), sizes)], minlength=len(words))
            cols = [[(task << 32) + seq], [len(words)], [int(sizes.sum())], [ids], [sizes.tolist()], [train], [pack(_ranks(counts)[place])], [pack(np.diff(words, prepend=np.uint64(0)))], [pack(counts)]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for b in small(batches):
            names, use = b.column("doc_id").to_pylist(), b.column("train").to_pylist()
            for i, words in enumerate(batch_word_hashes(b.column("text").to_pylist())):
                ids.append(names[i])
                train.append(use[i])
                held.append(np.append(np.maximum(words, np.uint64(3)), END))
                size += len(words) + 1
                if size >= block_tokens:
                    yield row()
                    seq, ids, train, held, size = seq + 1, [], [], [], 0
        if ids:
            yield row()

    return docs.mapInArrow(cut, BLOCKS)


def _ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each word of a block by falling count: small numbers for frequent words pack well."""
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(-counts.astype(np.int64), kind="stable")] = np.arange(len(counts))
    return rank


def tokens_of(row: dict) -> np.ndarray:
    """Each token's place among the block's words."""
    (ranks,), (counts,) = unpack(row["tokens"]), unpack(row["counts"])
    return np.argsort(-counts.astype(np.int64), kind="stable")[ranks.astype(np.int64)]


def words_of(row: dict) -> np.ndarray:
    return np.cumsum(unpack(row["words"])[0])  # sorted; kept as differences


def number_words(n_buckets: int):
    """A word bucket: sums counts, numbers words by falling count, answers each block."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        lists = [(np.cumsum(x), n) for x, n in map(unpack, t["payload"].to_pylist())]
        words, place = np.unique(np.concatenate([x[0] for x in lists]), return_inverse=True)
        count = np.bincount(place, np.concatenate([x[1] for x in lists]).astype(np.float64), minlength=len(words)).astype(np.int64)
        rank = np.empty(len(words), np.int64)
        rank[np.lexsort((words, -count))] = np.arange(len(words))
        ids = rank * n_buckets + bucket
        rows, at = [], 0
        for block, x in zip(t["block"].to_pylist(), lists, strict=True):
            own = place[at : at + len(x[0])]
            rows.append((bucket, block, pack(ids[own], count[own])))
            at += len(x[0])
        # The bucket's own table, under block -1: counts in the order of rank.
        rows.append((bucket, -1, pack(np.sort(count)[::-1])))
        return pa.Table.from_batches([mail(rows)])

    return run


def send_words(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                words, (counts,) = words_of(r), unpack(r["counts"])
                yield mail([(k, r["block"], pack(np.diff(words[at], prepend=np.uint64(0)), counts[at])) for k, at in deal(word_bucket(words, n_buckets), n_buckets)])

    return run


def answers(rows: pa.Table, bucket: np.ndarray, n: int, width: int) -> list[np.ndarray]:
    """Answers of all buckets put back in the order in which the items were dealt."""
    by = dict(zip(rows["bucket"].to_pylist(), rows["payload"].to_pylist(), strict=True))
    out = [np.zeros(len(bucket), np.int64) for _ in range(width)]
    for k, at in deal(bucket, n):
        for x, got in zip(out, unpack(by[k]), strict=True):
            x[at] = got.astype(np.int64)
    return out


# --- pairs -------------------------------------------------------------------


def block_pairs(place: np.ndarray, sizes: np.ndarray, ids: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context, word) places of a block in the order of their numbers, and which pair each token is."""
    n_words = len(ids)
    before = np.empty(len(place), np.int64)
    before[1:] = place[:-1]
    before[np.cumsum(sizes) - sizes] = start
    pairs, which = np.unique(before * n_words + place, return_inverse=True)
    u, w = pairs // n_words, pairs % n_words
    order = np.lexsort((ids[w], ids[u]))
    turn = np.empty(len(order), np.int64)
    turn[order] = np.arange(len(order))
    return u[order], w[order], turn[which]


def pack_pairs(u: np.ndarray, w: np.ndarray, seen: np.ndarray) -> bytes:
    """Pairs sorted by (u, w), as differences."""
    new = np.diff(u, prepend=-1) > 0
    return pack(np.diff(u, prepend=0), np.where(new, w, np.diff(w, prepend=0)), seen)


def unpack_pairs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    du, dw, seen = unpack(data)
    new = du > 0
    new[:1] = True
    total = np.cumsum(dw)
    first = np.flatnonzero(new)
    before = (total[first] - dw[first])[np.cumsum(new) - 1]
    return np.cumsum(du), total - before, seen


def pair_bucket(u: np.ndarray, w: np.ndarray, count_u: np.ndarray, n: int) -> np.ndarray:
    """By context; a context with more than a bucket's work is dealt on by the word."""
    spread = np.minimum(1 + count_u // BUCKET_ITEMS, n).astype(np.uint64)
    return ((mix64(u.astype(np.uint64)) % np.uint64(n) + mix64(w.astype(np.uint64) + np.uint64(77)) % spread) % np.uint64(n)).astype(np.int64)


def send_pairs(n_words: int, n_pairs: int, n_train: int):
    def run(key: tuple[pa.Scalar, ...], blocks: pa.Table, replies: pa.Table) -> pa.Table:
        r = blocks.to_pylist()[0]
        words = words_of(r)
        ids, count = answers(replies, word_bucket(words, n_words), n_words, 2)
        place, sizes, start = tokens_of(r), np.array(r["sizes"], np.int64), int(np.searchsorted(words, START))
        count[start] = n_train
        u, w, which = block_pairs(place, sizes, ids, start)
        seen = np.bincount(which[np.repeat(np.array(r["train"], bool), sizes)], minlength=len(u))
        rows = [(k, r["block"], pack_pairs(ids[u[at]], ids[w[at]], seen[at])) for k, at in deal(pair_bucket(ids[u], ids[w], count[u], n_pairs), n_pairs)]
        return pa.Table.from_batches([mail(rows)])

    return run


def merged_pairs(t: pa.Table) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A pair bucket's distinct pairs: (sizes by block, place of each item, u, w, c), in a fixed order."""
    lists = [unpack_pairs(p) for p in t["payload"].to_pylist()]
    u, w, c = (np.concatenate([x[i] for x in lists]) for i in range(3))
    _, first, place = np.unique(mix64(u) + w * np.uint64(0x9E3779B97F4A7C15), return_index=True, return_inverse=True)
    total = np.bincount(place, c.astype(np.float64), minlength=len(first)).astype(np.int64)
    return list(zip(t["block"].to_pylist(), [len(x[0]) for x in lists], strict=True)), place, u[first].astype(np.int64), w[first].astype(np.int64), total


STATE = "bucket int, u binary, w binary, c binary, t binary, kept binary, ones long, twos long"
COUNTED = f"{STATE}, block long, payload binary"


def _state(bucket: int, u, w, c, t, kept, ones: int = 0, twos: int = 0) -> pa.Table:
    kinds = [pa.int32(), *[pa.binary()] * 5, pa.int64(), pa.int64()]
    values = [bucket, *[pack(x) for x in (u, w, c, t, kept)], ones, twos]
    return pa.table([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in STATE.split(", ")])


def count_pairs(n_words: int):
    """A pair bucket's first state: pairs seen more than once, with one table each.

    The one table of a pair seen once never changes, so those pairs are not
    kept: they are summed here, as mail to the word buckets (block -2 - bucket).
    """

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        _, _, u, w, c = merged_pairs(t)
        more, one = c > 1, c == 1
        state = _state(bucket, u[more], w[more], c[more], np.ones(int(more.sum()), np.int64), np.zeros(int(more.sum()), np.int64), int(one.sum()), int((c == 2).sum()))
        state = state.append_column("block", pa.nulls(1, pa.int64())).append_column("payload", pa.nulls(1, pa.binary()))
        once = mail([(k, -2 - b, p) for k, b, p in table_mail(u[one], w[one], c[one], bucket, n_words)])
        rows = {n.split()[0]: once[n.split()[0]] if n.split()[0] in once.schema.names else pa.nulls(len(once), state.schema.field(n.split()[0]).type) for n in COUNTED.split(", ")}
        return pa.concat_tables([state, pa.table(rows)])

    return run


def table_mail(u: np.ndarray, w: np.ndarray, t: np.ndarray, bucket: int, n_words: int) -> list[tuple]:
    """Tables by context and by word, to the word buckets."""
    ids, place = np.unique(np.concatenate([u, w]), return_inverse=True)
    by_u = np.bincount(place[: len(u)], t.astype(np.float64), minlength=len(ids)).astype(np.int64)
    by_w = np.bincount(place[len(u) : len(u) + len(w)], t.astype(np.float64), minlength=len(ids)).astype(np.int64)
    return [(k, bucket, pack(ids[at], by_u[at], by_w[at])) for k, at in deal(ids % n_words, n_words)]


def add_tables(lists: list, tables: np.ndarray, customers: np.ndarray, n_words: int) -> None:
    for ids, by_u, by_w in lists:
        at = ids.astype(np.int64) // n_words
        tables[at] += by_u.astype(np.int64)
        customers[at] += by_w.astype(np.int64)


def sum_once(n_words: int):
    """A word bucket: what the pairs seen once add to its words, the same in every sweep (block -1)."""

    def run(key: tuple[pa.Scalar, ...], sent: pa.Table, words: pa.Table) -> pa.Table:
        (count,) = unpack(words["payload"].to_pylist()[0])
        tables, customers = np.zeros(len(count), np.int64), np.zeros(len(count), np.int64)
        add_tables([unpack(p) for p in sent["payload"].to_pylist()], tables, customers, n_words)
        return pa.Table.from_batches([mail([(key[0].as_py(), -1, pack(tables, customers))])])

    return run


def sum_tables(n_words: int, d0: float, vocabulary: int, root_before: int, seed: int):
    """A word bucket: customers and tables of its words in the root, tables of its contexts."""

    def run(key: tuple[pa.Scalar, ...], sent: pa.Table, once: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        tables, customers = (x.astype(np.int64) for x in unpack(once["payload"].to_pylist()[0]))
        lists = [(b, unpack(p)) for b, p in zip(sent["block"].to_pylist(), sent["payload"].to_pylist(), strict=True)]
        add_tables([x for _, x in lists], tables, customers, n_words)
        rng = np.random.default_rng([seed, bucket])
        some = np.flatnonzero(customers)
        root = np.zeros(len(tables), np.int64)
        root[some] = sample_tables(customers[some], np.full(len(some), float(root_before)), np.full(len(some), 1.0 / (vocabulary + 1)), ROOT_THETA, d0, rng, log_stirling(d0))
        rows = [(bucket, block, pack(x[0], tables[at], customers[at], root[at])) for block, x in lists for at in [x[0].astype(np.int64) // n_words]]
        rows.append((bucket, -1, pack(tables, customers, root)))
        return pa.Table.from_batches([mail(rows)])

    return run


def parent_probability(customers, root, d0: float, vocabulary: int, total: int, root_total: int):
    """Predictive probability of words in the unigram restaurant."""
    return (customers - d0 * root + (ROOT_THETA + d0 * root_total) / (vocabulary + 1)) / (ROOT_THETA + total)


def sweep(n_words: int, d: float, d0: float, vocabulary: int, total: int, root_total: int, keep: bool, seed: int):
    """One Gibbs sweep of a pair bucket, in two halves of its dishes."""

    def run(key: tuple[pa.Scalar, ...], state: pa.Table, replies: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        r = state.to_pylist()[0]
        u, w, c, t, kept = (unpack(r[n])[0].astype(np.int64) for n in ("u", "w", "c", "t", "kept"))
        if len(c) and replies.num_rows:
            got = [unpack(p) for p in replies["payload"].to_pylist()]
            ids, tables, customers, root = (np.concatenate([g[i] for g in got]).astype(np.int64) for i in range(4))
            order = np.argsort(ids)
            ids, tables, customers, root = ids[order], tables[order], customers[order], root[order]
            pu, pw = np.searchsorted(ids, u), np.searchsorted(ids, w)
            parent = parent_probability(customers, root, d0, vocabulary, total, root_total)[pw]
            rng = np.random.default_rng([seed, bucket])
            half = rng.integers(0, 2, len(c))
            for side in (0, 1):
                at = np.flatnonzero(half == side)
                new = sample_tables(c[at], np.maximum(tables[pu[at]] - t[at], 0).astype(np.float64), parent[at], THETA, d, rng, log_stirling(d))
                np.add.at(tables, pu[at], new - t[at])
                t[at] = new
        if keep:
            kept = kept + t
        return _state(bucket, u, w, c, t, kept)

    return run


def send_tables(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                u, w, t = (unpack(r[n])[0].astype(np.int64) for n in ("u", "w", "t"))
                yield mail(table_mail(u, w, t, r["bucket"], n_words))

    return run


def answer_pairs(key: tuple[pa.Scalar, ...], sent: pa.Table, state: pa.Table) -> pa.Table:
    """To each block: its pairs' counts and, of those seen more than once, the kept tables (summed over samples)."""
    bucket = key[0].as_py()
    blocks, place, u, w, c = merged_pairs(sent)
    tables = np.zeros(len(c), np.int64)
    tables[c > 1] = unpack(state.to_pylist()[0]["kept"])[0].astype(np.int64)  # the state keeps repeated pairs in this order
    rows, at = [], 0
    for block, n in blocks:
        own = place[at : at + n]
        rows.append((bucket, block, pack(c[own], tables[own][c[own] > 1])))
        at += n
    return pa.Table.from_batches([mail(rows)])


def answer_words(n_words: int):
    """To each block: count, and in each kept sample tables as context, customers and root tables."""

    def run(key: tuple[pa.Scalar, ...], asked: pa.Table, samples: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        kept = [[x.astype(np.int64) for x in unpack(p)] for _, p in sorted(zip(samples["sample"].to_pylist(), samples["payload"].to_pylist(), strict=True))]
        rows = []
        for block, p in zip(asked["block"].to_pylist(), asked["payload"].to_pylist(), strict=True):
            if block >= 0:
                ids, count = unpack(p)
                at = ids.astype(np.int64) // n_words
                rows.append((bucket, block, pack(ids, count, *[x[at] for k in kept for x in k])))
        return pa.Table.from_batches([mail(rows)])

    return run


SCORES = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def score_block(n_words: int, n_pairs: int, d: float, d0: float, vocabulary: int, n_train: int, corpus: int, totals: list[tuple[int, int]]):
    def run(key: tuple[pa.Scalar, ...], blocks: pa.Table, replies: pa.Table) -> pa.Table:
        r = blocks.to_pylist()[0]
        words = words_of(r)
        of_words, of_pairs = (replies.filter(pa.compute.equal(replies["kind"], k)) for k in ("word", "pair"))
        ids, count, *rest = answers(of_words, word_bucket(words, n_words), n_words, 2 + 3 * SAMPLES)
        place, sizes, start = tokens_of(r), np.array(r["sizes"], np.int64), int(np.searchsorted(words, START))
        context = count.copy()
        context[start] = n_train
        u, w, which = block_pairs(place, sizes, ids, start)
        c, tables = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64)
        by = dict(zip(of_pairs["bucket"].to_pylist(), of_pairs["payload"].to_pylist(), strict=True))
        for k, at in deal(pair_bucket(ids[u], ids[w], context[u], n_pairs), n_pairs):
            seen, more = (x.astype(np.int64) for x in unpack(by[k]))
            c[at], own_tables = seen, np.where(seen == 1, SAMPLES, 0)  # a pair seen once has one table in every sample
            own_tables[seen > 1] = more
            tables[at] = own_tables
        chance = (SAMPLES * c - d * tables).astype(np.float64)
        for s, (total, root_total) in enumerate(totals):
            own_tables, customers, root = rest[3 * s : 3 * s + 3]
            chance += (THETA + d * own_tables[u]) * parent_probability(customers, root, d0, vocabulary, total, root_total)[w]
        log = np.log10(chance / (SAMPLES * (THETA + context[u])))
        base = np.log10((count + SMOOTH) / (corpus + SMOOTH * (vocabulary + 1)))
        edges = np.cumsum(sizes) - sizes
        sums = lambda x: np.add.reduceat(x, edges)  # noqa: E731  every document has its end token at least
        cols = [r["doc_ids"], r["train"], sizes, sums((count[place] > 0).astype(np.int64)), sums(base[place]), sums(log[which])]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCORES.split(", ")])

    return run


class Kept:
    """Bucketed tables in the shared folder: grouping by their key needs no shuffle."""

    def __init__(self, spark):
        self.spark, self.names = spark, []

    def write(self, df: DataFrame, key: str, buckets: int) -> DataFrame:
        name = f"llm_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets, key).option("path", shared_path(self.spark, name)).format("parquet").saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def score_documents(docs: DataFrame, *, held_out: Column, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, bucket_items: int = BUCKET_ITEMS, seed: int = 5) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every text.

    Learns from the rows for which ``held_out`` is false; scores are log10
    probabilities of the whole text with its end token.

    Defined cases: a null or empty text is its end token alone; repeated rows
    are learned from and scored each; rows with a null id are scored like
    others; words never seen in training share the unknown word's probability;
    without training rows every token is unknown; an empty table gives an
    empty result. Other columns are ignored. The same input and seed give the
    same scores as long as Spark cuts the input into the same partitions.
    """
    kept = Kept(docs.sparkSession)
    try:
        return _scored(docs, kept, held_out, id_col, text_col, block_tokens, bucket_items, seed)
    finally:
        kept.drop()


def _scored(docs: DataFrame, kept: Kept, held_out: Column, id_col: str, text_col: str, block_tokens: int, bucket_items: int, seed: int) -> DataFrame:
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (~F.coalesce(held_out, F.lit(False))).alias("train"))
    blocks = kept.write(token_blocks(rows, block_tokens), "block", parts)
    n_items, n_tokens, n_train = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum(F.size(F.filter("train", lambda x: x))), F.lit(0))).first()
    wb, pb = max(1, math.ceil(n_items / bucket_items)), max(1, math.ceil(n_tokens / bucket_items))

    # Words: numbers and counts. Block -1 is a bucket's own table.
    numbered = blocks.select("block", "words", "counts").mapInArrow(send_words(wb), MAIL).groupBy("bucket").applyInArrow(number_words(wb), MAIL)
    numbered = stored(numbered, "word-numbers")
    own = numbered.where("block = -1")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count = [unpack(p)[0] for p in b.column("payload").to_pylist()]
            found = [[int(c.sum()) for c in count], [int((c > 0).sum()) for c in count], [int((c == 1).sum()) for c in count], [int((c == 2).sum()) for c in count]]
            yield pa.record_batch([pa.array(x, pa.int64()) for x in found], names=["n", "v", "v1", "v2"])

    corpus, vocabulary, v1, v2 = (x or 0 for x in own.mapInArrow(totals, "n long, v long, v1 long, v2 long").agg(F.sum("n"), F.sum("v"), F.sum("v1"), F.sum("v2")).first())
    discount = lambda one, two: min(max(one / (one + 2 * two), 0.1), 0.9) if one + two else 0.5

    # Pairs: counts; then Gibbs sweeps over those seen more than once.
    sent = blocks.groupBy("block").cogroup(numbered.where("block >= 0").groupBy("block")).applyInArrow(send_pairs(wb, pb, n_train), MAIL)
    sent = kept.write(sent, "bucket", min(pb, parts))
    counted = stored(sent.groupBy("bucket").applyInArrow(count_pairs(wb), COUNTED), "pair-counts")
    state = counted.where("payload is null").select(*[x.split()[0] for x in STATE.split(", ")])
    once = counted.where("payload is not null").select("bucket", "block", "payload")
    once = stored(once.groupBy("bucket").cogroup(own.groupBy("bucket")).applyInArrow(sum_once(wb), MAIL), "pairs-once")
    one, two = state.agg(F.coalesce(F.sum("ones"), F.lit(0)), F.coalesce(F.sum("twos"), F.lit(0))).first()
    d, d0 = discount(one, two), discount(v1, v2)
    samples, sums = [], []
    root_before = vocabulary  # the root's tables in the sweep before; at first one for each word
    for k in range(BURN_IN + SAMPLES + 1):
        mailed = state.select("bucket", "u", "w", "t").mapInArrow(send_tables(wb), MAIL)
        summed = mailed.groupBy("bucket").cogroup(once.groupBy("bucket")).applyInArrow(sum_tables(wb, d0, vocabulary, root_before, seed * 100 + k), MAIL)
        summed = stored(summed, "tables")

        def root_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = [unpack(p) for p in b.column("payload").to_pylist()]
                yield pa.record_batch([pa.array([int(y[1].sum()) for y in x], pa.int64()), pa.array([int(y[2].sum()) for y in x], pa.int64())], names=["n", "t"])

        total, root_total = (x or 0 for x in summed.where("block = -1").mapInArrow(root_totals, "n long, t long").agg(F.sum("n"), F.sum("t")).first())
        root_before = root_total
        if k > BURN_IN:  # the tables of the sweep before, which was kept
            samples.append(summed.where("block = -1").select("bucket", F.lit(k).alias("sample"), "payload"))
            sums.append((total, root_total))
        if k < BURN_IN + SAMPLES:
            step = sweep(wb, d, d0, vocabulary, total, root_total, k >= BURN_IN, seed * 1000 + k)
            replies = summed.where("block >= 0").select(F.col("block").cast("int").alias("bucket"), "payload")
            state = stored(state.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(step, STATE), "pair-state")

    # Answers to the blocks, which score their documents.
    of_pairs = sent.groupBy("bucket").cogroup(state.groupBy("bucket")).applyInArrow(answer_pairs, MAIL)
    every = samples[0]
    for s in samples[1:]:
        every = every.unionByName(s)
    of_words = numbered.where("block >= 0").groupBy("bucket").cogroup(every.groupBy("bucket")).applyInArrow(answer_words(wb), MAIL)
    replies = of_pairs.withColumn("kind", F.lit("pair")).unionByName(of_words.withColumn("kind", F.lit("word")))
    scored = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score_block(wb, pb, d, d0, vocabulary, n_train, corpus, sums), SCORES)
    scored = stored(scored, "scores")
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(corpus).cast("long").alias("train_tokens"), "base_score", "score")
