"""SimHash near-duplicates found with BK-trees.

1. One pass over the texts gives each document's 64-bit fingerprint: a bit is
   set if it is set in over half of the hashes of its word shingles, repeats
   included. Equal fingerprints are one node.
2. A BK-tree holds each fingerprint below its parent on the edge named by
   their Hamming distance. Its top is grown by Spark jobs: a group of more than
   ``shard_rows`` fingerprints gets one of them as parent and is dealt out by
   the distance to it, until every group is a shard of bounded size, whose tree
   one task builds and packs into one row.
3. Every fingerprint goes down the top by the edges within the radius only (two
   fingerprints at distance r differ by at most r in their distance to a third),
   so it is sent to few shards, and to one of two shards that could meet it.
   Each shard's tree is broadcast to the blocks of fingerprints that reach it.
4. A block walks its tree level by level, all fingerprints at once, again by
   the edges within the radius. Links are united where they are found: a task
   returns a spanning forest of its links, never the pairs of a dense group.
   Forests give connected components.

Only the top tree passes the driver: one fingerprint for each group that was
split, less than one in ``shard_rows`` at every level.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesops.llm.common import slices, small, stored
from salesops.llm.components import components

SEED = 42
SHARD_ROWS = 1 << 18
QUERY_BLOCK = 1 << 15
# Fingerprints walked down a tree at a time, and (fingerprint, node) pairs held.
WALK, FRONTIER = 1024, 1 << 20
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def _count_bits(digests: list[bytes]) -> np.ndarray:
    """How many of the hashes (eight bytes each, high byte first) have each bit set, high bit first."""
    raw = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8)
    if len(raw) < 128:
        return np.unpackbits(raw, axis=1).sum(0, dtype=np.int64)
    places = raw.astype(np.int64) + np.arange(8) * 256
    return (np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """The SimHash of one whole text as a signed long; 0 without words."""
    counts, n, tail = np.zeros(64, np.int64), 0, []
    for part in slices(text or b""):
        words = tail + part.lower().split()
        if len(words) >= size:
            whole = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.append(0, ends[:-1] + 1)[: len(words) - size + 1]
            cut = [whole[a:b] for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)]
            counts += _count_bits(list(map(xxhash.xxh64_digest, cut, repeat(SEED))))
            n += len(cut)
            words = words[len(words) - size + 1 :]
        tail = words
    if not n and tail:
        counts, n = _count_bits([xxhash.xxh64_digest(b" ".join(tail), SEED)]), 1
    return int(np.packbits(counts * 2 > n).view(">i8")[0]) if n else 0


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, fp`` of ``docs`` (doc_id, text as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            found = [fingerprint(t.as_py(), size) for t in b.column("text")]
            yield pa.record_batch([b.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return docs.mapInArrow(run, "doc_id long, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int32)


class BKTree:
    """Nodes in breadth-first order: a node's children are neighbours, by rising key."""

    def __init__(self, fps: np.ndarray, key: np.ndarray, first: np.ndarray, count: np.ndarray):
        self.fps, self.key, self.first, self.count = fps, key, first, count

    @classmethod
    def build(cls, fps: np.ndarray) -> BKTree:
        """The tree that inserting the (distinct) fingerprints in their order gives, level by level."""
        node, keys, parents = [fps[:1]], [np.zeros(1, np.int32)], []
        rest, parent, parent_fp, made = fps[1:], np.zeros(len(fps) - 1, np.int64), np.repeat(fps[:1], len(fps) - 1), 1
        while len(rest):
            d = distance(rest, parent_fp)
            edge = parent * 65 + d
            order = np.argsort(edge, kind="stable")
            rest, edge = rest[order], edge[order]
            head = np.append(True, edge[1:] != edge[:-1])
            node.append(rest[head])
            keys.append(d[order][head])
            parents.append(parent[order][head])
            mine = np.cumsum(head) - 1
            rest, parent, parent_fp = rest[~head], (made + mine)[~head], node[-1][mine[~head]]
            made += int(head.sum())
        count = np.bincount(np.concatenate([np.zeros(0, np.int64), *parents]), minlength=len(fps)).astype(np.int32)
        first = (1 + np.append(0, np.cumsum(count)[:-1])).astype(np.int32)
        return cls(np.concatenate(node), np.concatenate(keys).astype(np.int32), first, count)

    def pack(self) -> bytes:
        return self.fps.tobytes() + self.key.tobytes() + self.first.tobytes() + self.count.tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> BKTree:
        n = len(data) // 20
        return cls(np.frombuffer(data, np.uint64, n), *(np.frombuffer(data, np.int32, n, 8 * n + 4 * n * i) for i in range(3)))

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) pairs at most ``radius`` apart, following only edges within it."""
        todo = [(np.arange(at, min(at + WALK, len(queries)), dtype=np.int32), None) for at in range(0, len(queries), WALK)][::-1]
        while todo:
            q, node = todo.pop()
            if node is None:
                node = np.zeros(len(q), np.int32)
            if len(q) > FRONTIER:
                half = len(q) // 2
                todo += [(q[half:], node[half:]), (q[:half], node[:half])]
                continue
            d = distance(queries[q], self.fps[node])
            hit = d <= radius
            if hit.any():
                yield q[hit], node[hit]
            n = self.count[node]
            inner = np.flatnonzero(n)
            if not len(inner):
                continue
            n = n[inner]
            of = np.repeat(inner, n)
            child = np.arange(int(n.sum()), dtype=np.int32) + np.repeat(self.first[node[inner]] - np.append(0, np.cumsum(n)[:-1]).astype(np.int32), n)
            keep = np.abs(self.key[child] - d[of]) <= radius
            if keep.any():
                todo.append((q[of[keep]], child[keep]))


def forest(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each a node's least known partner, in the end its root) after uniting a[i] with b[i]."""
    while True:
        x, y = labels[a], labels[b]
        if (x == y).all():
            return labels
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up


class TopTree:
    """Split groups: a fingerprint, and by distance to it either another one or a shard."""

    def __init__(self):
        self.nodes: list[tuple[int, dict[int, int]]] = []  # child: a node's number, or ~shard
        self.shards = 1

    def walk(self, fps: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(node, queries, distances) of all nodes met, and (~shard, queries, none) of all shards."""
        todo = [(0 if self.nodes else ~0, np.arange(len(fps)))]
        while todo:
            at, q = todo.pop()
            if at < 0:
                yield at, q, np.zeros(0, np.int32)
                continue
            fp, children = self.nodes[at]
            d = distance(fps[q], np.uint64(fp))
            yield at, q, d
            for key, child in children.items():
                near = np.abs(d - key) <= radius
                if radius == 0:
                    near &= fps[q] != np.uint64(fp)
                if near.any():
                    todo.append((child, q[near]))

    def place(self, fps: np.ndarray) -> np.ndarray:
        """Each fingerprint's shard; -1 for the tree's own."""
        out = np.full(len(fps), -1, np.int64)
        for at, q, _ in self.walk(fps, 0):
            if at < 0:
                out[q] = ~at
        return out

    def split(self, shard: int, fp: int) -> None:
        """``fp`` becomes the parent of a shard's fingerprints; each distance gets a shard."""
        me = len(self.nodes)
        for _, children in self.nodes:
            for key, child in children.items():
                if child == ~shard:
                    children[key] = me
        children = {d: ~(self.shards + d) for d in range(1, 65)}
        self.shards += 65
        self.nodes.append((fp, children))


def grow_top(nodes: DataFrame, shard_rows: int) -> TopTree:
    """Split every group that is over the bound until none is."""
    top = TopTree()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column("fp").to_numpy()
            yield pa.record_batch([b.column("fp"), pa.array(top.place(fps.view(np.uint64)))], names=["fp", "shard"])

    while True:
        placed = nodes.select("fp").mapInArrow(place, "fp long, shard long").where("shard >= 0")
        groups = placed.groupBy("shard").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("fp").alias("h"), "fp")).alias("first"))
        over = groups.where(F.col("n") > shard_rows).orderBy("shard").collect()
        if not over:
            return top
        for r in over:
            top.split(r["shard"], r["first"]["fp"] % (1 << 64))


def links(nodes: DataFrame, radius: int, shard_rows: int, query_block: int) -> DataFrame:
    """``a, b``: a spanning forest of the links of each task; all links' components are kept."""
    top = grow_top(nodes, shard_rows)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links to the top's own, and packed rows of fingerprints for each shard in reach."""
        for b in batches:
            fps = b.column("fp").to_numpy().view(np.uint64)
            own = top.place(fps)
            for at, q, d in top.walk(fps, radius):
                if at >= 0:
                    met = q[(d <= radius) & (d > 0)]
                    if len(met):
                        made = len(met)
                        yield pa.record_batch([pa.array([None] * made, pa.int64()), pa.array([None] * made, pa.binary()), pa.array(fps[met].view(np.int64)), pa.array(np.full(made, np.uint64(top.nodes[at][0])).view(np.int64))], names=["shard", "fps", "a", "b"])
                else:
                    # Of two shards the one of the lower number holds the tree.
                    met = q[own[q] >= ~at]
                    for s in range(0, len(met), query_block):
                        yield pa.record_batch([pa.array([~at], pa.int64()), pa.array([fps[met[s : s + query_block]].tobytes()], pa.binary()), pa.array([None], pa.int64()), pa.array([None], pa.int64())], names=["shard", "fps", "a", "b"])

    def plant(key, table):
        fps = table.sort_by([("h", "ascending"), ("fp", "ascending")])["fp"].to_numpy().view(np.uint64)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "tree": pa.array([BKTree.build(fps).pack()], pa.binary())})

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = top.place(b.column("fp").to_numpy().view(np.uint64))
            yield pa.record_batch([b.column("fp"), b.column("h"), pa.array(shard)], names=["fp", "h", "shard"])

    sent = stored(nodes.select("fp").mapInArrow(send, "shard long, fps binary, a long, b long"), "simhash-sent")
    hashed = nodes.select("fp", F.xxhash64("fp").alias("h"))
    trees = stored(hashed.mapInArrow(home, "fp long, h long, shard long").where("shard >= 0").groupBy("shard").applyInArrow(plant, "shard long, tree binary"), "simhash-trees")

    # Blocks of about query_block fingerprints; every block of a shard gets its tree.
    asked = sent.where("shard is not null")
    load = asked.groupBy("shard").agg(F.ceil(F.sum(F.octet_length("fps")) / F.lit(8 * query_block)).cast("int").alias("blocks"))
    quer = asked.join(load, "shard").withColumn("block", F.pmod(F.xxhash64("fps"), F.col("blocks")).cast("int")).select("shard", "block", "fps")
    wide = trees.join(load, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("shard", "block", "tree")

    def search(key, tree_rows: pa.Table, query_rows: pa.Table) -> pa.Table:
        if not tree_rows.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        tree = BKTree.unpack(tree_rows["tree"][0].as_py())
        queries = np.frombuffer(b"".join(query_rows["fps"].to_pylist()), np.uint64)
        whole = np.concatenate([tree.fps, queries])
        labels = np.arange(len(whole))
        for q, node in tree.within(queries, radius):
            labels = forest(labels, node.astype(np.int64), q + np.int64(len(tree.fps)))
        a, b = whole, whole[labels]
        met = a != b
        # A fingerprint is a query and perhaps a node too: its root is the same, as its distance to itself is 0.
        pairs = np.unique(np.column_stack([a[met], b[met]]).view(np.int64), axis=0) if met.any() else np.zeros((0, 2), np.int64)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    found = wide.groupBy("shard", "block").cogroup(quer.groupBy("shard", "block")).applyInArrow(search, "a long, b long")
    return stored(found.unionByName(sent.where("a is not null").select("a", "b")), "simhash-links")


def simhash_duplicates(docs: DataFrame, *, size: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """One row per document: its fingerprint and its near-duplicate group.

    Words are ASCII-lower-cased runs between ASCII white space; a shingle is
    ``size`` of them joined by spaces, hashed by XXH64 with seed 42. Documents
    whose fingerprints differ in at most ``radius`` bits are linked. Returns
    ``doc_id, fp`` (signed long) and ``component_id``, the least doc_id
    reachable, its own included.

    Defined cases: texts of fewer words are one shingle; a null text, or one
    without words, has the fingerprint 0 and is linked like any other. A null
    id is the least id only of a group without any other (then ``component_id``
    is null); repeated rows come back each. Texts of any length are read whole,
    in slices. An empty table gives an empty result. Other columns are ignored.
    """
    if not 0 <= radius <= 64:
        raise ValueError("a radius is 0 to 64 bits")
    text = F.col(text_col).cast("string").cast("binary")
    prints = stored(fingerprints(docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")), size), "simhash-prints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    groups = components(links(nodes, radius, shard_rows, query_block))
    member = stored(nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "simhash-members")
    heads = member.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(member.join(heads, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
