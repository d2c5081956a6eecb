"""MinHash near-duplicates with odd sketches.

1. One pass over the texts: the set of distinct word shingles, ``BANDS * ROWS``
   MinHash samples, a hash of each band, and an odd sketch - the samples folded
   into a parity bitmap. Texts with equal sets form a class; one row each goes on.
2. Classes that share a band are candidates. Pairs are not formed within a
   band bucket: each bucket names its most central member (the one whose
   buckets hold most) and every other member is held against that one.
3. The population count of two sketches' XOR estimates their similarity; members
   far from their centre go to step 5, the others are confirmed on full sets.
   Links give connected components.
4. Members outside their centre's component may still be linked to another
   member. Relative to the centre m a set is m less its missing shingles a plus
   its extra shingles b. If r is not linked to m, r and x can only be linked if
   they share more than (|a_x| + 0.8 |b_x|) / 1.8 of x's edits a_x and b_x (at
   0.8; from J = (|m| - |a_r u a_x| + |b_r n b_x|) / (|m| - |a_r n a_x| + |b_r u b_x|)).
   So x lists its rarest edits, as many as cannot all be unshared, r lists all,
   and only pairs that meet in an edit go on. A second odd sketch, of the whole
   set, bounds the symmetric difference from below (one element flips one bit),
   which rules most of them out; the rest is confirmed. This step loses nothing.
5. Members far from their centre (the Jaccard distance is a metric, so their
   partners are far as well) are compared with each other by their sketches.

A pair at the threshold shares no band of 32 x 5 samples with a probability of
3 in a million. A member is taken for far from its centre by an estimate below
0.5; at a true similarity of 0.75 that has a probability of under 1 in a million
(simulated: 0.29 % at 0.64, 0.003 % at 0.70), and all that are less like their
centre are compared among each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesops.llm.common import batch_word_hashes, giving_back, mix64, release_tokens, small, stored, unused
from salesops.llm.components import components

BANDS, ROWS = 32, 5
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
SKETCH_WORDS = SKETCH_BITS // 64
# Estimates below these are taken for certain to lie under a similarity of 0.8:
# the estimate's standard error there is about 0.035.
CENTRE_ESTIMATE, PAIR_ESTIMATE = 0.5, 0.6
# True similarity that a member with an estimate below CENTRE_ESTIMATE does not reach, but once in a million.
FAR_LIKENESS = 0.75
_CHUNK = 2048

PARITY_BITS = 256
SIGNATURES = "doc_id long, text_hash long, n_shingles long, node binary, bands array<long>, sketch array<long>, parity array<long>"


def multipliers() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; fewer words are one run."""
    if not len(words):
        return words
    n = max(len(words) - size + 1, 1)
    h = mix64(words[:n] + np.uint64(min(size, len(words))))
    for i in range(1, min(size, len(words))):
        h = mix64(h + words[i : n + i])
    return np.unique(h)


def minhash(s: np.ndarray, a: np.ndarray) -> np.ndarray:
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), _CHUNK):
        np.minimum(out, (s[i : i + _CHUNK, None] * a).min(axis=0), out=out)
    return out


def sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of all samples (rows x SAMPLES) as rows of signed 64-bit words."""
    n = len(samples)
    bit = mix64(samples + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(SKETCH_BITS)
    flat = bit.astype(np.int64) + np.arange(n)[:, None] * SKETCH_BITS
    odd = np.bincount(flat.ravel(), minlength=n * SKETCH_BITS).astype(np.uint8) & 1
    return np.packbits(odd.reshape(n, SKETCH_BITS), axis=1).view(np.int64)


def parity(s: np.ndarray) -> np.ndarray:
    """Parity bitmap of a whole set: two bitmaps differ in no more bits than the sets in elements."""
    odd = np.bincount((s % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def band_hashes(samples: np.ndarray) -> np.ndarray:
    h = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)
    part = samples.reshape(len(samples), BANDS, ROWS)
    for r in range(ROWS):
        h = mix64(h + part[:, :, r])
    return h.view(np.int64)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """``docs`` (doc_id, text, text_hash) to ``SIGNATURES``; empty texts have null node and arrays."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_tokens()
        a = multipliers()
        for b in small(batches):
            sizes, nodes, samples, odd = [], [], np.empty((b.num_rows, SAMPLES), np.uint64), np.empty((b.num_rows, PARITY_BITS // 64), np.int64)
            for i, words in enumerate(batch_word_hashes(b.column("text").to_pylist())):
                s = shingle_set(words, size)
                sizes.append(len(s))
                samples[i], odd[i] = minhash(s, a), parity(s)
                nodes.append(np.array([mix64(s).sum(dtype=np.uint64), mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)]).tobytes() if len(s) else None)
            void = np.array(sizes, np.int64) == 0
            lists = []
            for m in (band_hashes(samples), sketches(samples), odd):
                offsets = np.append(0, np.cumsum(~void)) * m.shape[1]
                lists.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.ascontiguousarray(m[~void]).ravel()), mask=pa.array(void)))
            yield pa.record_batch([b.column("doc_id"), b.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), *lists], names=["doc_id", "text_hash", "n_shingles", "node", "bands", "sketch", "parity"])

    return docs.select("doc_id", "text", "text_hash").mapInArrow(giving_back(sign), SIGNATURES)


def odd_bits(estimate: float) -> int:
    """Largest XOR population count at which the estimated similarity is ``estimate`` or more."""
    apart = 2 * SAMPLES * (1 - estimate)
    return math.floor(SKETCH_BITS / 2 * (1 - math.exp(-2 * apart / SKETCH_BITS)))


def xor_count(a: str, b: str, bits: int = SKETCH_BITS) -> Column:
    return F.expr(" + ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(bits // 64)))


def may_link(a: str, b: str, percent: int) -> Column:
    """False if the parity bitmaps prove two sets (``<a>_n, <a>_parity``, …) too far apart: a link has a
    symmetric difference of at most (100 - percent) / (100 + percent) of the sizes' sum."""
    return xor_count(f"{a}_parity", f"{b}_parity", PARITY_BITS) * (100 + percent) <= (F.col(f"{a}_n") + F.col(f"{b}_n")) * (100 - percent)


def shingle_sets(nids: DataFrame, docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """``nid, shingles`` (sorted hashes as bytes) of the classes in ``nids``."""
    needed = stored(classes.join(nids, "nid", "left_semi").select("nid", F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("hash")), "needed")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_tokens()
        for b in small(batches):
            found = [shingle_set(w, size).tobytes() for w in batch_word_hashes(b.column("text").to_pylist())]
            yield pa.record_batch([b.column("nid"), pa.array(found, pa.binary())], names=["nid", "shingles"])

    # The same shuffle at every size: a broadcast of the ids would grow with the input.
    rows = docs.join(needed.hint("merge"), docs["doc_id"].eqNullSafe(needed["id"]) & docs["text_hash"].eqNullSafe(needed["hash"]))
    return stored(rows.select("nid", "text").mapInArrow(giving_back(sets), "nid long, shingles binary").dropDuplicates(["nid"]), "sets")


def edits_of(shingles: bytes, centre: bytes) -> tuple[int, int, int, np.ndarray]:
    """Sizes of the intersection, of the missing and extra shingles, and these themselves."""
    x, m = np.frombuffer(shingles, np.uint64), np.frombuffer(centre, np.uint64)
    both, times = np.unique(np.concatenate([x, m]), return_counts=True)
    edits = both[times == 1]
    shared = len(both) - len(edits)
    return shared, len(m) - shared, len(x) - shared, edits.view(np.int64)


def confirm(pairs: DataFrame, sets: DataFrame, with_edits: bool = False) -> DataFrame:
    """``a, b`` with ``shared, missing, extra`` on full sets: sizes of a n b, b less a, a less b (and all ``edits``)."""
    kind = "struct<shared:long,missing:long,extra:long" + (",edits:array<long>>" if with_edits else ">")

    @F.pandas_udf(kind)
    def compare(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        found = [edits_of(p, q)[: 4 if with_edits else 3] for p, q in zip(x, y, strict=True)]
        return pd.DataFrame(found, columns=["shared", "missing", "extra", "edits"][: 4 if with_edits else 3])

    left, right = sets.select(F.col("nid").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("nid").alias("b"), F.col("shingles").alias("sb"))
    met = pairs.select("a", "b").join(left, "a").join(right, "b")
    return stored(met.select("a", "b", compare("sa", "sb").alias("c")).select("a", "b", "c.*"), "confirmed")


def edit_pairs(stars: DataFrame, group_of: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` that may be linked although ``a`` is not in the component of their common centre.

    ``stars``: a (member), b (centre), missing, extra, edits; ``group_of``: node, component.
    """
    of = lambda c, out: group_of.select(F.col("node").alias(c), F.col("component").alias(out))
    placed = stars.join(of("a", "g"), "a", "left").join(of("b", "gc"), "b", "left").withColumns({"g": F.coalesce("g", "a"), "gc": F.coalesce("gc", "b")})
    mixed = placed.where("g <> gc").select("b").distinct()
    placed = stored(placed.join(mixed, "b").select(F.col("a").alias("nid"), F.col("b").alias("centre"), "g", "gc", "missing", "extra", "edits"), "edits")
    # Shared edits s satisfy s * (100 + percent) > 100 * missing + percent * extra of x, so at least this many:
    least = F.floor((F.col("missing") * 100 + F.col("extra") * percent) / F.lit(100.0 + percent)) + 1
    listed = placed.withColumn("rank_to", F.col("missing") + F.col("extra") - least + 1).select("nid", "centre", "g", "gc", "rank_to", F.explode("edits").alias("edit"))
    often = listed.groupBy("centre", "edit").agg(F.count("*").alias("held")).where("held > 1")
    listed = listed.join(often, ["centre", "edit"], "left").withColumn("held", F.coalesce("held", F.lit(1)))
    rarest = Window.partitionBy("centre", "nid").orderBy("held", "edit")
    own = lambda p: classes.select(F.col("nid").alias(p), F.col("n").alias(f"{p}_n"), F.col("parity").alias(f"{p}_parity"))
    x = listed.withColumn("rank", F.row_number().over(rarest)).where("rank <= rank_to and held > 1").select("centre", "edit", F.col("nid").alias("x"), F.col("g").alias("x_g"))
    r = listed.where("g <> gc and held > 1").select("centre", "edit", F.col("nid").alias("r"), "g")
    met = r.join(own("r"), "r").join(x.join(own("x"), "x"), ["centre", "edit"]).where((F.col("r") != F.col("x")) & (F.col("g") != F.col("x_g")) & may_link("r", "x", percent))
    return met.select(F.least("r", "x").alias("a"), F.greatest("r", "x").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its near-duplicate group.

    Two documents are linked if ``100 * shared >= percent * union`` of their
    distinct ``size``-word shingles (words are lower-cased runs between ASCII
    white space). Returns ``doc_id, text_hash, n_shingles, component_id`` (least
    doc_id of the group), ``kept`` (doc_id equals it), ``is_first`` (this id and
    text stand for the group: least (doc_id, text hash)) and ``n_links`` of the
    document's class to other classes found directly.

    Defined cases: a null text, or one without words, has an empty set, is
    linked with nothing and is its own group; a null id never is the least id
    unless a group has no other (then ``component_id`` is null and ``kept``
    true); repeated rows are one class and come back each; texts with fewer
    words than ``size`` are one shingle. Other columns are ignored; an empty
    table gives an empty result.
    """
    if not 80 <= percent <= 100:
        raise ValueError("bands and sketches are laid out for 80 percent or more")
    text = F.col(text_col).cast("string")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    signed = stored(signatures(docs, size), "signatures")
    one = signed.where("node is not null").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("parity").alias("parity")
    )
    classes = stored(one.withColumn("nid", F.monotonically_increasing_id()), "classes")

    # Buckets of more than one class, and each one's most central member.
    every = classes.select("nid", F.explode("bands").alias("key"))
    shared_keys = every.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    buckets = stored(every.join(shared_keys, "key"), "buckets")
    weights = buckets.groupBy("nid").agg(F.sum("held").alias("weight"))
    centres = buckets.join(weights, "nid").groupBy("key").agg(F.max(F.struct("weight", (-F.col("nid")).alias("low"))).alias("c")).select("key", (-F.col("c.low")).alias("centre"))
    buckets = stored(buckets.join(centres, "key").select("key", "nid", "centre"), "centred")

    described = classes.select("nid", "n", "sketch")
    sketched = lambda c, n, s: described.select(F.col("nid").alias(c), F.col("n").alias(n), F.col("sketch").alias(s))
    stars = buckets.where("nid <> centre").select(F.col("nid").alias("a"), F.col("centre").alias("b")).distinct()
    stars = stars.join(sketched("a", "n_a", "s_a"), "a").join(sketched("b", "n_b", "s_b"), "b").where(xor_count("s_a", "s_b") <= odd_bits(CENTRE_ESTIMATE))
    sets = shingle_sets(buckets.select("nid").distinct(), docs, classes, size)
    stars = confirm(stars, sets, with_edits=True)
    linked = F.col("shared") * 100 >= (F.col("shared") + F.col("missing") + F.col("extra")) * percent
    links = stars.where(linked).select("a", "b")
    first_groups = components(links)
    more = [edit_pairs(stars, first_groups, classes, percent)]

    # Members far from their centre, against others that are not near it.
    likeness = F.col("shared") / (F.col("shared") + F.col("missing") + F.col("extra"))
    known = stars.select(F.col("a").alias("nid"), F.col("b").alias("centre"), likeness.alias("like"))
    placed = buckets.where("nid <> centre").join(known, ["nid", "centre"], "left").where(F.col("like").isNull() | (F.col("like") <= FAR_LIKENESS + 1 - percent / 100))
    lone = placed.where("like is null").select("key").distinct()
    placed = placed.join(lone, "key").join(first_groups.select(F.col("node").alias("nid"), F.col("component").alias("g")), "nid", "left")
    placed = stored(placed.withColumn("g", F.coalesce("g", "nid")).join(classes.select("nid", "n", "sketch", "bands", "parity"), "nid"), "placed")
    side = lambda p: placed.select("key", *[F.col(c).alias(f"{p}_{c}") for c in ("nid", "g", "n", "sketch", "bands", "parity", "like")])
    far = side("a").where("a_like is null").join(side("b"), "key").where(
        (F.col("a_g") != F.col("b_g"))
        & (F.col("b_like").isNotNull() | (F.col("a_nid") < F.col("b_nid")))
        & (F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent)
        & (xor_count("a_sketch", "b_sketch") <= odd_bits(PAIR_ESTIMATE))
        & may_link("a", "b", percent)
        # A pair is formed in the first bucket that both share and in no other.
        & (F.expr("filter(a_bands, (x, i) -> x = b_bands[i])[0]") == F.col("key"))
    )
    more.append(far.select(F.least("a_nid", "b_nid").alias("a"), F.greatest("a_nid", "b_nid").alias("b")))
    more = confirm(more[0].unionByName(more[1]).distinct(), sets)
    links = stored(links.unionByName(more.where(linked).select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    groups = components(links)

    degree = links.select(F.explode(F.array("a", "b")).alias("nid")).groupBy("nid").agg(F.count("*").alias("n_links"))
    whole = classes.select("nid", "node", "first").join(groups.withColumnRenamed("node", "nid"), "nid", "left").join(degree, "nid", "left")
    whole = stored(whole.select("node", "first", F.coalesce("component", "nid").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "grouped")
    heads = whole.groupBy("component").agg(F.min("first").alias("head"))
    member = whole.join(heads, "component").select("node", "head", "n_links")
    out = signed.where("node is not null").select("doc_id", "text_hash", "n_shingles", "node").join(member, "node")
    is_head = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & F.col("text_hash").eqNullSafe(F.col("head.text_hash"))
    out = out.select("doc_id", "text_hash", "n_shingles", F.col("head.doc_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("head.doc_id")).alias("kept"), is_head.alias("is_first"), "n_links")
    alone = signed.where("node is null").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(True).alias("is_first"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone)


def drop_near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate group; texts without words all stay."""
    found = near_duplicates(docs, size=size, percent=percent, id_col=id_col, text_col=text_col)
    own, head_id, head_hash = (unused(n, docs.columns) for n in ("text_hash", "head_id", "head_hash"))
    heads = stored(found.where("is_first and n_shingles > 0").select(F.col("doc_id").alias(head_id), F.col("text_hash").alias(head_hash)).distinct(), "heads")
    keyed = docs.withColumn(own, F.xxhash64(F.col(text_col).cast("string")))
    words = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = keyed.where(words).join(heads, F.col(id_col).cast("long").eqNullSafe(F.col(head_id)) & F.col(own).eqNullSafe(F.col(head_hash)), "left_semi")
    kept = kept.dropDuplicates([id_col, own])
    return kept.unionByName(keyed.where(~words)).select(*[F.col(f"`{c}`") for c in docs.columns])
