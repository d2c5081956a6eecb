import random
import zlib

import numpy as np
import pyspark.sql.functions as F
from tokenizers import Tokenizer

from salesops.llm.common import shared_path
from salesops.llm.packing import best_fit_decreasing, bin_bound, pack, pack_documents
from salesops.llm.token_files import TokenReader, open_tokens, sequence, token_files, write_token_files
from salesops.llm.tokens import default_tokenizer, encoder


def reference_ids(text):
    return np.array([*Tokenizer.from_file(default_tokenizer()).encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_chunks_give_the_ids_of_whole_texts():
    ids, rng = encoder(default_tokenizer()), random.Random(1)
    letters = "aZéÉ'.,-! \n\t<|>3̸́=ßΣςİ  日本"
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        assert ids.encode(text) == ids.direct(text), text


def test_words_and_marks_by_the_model_give_the_ids_of_whole_texts():
    """Plain letters, runs of marks after them, special tokens with letters and marks around them."""
    ids, rng = encoder(default_tokenizer()), random.Random(9)
    assert ids.letters
    letters = "abzABZéÉèßªºµÿĀāıĳŉſƀ'\"!#$%&()*+,-./:;<=>?@[]^_`{|}~09٣ \t̸́İŉ日本 \u0085"
    wholes = ["<|endoftext|>", "<|startoftext|>", "'s", "'ll", "won't"]
    for _ in range(5000):
        text = "".join(rng.choice(letters) if rng.random() < 0.9 else rng.choice(wholes) for _ in range(rng.randint(0, 14)))
        assert ids.encode(text) == ids.direct(text), ascii(text)


def test_long_text_is_cut_at_white_space(monkeypatch):
    from salesops.llm import tokens

    monkeypatch.setattr(tokens, "PIECE_BYTES", 50)
    ids = encoder(default_tokenizer())
    text = "a longer text, with wörds and marks! " * 40 + "x" * 200 + " end"
    assert ids.encode(text) == ids.direct(text)


def test_token_files_round_trip(spark, make_docs, edge):
    docs = [*edge, (10, "many words here " * 3000)]
    got = token_files(make_docs(docs).withColumn("start", F.lit("clash"))).collect()
    assert len(got) == len(docs)
    by = {}
    for d, t in docs:
        by.setdefault(d, []).append(reference_ids(t))
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        match = [x for x in by[r.doc_id] if len(x) == r.n_tokens and zlib.crc32(x.tobytes()) == r.ids_crc32]
        assert match
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))


def test_sequences_are_read_by_place(spark, make_docs):
    docs = [(i, f"text {i} " * (i * 7 % 50)) for i in range(60)]
    shards = write_token_files(make_docs(docs, 1).coalesce(1), shared_path(spark, "t"), length=16).collect()
    for s in shards:
        reader = open_tokens(s.tokens)
        assert str(reader.schema.field("ids").type).startswith("fixed_size_list<item: uint16>[16]")
        flat = np.concatenate([x for x in TokenReader(s.tokens).spans(0, s.n_tokens)])
        for row in range(-(-s.n_tokens // 16)):
            ids, mask = sequence(reader, row)
            own = flat[row * 16 : (row + 1) * 16]
            assert mask.sum() == len(own) and (ids[: len(own)] == own).all()
    assert sum(s.n_docs for s in shards) == 60


def test_empty_tables(spark, make_docs):
    none = make_docs([(1, "x")]).where("doc_id < 0")
    assert token_files(none).collect() == [] and pack_documents(none).collect() == []


def exact_bins(lengths, capacity):
    """Fewest bins, by trying everything."""
    best = [len(lengths)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[i] <= capacity:
                place(i + 1, [*bins[:b], bins[b] + lengths[i], *bins[b + 1 :]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best[0]


def test_bounds_hold_and_best_fit_packs():
    rng = np.random.default_rng(4)
    for _ in range(150):
        lengths = rng.integers(1, 21, rng.integers(1, 9))
        bins, offsets, n = best_fit_decreasing(lengths, 20)
        fewest = exact_bins(sorted(lengths.tolist(), reverse=True), 20)
        assert bin_bound(lengths, 20) <= fewest <= n
        for b in range(n):
            own = sorted(zip(offsets[bins == b], lengths[bins == b], strict=True))
            assert [o for o, _ in own] == np.cumsum([0, *[s for _, s in own]])[:-1].tolist() and sum(s for _, s in own) <= 20
    assert bin_bound(np.array([11] * 6), 20) == 6  # six pieces over half a bin each


def test_partitions_exchange_their_loose_ends(spark):
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 4097, 3000).tolist()
    out = pack(spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "id long, length long"), partition_pieces=300).toPandas()
    assert sorted(out["id"]) == list(range(3000))
    full = out.groupby("sequence_id").length.sum()
    assert full.max() <= 4096 and len(full) <= bin_bound(np.array(lengths), 4096) * 1.02 + 1
    ordered = out.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()


def test_pack_documents_pieces(make_docs, edge):
    docs = [*edge, (10, "many words here " * 3000)]
    out = pack_documents(make_docs(docs).withColumn("bin", F.lit(1))).toPandas()
    assert len(out) == len(docs) - 1 + -(-len(reference_ids(docs[-1][1])) // 4096)
    for doc in (7, 8, 9, 10):
        ids = reference_ids(dict(docs)[doc])
        for r in out[out.doc_id == doc].itertuples():
            part = ids[r.start : r.start + r.length]
            assert r.start == r.piece * 4096 and zlib.crc32(part.tobytes()) == r.ids_crc32
    assert out[out.doc_id == 4].length.tolist() == [1]


def test_shards_are_read_back_in_as_many_tasks(spark, make_docs):
    from salesops.llm.common import shared_path
    from salesops.llm.token_files import read_documents

    docs = make_docs([(i, "some words " * 50) for i in range(400)], 8)
    shards = write_token_files(docs, shared_path(spark, "t"))
    many = shards.limit(0).unionByName(shards)
    for n in range(1, 6):  # as if more tasks had written
        many = many.unionByName(shards.withColumn("shard", F.col("shard") + 100 * n))
    back = read_documents(many)
    assert back.rdd.getNumPartitions() == many.count() >= 6
    assert back.count() == 6 * 400
