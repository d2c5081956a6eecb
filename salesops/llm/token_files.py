"""Token ids as Arrow files of fixed-size lists.

Documents are range-partitioned and sorted by id; each task writes one shard
of two Arrow IPC files into the shared folder:

* ``part-N.tokens.arrow`` - record batches of equal-length sequences:
  ``ids fixed_size_list<uint16|uint32>[length]`` and
  ``mask fixed_size_list<bool>[length]`` (false only after a shard's last id),
  so row r of batch b lies at a known place and is read without copying;
* ``part-N.docs.arrow`` - ``doc_id, start, n_tokens`` of each document, start
  counted within the shard.

A retried task writes under another name; only the files its committed row
names belong to the dataset. A shard's place in the whole is the sum of the
tokens in the shards before it (one small row per shard).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesops.llm.common import shared_path, small, stored
from salesops.llm.tokens import default_tokenizer, encode_ids, encoder

SEQUENCE_LENGTH = 2048
BATCH_SEQUENCES = 128

INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
SHARDS = "shard int, tokens string, docs string, n_docs long, n_tokens long"


class SequenceWriter:
    """Cuts a stream of ids into equal sequences and writes them in batches."""

    def __init__(self, path: str, length: int, small: bool):
        self.length, self.kind = length, np.uint16 if small else np.uint32
        value = pa.uint16() if small else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))])
        system, name = fs.FileSystem.from_uri(path)
        self.out = system.open_output_stream(name)
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.block = np.zeros(length * BATCH_SEQUENCES, self.kind)
        self.used = 0

    def add(self, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            n = min(len(ids) - at, len(self.block) - self.used)
            self.block[self.used : self.used + n] = ids[at : at + n]
            self.used, at = self.used + n, at + n
            if self.used == len(self.block):
                self.flush()

    def flush(self) -> None:
        rows = -(-self.used // self.length)
        if rows:
            self.block[self.used : rows * self.length] = 0
            mask = np.arange(rows * self.length) < self.used
            cols = [pa.FixedSizeListArray.from_arrays(pa.array(self.block[: rows * self.length]), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)]
            self.file.write_batch(pa.record_batch(cols, schema=self.schema))
        self.used = 0

    def close(self) -> None:
        self.flush()
        self.file.close()
        self.out.close()


def write_token_files(docs: DataFrame, folder: str, *, tokenizer: str | None = None, end_id: int = 1, length: int = SEQUENCE_LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the dataset; returns one row per shard (``SHARDS``), in id order.

    Defined cases: a null text is an empty one (its end id alone); documents
    with a null id come first; rows with the same id are all written, next to
    each other in input order; an empty table gives no shard. Other columns
    are ignored.
    """
    path = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(place)
    root = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toUri().toString()
    root = root.replace("file:/", "file:///", 1) if root.startswith("file:/") and not root.startswith("file:///") else root

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(path)
        shard = TaskContext.get().partitionId()
        stem = f"{root}/part-{shard:05d}-{uuid.uuid4().hex}"
        tokens = index = None
        total = n_docs = 0
        for b in small(batches):
            if tokens is None:
                tokens = SequenceWriter(f"{stem}.tokens.arrow", length, ids.tokenizer.get_vocab_size() <= 1 << 16)
                system, name = fs.FileSystem.from_uri(f"{stem}.docs.arrow")
                out = system.open_output_stream(name)
                index = pa.ipc.new_file(out, INDEX)
            sizes = np.empty(b.num_rows, np.int64)
            for i, text in enumerate(b.column("text")):
                own = encode_ids(ids, text.as_py(), end_id)
                tokens.add(own)
                sizes[i] = len(own)
            starts = total + np.cumsum(sizes) - sizes
            index.write_batch(pa.record_batch([b.column("doc_id"), pa.array(starts), pa.array(sizes)], schema=INDEX))
            total += int(sizes.sum())
            n_docs += b.num_rows
        if tokens is not None:
            tokens.close()
            index.close()
            out.close()
            yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([f"{stem}.tokens.arrow"]), pa.array([f"{stem}.docs.arrow"]), pa.array([n_docs]), pa.array([total])], names=["shard", "tokens", "docs", "n_docs", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("place"))
    dealt = rows.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "text")
    return stored(dealt.mapInArrow(write, SHARDS), "token-shards")


def open_tokens(path: str) -> pa.ipc.RecordBatchFileReader:
    """A shard's token file; memory-mapped, so without a copy, on a local path."""
    system, name = fs.FileSystem.from_uri(path)
    return pa.ipc.open_file(pa.memory_map(name) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(name))


def sequence(reader: pa.ipc.RecordBatchFileReader, row: int, per_batch: int = BATCH_SEQUENCES) -> tuple[np.ndarray, np.ndarray]:
    """Sequence ``row`` of a shard and its mask, by place."""
    batch = reader.get_batch(row // per_batch)
    ids, mask = batch.column(0)[row % per_batch], batch.column(1)[row % per_batch]
    return ids.values.to_numpy(), mask.values.to_numpy(zero_copy_only=False)


class TokenReader:
    """Ids of any span of a shard; holds the batch last read."""

    def __init__(self, path: str):
        self.file, self.at, self.held = open_tokens(path), -1, None
        self.batch_tokens = BATCH_SEQUENCES * self.file.schema.field("ids").type.list_size

    def spans(self, start: int, n: int) -> Iterator[np.ndarray]:
        while n > 0:
            b, inside = divmod(start, self.batch_tokens)
            if b != self.at:
                batch = self.file.get_batch(b)
                flat, mask = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False)
                self.at, self.held = b, flat[: int(mask.sum())]
            part = self.held[inside : inside + n]
            if not len(part):
                raise ValueError("a token file ends before its documents do")
            yield part
            start, n = start + len(part), n - len(part)


def read_documents(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the files."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    placed = shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.to_pylist():
                tokens = TokenReader(shard["tokens"])
                system, name = fs.FileSystem.from_uri(shard["docs"])
                docs = pa.ipc.open_file(system.open_input_file(name))
                for i in range(docs.num_record_batches):
                    d = docs.get_batch(i)
                    start, size = d.column("start").to_numpy(), d.column("n_tokens").to_numpy()
                    crc = np.zeros(len(start), np.int64)
                    for j in range(len(start)):
                        value = 0
                        for part in tokens.spans(int(start[j]), int(size[j])):
                            value = zlib.crc32(part.astype("<u4").tobytes(), value)
                        crc[j] = value
                    yield pa.record_batch([d.column("doc_id"), pa.array(start + shard["base"]), d.column("n_tokens"), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # As many ranges of shard numbers as there are shards: a given number of partitions is not
    # coalesced, however small a shard's row is.
    return placed.repartitionByRange(max(shards.count(), 1), "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, **options) -> DataFrame:
    """Write the documents' token files and read them back, document by document."""
    return read_documents(write_token_files(docs, shared_path(docs.sparkSession, "token-files"), **options))
