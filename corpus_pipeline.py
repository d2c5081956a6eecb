"""Corpus pipeline: documents to packed training sequences.

``STAGES`` are applied in order; each takes ``(spark, docs, sf_dir)`` and
returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last keep the columns of documents.

1. quality: rows that the compression classifier rejects go;
2. near_dup: one document of each near-duplicate group stays (five-word
   shingles, similarity of 0.8 or more);
3. mix: each leaf of the domain - language - source tree gives the documents
   its token budget pays for, whole passes first, so a document may come again;
4. pack: documents become pieces of at most 4096 tokens, packed into sequences.

Defined cases: a null or empty text is scored like an empty text, is no
duplicate and is one end token where it gets to packing; repeated rows are
exact copies, one of which stays; an empty table gives empty results; extra
columns pass through to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from salesops.llm.common import stored, table, unused
from salesops.llm.mixing import mix_to_weights
from salesops.llm.near_dup import drop_near_duplicates
from salesops.llm.packing import pack_documents
from salesops.llm.quality import quality_filter
from salesops.llm.queries import held_out_quality
from salesops.session import bound_batches, ship_package


def prepare(spark: SparkSession) -> None:
    ship_package(spark)
    # All stages share the executors' memory, so few texts are on their way to a worker at a time.
    bound_batches(spark)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality_filter(docs, table(spark, sf_dir, "labels"), held_out=held_out_quality())


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return drop_near_duplicates(docs, size=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    note = unused("mix", docs.columns)
    return mix_to_weights(docs, mix_col=note).drop(note)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    # The stages before it share the workers, so fewer chunks are kept than by packing alone.
    return pack_documents(docs, remembered=100_000)


STAGES = [("quality", quality), ("near_dup", near_dup), ("mix", mix), ("pack", pack)]

# Compression, sampled hashes and packing are not expressible in SQL; tests
# hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if i == len(STAGES) - 1 else stored(out, f"stage-{name}")
    return docs
