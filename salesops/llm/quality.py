"""Quality classifier by compression with class dictionaries.

Pairs of zstandard dictionaries of a few sizes are built, one from good and
one from bad labelled texts. A text is compressed whole with each; the class
whose dictionaries shrink it more is likelier. The normalised size difference
``(bad - good) / (bad + good)`` of the mean sizes and how far the text shrinks
at all are turned into a probability by a logistic curve, fitted on labelled
texts that did not go into the dictionaries. Small dictionaries hold what a
class says most often, large ones what it says at all; together their
difference tells the classes apart better than that of any one size.

The model is a bounded object (six dictionaries and a few coefficients) that
travels with the task. Only training reads labels. It learns from a bounded
number of rows, each whole; their texts stay in tasks, and the driver gets
dictionaries, ids and sizes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesops.llm.common import give_back, release_tokens, small, stored

# Bound of what training reads: texts of each class.
TRAIN_PER_CLASS = 2000
DICTIONARY_BYTES = (16384, 32768, 65536)
# Pieces that few texts are cut into, whole, to have enough samples to train on.
SAMPLE_BYTES = 512
LEVEL = 3


@dataclass
class CompressionModel:
    good: list[bytes]
    bad: list[bytes]
    weights: list[float]
    mean: list[float]
    scale: list[float]

    def sizes(self, texts) -> np.ndarray:
        """Compressed sizes (plain, the means with the good and with the bad dictionaries) and length."""
        plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_dict_id=False)

        def compressor(d: bytes) -> zstandard.ZstdCompressor:
            if not d:
                return plain
            data = zstandard.ZstdCompressionDict(d)
            data.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False)

        made = [[plain], *([compressor(d) for d in ds] or [plain] for ds in (self.good, self.bad))]
        out = np.empty((len(texts), 4))
        for i, t in enumerate(texts):
            data = (t or "").encode("utf-8", "surrogatepass")
            out[i] = [*(sum(len(c.compress(data)) for c in cs) / len(cs) for cs in made), len(data)]
        return out

    def score(self, texts) -> np.ndarray:
        if not len(texts):
            return np.empty(0)
        x = (features(self.sizes(texts)) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)))


def features(s: np.ndarray) -> np.ndarray:
    """The normalised size difference, alone and by how far the text shrinks."""
    plain, good, bad, n = s.T
    diff = (bad - good) / (bad + good)
    shrink = plain / (n + 16)
    gain = np.minimum(good, bad) / plain
    return np.column_stack([diff, shrink, gain, diff * shrink, shrink**2, np.log1p(n)])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 40) -> np.ndarray:
    """Newton steps for a ridge logistic regression with an intercept."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    keep = ridge * len(a) * np.append(0, np.ones(x.shape[1])) + 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(keep), a.T @ (y - p) - keep * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def dictionaries(texts: list[str]) -> list[bytes]:
    """A trained dictionary of each size. Texts too few to train on are cut into pieces;
    if there are too few of these, all of the text is the one dictionary."""
    whole = [t.encode("utf-8", "surrogatepass") for t in texts if t]
    total = sum(map(len, whole))
    pieces = [d[at : at + SAMPLE_BYTES] for d in whole for at in range(0, len(d), SAMPLE_BYTES)]
    for samples in (whole, pieces):
        try:
            return [zstandard.train_dictionary(min(size, max(1024, total // 8)), samples).as_bytes() for size in DICTIONARY_BYTES]
        except zstandard.ZstdError:
            continue
    return [b"\n".join(whole)]


def one_class(good: bool, bad: bool) -> CompressionModel:
    """One class or none: nothing to tell apart."""
    p = 0.5 if good == bad else (0.99 if good else 0.01)
    return CompressionModel([], [], [float(np.log(p / (1 - p))), *[0.0] * 6], [0.0] * 6, [1.0] * 6)


def _part(xs: list, last: bool) -> list:
    """The last third of a class, or the rest; all of it if that is none."""
    return [x for i, x in enumerate(xs) if (i % 3 == 2) == last] or xs


def fit_curve(model: CompressionModel, good: np.ndarray, bad: np.ndarray, share_good: float | None = None) -> CompressionModel:
    """The model with its curve fitted on the sizes of good and of bad texts.

    ``share_good``: the class share among all labelled rows, when the two lists
    were sampled at other rates; the curve is weighted back to it.
    """
    x = features(np.concatenate([good, bad]))
    y = np.repeat([1.0, 0.0], [len(good), len(bad)])
    model.mean, model.scale = x.mean(0).tolist(), (x.std(0) + 1e-9).tolist()
    w = fit_logistic((x - model.mean) / model.scale, y)
    if share_good is not None and 0 < share_good < 1:
        w[0] += np.log(share_good / (1 - share_good)) - np.log(len(good) / len(bad))
    model.weights = w.tolist()
    return model


def fit(good: list[str], bad: list[str], share_good: float | None = None) -> CompressionModel:
    """Dictionaries from two thirds of each class; the curve from the last third."""
    if not good or not bad:
        return one_class(bool(good), bool(bad))
    model = CompressionModel(dictionaries(_part(good, False)), dictionaries(_part(bad, False)), [], [], [])
    return fit_curve(model, model.sizes(_part(good, True)), model.sizes(_part(bad, True)), share_good)


def labelled_sample(docs: DataFrame, labels: DataFrame, train: Column, per_class: int = TRAIN_PER_CLASS) -> tuple[DataFrame, float | None]:
    """At most ``per_class`` training rows of each class, the first by hash of id, with whole texts."""
    names = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & train).select("doc_id", "quality").dropDuplicates(["doc_id"])
    n = {r["quality"]: r["n"] for r in names.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    # Choose ids first, so that only their texts are read into the join.
    picks = [names.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (1, 0)]
    chosen = F.broadcast(picks[0].unionByName(picks[1]))  # at most 2 * per_class ids
    text = docs.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    rows = text.join(chosen, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "quality")).alias("s"))
    total = sum(n.values())
    return rows.select(F.col("doc_id").cast("long"), F.col("s.text").alias("text"), F.col("s.quality").cast("int").alias("quality")), (n.get(1, 0) / total if total else None)


def fit_sample(docs: DataFrame, labels: DataFrame, train: Column) -> CompressionModel:
    """``fit`` on the labelled sample, its texts read whole in tasks."""
    rows, share_good = labelled_sample(docs, labels, train)
    sample = stored(rows, "quality-sample")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each class's dictionaries, and the ids that did not go into them."""
        release_tokens()
        held: dict[int, list[tuple[int, str]]] = {}
        for b in batches:
            for doc, text, quality in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "quality")), strict=True):
                held.setdefault(quality, []).append((doc, text))
        for quality, own in held.items():
            own.sort()
            made = dictionaries([t for _, t in _part(own, False)])
            yield pa.record_batch([pa.array([quality], pa.int32()), pa.array([made], pa.list_(pa.binary())), pa.array([[d for d, _ in _part(own, True)]], pa.list_(pa.int64()))], names=["quality", "dictionaries", "curve"])

    # A class is one task: its rows are at most TRAIN_PER_CLASS.
    learnt = {r["quality"]: r for r in sample.repartition(2, "quality").mapInArrow(learn, "quality int, dictionaries array<binary>, curve array<long>").collect()}
    if len(learnt) < 2:
        return one_class(1 in learnt, 0 in learnt)
    model = CompressionModel(*([bytes(d) for d in learnt[q]["dictionaries"]] for q in (1, 0)), [], [], [])
    ids = {*learnt[0]["curve"], *learnt[1]["curve"]}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_tokens()
        for b in small(batches):
            b = b.filter(pa.array([d in ids for d in b.column("doc_id").to_pylist()], pa.bool_()))
            sizes = model.sizes(b.column("text").to_pylist())
            yield pa.record_batch([b.column("doc_id"), b.column("quality"), pa.array(list(sizes), pa.list_(pa.float64()))], names=["doc_id", "quality", "sizes"])

    found = sorted(sample.mapInArrow(measure, "doc_id long, quality int, sizes array<double>").collect())
    return fit_curve(model, *(np.array([r["sizes"] for r in found if r["quality"] == q]) for q in (1, 0)), share_good)


def score_quality(docs: DataFrame, labels: DataFrame, *, held_out: Column, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``quality_score`` and ``quality_predicted``.

    The model learns from labelled rows for which ``held_out`` is false. The
    training sample is bounded: ``TRAIN_PER_CLASS`` texts of each class; training
    and scoring read every text whole.

    Defined cases: a null or empty text gets the score that an empty text
    earns; equal texts get equal scores; labels other than 0 and 1, or with a
    null id, are ignored; of several labels for one id any one counts; with a
    single labelled class every score is 0.99 or 0.01, with none 0.5. Extra
    columns pass through, but ones named like the two new columns are replaced.
    """
    score = scorer(fit_sample(docs, labels, ~held_out))
    out = docs.withColumn("quality_score", score(F.col(text_col)))
    return out.withColumn("quality_predicted", (F.col("quality_score") >= threshold).cast("int"))


def scorer(model: CompressionModel):
    """The model as a column function of a text."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release_tokens()
        for text in batches:
            # A few hundred texts at a time are Python objects.
            parts = [model.score(text.iloc[at : at + 500].tolist()) for at in range(0, len(text), 500)]
            yield pd.Series(np.concatenate(parts) if parts else [], dtype="float64")
        give_back()

    return score


def quality_filter(docs: DataFrame, labels: DataFrame, *, held_out: Column, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected; cases as in ``score_quality``, all columns unchanged."""
    score = scorer(fit_sample(docs, labels, ~held_out))
    return docs.where(score(F.col(text_col)) >= threshold)
