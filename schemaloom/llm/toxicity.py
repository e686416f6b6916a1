"""Toxicity by a character n-gram linear classifier with naive Bayes features.

A text's features are the hashes of its character n-grams, present or not. Each is scaled by its
naive Bayes log-count ratio between toxic and clean training texts, and a logistic regression
weighs the scaled features. A score is a sum over the features that a text has, so it covers the
whole text and depends on nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import workspace, written

#: Hash space of the features, and n-gram sizes.
FEATURES, SIZES = 1 << 18, (3, 4, 5)
#: Characters hashed at once; bounds the memory of a long text.
CHUNK = 1 << 20
#: Texts that a worker holds as strings at once.
TEXTS = 256
#: The bound of the labelled sample: so many training documents of each class, those of the smallest hash.
PER_CLASS = 1500
#: Of five folds by the identifier's CRC-32, the one that is never trained on.
FOLDS, HELD_OUT = 5, 0
SMOOTHING, LEAST_DOCS, PENALTY, ROUNDS = 1.0, 4, 1.0, 150
#: Standard errors by which a feature's log-count ratio must differ from 0 to be used.
SIGNIFICANCE = 3.0


def features(text: str | None) -> np.ndarray:
    """The sorted feature numbers of a text; white space is one space, and one stands at both ends."""
    points = np.frombuffer(f" {' '.join((text or '').lower().split())} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    found = []
    for at in range(0, max(1, len(points) - 1), CHUNK):
        part = points[at : at + CHUNK + max(SIZES) - 1].astype(np.uint64)
        for n in SIZES:
            if len(part) < n:
                continue
            h = np.full(len(part) - n + 1, n, np.uint64)
            for i in range(n):
                h = (h ^ part[i : len(part) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            found.append((h >> np.uint64(40)).astype(np.int32) & (FEATURES - 1))
    seen = np.zeros(FEATURES, bool)
    for ids in found:
        seen[ids] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.weights[features(text)].sum(dtype=np.float64))
        return 1.0 / (1.0 + np.exp(-min(50.0, max(-50.0, z))))


def _log_ratio(p: np.ndarray, q: np.ndarray, n_p: int, n_q: int) -> np.ndarray:
    """The naive Bayes log-count ratio of features that p of n_p toxic and q of n_q clean texts have; 0 where it tells nothing."""
    ratio = np.log((p + SMOOTHING) / (n_p + 2 * SMOOTHING)) - np.log((q + SMOOTHING) / (n_q + 2 * SMOOTHING))
    error_of = np.sqrt(1 / (p + SMOOTHING) + 1 / (q + SMOOTHING))
    return np.where((np.abs(ratio) < SIGNIFICANCE * error_of) | (p + q < LEAST_DOCS), 0.0, ratio)


def fit(rows: list[np.ndarray], toxic: np.ndarray, prior: float | None = None) -> Model:
    """Train on the feature numbers of texts and their labels; ``prior`` is the share of toxic texts to expect."""
    if not len(toxic) or toxic.min() == toxic.max():
        return Model(np.zeros(FEATURES, np.float32), 0.0 if not len(toxic) else (4.0 if toxic[0] else -4.0))
    sizes = np.array([len(r) for r in rows])
    every = np.concatenate(rows)
    p, q = (np.bincount(np.concatenate([r for r, t in zip(rows, toxic, strict=True) if t == c]), minlength=FEATURES).astype(np.float64) for c in (1, 0))
    n_p, n_q = (toxic == 1).sum(), (toxic == 0).sum()
    ratio = _log_ratio(p, q, n_p, n_q)
    # rows as compressed indexes over the features that tell anything
    used = (ratio != 0)[every]
    owner, column = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)[used], every[used]
    del every, used
    value = ratio[column]
    share = np.where(toxic == 1, 0.5 / n_p, 0.5 / n_q)
    w, bias = np.zeros(FEATURES), 0.0
    m, v, mb, vb = np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 0.0
    for t in range(1, ROUNDS + 1):
        z = np.bincount(owner, weights=value * w[column], minlength=len(rows)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - toxic) * share
        g = np.bincount(column, weights=value * error[owner], minlength=FEATURES) + PENALTY * w / len(rows)
        gb = error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.05 / (1 - 0.9**t) * np.sqrt(1 - 0.99**t)
        w -= rate * m / (np.sqrt(v) + 1e-8)
        bias -= rate * mb / (np.sqrt(vb) + 1e-8)
    if prior:
        bias += np.log(prior / (1 - prior))
    return Model((w * ratio).astype(np.float32), float(bias))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on labelled documents outside the held-out fold: at most ``per_class`` of each class.

    Labels are rows of doc_id and toxic (0 or 1; other values and nulls are left out). Where one
    doc_id has several labels, a toxic one counts; where it has several texts, that of the smallest hash. Without labels of both classes the
    model has one score for all texts.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    known = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * per_class rows
    text = F.coalesce(F.col("text"), F.lit(""))
    one_each = docs.select("doc_id", text.alias("text")).join(ids, "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = written(one_each.select("text", "doc_id", F.col("toxic").cast("int").alias("toxic")), workspace(docs.sparkSession, "toxicity-sample"))
    useful = docs.sparkSession.sparkContext.broadcast(_telling(sample))  # a flag for each feature

    def featurize(batches) -> Iterator:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                every = (features(t) for t in some.column(0).to_pylist())
                found = [ids[useful.value[ids]].tobytes() for ids in every]
                yield pa.RecordBatch.from_arrays([some.column(1), some.column(2), pa.array(found, pa.binary())], names=["doc_id", "toxic", "ids"])

    got = sample.mapInArrow(featurize, "doc_id bigint, toxic int, ids binary").toArrow().to_pylist()
    ordered = sorted(got, key=lambda r: r["doc_id"])
    share = known.agg(F.avg("toxic")).first()[0]
    prior = None if share is None else min(0.5, max(0.01, share))
    return fit([np.frombuffer(r["ids"], np.int32) for r in ordered], np.array([r["toxic"] for r in ordered], dtype=np.int64), prior)


def _telling(sample: DataFrame) -> np.ndarray:
    """The features whose log-count ratio differs from 0, counted on the executors: the driver gets two numbers for each feature at most."""

    def count(batches) -> Iterator:
        counts = np.zeros((2, FEATURES), np.int64)
        texts = np.zeros(2, np.int64)
        for batch in batches:
            for t, toxic in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                counts[toxic][features(t)] += 1
                texts[toxic] += 1
        held = np.flatnonzero(counts.any(axis=0))
        rows = [np.append(held, -1), np.append(counts[1][held], texts[1]), np.append(counts[0][held], texts[0])]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["feature", "p", "q"])

    summed = sample.mapInArrow(count, "feature bigint, p bigint, q bigint").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).toArrow()
    feature, p, q = (summed.column(c).to_numpy() for c in ("feature", "p", "q"))
    told = np.zeros(FEATURES, bool)
    if len(feature):
        ratio = _log_ratio(p, q, p[feature < 0].sum(), q[feature < 0].sum())
        told[feature[(ratio != 0) & (feature >= 0)]] = True
    return told


def scored(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with all columns and the score of each whole text, from 0 to 1; null texts score as empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES numbers

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        own = shared.value
        some = (texts.slice(i, TEXTS).to_pylist() for i in range(0, len(texts), TEXTS))
        return pa.array([own.score(t) for part in some for t in part], pa.float64())

    return docs.withColumn(column, score(F.col("text")))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents, with all their columns, that score below ``threshold`` by a model of their labels."""
    return scored(docs, train(docs, labels), "__sl_score").where(F.col("__sl_score") < threshold).drop("__sl_score")


def op6_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: one row for each row of ``docs``. A null doc_id is not held out.

    Repeated rows score alike. Only doc_id and text are read, and no label enters a score. Empty
    tables give no rows.
    """
    found = scored(docs.select("doc_id", "text"), train(docs, labels))
    held_out = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
