"""Toxicity scores by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features are the distinct words, word bigrams and one-word skip-grams of a text, hashed.  Each
coordinate has a learning rate of its own and L1 keeps the weights few, so that a compact list
of (feature, weight) goes to every task.  Training reads a bounded sample of labelled rows
(features are made where the rows are, one task runs the updates); scoring is a map.

``LEAST_DOCS`` is part of the model: a feature of fewer labelled documents than L1 lets through
in as many steps tells their text apart, not their tone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, docs_of, slices, staged, table, texts_of
from .hashing import hashed_words, mixed, pairs

BITS = 22
#: Labelled documents that training reads at most, those with the least hash of doc_id.
TRAIN_DOCS = 16_000
#: Bytes of their features at most: what the training task holds.  Of the sample, documents come in the order of their hash.
TRAIN_BYTES = 256 << 20
SEED = 7_019
RATE, BETA, L1, L2, EPOCHS = 2.0, 1.0, 8.0, 1.0, 6
#: Labelled documents that a feature must occur in to be learned.
LEAST_DOCS = 3


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (repeats included) of all texts, and the text of each."""
    words, sizes = hashed_words(texts)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    two, doc2 = pairs(words, sizes, 1)
    skip, doc3 = pairs(words, sizes, 2)
    return np.concatenate((mixed(words, BITS), mixed(two, BITS), mixed(skip, BITS))), np.concatenate((doc, doc2, doc3))


class Ftrl:
    """FTRL-proximal: the weight of a coordinate follows from its gradient sums z and n."""

    def __init__(self, size: int) -> None:
        self.z = np.zeros(size)
        self.n = np.zeros(size)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / RATE + L2))

    def update(self, at: np.ndarray, label: float) -> None:
        """One document with distinct features ``at``."""
        w = self.weights(at)
        g = sigmoid(w.sum()) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / RATE * w
        self.n[at] = n + g * g


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(rows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and weights other than zero; feature ``2 ** BITS`` is the constant one."""
    model = Ftrl((1 << BITS) + 1)
    in_docs = np.zeros(1 << BITS, np.int32)
    for at, _ in rows:
        in_docs[at] += 1
    rows = [(at[in_docs[at] >= LEAST_DOCS], label) for at, label in rows]
    order = np.random.default_rng(SEED)
    constant = np.array([1 << BITS])
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            at, label = rows[k]
            model.update(np.concatenate((at.astype(np.int64), constant)), float(label))
    w = model.weights(np.arange(len(model.z)))
    at = np.flatnonzero(w)
    return at, w[at]


def learned(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Weights from the labelled rows of ``docs``; ``labels(doc_id, toxic)``, nulls ignored."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(most)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            f, doc = features(texts_of(batch))
            sets = [np.unique(f[doc == k]).astype("<u4").tobytes() for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "toxic"), pa.array(sets, pa.binary())], names=["doc_id", "toxic", "features"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            rows += [(d, np.frombuffer(f, "<u4"), t) for d, t, f in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        rows.sort(key=lambda r: (r[0], r[1].tobytes()))
        at, w = train([(f, t) for _, f, t in rows]) if rows else (np.zeros(0, np.int64), np.zeros(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w)], names=["at", "w"])

    # the sample's ids are broadcast: twelve bytes each of at most ``most``
    marked = docs_of(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic")
    sets = staged(marked.mapInArrow(extract, "doc_id long, toxic int, features binary"), "toxic-features")
    row = (F.xxhash64(F.lit(SEED), "doc_id"), F.col("doc_id"), F.xxhash64("features"))
    before = F.sum(F.octet_length("features")).over(W.orderBy(*row).rowsBetween(W.unboundedPreceding, 0))  # of ``most`` documents
    within = sets.select(*(c.alias(f"k{n}") for n, c in enumerate(row)), before.alias("held")).where(F.col("held") <= TRAIN_BYTES).agg(F.max(F.struct("k0", "k1", "k2")).alias("last"))
    kept = sets.join(F.broadcast(within)).where(F.struct(*row) <= F.col("last")).drop("last")  # one row
    got = kept.repartition(1).mapInArrow(fit, "at long, w double").toArrow()
    return got.column("at").to_numpy(), got.column("w").to_numpy()


def scores(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``doc_id, score`` of every row."""
    at, w = weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((1 << BITS) + 1, np.float32)
        dense[at] = w
        for batch in slices(batches):
            f, doc = features(texts_of(batch))
            hit = np.flatnonzero(dense[f])
            key = np.unique(doc[hit] * np.int64(1 << BITS) + f[hit])  # a feature counts once in a text
            total = np.bincount(key >> BITS, weights=dense[key & ((1 << BITS) - 1)], minlength=batch.num_rows) + dense[-1]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(sigmoid(total.astype(float)))], names=["doc_id", "score"])

    return docs_of(docs).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, score, predicted`` of every row; null and empty texts get the constant's score.

    Without labels every score is one half.  Repeated rows are scored one by one.
    """
    scored = scores(docs, learned(docs, labels))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return toxicity(docs, labels.where(~held)).select("doc_id", held.alias("held_out"), "score", "predicted")
