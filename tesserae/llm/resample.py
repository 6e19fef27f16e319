"""Quality selection by importance resampling with hashed n-gram models.

Two generative models, of target text and of raw text, count hashed words and word bigrams.  A
document's log importance weight is the mean log ratio of its n-grams, as if every document had
``LENGTH`` of them: else a long clean document would weigh in like a short bad one.  Gumbel
top-k on the log weights draws k documents without replacement, in proportion to the weights.

The raw model counts every document.  The target model may use a bounded sample of documents
labelled good.  k follows from the weights at every size: it is the number of documents that
sampling without replacement draws, on average, until it has drawn ``MASS`` of all weight.
Documents of a far greater weight than e to the minus the draw's length are then all but sure to
come along, those of a far smaller one all but sure to stay, and the noise decides between them.
The k-th key is found by counting, never by gathering keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_slices, column, docs_of, short_batches, slices, staged, table, texts_of
from .hashing import bigrams, hashed_words, mixed

BITS = 16
#: Labelled documents that the target model counts at most, those with the least hash of doc_id.
TARGET_DOCS = 20_000
#: Share of all importance weight that is drawn.
MASS = 0.99999
LENGTH = 32
#: N-grams without evidence that every document has besides its own.
EVEN = 20
SEED = 20_240_601
SMOOTH = 1.0
#: Bins of a unit of log weight in the histogram that k is computed from.
BINS = 64


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and bigrams, and the text of each."""
    words, sizes = hashed_words(texts)
    two, doc2 = bigrams(words, sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    return np.concatenate((mixed(words, BITS), mixed(two, BITS))), np.concatenate((doc, doc2))


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    size = len(raw)
    if not target.sum():
        return np.zeros(size)
    return np.log((target + SMOOTH) / (target.sum() + SMOOTH * size)) - np.log((raw + SMOOTH) / (raw.sum() + SMOOTH * size))


def good_ids(labels: DataFrame, most: int) -> DataFrame:
    """doc_ids labelled good (and never bad), at most ``most``."""
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    return good.select(F.col("doc_id").cast("long")).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(most)


def models(docs: DataFrame, labels: DataFrame, target_docs: int = TARGET_DOCS) -> np.ndarray:
    """Log ratios by bucket; what reaches the driver is one row a bucket."""
    # target_docs bounds what is broadcast: eight bytes a document
    marked = docs_of(docs).join(F.broadcast(good_ids(labels, target_docs).withColumn("good", F.lit(True))), "doc_id", "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), np.int64)
        for batch in slices(batches):
            bucket, doc = features(texts_of(batch))
            good = np.array([bool(g) for g in column(batch, "good").to_pylist()], bool)
            total[1] += np.bincount(bucket, minlength=1 << BITS)
            total[0] += np.bincount(bucket[good[doc]], minlength=1 << BITS)
        seen = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[0, seen]), pa.array(total[1, seen])], names=["bucket", "target", "raw"])

    counts = marked.mapInArrow(count, "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))
    target, raw = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for r in counts.collect():
        target[r.bucket], raw[r.bucket] = r.target, r.raw
    return log_ratios(target, raw)


def log_weights(texts: list[str], ratios: np.ndarray) -> np.ndarray:
    bucket, doc = features(texts)
    total = np.bincount(doc, weights=ratios[bucket], minlength=len(texts))
    return total * (LENGTH / (np.bincount(doc, minlength=len(texts)) + EVEN))


def weighed(docs: DataFrame, ratios: np.ndarray, name: str = "log_weight") -> DataFrame:
    """Every row of ``docs`` with its log weight in a further column; only texts go to Python."""

    @F.arrow_udf("double")
    def weight(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in texts:
            yield pa.array(np.concatenate([np.zeros(0), *(log_weights(part, ratios) for part in by_slices(some))]))

    return short_batches(docs).withColumn(name, weight(F.col("text").cast("string")))


def gumbel(seed: int, *keys: Column | str) -> Column:
    """Standard Gumbel noise that depends on the seed and the keys alone."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def draw_size(weights: np.ndarray, counts: np.ndarray, mass: float = MASS) -> int:
    """Documents that are drawn, on average, when the share ``mass`` of all weight is.

    Drawing without replacement is like documents arriving at exponential times, each at its
    weight as rate: at time t a document has come with probability 1 - exp(-weight t).
    """
    if not counts.sum():
        return 0
    weights = weights / weights.max()
    total = (weights * counts).sum()
    low, high = 0.0, 1.0
    drawn = lambda t: (weights * counts * -np.expm1(-weights * t)).sum() / total
    while drawn(high) < mass:
        low, high = high, 2 * high
    for _ in range(60):
        t = (low + high) / 2
        low, high = (t, high) if drawn(t) < mass else (low, t)
    return round(float((counts * -np.expm1(-weights * high)).sum()))


def kth_largest(keys: DataFrame, name: str, k: int, bins: int = 2000) -> float | None:
    """The k-th largest value of a column by repeated counting in ever narrower bins."""
    left = keys.select(F.col(name).alias("x"))
    while True:
        low, high, n = left.agg(F.min("x"), F.max("x"), F.count("x")).first()
        if k < 1 or n < k:
            return None
        if low == high or n <= bins:
            values = sorted((r.x for r in left.groupBy("x").count().withColumn("x", F.col("x")).collect() for _ in range(r["count"])), reverse=True) if low < high else None
            return values[k - 1] if values else low
        bin_of = F.least(F.lit(bins - 1), F.floor((F.col("x") - low) / ((high - low) / bins)))
        above = 0
        for r in sorted(left.groupBy(bin_of.alias("b")).count().collect(), reverse=True):
            if above + r["count"] >= k:
                left, k = left.where(bin_of == r.b), k - above
                break
            above += r["count"]


def _drawn_by_noise(scored: DataFrame, ratios: np.ndarray, mass: float, weight: str = "log_weight", noise: str = "noise") -> Column:
    """The condition on weighed rows that the draw takes them: a key among the k largest."""
    if not ratios.any():
        return F.lit(True)
    rows = scored.groupBy(F.round(F.col(weight) * BINS).alias("x")).count().collect()  # as many as there are bins between the extremes of a mean
    k = draw_size(np.exp(np.array([r.x for r in rows]) / BINS), np.array([r["count"] for r in rows]), mass)
    key = F.col(weight) + F.col(noise)
    least = kth_largest(scored.select(key.alias("key")), "key", k)
    return key >= (math.inf if least is None else least)


def resample(docs: DataFrame, labels: DataFrame, mass: float = MASS, seed: int = SEED) -> DataFrame:
    """``doc_id, log_weight, key`` of the documents drawn.

    Null and empty texts have weight one (log 0).  Equal rows share their noise; rows that tie
    with the k-th key are all drawn; rows without a doc_id are drawn like others.  Without
    labelled good documents, or without documents, nothing tells target from raw: the models are
    equal and all rows are drawn.
    """
    ratios = models(docs, labels)
    scored = staged(weighed(docs_of(docs), ratios).select("doc_id", "log_weight", gumbel(seed, "doc_id", "text").alias("noise")), "log-weights")
    return scored.where(_drawn_by_noise(scored, ratios, mass)).select("doc_id", "log_weight", (F.col("log_weight") + F.col("noise")).alias("key"))


def resampled_rows(docs: DataFrame, labels: DataFrame, mass: float = MASS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that ``resample`` draws, with all their columns; no row is shuffled."""
    ratios = models(docs, labels)
    weight, noise = (_free(docs.columns, x) for x in ("log_weight", "noise"))
    text = F.col("text").cast("string")
    scored = staged(weighed(docs, ratios, weight).withColumn(noise, gumbel(seed, F.col("doc_id").cast("long"), text)), "weighed-rows")
    return scored.where(_drawn_by_noise(scored, ratios, mass, weight, noise)).select(*docs.columns)


def _free(names: list[str], name: str) -> str:
    while name.lower() in {x.lower() for x in names}:
        name += "_"
    return name


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return drawn.select("doc_id", F.lit(True).alias("kept"), "log_weight", "key")
