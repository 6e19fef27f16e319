"""Language identification as a mixture of languages, by expectation-maximisation.

Every language has a model of character n-grams (hashed, within words).  A document is a
mixture: each of its words comes from one language, with the likelihood of its n-grams.  EM
estimates the proportions; sets of the 1, 2, ... best languages are fitted, and the set with
the best penalised likelihood stands.  The prediction is the language of the largest share.

Models are learned from a bounded sample of labelled documents of every language there is.
Every document is read whole, as its distinct words and their counts; all documents of a slice
are fitted together, and a task computes the likelihoods of a word once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, column, docs_of, slices, table, texts_of

BITS = 16
ORDERS = (1, 2, 3, 4)
#: Labelled documents that a language learns from, about: those with the least hashes of doc_id.
TRAIN_DOCS = 1_500
ROUNDS = 8
#: Share in the fit over all languages below which a language is in no set.
LEAST_SHARE = 0.01
#: Log likelihood that a further language must gain, by log of the number of words.
PENALTY = 3.0
SMOOTH = 0.5
SEED = 90_021
#: Cells (characters or words, times languages) that are computed at a time, and that a task remembers.
CELLS, REMEMBERED_CELLS = 1 << 21, 1 << 23
WORDS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def ngrams(words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """By order the n-gram bucket at each character (``2 ** BITS``: none there), and words' character counts.

    A word is a run of letters, in lower case between two blanks.
    """
    joined = "".join(f" {w} " for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    room = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # characters to the word's end
    h = np.zeros(len(codes), np.uint64)
    found = []
    for n in ORDERS:
        h = h[: max(0, len(codes) - n + 1)]
        h = h * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(n)
        bucket = np.full(len(codes), 1 << BITS, np.int32)
        bucket[: len(h)] = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
        bucket[room < n] = 1 << BITS
        if n == 1:
            bucket[codes == 32] = 1 << BITS
        found.append(bucket)
    return found, lengths


def pieces(words: list[str], characters: int) -> Iterator[list[str]]:
    """The words in lists of at most so many characters, but for one long word."""
    start = held = 0
    for k, w in enumerate(words):
        if held and held + len(w) + 2 > characters:
            yield words[start:k]
            start, held = k, 0
        held += len(w) + 2
    if words:
        yield words[start:]


def learn(labelled: DataFrame, most: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities by bucket (buckets x languages; the last row, of no n-gram, is 0)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for lang, text in zip(column(batch, "lang").to_pylist(), texts_of(batch), strict=True):
                total.setdefault(lang, np.zeros((1 << BITS) + 1, np.int64))
                for words in pieces(WORDS.findall(text.lower()), CELLS):
                    total[lang] += sum(np.bincount(g, minlength=(1 << BITS) + 1) for g in ngrams(words)[0])
        for lang, counts in total.items():
            seen = np.flatnonzero(counts[: 1 << BITS])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen), pa.array(counts[seen])], names=["lang", "bucket", "n"])

    known = labelled.where("doc_id is not null and lang is not null and lang <> 'und'")
    # a row a language: the share of its documents that are read
    shares = known.groupBy("lang").agg((F.lit(float(most)) / F.count("*")).alias("share"))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col("doc_id").cast("long")), 11) / float(1 << 53)
    marked = known.select("lang", F.col("text").cast("string").alias("text"), u.alias("u")).join(F.broadcast(shares), "lang").where("u < share").select("text", "lang")
    counts = marked.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts.column("lang").to_pylist()))
    number = {x: k for k, x in enumerate(langs)}
    model = np.full((1 << BITS, len(langs)), SMOOTH)
    where = np.array([number[x] for x in counts.column("lang").to_pylist()], np.int64)
    model[counts.column("bucket").to_numpy(), where] += counts.column("n").to_numpy()
    return langs, np.concatenate((np.log(model / model.sum(axis=0)), np.zeros((1, len(langs))))).astype(np.float32)


class Likelihoods:
    """Likelihoods of words by language, remembered: relative to the best one, and the log of that."""

    def __init__(self, model: np.ndarray) -> None:
        self._model = model
        self._languages = model.shape[1]
        self._forget()

    def _forget(self) -> None:
        self._number: dict[str, int] = {}
        self.relative, self.best = np.zeros((0, self._languages), np.float32), np.zeros(0)

    def numbers(self, texts_words: list[Counter]) -> np.ndarray:
        """The row of each word of each text; rows hold until the next call."""
        if len(self._number) * self._languages > REMEMBERED_CELLS:
            self._forget()
        number = self._number
        new = [*set().union(*texts_words).difference(number)]
        if new:
            number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
            relative, best = [self.relative], [self.best]
            for some in pieces(new, max(64, CELLS // self._languages)):
                grams, lengths = ngrams(some)
                at_char = self._model[grams[0]]
                for g in grams[1:]:
                    at_char += self._model[g]
                log = np.add.reduceat(at_char, np.cumsum(lengths) - lengths, axis=0)
                top = log.max(axis=1)
                relative.append(np.exp(log - top[:, None]))
                best.append(top.astype(np.float64))
            self.relative, self.best = np.concatenate(relative), np.concatenate(best)
        return np.fromiter(map(number.__getitem__, chain.from_iterable(texts_words)), np.int64, sum(map(len, texts_words)))


class Texts:
    """The texts of a slice as (text, word, count) triples, for fits of all at once."""

    def __init__(self, texts: list[str], of: Likelihoods) -> None:
        words = [Counter(WORDS.findall(t.lower())) for t in texts]
        self.has = np.array([k for k, w in enumerate(words) if w], np.int64)
        words = [w for w in words if w]
        self._of, self._word = of, of.numbers(words)
        self._count = np.fromiter(chain.from_iterable(w.values() for w in words), np.float64, len(self._word))
        self._ends = np.cumsum([len(w) for w in words])
        self._doc = np.repeat(np.arange(len(words)), np.diff(self._ends, prepend=0)) if words else np.zeros(0, np.int64)
        self.sizes = np.bincount(self._doc, self._count, len(words))

    def _blocks(self, docs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Triples of some texts, not too many at a time, with the row of each one's text in ``docs``."""
        row = np.full(len(self.sizes), -1)
        row[docs] = np.arange(len(docs))
        row = row[self._doc]
        at = np.flatnonzero(row >= 0)
        step = max(1, CELLS // self._of.relative.shape[1])
        for k in range(0, len(at), step):
            yield at[k : k + step], row[at[k : k + step]]

    def single(self, languages: np.ndarray) -> np.ndarray:
        """Log likelihood of every text in the language given for it."""
        out = np.zeros(len(self.sizes))
        for at, doc in self._blocks(np.arange(len(self.sizes))):
            word = self._word[at]
            log = np.log(self._of.relative[word, languages[doc]] + 1e-30) + self._of.best[word]
            out += np.bincount(doc, log * self._count[at], len(out))
        return out

    def fit(self, docs: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and log likelihood of some texts over each one's allowed languages, by EM."""
        share = (allowed / allowed.sum(axis=1, keepdims=True)).astype(np.float32)
        blocks = [(at, doc, np.flatnonzero(np.diff(doc, prepend=-1))) for at, doc in self._blocks(docs)]
        gathered = self._of.relative[self._word[blocks[0][0]]] if len(blocks) == 1 else None
        for last in (*[False] * ROUNDS, True):
            got, likelihood = np.zeros(share.shape), np.zeros(len(docs))
            for at, doc, first in blocks:
                p = self._of.relative[self._word[at]] if gathered is None else gathered
                total = np.einsum("ij,ij->i", p, share[doc]) + np.float32(1e-30)
                if last:
                    likelihood += np.bincount(doc, (np.log(total) + self._of.best[self._word[at]]) * self._count[at], len(docs))
                else:
                    got[doc[first]] += np.add.reduceat(p * (self._count[at] / total).astype(np.float32)[:, None], first, axis=0)
            if not last:
                share = (share * got / self.sizes[docs][:, None]).astype(np.float32)
        return share.astype(np.float64), likelihood


def predict(texts: list[str], langs: list[str], of: Likelihoods) -> tuple[list[str], np.ndarray]:
    """Language and score (its share within the chosen set) of each text.

    Sets grow by the next best language as long as the penalised likelihood gains.
    """
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not langs:
        return names, scores
    some = Texts(texts, of)
    n, docs = len(langs), np.arange(len(some.has))
    if not len(docs):
        return names, scores
    full, _ = some.fit(docs, np.ones((len(docs), n)))
    order = np.argsort(-full, axis=1, kind="stable")
    best_share, best = np.eye(n)[order[:, 0]], some.single(order[:, 0])
    for k in range(2, n + 1):
        docs = docs[full[docs, order[docs, k - 1]] >= LEAST_SHARE]
        if not len(docs):
            break
        allowed = np.zeros((len(docs), n))
        np.put_along_axis(allowed, order[docs, :k], 1.0, axis=1)
        got, total = some.fit(docs, allowed)
        total = total - PENALTY * (k - 1) * np.log(some.sizes[docs] + 1)
        better = total > best[docs]
        docs = docs[better]
        best[docs], best_share[docs] = total[better], got[better]
    for at, k in zip(some.has.tolist(), best_share.argmax(axis=1).tolist(), strict=True):
        names[at] = langs[k]
    scores[some.has] = np.clip(best_share.max(axis=1), 0, 1)
    return names, scores


def identify(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row of ``docs``.

    Learned from the rows of ``labelled(doc_id, text, lang)``.  ``und`` with score 0 if the text
    is null or has no letter, or if there is nothing to learn from.  Repeated rows come out
    repeatedly; ties go to the first language in order.  A task holds a table of 256 kB a language.
    """
    langs, model = learn(labelled)
    size = max(1 << 16, SLICE_BYTES * 8 // max(8, len(langs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Likelihoods(model)
        for batch in slices(batches, size=size):
            names, scores = predict(texts_of(batch), langs, of)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return docs_of(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    return identify(docs, docs.where(~held)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
