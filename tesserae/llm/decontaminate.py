"""Benchmark decontamination by a BM25 inverted index of test items with block-max WAND.

Every window of every document is a query against an index of the test items; an item's score
is measured in shares of what the item scores for itself, so that one threshold holds for all.

* Postings are sorted by item; each term has its largest share over all items and over every
  block of items.
* A first bound adds up, for all windows of a slice at once, the terms' largest shares within
  coarse regions of items.  A window under the threshold in a region has no pivot there.
* Where the bound passes, block-max WAND runs over the region: cursors in item order, a pivot
  where the terms' upper bounds reach the threshold, a look at the pivot's block before any
  scoring, and a skip to the end of the block if that cannot reach it.

All items above the threshold are retrieved (no top-k), then verified: the document must hold
enough of the item's question and of its answer as word 5-grams.  Document frequencies and the
mean length are those of all items, however many of them are indexed at a time.
"""

from __future__ import annotations

import uuid
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_slices, column, docs_of, short_batches, slices, staged, table, texts_of

WORDS = regex.compile(r"\w+")
K1, B = 1.2, 0.75
#: Items of a block, and regions (of whole blocks) that the items are cut into.
BLOCK_ITEMS = 4
REGIONS = 64
#: Items that are indexed, and sent to the tasks, at a time (about a kilobyte each).
CHUNK_ITEMS = 20_000
#: Items shorter than this part of the longest have windows of their own.
LENGTH_CLASS = 8
#: A window must reach this share of the score of the item itself.
SCORE_SHARE = 0.6
#: Share of the question's and of the answer's word 5-grams that the document must hold.
OVERLAP = 0.8
NGRAM = 5
#: Slack of the bounds for sums of 32-bit floats.
ROUNDING = 1e-4


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def grams(words: list[str], n: int = NGRAM) -> list[tuple[str, ...]]:
    """The n-grams of a word list; of a shorter one the list as a whole."""
    return [tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))] if words else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of an item before its last sentence or line, and words of that last part.

    An item of one part is all question; a last part under ``NGRAM`` words takes words before it
    along, so that the answer is as telling as a gram of the question.
    """
    parts = [p for p in map(words_of, regex.split(r"(?<=[.!?])\s+|\n+", text)) if p]
    words = [w for p in parts for w in p]
    if len(parts) < 2:
        return words, []
    cut = len(words) - max(len(parts[-1]), NGRAM)
    return (words[:cut], words[cut:]) if cut >= NGRAM else (words, [])


class Statistics:
    """What BM25 knows of all items: how many, their mean length, and in how many a word is."""

    def __init__(self, n: int, mean_length: float, df: dict[str, int]) -> None:
        self.n, self.mean_length, self.df = n, mean_length, df

    @staticmethod
    def of(split: list[list[str]]) -> Statistics:
        df = Counter(w for words in split for w in set(words))
        return Statistics(len(split), sum(map(len, split)) / max(1, len(split)), df)

    def idf(self, word: str) -> float:
        df = self.df[word]
        return float(np.log(1 + (self.n - df + 0.5) / (df + 0.5)))


class Index:
    """Postings of items of similar length with term, region and block maxima, all in shares of an item's own score."""

    def __init__(self, items: list[tuple[int, str]], known: Statistics) -> None:
        items = sorted(items, key=lambda x: (len(words_of(x[1])), x))
        split = [words_of(t) for _, t in items]
        self.ids = np.array([i for i, _ in items], np.int64)
        self.texts = [t for _, t in items]
        self.longest = max((len(w) for w in split), default=1)
        self.terms: dict[str, int] = {}
        term, item, weight = [], [], []
        for k, words in enumerate(split):
            norm = K1 * (1 - B + B * len(words) / max(1.0, known.mean_length))
            own = {w: known.idf(w) * c * (K1 + 1) / (c + norm) for w, c in Counter(words).items()}
            total = sum(own.values())
            for w, x in own.items():
                term.append(self.terms.setdefault(w, len(self.terms)))
                item.append(k)
                weight.append(x / total)
        t, d, share = np.array(term, np.int64), np.array(item, np.int64), np.array(weight, np.float64)
        order = np.lexsort((d, t))
        t, d, share = t[order], d[order], share[order]
        size = len(self.terms)
        self.start = array("q", np.searchsorted(t, np.arange(size + 1)).tolist())
        self.item, self.share = array("i", d.tolist()), array("d", share.tolist())
        most = np.zeros(size)
        np.maximum.at(most, t, share)
        self.most = array("d", most.tolist())
        first = np.concatenate(([True], (np.diff(t) != 0) | (np.diff(d // BLOCK_ITEMS) != 0))) if len(t) else np.zeros(0, bool)
        at = np.flatnonzero(first)
        self.block_start = array("q", np.searchsorted(t[at], np.arange(size + 1)).tolist())
        self.block = array("i", (d[at] // BLOCK_ITEMS).tolist())
        self.block_most = array("d", np.maximum.reduceat(share, at).tolist() if len(at) else [])
        blocks = -(-len(items) // BLOCK_ITEMS)
        self.region_items = BLOCK_ITEMS * max(1, -(-blocks // REGIONS))
        self.region_most = np.zeros((size + 1, -(-len(items) // self.region_items)), np.float32)  # the last row: unknown words
        np.maximum.at(self.region_most, (t, d // self.region_items), share.astype(np.float32))
        self._wanted: dict[int, tuple[set, set]] = {}

    def wanted(self, item: int) -> tuple[set, set]:
        """Grams of an item's question and answer."""
        if item not in self._wanted:
            q, a = question_and_answer(self.texts[item])
            self._wanted[item] = set(grams(q)), set(grams(a))
        return self._wanted[item]


def wand(terms: list[int], index: Index, low: int, high: int, least: float) -> list[tuple[int, float]]:
    """Items from ``low`` to below ``high`` that share at least ``least`` of their score with the terms, by block-max WAND."""
    item, most = index.item, index.most
    cursors = []  # [current item, term, place of its posting]
    for t in terms:
        at = bisect_left(item, low, index.start[t], index.start[t + 1])
        if at < index.start[t + 1] and item[at] < high:
            cursors.append([item[at], t, at])
    found = []

    def advance(some: list[list[int]], to: int) -> None:
        for c in some:
            end = index.start[c[1] + 1]
            c[2] = bisect_left(item, to, c[2], end)
            c[0] = item[c[2]] if c[2] < end else high

    while True:
        cursors = sorted(c for c in cursors if c[0] < high)
        bound = 0.0
        for pivot_at, c in enumerate(cursors):
            bound += most[c[1]]
            if bound >= least:
                break
        else:
            return found
        pivot = cursors[pivot_at][0]
        while pivot_at + 1 < len(cursors) and cursors[pivot_at + 1][0] == pivot:
            pivot_at += 1
        reach = cursors[: pivot_at + 1]
        block, bound = pivot // BLOCK_ITEMS, 0.0
        for _, t, _ in reach:
            at = bisect_left(index.block, block, index.block_start[t], index.block_start[t + 1])
            if at < index.block_start[t + 1] and index.block[at] == block:
                bound += index.block_most[at]
        if bound < least:  # nothing in this block, as long as no further term joins in
            after = cursors[pivot_at + 1][0] if pivot_at + 1 < len(cursors) else high
            advance(reach, min((block + 1) * BLOCK_ITEMS, after))
        elif cursors[0][0] == pivot:
            score = sum(index.share[c[2]] for c in reach)
            if score >= least:
                found.append((pivot, score))
            advance(reach, pivot + 1)
        else:
            advance([c for c in reach if c[0] < pivot], pivot)


#: Tokens whose region maxima are added up at a time.
BOUND_ROWS = 100_000


def occurrences(ids: np.ndarray, sizes: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of documents as (window numbers, terms), and each window's document.

    Windows are twice the longest item and half a window apart, so that any item lies whole in
    one.  A term counts once in a window; words that no item has are left out.
    """
    step = max(16, index.longest)
    per = np.maximum(1, -(-(sizes - step) // step))
    first = np.cumsum(per) - per
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    known = np.flatnonzero(ids < len(index.terms))
    doc, at, term = doc[known], at[known], ids[known]
    key = doc * (len(index.terms) + 1) + term
    order = np.argsort(key, kind="stable")
    before = np.full(len(at), -1)
    same = np.flatnonzero(key[order][1:] == key[order][:-1]) + 1
    before[order[same]] = at[order[same - 1]]
    found_w, found_t = [], []
    for k in (at // step, at // step - 1):
        fits = (k >= 0) & (k < per[doc]) & (before < k * step)
        found_w.append((first[doc] + k)[fits])
        found_t.append(term[fits])
    w, t = np.concatenate(found_w), np.concatenate(found_t)
    order = np.argsort(w, kind="stable")
    return w[order], t[order], np.repeat(np.arange(len(sizes)), per)


def matches(split: list[list[str]], index: Index) -> list[tuple[int, int, float, float, float]]:
    """Verified items of documents: (document, item number, best score share, question and answer overlap)."""
    get, unknown = index.terms.get, len(index.terms)
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    ids = np.fromiter((get(w, unknown) for words in split for w in words), np.int64, int(sizes.sum()))
    w, t, doc_of = occurrences(ids, sizes, index)
    best: dict[tuple[int, int], float] = {}
    cuts = np.flatnonzero(np.diff(w, prepend=-1))
    ends = np.append(cuts[1:], len(w))
    lo, least = 0, SCORE_SHARE - ROUNDING
    while lo < len(cuts):
        hi = max(lo + 1, int(np.searchsorted(ends, cuts[lo] + BOUND_ROWS, "right")))
        a, b = cuts[lo], ends[hi - 1]
        bound = np.add.reduceat(index.region_most[t[a:b]], cuts[lo:hi] - a, axis=0)
        for k, region in zip(*(x.tolist() for x in np.nonzero(bound >= least - ROUNDING)), strict=True):
            doc = int(doc_of[w[cuts[lo + k]]])
            first = region * index.region_items
            for item, score in wand(t[cuts[lo + k] : ends[lo + k]].tolist(), index, first, min(first + index.region_items, len(index.ids)), least):
                best[doc, item] = max(best.get((doc, item), 0.0), score)
        lo = hi
    out, held = [], (-1, {})
    for doc, item in sorted(best):
        if held[0] != doc:
            held = doc, {}
        q, a = (_share(want, split[doc], held[1]) for want in index.wanted(item))
        if q >= OVERLAP and a >= OVERLAP:
            out.append((doc, item, best[doc, item], q, a))
    return out


def _share(want: set[tuple[str, ...]], words: list[str], held: dict[int, set]) -> float:
    """Share of the wanted grams that the words hold; ``held`` keeps the words' grams by length."""
    if not want:
        return 1.0
    n = len(next(iter(want)))
    if n not in held:
        held[n] = set(zip(*(words[k:] for k in range(n)), strict=False))
    return len(want & held[n]) / len(want)


FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


class Items:
    """A part of the items and what is known of all, sent to the tasks; every worker builds the indexes once."""

    built: dict[str, list[Index]] = {}

    def __init__(self, rows: list[tuple[int, str]], known: Statistics) -> None:
        self.key, self.rows, self.known = uuid.uuid4().hex, rows, known

    def indexes(self) -> list[Index]:
        """An index for each class of lengths: windows follow the longest item of an index."""
        if self.key not in Items.built:
            Items.built.clear()
            by_class: dict[int, list[tuple[int, str]]] = {}
            sizes = [len(words_of(t)) for _, t in self.rows]
            for row, n in zip(self.rows, sizes, strict=True):
                size, k = max(sizes), 0
                while n * LENGTH_CLASS <= size:
                    size, k = size // LENGTH_CLASS, k + 1
                by_class.setdefault(k, []).append(row)
            Items.built[self.key] = [Index(some, self.known) for _, some in sorted(by_class.items())]
        return Items.built[self.key]

    def find(self, texts: list[str]) -> list[tuple[int, int, float, float, float]]:
        """(text, item_id, score, question and answer overlap)."""
        split = [words_of(t) for t in texts]
        return sorted((doc, int(index.ids[m]), score, q, a) for index in self.indexes() for doc, m, score, q, a in matches(split, index))


def _parts(items: DataFrame, chunk_items: int) -> Iterator[Items]:
    """The stated items, about ``chunk_items`` at a time, with the statistics of all."""
    stated = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    parts = max(1, -(-stated.count() // chunk_items))
    if parts == 1:
        rows = [(r.item_id, r.text) for r in stated.collect() if words_of(r.text)]  # chunk_items at most
        yield Items(sorted(rows), Statistics.of([words_of(t) for _, t in rows]))
        return

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, w, len(words)) for p, words in zip(column(batch, "part").to_pylist(), map(words_of, texts_of(batch)), strict=True) for w in [*set(words), *[None] * bool(words)]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.int64()), strict=True)], names=["part", "word", "n"])

    dealt = staged(stated.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int")), "items", "part")
    words = staged(dealt.select("part", "text").mapInArrow(count, "part int, word string, n long"), "item-words")  # one row without a word an item
    n, mean = words.where("word is null").agg(F.count("*"), F.coalesce(F.avg("n"), F.lit(0.0))).first()
    df = staged(words.where("word is not null").groupBy("word").agg(F.count("*").alias("df")), "item-frequencies")
    for k in range(parts):
        own = df.join(words.where((F.col("part") == k) & F.col("word").isNotNull()).select("word").distinct(), "word").collect()  # words of about chunk_items
        rows = [(r.item_id, r.text) for r in dealt.where(F.col("part") == k).collect() if words_of(r.text)]
        yield Items(sorted(rows), Statistics(n, mean, {r.word: r.df for r in own}))


def contaminated(docs: DataFrame, items: DataFrame, chunk_items: int = CHUNK_ITEMS) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap`` of every document that holds an item.

    ``items(item_id, text)`` is a stated query set: it is indexed ``chunk_items`` at a time, and
    each index, whose size that bounds, goes over all documents; scores don't depend on it.
    Items without words (null, empty) match nothing, nor do documents without words.  Repeated
    rows of documents and of items are found repeatedly; rows without a doc_id are found too.
    """

    def found_by(part: Items) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                names = column(batch, "doc_id").to_pylist()
                out = [(names[doc], *rest) for doc, *rest in part.find(texts_of(batch))]
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in FOUND.split(", ")])

        return docs_of(docs).mapInArrow(run, FOUND)

    parts = _parts(items, chunk_items)
    first, second = next(parts), next(parts, None)
    if second is None:
        return found_by(first)
    found = docs.sparkSession.createDataFrame([], FOUND)
    for part in chain((first, second), parts):  # written one by one: the driver holds few parts at a time
        found = found.unionByName(staged(found_by(part), "found-items"))
    return found


def without_items(docs: DataFrame, items: DataFrame, chunk_items: int = CHUNK_ITEMS) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, whatever their other columns; no row is shuffled."""

    def holds(part: Items):
        @F.arrow_udf("boolean")
        def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for some in texts:
                out: list[bool] = []
                for own in by_slices(some):
                    held = {doc for doc, *_ in part.find(own)}
                    out += [k in held for k in range(len(own))]
                yield pa.array(out, pa.bool_())

        return run

    for part in _parts(items, chunk_items):
        docs = short_batches(docs).where(~holds(part)(F.col("text").cast("string")))
    return docs


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
