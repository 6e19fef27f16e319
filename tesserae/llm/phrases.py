"""Phrase collocations by dynamic itemset counting.

Documents are dealt into shards that are scanned in a cycle.  Words are counted from the first
step; a longer phrase becomes active at the step before which both phrases that are one word
shorter (its beginning and its end) had reached the threshold, is counted for one full cycle from
there, and is done.  Lengths are so counted side by side, and what can't be frequent never
travels.

What has reached the threshold is told by a filter of fixed size: cells that hold the first step
for which a key is set, three cells a key.  A key set by mistake only makes a phrase active that
needn't be.  Counts travel under 56-bit keys; phrases whose keys are frequent are counted once
more by their words, so that no figure of the result hangs on a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, deleted, short_batches, slices, staged, table
from .tokens import _bytes_of

#: Shards of a cycle.
SHARDS = 2
#: Cells of the filter: bytes that every worker holds.
CELL_BITS = 25
UNSET = 255
#: Bytes of text that are cut into words together, unless one text has more.
SLICE_BYTES = 4 << 20
#: Kinds of bytes after lower-casing: 0 of a word, 1 blank, 2 between pieces.
SMALL = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
KINDS = np.array([1 if b in b" \t" else 2 if b in b".,;:!?\n\x0b\x0c\r" else 0 for b in range(256)], np.uint8)
NEXT = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0xD6E8FEB86659FD93)
#: Low bits of a key: words of the phrase (3) and the step it is active from (5).
META = np.uint64(0xFF)
PARTS = 64
#: Exact up to a tenth of 38 digits: counts below 10^16.
SCORE = "(CAST(a AS DECIMAL(19, 0)) * CAST(a AS DECIMAL(19, 0)) * CAST(1000000 AS DECIMAL(7, 0))) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) & ~META


def cells_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The three cells of every key."""
    return np.stack([((keys | np.uint64(k + 1)) * NEXT) >> np.uint64(64 - bits) for k in range(3)]).astype(np.int64)


def times(cells: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The step from which keys are set, UNSET for keys that aren't."""
    bits = len(cells).bit_length() - 1
    out = np.zeros(len(keys), np.uint8)
    for k in range(3):
        np.maximum(out, cells[((keys | np.uint64(k + 1)) * NEXT) >> np.uint64(64 - bits)], out=out)
    return out


class Words:
    """The words of a slice of documents, in order.

    token: number of the word in its language; follows: if it follows the word before within a
    piece; names, langs, hashes: of every number.
    """

    def __init__(self, texts: pa.Array, langs: pa.Array) -> None:
        bounds, data = _bytes_of(pc.fill_null(texts.cast(pa.large_string()), ""))
        data = SMALL[data]
        kind = KINDS[data]
        solid = kind == 0
        heads = np.zeros(len(data), bool)
        heads[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        opens, closes = solid.copy(), solid.copy()
        opens[1:] &= ~solid[:-1] | heads[1:]
        closes[:-1] &= ~solid[1:] | heads[1:]
        starts = np.flatnonzero(opens)
        edges = np.append(0, np.cumsum(np.flatnonzero(closes) + 1 - starts))
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data[solid]))
        coded = words.dictionary_encode()
        doc = np.searchsorted(bounds, starts, "right") - 1
        breaks = np.searchsorted(np.flatnonzero(kind == 2), starts)
        self.follows = np.zeros(len(starts), bool)
        self.follows[1:] = (doc[1:] == doc[:-1]) & (breaks[1:] == breaks[:-1])
        spoken = pc.fill_null(langs.cast(pa.string()), "und").dictionary_encode()
        tongue = spoken.indices.to_numpy().astype(np.int64)[doc]
        size = max(1, len(coded.dictionary))
        both = tongue * size + coded.indices.to_numpy()
        seen = np.zeros(size * max(1, len(spoken.dictionary)), bool)
        seen[both] = True
        kinds = np.flatnonzero(seen)
        number = np.cumsum(seen) - 1
        self.token = number[both]
        self.names = coded.dictionary.take(pa.array(kinds % size))
        self.langs = spoken.dictionary.take(pa.array(kinds // size))
        self.hashes = mixed(_hashed(coded.dictionary)[kinds % size] + NEXT * _hashed(spoken.dictionary.cast(pa.large_string()))[kinds // size]) if len(kinds) else np.zeros(0, np.uint64)

    def ends(self, n: int) -> np.ndarray:
        """Places of the last words of all phrases of ``n`` words."""
        run = np.ones(len(self.token), bool)
        for k in range(n - 1):
            run[: k + 1] = False
            run[k + 1 :] &= self.follows[1 : len(run) - k] if k else self.follows[1:]
        return np.flatnonzero(run)

    def word_keys(self) -> np.ndarray:
        """Keys of all words by their number."""
        return mixed(NEXT + self.hashes)

    def keys(self, ends: np.ndarray, n: int) -> np.ndarray:
        """Keys of the phrases of ``n`` words that end at these places."""
        h = np.zeros(len(ends), np.uint64)
        for k in range(n - 1, -1, -1):
            h = (h + np.uint64(n)) * NEXT + self.hashes[self.token[ends - k]]
        return mixed(h)

    def phrases(self, ends: np.ndarray, n: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """Languages, spellings and counts of the distinct phrases that end at these places."""
        width = max(1, len(self.names).bit_length())
        parts = [self.token[ends - k] for k in range(n - 1, -1, -1)]
        if width * n < 63:  # the numbers of all words in one
            packed = parts[0]
            for more in parts[1:]:
                packed = packed << width | more
            packed, counts = np.unique(packed, return_counts=True)
            parts = [packed >> width * k & (1 << width) - 1 for k in range(n - 1, -1, -1)]
        else:
            ids = parts[0]
            for more in parts[1:]:  # numbers of distinct beginnings stay below the number of places
                ids = np.unique(ids, return_inverse=True)[1] * len(self.names) + more
            _, first, counts = np.unique(ids, return_index=True, return_counts=True)
            parts = [x[first] for x in parts]
        spelled = [self.names.take(pa.array(x)) for x in parts]
        return self.langs.take(pa.array(parts[-1])), spelled[0] if n == 1 else pc.binary_join_element_wise(*spelled, pa.scalar(" ", pa.large_string())), counts


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in slices(_gathered(batches), 1 << 30, 2 * SLICE_BYTES):
        yield Words(column(batch, "text"), column(batch, "lang"))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``SLICE_BYTES``: the more text at once, the fewer words and phrases are looked at twice."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= SLICE_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _hashed(words: pa.LargeStringArray) -> np.ndarray:
    """A polynomial of the bytes of every word."""
    bounds, data = _bytes_of(words)
    sizes = np.diff(bounds)
    powers = np.cumprod(np.full(int(sizes.max(initial=0)), BASE, np.uint64))
    terms = (data.astype(np.uint64) + np.uint64(1)) * powers[np.arange(len(data)) - np.repeat(bounds[:-1], sizes)]
    total = np.append(np.uint64(0), np.cumsum(terms, dtype=np.uint64))
    return total[bounds[1:]] - total[bounds[:-1]]


def _counted(shard: DataFrame, step: int, shards: int, filter_, max_words: int) -> DataFrame:
    """``key, c`` of the phrases that are active at ``step``, of one slice of documents after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = filter_.value
        for words in _cut(batches):
            single = words.word_keys()
            if step < shards and len(single):
                yield pa.RecordBatch.from_arrays([pa.array((single | np.uint64(1 << 5)).view(np.int64)), pa.array(np.bincount(words.token, minlength=len(single)))], names=["key", "c"])
            # from which step the phrase of n words that ends at a place is set
            known = times(cells, single)[words.token]
            for n in range(2, max_words + 1):
                since = np.full(len(words.token), UNSET, np.uint8)
                since[1:] = np.maximum(known[1:], known[:-1])
                ends = words.ends(n)
                ends = ends[since[ends] <= step]
                keys, own = words.keys(ends, n), since[ends]
                on = step < own.astype(np.int64) + shards
                found, c = np.unique(keys[on] | np.uint64(n << 5) | own[on].astype(np.uint64), return_counts=True)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(c)], names=["key", "c"])
                if n < max_words:  # not before it was active itself, should its cells be set by others
                    known = np.full(len(words.token), UNSET, np.uint8)
                    known[ends] = np.maximum(times(cells, keys), own + 1)

    return shard.mapInArrow(run, "key long, c long")


def _newly_set(keys: DataFrame, bits: int) -> np.ndarray:
    """True for the cells of all ``key``: a bit a cell reaches the driver at most, as 2 bytes a cell and part that holds it."""
    low = 16

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(cells_of(column(batch, "key").to_numpy().view(np.uint64) & ~META, bits))
            chunk, begin = np.unique(at >> low, return_index=True)
            lists = [x.astype("<u2").tobytes() for x in np.split(at & ((1 << low) - 1), begin[1:])] if len(at) else []
            yield pa.RecordBatch.from_arrays([pa.array(chunk), pa.array(lists, pa.binary())], names=["chunk", "at"])

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, at in zip(column(batch, "chunk").to_pylist(), column(batch, "at").to_pylist(), strict=True):
                bitmaps.setdefault(chunk, np.zeros(1 << low, bool))[np.frombuffer(at, "<u2")] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(bitmaps), pa.int64()), pa.array([np.packbits(b).tobytes() for b in bitmaps.values()], pa.binary())], names=["chunk", "at"])

    made = keys.mapInArrow(spread, "chunk long, at binary").repartition(8, "chunk").mapInArrow(united, "chunk long, at binary")
    out = np.zeros(1 << bits, bool)
    for row in made.collect():
        out[row.chunk << low : (row.chunk + 1) << low] = np.unpackbits(np.frombuffer(row.at, np.uint8)).astype(bool)
    return out


def phrase_counts(docs: DataFrame, least: int = 10, max_words: int = 3, shards: int = SHARDS, bits: int = CELL_BITS) -> DataFrame:
    """``lang, n, phrase, c`` of all phrases of 1 to ``max_words`` words that occur ``least`` times in a language, and all words of a language under the empty phrase of n = 0.

    Null text is empty, null lang is ``und``; every row counts, whatever its doc_id; of a very
    long text only the Arrow slice grows.  An empty table gives no rows.
    """
    if not (1 <= max_words <= 7 and shards >= 1 and max_words * shards < 31):
        raise ValueError("up to 7 words, and fewer than 31 steps")
    spark = docs.sparkSession
    rows = short_batches(docs).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard"))
    texts = staged(rows, "phrase-shards", "shard")
    cells = np.full(1 << bits, UNSET, np.uint8)
    left: DataFrame | None = None
    step, last = 0, 0  # last: the last step that phrases are active from
    while step < last + shards:
        filter_ = spark.sparkContext.broadcast(cells)
        counted = _counted(texts.where(F.col("shard") == step % shards).select("lang", "text"), step, shards, filter_, max_words)
        merged = (counted if left is None else counted.unionByName(left)).groupBy("key").agg(F.sum("c").alias("c"))
        done = (F.col("key").bitwiseAND(31) + shards - 1) <= step
        kept = staged(merged.where(~done | (F.col("c") >= least)), "phrase-step")
        new = _newly_set(kept.where(F.col("c") >= least).select("key"), bits) & (cells == UNSET)
        step += 1
        if new.any():
            cells[new] = step
            last = min(step, (max_words - 1) * shards)
        if left is not None:
            deleted(left)
        left = kept.where(~done)
        filter_.destroy()
    filter_ = spark.sparkContext.broadcast(cells)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "n", "phrase", "c"]
        for words in _cut(batches):
            total = pa.table({"lang": words.langs.take(pa.array(words.token))}).group_by("lang").aggregate([([], "count_all")])
            for lang, c in zip(total["lang"].to_pylist(), total["count_all"].to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([0], pa.int32()), pa.array([""], pa.large_string()), pa.array([c], pa.int64())], names=names)
            known = (times(filter_.value, words.word_keys()) < UNSET)[words.token]
            for n in range(1, max_words + 1):
                ends = words.ends(n)
                ends = ends[known[ends]] if n == 1 else ends[known[ends] & known[ends - 1]]  # whose beginning and end are frequent
                if n > 1:
                    ends = ends[times(filter_.value, words.keys(ends, n)) < UNSET]
                    known = np.zeros(len(words.token), bool)
                    known[ends] = True
                if len(ends):
                    langs, spelled, c = words.phrases(ends, n)
                    yield pa.RecordBatch.from_arrays([langs, pa.array(np.full(len(c), n, np.int32)), spelled, pa.array(c)], names=names)

    out = texts.select("lang", "text").mapInArrow(exact, "lang string, n int, phrase string, c long").groupBy("lang", "n", "phrase").agg(F.sum("c").alias("c"))
    counts = staged(out.where((F.col("n") == 0) | (F.col("c") >= least)), "phrases")
    filter_.destroy()
    deleted(left)
    deleted(texts)
    return counts


def _part(first: Column | int, words: Column) -> Column:
    return F.array_join(F.slice("w", first, words), " ")


def collocations(docs: DataFrame, least: int = 10, max_words: int = 3, share: int = 50, top: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language.

    a, l and r: how often the phrase and the two parts of its lowest-scoring cut occur; n: words
    of the language.  Phrases of two words and more go that lie in a longer one with at least
    ``share`` percent of their occurrences.  Scores are integers: a million times a * a / (l * r),
    floored, in decimals of 38 digits.  What is empty or null is as in ``phrase_counts``.
    """
    counts = phrase_counts(docs, least, max_words)
    frequent = counts.where("n > 0").select("lang", "n", "phrase", "c")
    longer = frequent.where("n > 1").select("lang", "phrase", F.col("c").alias("a"), "n", F.split("phrase", " ").alias("w"))
    within = longer.where("n > 2").select("lang", "a", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("n") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("n") - m + 1), lambda i: _part(i, m))))).alias("phrase"))
    held = within.groupBy("lang", "phrase").agg(F.max("a").alias("held"))
    kept = longer.join(held, ["lang", "phrase"], "left").where(F.col("held").isNull() | (100 * F.col("held") < share * F.col("a")))
    cuts = kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"), "w", "n")
    parts = cuts.select("lang", "phrase", "a", "k", F.explode(F.array(F.struct(F.lit("l").alias("side"), _part(1, F.col("k")).alias("part")), F.struct(F.lit("r").alias("side"), _part(F.col("k") + 1, F.col("n") - F.col("k")).alias("part")))).alias("p"))
    rated = parts.select("lang", "phrase", "a", "k", "p.side", F.col("p.part").alias("part")).join(frequent.select("lang", F.col("phrase").alias("part"), "c"), ["lang", "part"])
    sides = rated.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == "l", F.col("c"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("c"))).alias("r"))
    scored = sides.withColumn("score", F.expr(SCORE))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    # the first of each part of a language, then of the language: no task sorts all of its phrases
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("at", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("at") <= top)
    first = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("n = 0").select("lang", F.col("c").alias("n"))  # a row a language
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents
), cut AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
f1 AS (SELECT lang, w1, count(*) AS f FROM (SELECT lang, unnest(w) AS w1 FROM cut) GROUP BY ALL),
f2 AS (SELECT lang, z[1] AS w1, z[2] AS w2, count(*) AS f FROM (SELECT lang, unnest(list_zip(w[:-2], w[2:])) AS z FROM cut WHERE len(w) > 1) GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, z[1] AS w1, z[2] AS w2, z[3] AS w3, count(*) AS f FROM (SELECT lang, unnest(list_zip(w[:-3], w[2:-2], w[3:])) AS z FROM cut WHERE len(w) > 2) GROUP BY ALL HAVING count(*) >= 10),
cand AS (
  SELECT p.lang, p.w1 || ' ' || p.w2 AS phrase, p.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM f2 p JOIN f1 x ON x.lang = p.lang AND x.w1 = p.w1 JOIN f1 y ON y.lang = p.lang AND y.w1 = p.w2
  WHERE NOT EXISTS (SELECT 1 FROM f3 t WHERE t.lang = p.lang AND (t.w1 = p.w1 AND t.w2 = p.w2 OR t.w2 = p.w1 AND t.w3 = p.w2) AND 100 * t.f >= 50 * p.f)
  UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 1, x.f, y.f
  FROM f3 t JOIN f1 x ON x.lang = t.lang AND x.w1 = t.w1 JOIN f2 y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 2, x.f, y.f
  FROM f3 t JOIN f2 x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN f1 y ON y.lang = t.lang AND y.w1 = t.w3
), scored AS (
  SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cand
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS c FROM scored
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE c = 1
)
SELECT lang, rank, phrase, a, l, r, (SELECT CAST(sum(f) AS BIGINT) FROM f1 WHERE f1.lang = ranked.lang) AS n, score FROM ranked WHERE rank <= 2000
"""
