"""Packing documents into fixed windows by non-negative least squares on the length histogram.

Documents give whole windows and one remainder each.  Shallow combinations of remainders that
fill a window exactly are columns of a least-squares problem, the histogram of remainders is
its target.  The columns are enumerated by price: for every length, the combination with it
that the unexplained histogram values most (a knapsack over the window, a few pieces deep).
Repeat counts are solved over those columns, new columns are priced against what is left over,
and so on; the counts are rounded, and what rounding leaves is solved again.  The residuals
that no combination fills any more are packed greedily: end to end, the longest first, with
one cut at each window's end.

Only the histogram (fewer bins than the window) and the plan made from it meet the driver;
documents find their place by their rank among equal remainders, with prefix sums over tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, docs_of, slices, staged, table
from .tokens import encoder, packed, unpacked

SEED = 611
#: Rounds of pricing new columns in the first solution, and in those of what rounding left.
STEPS, LATER_STEPS = 60, 8
#: Gradient steps after each round of pricing.
ROUNDS = 40
#: A repeat count whose fraction reaches this is rounded up as long as there are documents.
LEAST_FRACTION = 0.05
#: Rows that are tokenised together at most: the more, the fewer units are looked up.
SLICE_ROWS = 4096
#: Cut remainders up to which they are broadcast to find their ids; beyond, both sides are shuffled.
FEW_CUTS = 100_000


def depth_of(counts: np.ndarray) -> int:
    """Pieces of a combination at most: one more than windows take of mean remainders."""
    n = int(counts.sum())
    mean = float((counts * np.arange(len(counts))).sum()) / max(1, n)
    return int(max(3, np.ceil(len(counts) / max(1.0, mean)) + 1))


def combinations_of(value: np.ndarray, depth: int) -> np.ndarray:
    """For every present length, the combination with it of up to ``depth`` lengths that fills the window and is worth most.

    value[k]: what a piece of length k is worth, minus infinity if there is none.  A row has the
    lengths in descending order and zeros behind them.
    """
    window = len(value)
    worth = np.full(2 * window + 1, -np.inf, np.float32)
    worth[window] = 0  # worth[window + t]: the best of up to so many pieces that sum up to t
    v = value.astype(np.float32)
    picks = []
    for _ in range(depth - 1):
        total = as_strided(worth[window:], (window + 1, window), (worth.strides[0], -worth.strides[0])) + v
        pick = total.argmax(axis=1)
        best = total[np.arange(window + 1), pick]
        none = worth[window:] >= best
        pick[none] = 0
        worth[window:] = np.where(none, worth[window:], best)
        picks.append(pick)
    have = np.flatnonzero(np.isfinite(v))
    rows = np.zeros((len(have), depth), np.int64)
    rows[:, 0] = have
    rest = window - have
    reached = np.isfinite(worth[window + rest])
    for k in range(depth - 2, -1, -1):
        rows[:, depth - 1 - k] = picks[k][rest]
        rest = rest - rows[:, depth - 1 - k]
    return np.sort(rows[reached & (rest == 0)], axis=1)[:, ::-1]


def affordable(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The combinations that need no more documents of a length than there are."""
    run, fits = np.ones(len(rows), np.int64), np.ones(len(rows), bool)
    for k in range(1, rows.shape[1]):
        run = np.where(rows[:, k] == rows[:, k - 1], run + 1, 1)
        fits &= (rows[:, k] == 0) | (run <= counts[rows[:, k]])
    return rows[fits]


def least_squares(rows: np.ndarray, counts: np.ndarray, x: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Repeat counts x >= 0 that bring the combinations' use of lengths nearest to the histogram, and what stays unexplained.

    Accelerated projected gradient from the given x; a combination touches few bins.
    """
    n = len(counts)
    k, at = np.repeat(np.arange(len(rows)), rows.shape[1]), rows.ravel()
    k, at = k[at > 0], at[at > 0]

    def use(z: np.ndarray) -> np.ndarray:
        return np.bincount(at, weights=z[k], minlength=n)

    def back(r: np.ndarray) -> np.ndarray:
        return np.bincount(k, weights=r[at], minlength=len(rows))

    v, bound = np.ones(len(rows)), 1.0
    for _ in range(8):  # largest eigenvalue by power iteration
        v = back(use(v))
        bound = np.linalg.norm(v)
        v /= bound
    step = 1 / (1.1 * bound)
    y, t = x, 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(use(y) - counts))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x, counts - use(x)


def solve(counts: np.ndarray, steps: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Combinations and their repeat counts, columns added by price."""
    rows, x = np.zeros((0, depth_of(counts)), np.int64), np.zeros(0)
    open_ = counts.astype(float)
    for _ in range(steps):
        # a little noise, so that lengths of equal value don't all ask for the same partners
        value = open_ + rng.normal(size=len(counts)) * 0.3 * np.abs(open_).mean()
        new = affordable(combinations_of(np.where(counts > 0, value, -np.inf), rows.shape[1]), counts)
        rows, first = np.unique(np.concatenate((rows[x > 0], new)), axis=0, return_index=True)
        x = np.concatenate((x[x > 0], np.zeros(len(new))))[first]
        if not len(rows):
            break
        x, open_ = least_squares(rows, counts.astype(float), x)
    return rows, x


def plan(counts: np.ndarray) -> tuple[list[tuple[int, int, int, int]], np.ndarray, int]:
    """Where the documents of each remainder go: slots, the residual histogram, and the next sequence.

    counts[k]: documents with remainder k, below the window.  A slot (length, first rank, first
    sequence, offset) holds up to the next one of its length: ranks follow each other from
    sequence to sequence.  What the slots leave out is the residual, the highest ranks.
    """
    left = counts.copy()
    left[0] = 0
    rng = np.random.default_rng(SEED)
    done: list[tuple[np.ndarray, int]] = []
    steps = STEPS
    while left.any():
        rows, x = solve(left, steps, rng)
        steps = LATER_STEPS
        before = len(done)
        order = np.argsort(-x, kind="stable").tolist()
        for up in (False, True):  # whole counts of all combinations first
            for k in order:
                wanted = int(x[k] % 1 >= LEAST_FRACTION) if up else int(x[k])
                if wanted:
                    lengths, m = np.unique(rows[k][rows[k] > 0], return_counts=True)
                    take = min(wanted, int((left[lengths] // m).min()))
                    if take:
                        left[lengths] -= take * m
                        done.append((rows[k], take))
        if len(done) == before:
            break
    slots: list[tuple[int, int, int, int]] = []
    rank = np.zeros(len(counts), np.int64)
    sequence = 0
    for lengths, take in done:
        offset = 0
        for length in lengths[lengths > 0].tolist():
            slots.append((length, int(rank[length]), sequence, offset))
            rank[length] += take
            offset += length
        sequence += take
    return slots, left, sequence


SCHEMA = "doc_id long, part int, row int, n long, rest int, rest_rank int, windows_before long, crcs array<long>, rest_crc long, ids binary"


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, led: bool, window: int) -> DataFrame:
    """Ids of every document with checksums of its whole windows and its remainder.

    part, row name a row; rest_rank counts equal remainders, windows_before whole windows,
    within the task.  A task that runs again reads the same rows and gives the same numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = encoder(tokenizer, end_id, led)
        wide = enc.vocabulary > 1 << 16
        seen = np.zeros(window, np.int64)
        row = windows = 0
        for batch in slices(batches, SLICE_ROWS):
            ids, counts = enc.encode(column(batch, "text"))
            out: list[tuple] = []
            at = 0
            for n in counts.tolist():
                own = ids[at : at + n].astype("<u4")
                at += n
                whole, rest = divmod(n, window)
                crcs = [zlib.crc32(own[k * window : (k + 1) * window].tobytes()) for k in range(whole)]
                out.append((part, row, n, rest, int(seen[rest]), windows, crcs, zlib.crc32(own[whole * window :].tobytes()), packed(own, wide)))
                seen[rest] += 1
                row += 1
                windows += whole
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *columns], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs_of(docs).mapInArrow(run, SCHEMA)


def pack(docs: DataFrame, tokenizer: str, end_id: int, led: bool = True, window: int = 2048) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Every id of a document, the end id included, is in one piece.  Whole windows are sequences
    of their own (odd ids), combinations and the end-to-end stream of residuals have even ids;
    only the last sequence of the stream can be short.  Null text is empty (the end id alone);
    rows without a doc_id and repeated rows are documents of their own; an empty table gives an
    empty table.
    """
    wide = encoder(tokenizer, end_id, led).vocabulary > 1 << 16
    tokens = staged(tokenised(docs, tokenizer, end_id, led, window), "packing-tokens")
    narrow = tokens.drop("ids")
    counts = np.zeros(window, np.int64)
    for r in narrow.where("rest > 0").groupBy("rest").count().collect():  # fewer rows than the window
        counts[r["rest"]] = r["count"]
    slots, residual, stream = plan(counts)
    # whole windows of the tasks before; ranks of equal remainders of the tasks before
    whole = narrow.select(
        "doc_id", "n", F.posexplode("crcs").alias("k", "crc"), "part", "windows_before"
    ).select(
        "doc_id", (F.col("k").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"),
        ((F.shiftleft(F.col("part").cast("long"), 40) + F.col("windows_before") + F.col("k")) * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    ends = narrow.where("rest > 0")
    tasks = ends.groupBy("part", "rest").agg(F.count("*").alias("m"))
    before = tasks.select("part", "rest", (F.sum("m").over(W.partitionBy("rest").orderBy("part")) - F.col("m")).alias("before"))
    ranked = ends.join(before, ["part", "rest"]).select("doc_id", "part", "row", "n", "rest", "rest_crc", (F.col("before") + F.col("rest_rank")).alias("rank"))
    placed = ranked.mapInArrow(_placing(slots, residual, counts, stream), PLACED)
    kept = placed.where(F.col("offset") + F.col("rest") <= window).select(
        "doc_id", (F.col("n") - F.col("rest")).alias("start"), F.col("rest").cast("long").alias("length"), F.col("rest_crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", "offset"
    )
    cut = placed.where(F.col("offset") + F.col("rest") > window).select("part", "row", "sequence_id", "offset")
    if residual.sum() <= FEW_CUTS:
        cut = F.broadcast(cut)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                ids, first = unpacked(r["ids"], wide), window - r["offset"]
                begin = r["n"] - r["rest"]
                for start, stop, seq, off in ((begin, begin + first, r["sequence_id"], r["offset"]), (begin + first, r["n"], r["sequence_id"] + 2, 0)):
                    out.append((r["doc_id"], start, stop - start, zlib.crc32(ids[start:stop].tobytes()), r["n"], seq, off))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=PIECES)

    halves = tokens.join(cut, ["part", "row"]).select("doc_id", "n", "rest", "sequence_id", "offset", "ids").mapInArrow(split, ", ".join(f"{c} long" for c in PIECES))
    return whole.unionByName(kept).unionByName(halves)


PLACED = "doc_id long, part int, row int, n long, rest int, rest_crc long, sequence_id long, offset long"


def _placing(slots: list[tuple[int, int, int, int]], residual: np.ndarray, counts: np.ndarray, stream: int):
    """A map from ranked remainders to sequences and offsets.

    What travels to the tasks is the plan: its size follows the window, not the documents.
    """
    window = len(counts)
    span = int(counts.max(initial=0)) + 1
    lengths = np.flatnonzero(residual)[::-1]  # the longest first, end to end
    places = np.cumsum(lengths * residual[lengths]) - lengths * residual[lengths]
    rows = [(length, first, seq, off) for length, first, seq, off in slots]
    rows += [(int(x), int(counts[x] - residual[x]), int(p), -1) for x, p in zip(lengths, places, strict=True)]
    rows.sort()
    length, first, seq, off = np.array(rows, np.int64).reshape(-1, 4).T.copy()
    keys = length * span + first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest, rank = (column(batch, c).to_numpy().astype(np.int64) for c in ("rest", "rank"))
            k = np.searchsorted(keys, rest * span + rank, "right") - 1
            later = rank - first[k]
            at = seq[k] + later * rest  # in the stream
            streamed = off[k] < 0
            sequence = np.where(streamed, stream + at // window, seq[k] + later) * 2
            offset = np.where(streamed, at % window, off[k])
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("doc_id", "part", "row", "n", "rest", "rest_crc")), pa.array(sequence), pa.array(offset)], names=[c.split()[0] for c in PLACED.split(", ")])

    return run


PIECES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1)
