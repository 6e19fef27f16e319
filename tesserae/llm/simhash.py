"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints differ in at most ``2h`` bits exactly when some variant lies within
``h`` bits of both.  Every distinct fingerprint therefore sends out all variants within half
the radius; variants that meet name a pair.  What travels is not a row per variant: variants
are shuffled by their leading ``prefix`` bits, and all variants of one fingerprint that share
a prefix go as one row and are written out at the receiving task.

* Copies collapse before: only distinct fingerprints send variants.
* Fingerprints that share a variant are pairwise within the radius, so linking each to the
  smallest of those that meet keeps the components; no group is expanded into pairs.
* A prefix where more than ``HOT_VARIANTS`` meet (a ball of near copies) is written out as a row
  per variant.  These meet by a minimum per variant, combined before the shuffle, and a
  join back that adaptive execution may split: no task holds a whole ball.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, docs_of, slices, staged, table, texts_of
from .components import connected_components

SEED = 42
#: Parity classes of a variant: code of bit ``i`` is odd-multiplied ``i`` in six bits.
CLASSES = 64
CODES = np.array([(i * 37 + 11) % CLASSES for i in range(64)], dtype=np.uint64)
#: Fingerprints that share a prefix on average, and variants that may meet at one in a task (some
#: ten times the average); the variants of a fuller one are shuffled themselves.
PER_PREFIX = 1_000
HOT_VARIANTS = 20_000_000
#: Variants that a task sorts at a time, and writes out at a time.
SORT_ROWS = 2_000_000


def fingerprint(text: str, width: int = 4) -> int:
    """SimHash of the ``width``-word shingles of a text, repeats included; no words: zero."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        parts = [joined]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        ends = starts + lengths
        parts = [joined[a:b] for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts))
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long); null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t, width) for t in texts_of(batch)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return docs_of(docs).mapInArrow(run, "doc_id long, fp long")


@lru_cache(maxsize=64)
def _masks(bits: int, flips: int) -> np.ndarray:
    """All masks of up to ``flips`` of the low ``bits`` bits."""
    return np.array([sum(1 << i for i in c) for k in range(flips + 1) for c in combinations(range(bits), k)], dtype=np.uint64)


@lru_cache(maxsize=64)
def _masks_by_class(bits: int, flips: int) -> list[np.ndarray]:
    masks = _masks(bits, flips)
    of = _parity(masks)
    return [masks[of == np.uint64(c)] for c in range(CLASSES)]


def _parity(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), np.uint64)
    for i in range(64):
        out ^= ((values >> np.uint64(i)) & np.uint64(1)) * CODES[i]
    return out


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable by the links a-b among n items."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        was = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (was == label).all():
            break
    return label


def meet(base: np.ndarray, left: np.ndarray, fps: np.ndarray, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints whose variants meet at one prefix.

    base: the fingerprints with that prefix put in; left: flips still free in the low ``bits``.
    ``fps`` must be sorted.  Returns the linked fingerprints and the smallest one reachable here.
    """
    links: list[np.ndarray] = []
    n = len(fps)

    def close(variants: list[np.ndarray], owners: list[np.ndarray]) -> None:
        v, o = np.concatenate(variants), np.concatenate(owners)
        order = np.argsort(v, kind="stable")
        v, o = v[order], o[order]
        same = np.flatnonzero(v[1:] == v[:-1]) + 1
        if not len(same):
            return
        first = np.concatenate(([True], v[1:] != v[:-1]))
        starts = np.flatnonzero(first)
        least = np.minimum.reduceat(o, starts)[np.cumsum(first)[same] - 1].astype(np.int64)
        for end in (o[same], o[same - 1]):
            pair = np.unique(least * n + end)
            links.append(pair[pair // n != pair % n])

    variants: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    kinds = [(int(k), np.flatnonzero(left == k)) for k in np.unique(left)]
    if sum(len(at) * len(_masks(bits, k)) for k, at in kinds) <= SORT_ROWS:
        for k, at in kinds:
            m = _masks(bits, k)
            variants.append((base[at][:, None] ^ m[None, :]).ravel())
            owners.append(np.repeat(at.astype(np.int32), len(m)))
        close(variants, owners)
    else:
        own = _parity(base)
        rows = [(k, c, at[own[at] == np.uint64(c)]) for k, at in kinds for c in range(CLASSES)]
        held = 0
        for want in range(CLASSES):  # one parity class of variants after the other
            for k, c, at in rows:
                m = _masks_by_class(bits, k)[c ^ want]
                if len(at) and len(m):
                    variants.append((base[at][:, None] ^ m[None, :]).ravel())
                    owners.append(np.repeat(at.astype(np.int32), len(m)))
                    held += len(variants[-1])
            if held >= SORT_ROWS or (held and want == CLASSES - 1):
                close(variants, owners)
                variants, owners, held = [], [], 0
    pairs = np.unique(np.concatenate(links)) if links else np.zeros(0, np.int64)
    a, b = pairs // n, pairs % n
    near = np.bitwise_count(fps[a] ^ fps[b]) <= radius
    root = _roots(a[near], b[near], n)
    linked = np.flatnonzero(root != np.arange(n))
    return fps[linked], fps[root[linked]]


def near_links(fps: DataFrame, radius: int = 4, prefix: int | None = None, hot_variants: int = HOT_VARIANTS) -> DataFrame:
    """Links ``u, v`` whose components are those of all pairs of ``fps(fp)`` within ``radius``.

    ``fps`` holds distinct fingerprints.  The radius must be even.  The prefix length follows
    the number of fingerprints, so that what meets at a prefix stays small at any size.
    """
    if radius % 2:
        raise ValueError("meet-in-the-middle halves need an even radius")
    half = radius // 2
    if prefix is None:
        prefix = int(min(32, max(8, np.ceil(np.log2(max(1, fps.count()) / PER_PREFIX)))))
    bits = 64 - prefix
    masks = [(sum(1 << (bits + i) for i in c), half - k) for k in range(half + 1) for c in combinations(range(prefix), k)]
    signed = [m - (1 << 64) if m >> 63 else m for m, _ in masks]
    flips = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(k).alias("k")) for m, (_, k) in zip(signed, masks, strict=True)])
    sent = fps.select("fp", F.explode(flips).alias("f")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("f.m")).alias("base"), F.col("f.k").alias("left")
    ).withColumn("bucket", F.shiftrightunsigned("base", bits))
    made = F.element_at(F.array(*[F.lit(len(_masks(bits, k))) for k in range(half + 1)]), F.col("left") + 1).cast("long")
    hot = sent.groupBy("bucket").agg(F.sum(made).alias("n")).where(F.col("n") > hot_variants).select("bucket")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        fp = group.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(fp)
        base = group.column("base").to_numpy().astype(np.int64).view(np.uint64)[order]
        u, v = meet(base, group.column("left").to_numpy()[order], fp[order], bits, radius)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    def write_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, base, left = (column(batch, c).to_numpy() for c in ("fp", "base", "left"))
            for k in np.unique(left).tolist():
                m = _masks(bits, k)
                at = np.flatnonzero(left == k)
                for some in np.array_split(at, max(1, -(-len(at) * len(m) // SORT_ROWS))):
                    variants = (base[some].astype(np.int64).view(np.uint64)[:, None] ^ m[None, :]).ravel().view(np.int64)
                    yield from pa.table({"variant": variants, "fp": np.repeat(fp[some], len(m))}).to_batches(max_chunksize=1 << 18)

    in_tasks = sent.join(hot, "bucket", "left_anti").select("bucket", "fp", "base", "left").groupBy("bucket").applyInArrow(run, "u long, v long")
    variants = sent.join(hot, "bucket", "left_semi").select("fp", "base", "left").mapInArrow(write_out, "variant long, fp long")
    least = variants.groupBy("variant").agg(F.min("fp").alias("v"), F.max("fp").alias("most")).where("v < most").select("variant", "v")
    return in_tasks.unionByName(variants.join(least, "variant").where("fp <> v").select(F.col("fp").alias("u"), "v").distinct())


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most ``radius`` differing
    bits (whatever the shingles' similarity: near copies further apart don't link).  Null and
    empty texts have fingerprint zero and link like any other; rows without a doc_id are members
    that name no component but one all of whose rows are so; repeated rows come out as often as
    they came in; an empty table gives an empty table.
    """
    fps = staged(fingerprints(docs, width), "fingerprints")
    each = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(near_links(each.select("fp"), radius))
    rooted = each.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = staged(rooted.join(least, "root").select("fp", "component_id"), "classes")
    return fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
