"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Tokenizer A is a byte-level BPE of a space and the text, B a piece BPE of the text (which puts
the space there itself).  Both tokenisations of a document are merged in lockstep: one state
vector holds the places of A and B in all lanes, each step emits a link a lane, a cut where both
tokens end, moves the side that ends first (or both), and drops the lanes that are through.  A
lane is a stretch of a document between two bytes where tokens of both sides end, so that a very
long document is many lanes.

Documents are aligned a slice at a time.  A slice keeps its distinct pairs of ids, and its links
as numbers of them: what is shuffled for the corpus-wide counts is a row per slice and distinct
pair, not per link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, docs_of, slices, staged, table
from .tokens import _bytes_of, _Units, byte_letters, encoder

#: Rows and bytes of text that are aligned together.
SLICE_ROWS, SLICE_BYTES = 8192, 4 << 20
#: Bytes of text of a slice that are in work at once, but for one long row: a worker's arrays are many times as large.
PART_BYTES = 1 << 19
#: Tokens of A between two places that may begin a lane.
LANE = 96
#: Units a worker remembers for each tokenizer.
REMEMBERED = 150_000
SPACE = "▁"


class Bytes:
    """The bytes of every id of a vocabulary."""

    def __init__(self, of: list[bytes]) -> None:
        self.sizes = np.fromiter(map(len, of), np.int64, len(of))
        self.flat = np.frombuffer(b"".join(of), np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after the other."""
        n = self.sizes[ids]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.starts[ids] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


class ByteTokens:
    """Tokenizer A: ids and bytes; strings of special tokens are plain text."""

    def __init__(self, path: str) -> None:
        self._encoder = encoder(path, 0, True, True, REMEMBERED)
        back = {v: k for k, v in byte_letters().items()}
        names = self._encoder.names()
        self.bytes = Bytes([bytes(back.get(ord(ch), ord(ch) & 255) for ch in name) for name in names])

    def encode(self, led: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = self._encoder.encode(led)
        keep = np.ones(len(ids), bool)
        keep[np.cumsum(counts) - 1] = False  # end ids
        return ids[keep].astype(np.int64), counts - 1


class PieceTokens:
    """Tokenizer B: ids and bytes.

    No piece has a space behind another character, so that units of a text (blanks and what
    follows them) are encoded one by one, each distinct one once.
    """

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self._library = SentencePieceProcessor(model_file=path)
        pieces = [self._library.id_to_piece(k) for k in range(self._library.vocab_size())]
        self._apart = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.bytes = Bytes([bytes([int(p[3:5], 16)]) if self._library.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(pieces)])
        self._forget()

    def _forget(self) -> None:
        self._units = _Units()
        self._units.next = 0
        self._n, self._flat = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, led: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that a space leads."""
        bounds, data = _bytes_of(led)
        cut = np.zeros(len(data) + 1, bool)
        if self._apart and len(data):
            blank = data == 32
            cut[1:-1] = blank[1:] & ~blank[:-1]
        cut[bounds] = True
        at = np.flatnonzero(cut)
        coded = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self._n) > REMEMBERED:
            self._forget()
        units = self._units
        numbers = np.fromiter(map(units.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        if units.new:
            ids = self._library.encode([u[1:] for u in units.new], num_threads=1)  # the library puts the first space there
            ids = [x if len(u) > 1 else [self._library.piece_to_id(SPACE)] for u, x in zip(units.new, ids, strict=True)]
            self._n = np.concatenate((self._n, np.fromiter(map(len, ids), np.int64, len(ids))))
            self._flat = np.concatenate((self._flat, np.fromiter((i for x in ids for i in x), np.int64)))
            units.new = []
        n = self._n[numbers]
        ends = np.cumsum(n)
        begin = np.cumsum(self._n) - self._n
        out = self._flat[np.repeat(begin[numbers] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        until = np.append(0, ends)[np.searchsorted(at, bounds)]
        return out, np.diff(until)


@lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> tuple[ByteTokens, PieceTokens]:
    return ByteTokens(path_a), PieceTokens(path_b)


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (places in A and in B) and cuts (places of the last tokens of groups) of two tokenisations of the same bytes.

    bounds: byte offsets where tokens of both end, first and last included; stretches between
    them are the lanes.
    """
    a, stop = np.searchsorted(ends_a, bounds[:-1], "right"), np.searchsorted(ends_a, bounds[1:], "right")
    b = np.searchsorted(ends_b, bounds[:-1], "right")
    links_a, links_b, cuts_a, cuts_b = [], [], [], []
    while len(a):
        links_a.append(a)
        links_b.append(b)
        end_a, end_b = ends_a[a], ends_b[b]
        both = end_a == end_b
        cuts_a.append(a[both])
        cuts_b.append(b[both])
        a, b = a + (end_a <= end_b), b + (end_b <= end_a)
        on = a < stop
        if not on.all():
            a, b, stop = a[on], b[on], stop[on]
    whole = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return whole(links_a), whole(links_b), np.sort(whole(cuts_a)), np.sort(whole(cuts_b))


def lane_bounds(ends_a: np.ndarray, ends_b: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Byte offsets between lanes: those of documents, and about every ``LANE`` tokens one where tokens of both end."""
    some = ends_a[LANE - 1 :: LANE]
    at = np.searchsorted(ends_b, some)
    return np.unique(np.concatenate((docs, some[ends_b[np.minimum(at, len(ends_b) - 1)] == some]))) if len(ends_b) else docs


def spelled(ids_a: np.ndarray, ids_b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups as text, ``a1,a2|b1;a3|b2``, and where it ends behind each group; last: groups that end a document."""
    first_b = np.append(0, cuts_b[:-1] + 1)
    at_a = np.arange(len(ids_a)) + first_b[np.searchsorted(cuts_a, np.arange(len(ids_a)))]
    at_b = np.arange(len(ids_b)) + (cuts_a + 1)[np.searchsorted(cuts_b, np.arange(len(ids_b)))]
    items, after = np.empty(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
    items[at_a], items[at_b] = ids_a, ids_b
    after[at_a[cuts_a]] = ord("|")
    after[at_b[cuts_b]] = ord(";")
    after[at_b[cuts_b[last]]] = 0
    width = len(str(int(items.max()))) if len(items) else 1
    digits = 1 + sum((items >= 10**k).astype(np.int64) for k in range(1, width))
    ends = np.cumsum(digits + (after > 0))
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    starts = ends - digits - (after > 0)
    for k in range(width):  # the k-th digit from the right
        own = digits > k
        out[(starts + digits - 1 - k)[own]] = ord("0") + items[own] // 10**k % 10
    marked = after > 0
    out[ends[marked] - 1] = after[marked]
    return out, ends[at_b[cuts_b]]


ALIGNED = "slice long, doc_id array<long>, n_a array<int>, n_b array<int>, n_groups array<int>, n_links array<int>, groups_sha256 array<string>, links binary, a array<int>, b array<int>, n array<long>"
KINDS = [pa.int64(), *[pa.list_(pa.int64())], *[pa.list_(pa.int32())] * 4, pa.list_(pa.string()), pa.binary(), *[pa.list_(pa.int32())] * 2, pa.list_(pa.int64())]
NAMES = [c.split()[0] for c in ALIGNED.split(", ")]


def align(texts: pa.Array, a: ByteTokens, b: PieceTokens) -> dict[str, np.ndarray | list]:
    """All of a slice but its number and its doc_ids, made a part at a time.

    Texts that are null, empty or whose tokens don't join to a space and the text have zeros.
    """
    found = [align_part(part.column(0), a, b) for part in slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), SLICE_ROWS, PART_BYTES)]
    # pairs are numbered anew for the whole slice; links keep their order
    pairs, number = np.unique(np.concatenate([f["pairs"] for f in found]), return_inverse=True)
    n = np.zeros(len(pairs), np.int64)
    np.add.at(n, number, np.concatenate([f["n"] for f in found]))
    own = np.split(number, np.cumsum([len(f["pairs"]) for f in found])[:-1])
    kind = "<u4" if len(pairs) > 1 << 16 else "<u2"
    whole = {c: np.concatenate([f[c] for f in found]) for c in ("n_a", "n_b", "n_groups", "n_links")}
    return whole | {"groups_sha256": [x for f in found for x in f["groups_sha256"]], "links": b"".join(of[f["links"]].astype(kind).tobytes() for of, f in zip(own, found, strict=True)), "a": pairs >> 32, "b": pairs & 0xFFFFFFFF, "n": n}


def align_part(texts: pa.Array, a: ByteTokens, b: PieceTokens) -> dict[str, np.ndarray | list]:
    """Counts and digests of some texts, their distinct pairs of ids, how often each is linked, and the links as numbers of them."""
    led = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pc.fill_null(texts.cast(pa.large_string()), ""), pa.scalar("", pa.large_string()))
    bounds, data = _bytes_of(led)
    (ids_a, n_a), (ids_b, n_b) = a.encode(led), b.encode(led)
    docs = len(led)
    good = np.diff(bounds) > 1
    for ids, n, of in ((ids_a, n_a, a.bytes), (ids_b, n_b, b.bytes)):
        size = np.bincount(np.repeat(np.arange(docs), n), of.sizes[ids], minlength=docs).astype(np.int64)
        good &= size == np.diff(bounds)
        same = np.repeat(good, np.diff(bounds))
        wrong = np.flatnonzero(of.joined(ids[np.repeat(good, n)]) != data[same])
        good[np.searchsorted(bounds, np.flatnonzero(same)[wrong], "right") - 1] = False
    ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
    n_a, n_b = n_a * good, n_b * good
    ends_a, ends_b = np.cumsum(a.bytes.sizes[ids_a]), np.cumsum(b.bytes.sizes[ids_b])
    until = np.append(0, np.cumsum(np.diff(bounds) * good))
    links_a, links_b, cuts_a, cuts_b = lockstep(ends_a, ends_b, lane_bounds(ends_a, ends_b, np.unique(until)))
    order = np.argsort(links_a, kind="stable")
    links_a, links_b = links_a[order], links_b[order]
    pairs, number, n = np.unique(ids_a[links_a] << 32 | ids_b[links_b], return_inverse=True, return_counts=True)
    of_a = np.repeat(np.arange(docs), n_a)
    n_groups = np.bincount(of_a[cuts_a], minlength=docs)
    behind = np.cumsum(n_groups)
    text, ends = spelled(ids_a, ids_b, cuts_a, cuts_b, behind[n_groups > 0] - 1)
    shas = [""] * docs
    begin = 0
    for k in np.flatnonzero(n_groups).tolist():
        end = int(ends[behind[k] - 1])
        shas[k] = hashlib.sha256(text[begin:end]).hexdigest()
        begin = end
    return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": np.bincount(of_a[links_a], minlength=docs), "groups_sha256": shas, "pairs": pairs, "n": n, "links": number.astype("<u4")}


def aligned_slices(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row a slice of documents: their counts and digests, the slice's distinct pairs of ids, and the links as numbers of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        a, b = tokenizers(path_a, path_b)
        for k, batch in enumerate(slices(batches, SLICE_ROWS, SLICE_BYTES)):
            row = {"slice": TaskContext.get().partitionId() << 32 | k, "doc_id": column(batch, "doc_id").to_pylist()} | align(column(batch, "text"), a, b)
            yield pa.RecordBatch.from_arrays([pa.array([row[c]], kind) for c, kind in zip(NAMES, KINDS, strict=True)], names=NAMES)

    return docs_of(docs).mapInArrow(run, ALIGNED)


def pair_counts(found: DataFrame) -> DataFrame:
    """``a, b, n, best`` of all links of aligned slices; best: no pair of this B has more."""
    pairs = found.select(F.explode(F.arrays_zip("a", "b", "n")).alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.n").alias("n"))
    most = pairs.groupBy("b").agg(F.max("n").alias("most"))  # a row an id of B
    return pairs.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    Texts that are null, empty or that a tokenizer changes have no tokens: zeros and an empty
    digest.  Every row counts for itself, whatever its doc_id; copies count as often as they
    occur.  A very long text is a slice of its own, cut into lanes.  An empty table gives no rows.
    """
    found = staged(aligned_slices(docs, path_a, path_b), "aligned")
    counts = staged(pair_counts(found), "pair-counts")
    asked = found.select("slice", F.posexplode(F.arrays_zip("a", "b")).alias("k", "p")).select("slice", "k", "p.a", "p.b")
    # the pairs of a slice are bounded by its links; both lists are in the same order
    known = asked.join(counts, ["a", "b"]).groupBy("slice").agg(F.collect_list("k").alias("k"), F.collect_list("n").alias("c"), F.collect_list("best").alias("best"))
    own = found.select("slice", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links").join(known, "slice", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(i)[k] for i, c in enumerate(batch.schema.names)}
                n_links = row["n_links"].values.to_numpy()
                c = best = np.zeros(0, np.int64)
                if row["k"].is_valid:
                    at = row["k"].values.to_numpy()
                    c, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                    c[at], best[at] = row["c"].values.to_numpy(), row["best"].values.to_numpy(zero_copy_only=False)
                links = np.frombuffer(row["links"].as_py(), "<u4" if len(c) > 1 << 16 else "<u2")
                until = np.append(0, np.cumsum(n_links))
                sums = [np.diff(np.append(0, np.cumsum(x[links]))[until]) for x in (best, c)]
                lists = [row[x].values.cast(pa.int64()) for x in names[:5]]
                yield pa.RecordBatch.from_arrays([*lists, *map(pa.array, sums), row["groups_sha256"].values], names=names)

    return own.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
