"""Token files: static range asymmetric numeral systems over interleaved blocks.

A file is a Parquet folder of self-contained rows.  One ``table`` row holds the shared
frequency table; every ``block`` row holds whole documents in ascending doc_id order, coded by
many interleaved states that start afresh in each block, with states saved at checkpoints (a
reader can start there) and a checksum of the ids.  Any block decodes with the table alone, so
readers share nothing and a lost task repeats only its own blocks.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, docs_of, shared_dir, slices, staged, table
from .tokens import encoder, packed, unpacked

MAGIC = b"TNS1"
HEADER = struct.Struct("<4sIQIIII")
LANES = 1024
#: Tokens after which a block ends, with the document it is in.
BLOCK_TOKENS = 1 << 18
#: Steps (of one token a lane) between checkpoints.
CHECKPOINT_STEPS = 128
#: Rows that are tokenised together at most: the more, the fewer units are looked up.
SLICE_ROWS = 4096
#: Frequencies sum up to this power of two.
BITS = 18
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)


class Table:
    """Frequencies that sum up to ``2 ** BITS``, at least one for every symbol that occurs."""

    def __init__(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.most = self.freq << np.uint64(31 - BITS + 32)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))

    @staticmethod
    def from_counts(counts: np.ndarray) -> Table:
        counts = counts.astype(np.float64)
        seen = counts > 0
        total, size = counts.sum(), 1 << BITS
        if seen.sum() > size:
            raise ValueError("more symbols than table slots")
        freq = np.zeros(len(counts), np.int64)
        if total:
            freq[seen] = np.maximum(1, np.floor(counts[seen] / total * size)).astype(np.int64)
            over = int(freq.sum()) - size
            for at in np.argsort(-freq, kind="stable"):  # the commonest symbols take the difference
                if over == 0:
                    break
                take = min(over, int(freq[at]) // 2) if over > 0 else over
                freq[at] -= take
                over -= take
        return Table(freq)


def encode_block(ids: np.ndarray, t: Table) -> bytes:
    """One block: header, checksum, final states, checkpoints and the words of all lanes."""
    n = len(ids)
    lanes = max(1, min(LANES, n))
    steps = -(-n // lanes)
    x = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    saved: dict[int, np.ndarray] = {}
    bits, mask = np.uint64(BITS), np.uint64(0xFFFFFFFF)
    for step in range(steps - 1, -1, -1):
        s = ids[step * lanes : (step + 1) * lanes]
        y = x[: len(s)]
        f = t.freq[s]
        full = y >= t.most[s]
        words.append((y[full] & mask).astype("<u4"))
        y = np.where(full, y >> WORD, y)
        q = y // f
        x[: len(s)] = (q << bits) + (y - q * f) + t.start[s]
        if step % CHECKPOINT_STEPS == 0 and step:
            saved[step] = x.copy()
    words.reverse()
    sizes = np.cumsum([len(w) for w in words])
    marks = b"".join(struct.pack("<IQ", k, int(sizes[k - 1])) + saved[k].astype("<u8").tobytes() for k in sorted(saved))
    body = b"".join(w.tobytes() for w in words)
    head = HEADER.pack(MAGIC, lanes, n, len(saved), len(body) // 4, zlib.crc32(ids.astype("<u4").tobytes()), CHECKPOINT_STEPS)
    return head + x.astype("<u8").tobytes() + marks + body


def decode_block(data: bytes, t: Table, checkpoint: int = 0) -> np.ndarray:
    """The ids of a block, or from its ``checkpoint``-th checkpoint (1 is the first) to its end.

    A whole block is held against its checksum.
    """
    magic, lanes, n, marks, n_words, crc, _ = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at = HEADER.size
    x = np.frombuffer(data, "<u8", lanes, at).astype(np.uint64)
    at += 8 * lanes
    step = word = 0
    if checkpoint:
        where = at + (checkpoint - 1) * (12 + 8 * lanes)
        step, word = struct.unpack_from("<IQ", data, where)
        x = np.frombuffer(data, "<u8", lanes, where + 12).astype(np.uint64)
    words = np.frombuffer(data, "<u4", n_words, at + marks * (12 + 8 * lanes)).astype(np.uint64)
    begin = step * lanes
    out = np.empty(n - begin, np.uint32)
    bits, slots = np.uint64(BITS), np.uint64((1 << BITS) - 1)
    for k in range(step, -(-n // lanes)):
        y = x[: min(lanes, n - k * lanes)]
        slot = y & slots
        s = t.symbol[slot]
        out[k * lanes - begin : k * lanes - begin + len(s)] = s
        y = t.freq[s] * (y >> bits) + slot - t.start[s]
        low = np.flatnonzero(y < LOW)
        y[low] = (y[low] << WORD) | words[word : word + len(low)]
        word += len(low)
        x[: len(y)] = y
    if not checkpoint and zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise ValueError("a token block is damaged")
    return out


TOKENS = "shard int, block int, first long, doc_ids array<long>, counts array<int>, ids binary"


def _tokenised(docs: DataFrame, path: str, end_id: int, led: bool) -> DataFrame:
    """Blocks of ids in ascending doc_id order; ``first`` counts the shard's ids before a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        enc = encoder(path, end_id, led)
        wide = enc.vocabulary > 1 << 16
        names: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        block = first = held = 0

        def close() -> pa.RecordBatch:
            row = [shard, block, first, pa.concat_arrays(names), np.concatenate(sizes).astype(np.int32), packed(np.concatenate(ids), wide)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["shard", "block", "first", "doc_ids", "counts", "ids"])

        for batch in slices(batches, SLICE_ROWS):
            some, counts = enc.encode(column(batch, "text"))
            names.append(column(batch, "doc_id"))
            sizes.append(counts)
            ids.append(some)
            held += len(some)
            if held >= BLOCK_TOKENS:
                yield close()
                block, first, held = block + 1, first + held, 0
                names, sizes, ids = [], [], []
        if names:
            yield close()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs_of(docs).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(run, TOKENS)


def write_tokens(docs: DataFrame, to: str, tokenizer: str, end_id: int, led: bool = False) -> None:
    """Write the token file of ``docs`` into the folder ``to``.

    The frequency table counts all ids of all documents.  Rows without a doc_id come first; null
    text is empty; repeated doc_ids stay, side by side.
    """
    tokens = staged(_tokenised(docs, tokenizer, end_id, led), "tokens")
    size = encoder(tokenizer, end_id, led).vocabulary
    wide = size > 1 << 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for data in batch.column(0):
                total += np.bincount(unpacked(data.as_py(), wide), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    counts = np.zeros(size, np.int64)  # one row an id of the vocabulary at most
    for row in tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row.id] = row.n
    shared = Table.from_counts(counts)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [encode_block(unpacked(data.as_py(), wide), shared) for data in column(batch, "ids")]
            yield pa.RecordBatch.from_arrays([column(batch, c) for c in ("shard", "block", "first", "doc_ids", "counts")] + [pa.array(blobs, pa.binary())], names=["shard", "block", "first", "doc_ids", "counts", "payload"])

    schema = TOKENS.replace("ids binary", "payload binary")
    blocks = tokens.mapInArrow(code, schema).withColumn("kind", F.lit("block"))
    head = docs.sparkSession.createDataFrame([(-1, -1, 0, [], [], bytearray(shared.freq.astype("<u4").tobytes()), "table")], f"{schema}, kind string")
    blocks.unionByName(head.coalesce(1)).write.option("compression", "none").parquet(to)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, ids`` of a token file, decoded from its blocks."""
    rows = spark.read.parquet(path)
    freq = np.frombuffer(rows.where("kind = 'table'").select("payload").first()[0], "<u4")
    shared = Table(freq.astype(np.int64))
    blocks = rows.where("kind = 'block'")
    sizes = blocks.groupBy("shard").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    base = sizes.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("base"))  # a row a shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                ids = decode_block(column(one, "payload")[0].as_py(), shared).astype("<u4")
                docs = column(one, "doc_ids")[0].values
                counts = column(one, "counts")[0].values.to_numpy().astype(np.int64)
                ends = np.cumsum(counts)
                cuts = list(zip((ends - counts).tolist(), ends.tolist(), strict=True))
                crcs = np.array([zlib.crc32(ids[a:b].tobytes()) for a, b in cuts], np.int64)
                start = column(one, "base")[0].as_py() + column(one, "first")[0].as_py() + ends - counts
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([docs, pa.array(start), pa.array(counts), pa.array(crcs), lists], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    # base has a row for each shard, no more than there are shuffle partitions
    return blocks.join(F.broadcast(base), "shard").select("base", "first", "doc_ids", "counts", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def op6_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/token-file-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
