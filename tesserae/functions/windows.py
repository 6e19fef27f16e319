"""Windows of tokens as hashes, many texts at a time: where names may stand in prose.

A window's hash is a difference of running sums over the hashes of tokens, so that a window of any
length costs the same.  Which letters make a word is what Spark's own pattern says of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: A token: a run of letters, digits and underscores, or any other mark that isn't white space.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
SPACE, WORD, MARK = 0, 1, 2
#: Letters that are looked at together at most, but for a longer text; a worker holds some 60 bytes for each.
PART = 1 << 16
#: An odd base of the sums, and what undoes it, modulo 2^64.
BASE = 0x9E3779B97F4A7C15
UNDO = pow(BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def kinds(spark: SparkSession) -> np.ndarray:
    """The kind of every code point (a megabyte), asked of the patterns that cut names into tokens."""
    c = F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')")
    kind = F.when(F.col("id").between(0xD800, 0xDFFF), MARK).when(c.rlike(r"^[\p{L}\p{N}_]$"), WORD).when(c.rlike(r"^\s$"), SPACE).otherwise(MARK)
    found = spark.range(0x110000).select("id", kind.cast("byte").alias("kind")).where(f"kind <> {MARK}").toArrow()
    out = np.full(0x110000, MARK, np.uint8)
    out[found["id"].to_numpy()] = found["kind"].to_numpy()
    return out


def parts(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Texts in stretches of ``PART`` letters, each with the place of its first."""
    begin = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > PART:
            yield begin, texts[begin:k]
            begin, size = k, 0
        size += len(text) + 1
    if texts:
        yield begin, texts[begin:]


def may_hold(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The places of hashes that a filter (``graph.filter_words``) lets through."""
    last = np.uint64(64 * len(words) - 1)

    def on(h: np.ndarray, k: int) -> np.ndarray:
        p = (h >> np.uint64(k)) & last
        return (words[(p >> np.uint64(6)).view(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1

    at = np.flatnonzero(on(hashes, 0))
    for k in (20, 40):
        at = at[on(hashes[at], k)]
    return at


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes whose every bit hangs on all bits of ``h``."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def _sums(values: np.ndarray) -> np.ndarray:
    """Running sums of values times powers of the base, from 0 on."""
    while len(_powers[0]) <= len(values):
        for k, base in enumerate((BASE, UNDO)):
            _powers[k] = np.concatenate([_powers[k], _powers[k] * np.uint64(pow(base, len(_powers[k]), 1 << 64))])
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers[0][: len(values)], out=out[1:])
    return out


class Tokens:
    """The tokens of some texts, numbered through all of them.

    ``first`` has each text's first token, and their number at the end; ``row`` each token's text.
    """

    def __init__(self, texts: list[str], kinds: np.ndarray):
        self.text = "\n".join(texts) + "\n"  # white space, so that no token goes on in the next text
        points = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        kind = kinds.take(points, mode="clip")
        word, mark = kind == WORD, kind == MARK
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        self.begin, self.end = np.flatnonzero(begins | mark), np.flatnonzero(ends | mark) + 1
        starts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1, out=starts[1:])
        self.first = np.searchsorted(self.begin, starts)
        counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(texts)), counts)
        self.stop = np.repeat(self.first[1:], counts)
        letters = _sums(points.astype(np.uint64))
        self.sums = _sums(mixed((letters[self.end] - letters[self.begin]) * _powers[1][self.begin]))

    def hashes(self, at: np.ndarray, n: np.ndarray | int, salt: int = 0) -> np.ndarray:
        """64-bit hashes of the windows of ``n`` tokens that begin at tokens ``at``."""
        return mixed((self.sums[at + n] - self.sums[at]) * _powers[1][at] ^ np.uint64(salt))

    def within(self, at: np.ndarray, n: int) -> np.ndarray:
        """Those of ``at`` whose windows of ``n`` tokens end within their text."""
        return at[at + n <= self.stop[at]]

    def joined(self, at: int, n: int) -> str:
        """A window's tokens, parted by single spaces."""
        return " ".join(self.text[b:e] for b, e in zip(self.begin[at : at + n].tolist(), self.end[at : at + n].tolist()))
