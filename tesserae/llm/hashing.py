"""Hashed words and word n-grams of many texts at once."""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np

WORDS = re.compile(r"\w+|[^\w\s]+")
#: Words whose hash a worker remembers.
REMEMBERED = 100_000


@lru_cache(maxsize=1)
def _memory() -> dict[str, int]:
    return {}


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the lower-case words and marks of all texts (as uint64), and how many each text has."""
    memory = _memory()
    split = [WORDS.findall(t.lower()) for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    if len(memory) > REMEMBERED:
        memory.clear()
    new = set().union(*split).difference(memory)
    memory.update((w, zlib.crc32(w.encode("utf-8", "surrogatepass"))) for w in new)
    out = np.fromiter(map(memory.__getitem__, chain.from_iterable(split)), np.uint64, int(sizes.sum()))
    return out, sizes


def mixed(x: np.ndarray, bits: int) -> np.ndarray:
    """The top ``bits`` of a multiplicative hash."""
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


#: The bigram of a word with itself, whichever the word: repetition is one feature.
SAME = np.uint64(0x9D39247E33776D41)


def bigrams(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, doc = pairs(words, sizes, 1)
    inside = np.repeat(np.arange(len(sizes)), sizes)
    inside = inside[:-1] == inside[1:] if len(words) > 1 else np.zeros(0, bool)
    same = (words[:-1] == words[1:])[inside] if len(words) > 1 else inside
    return np.where(same, SAME, found), doc


def pairs(words: np.ndarray, sizes: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words ``gap`` apart within a text, and the text of each."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    inside = doc[:-gap] == doc[gap:] if len(doc) > gap else np.zeros(0, bool)
    first, second = words[:-gap][inside] if len(doc) > gap else words[:0], words[gap:][inside] if len(doc) > gap else words[:0]
    return (first * np.uint64(0xC2B2AE3D27D4EB4F) + second + np.uint64(gap)) ^ np.uint64(0x165667B19E3779F9), (doc[:-gap][inside] if len(doc) > gap else doc[:0])
