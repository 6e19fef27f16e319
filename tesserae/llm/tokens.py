"""Token ids of whole texts, through the tokenizers library.

Texts are cut into units at places where the tokenizer always starts a new piece, and every
distinct unit goes through the library once: a worker remembers the units it met first (the
frequent ones), the others are deduplicated within a slice.  Cutting and deduplication are
Arrow and numpy work on the bytes of all texts at once.  The result is that of encoding each
text as a whole; texts with an added token or white space beyond ASCII are encoded as a whole.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units a worker remembers (about 250 bytes each).
REMEMBERED = 500_000
#: Marks that are pieces of their own behind a letter.
MARKS = frozenset(".,!?:;")
#: Words of letters below this are their own normal form if they are in lower case.
LATIN_END = "ɐ"
#: Kinds of bytes: 1 ASCII letters, 2 other visible ASCII characters.
KINDS = np.array([1 if chr(b).isalpha() else 2 if 32 < b < 127 else 0 for b in range(128)] + [0] * 128, np.uint8)
#: ASCII white space, and the first bytes of wider white space.
BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
WIDE_FIRST = np.array([0xC2, 0xE1, 0xE2, 0xE3], np.uint8)
#: Line feeds as spaces; the same with ASCII letters in lower case.
SPACED = np.array([32 if b == 10 else b for b in range(256)], np.uint8)
LOWERED = np.array([b + 32 if 65 <= b <= 90 else int(SPACED[b]) for b in range(256)], np.uint8)


def byte_letters() -> dict[int, int]:
    """The byte-level alphabet as a translation of Latin-1: visible bytes stand for themselves, the others follow from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: 256 + k for k, b in enumerate(hidden)}


class _Units(dict):
    """Numbers of units; a unit without one gets the next and is put down as new."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []
        self.next = 1

    def __missing__(self, unit: str) -> int:
        number = self[unit] = self.next
        self.next += 1
        self.new.append(unit)
        return number


class Encoder:
    """Encodes texts to ids with an end id after each.

    led: the tokenizer lets a space lead the piece that follows it, and other white space makes
    pieces of its own.  Otherwise white space only separates pieces.
    The content of an added token (an end mark) in a text is that token, as the library has it;
    plain: it is text like any other.
    """

    def __init__(self, path: str, end_id: int, led: bool, plain: bool = False, remembered: int | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.encode_special_tokens = plain
        self._remembered = remembered or REMEMBERED
        self._added = [] if plain else [t.content.lower() for t in self._library.get_added_tokens_decoder().values()]
        self._model = self._library.model
        self._letters = byte_letters()
        self._space = chr(self._letters[32])
        self._led = led
        self._units = _Units()
        self._flat = np.array([end_id], np.uint32)
        self._n = np.ones(1, np.int64)
        self._marks = {m: self._whole([m])[0] for m in sorted(MARKS)}
        self.vocabulary = self._library.get_vocab_size(with_added_tokens=True)

    def names(self) -> list[str]:
        """The vocabulary's entries by id."""
        return [self._library.id_to_token(k) or "" for k in range(self.vocabulary)]

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._library.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str, lead: str) -> list[int]:
        """Ids of one word of Latin letters: one piece of the model."""
        if word.isascii():  # ASCII letters stand for themselves
            return [t.id for t in self._model.tokenize(self._space + word if lead else word)]
        return [t.id for t in self._model.tokenize((lead + word).encode().decode("latin-1").translate(self._letters))]

    def _plain(self, word: str) -> bool:
        return word.isalpha() and (word.isascii() or max(word) < LATIN_END) and (self._led or word == word.lower() and unicodedata.is_normalized("NFC", word))

    def _ids_of_new(self) -> list[list[int]]:
        """Ids of the new units in order.  Units they are made of may join at the end."""
        units, found = self._units, []
        made: dict[int, tuple[str, list[int]]] = {}
        whole: list[int] = []
        k = 0
        while k < len(units.new):
            unit = units.new[k]
            lead = " " if self._led and unit.startswith(" ") else ""
            word = unit[len(lead) :]
            ids: list[int] = []
            if self._plain(word):
                ids = self._word(word, lead)
            elif self._led:
                whole.append(k)
            elif len(word) > 1 and word[-1] in MARKS and word[-2].isalpha() and len(word[-2].lower()) == 1:
                made[k] = (word[:-1], self._marks[word[-1]])
                units[word[:-1]]  # noqa: B018  (it gets a number)
            elif word.isascii() and word != word.lower():
                made[k] = (word.lower(), [])
                units[word.lower()]  # noqa: B018
            else:
                whole.append(k)
            found.append(ids)
            k += 1
        for at, ids in zip(whole, self._whole([units.new[at] for at in whole]) if whole else [], strict=True):
            found[at] = ids
        if made:
            base = units.next - len(units.new)
            ends = np.cumsum(self._n)
            todo = list(made)
            while todo:  # a unit's parts may be made themselves, from units put down later
                later = []
                for at in reversed(todo):
                    part, after = made[at]
                    number = units[part]
                    if number < base:
                        ids = self._flat[ends[number] - self._n[number] : ends[number]].tolist()
                    elif number - base in made:
                        later.append(at)
                        continue
                    else:
                        ids = found[number - base]
                    found[at] = ids + after
                    del made[at]
                todo = later[::-1]
        return found

    def _odd(self, texts: pa.LargeStringArray, bounds: np.ndarray, data: np.ndarray) -> np.ndarray:
        """True for texts that are encoded as a whole: an added token in any case or, if spaces lead, white space beyond ASCII."""
        odd = np.zeros(len(texts), bool)
        for head in {t[:2] for t in self._added}:
            for k in np.flatnonzero(pc.match_substring(texts, head).to_numpy(zero_copy_only=False)).tolist():
                low = texts[k].as_py().lower()
                odd[k] |= any(t in low for t in self._added)
        if self._led and len(data) > 1:
            at = np.flatnonzero(np.isin(data[:-1], WIDE_FIRST))
            one, two, three = data[at], data[at + 1], data[np.minimum(at + 2, len(data) - 1)]
            wide = (one == 0xC2) & ((two == 0x85) | (two == 0xA0)) | (one == 0xE1) & (two == 0x9A) & (three == 0x80) | (one == 0xE3) & (two == 0x80) & (three == 0x80)
            wide |= (one == 0xE2) & ((two == 0x80) & ((three <= 0x8A) | np.isin(three, (0xA8, 0xA9, 0xAF))) | (two == 0x81) & (three == 0x9F))
            odd[np.searchsorted(bounds, at[wide], "right") - 1] = True
        return odd

    def _led_units(self, bounds: np.ndarray, data: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray]:
        """Units of all texts, and where each text's units end, if a space leads the piece behind it.

        Of a run of white space before a word all but the last character is a piece; the last one
        leads the word if it is a space and is a piece itself if not.  A new piece starts between
        a letter and a mark or digit on either side (but behind an apostrophe).
        """
        cut = np.zeros(len(data) + 1, bool)
        if len(data):
            blank = BLANK[data]
            starts = np.zeros(len(data), bool)
            starts[bounds[:-1][bounds[:-1] < len(data)]] = True
            inner = ~starts[1:]
            begins = np.flatnonzero(blank[1:] & ~blank[:-1] & inner) + 1
            words = np.flatnonzero(~blank[1:] & blank[:-1] & inner) + 1
            cut[begins] = cut[words - 1] = True
            cut[words[data[words - 1] != 32]] = True
            cut[self._joints(data)] = True
        cut[bounds] = True
        at = np.flatnonzero(cut)
        ends = np.searchsorted(at, bounds[1:])
        return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)), ends

    @staticmethod
    def _joints(data: np.ndarray) -> np.ndarray:
        kind = KINDS[data]
        latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))  # two-byte letters, without signs
        kind[latin] = kind[latin + 1] = 1
        return np.flatnonzero((kind[:-1] | kind[1:] == 3) & ((kind[1:] == 2) | (data[:-1] != ord("'")))) + 1

    def _separated(self, bounds: np.ndarray, data: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray]:
        """Units of all texts, and where each text's units end, if white space only separates.

        A new piece starts between a letter and a mark or digit on either side (but behind an
        apostrophe), so that a space put there changes nothing, nor do small letters for ASCII
        ones: the tokenizer makes them so, after composing letters with combining marks.
        """
        joint = self._joints(data)
        combining = ((data == 0xCC) | (data == 0xCD)).any()
        data = np.insert((SPACED if combining else LOWERED)[data], joint, ord(" "))
        bounds = bounds + np.searchsorted(joint, bounds)
        words = pc.split_pattern(pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(data)), " ")
        return words.flatten(), np.cumsum(words.value_lengths().to_numpy()).astype(np.int64)

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other (uint32), and how many each has, end id included.  Null is empty."""
        given = pa.array(texts, pa.large_string()) if isinstance(texts, list) else pc.fill_null(texts.cast(pa.large_string()), "")
        bounds, data = _bytes_of(given)
        odd = np.flatnonzero(self._odd(given, bounds, data))
        if len(odd):
            usual = given.to_pylist()
            rare = [usual[k] for k in odd.tolist()]
            for k in odd.tolist():
                usual[k] = ""
            bounds, data = _bytes_of(pa.array(usual, pa.large_string()))
        units = self._units
        kept, size = len(self._n), len(self._flat)
        words, ends = self._led_units(bounds, data) if self._led else self._separated(bounds, data)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(units.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        if units.new:
            self._append(self._ids_of_new())
        first = len(self._n)
        if len(odd):  # each such text is a unit of this slice alone
            self._append(self._whole(rare))
            numbers = np.insert(numbers, ends[odd], first + np.arange(len(odd)))
            ends = ends + np.cumsum(np.isin(np.arange(len(ends)), odd))
        numbers = np.insert(numbers, ends, 0)
        n = self._n[numbers]
        total = np.cumsum(n)
        begin = np.cumsum(self._n) - self._n
        ids = self._flat[np.repeat(begin[numbers] - total + n, n) + np.arange(total[-1] if len(total) else 0)]
        counts = np.diff(total[ends + np.arange(len(ends))], prepend=0)
        if len(self._n) > self._remembered:  # forget what this slice brought
            for unit in units.new:
                del units[unit]
            self._n, self._flat, units.next = self._n[:kept], self._flat[:size], kept
        elif len(odd):
            self._n, self._flat = self._n[:first], self._flat[: int(self._n[:first].sum())]
        units.new = []
        return ids, counts

    def _append(self, ids: list[list[int]]) -> None:
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        self._n = np.concatenate((self._n, n))
        self._flat = np.concatenate((self._flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum()))))


def _bytes_of(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Where texts begin and end, and their UTF-8 bytes."""
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(texts.buffers()[2], np.uint8, int(bounds[-1] - bounds[0]), int(bounds[0])) if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    return bounds - bounds[0], data


@lru_cache(maxsize=4)
def encoder(path: str, end_id: int, led: bool, plain: bool = False, remembered: int | None = None) -> Encoder:
    """One encoder per worker and tokenizer, so that remembered units outlive a task."""
    return Encoder(path, end_id, led, plain, remembered)


def packed(ids: np.ndarray, wide: bool) -> bytes:
    return ids.astype("<u4" if wide else "<u2").tobytes()


def unpacked(data: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(data, "<u4" if wide else "<u2").astype("<u4")
