"""Token ids of whole texts by the tokenizers library.

A byte-level BPE never joins what its splitting rule separates. That rule always separates before white space that follows
another character, and between letters and punctuation. So a text's ids are those of its units, cut at such places, and the
library is asked once for each unit that a worker meets. Units of at most 15 bytes are looked up all at once by their bytes, in a table
with one place for each hash; what it does not hold is looked up in a dictionary. A unit of letters is one piece for the splitting rule and goes
straight to the library's model; any other goes through the whole tokenizer. Rows of one slice of a batch are handled at a time.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np

from callweave.llm import arrays

END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
CACHED_UNITS = 900_000  # a full cache is begun anew: this changes time, never ids
TABLE_BITS = 19  # of the places of short units: this changes time, never ids

_SHORT = 15  # bytes
_ODD = arrays.byte_class(b" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f")
_LETTERS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LETTER = arrays.byte_class(_LETTERS)
_SIGN = arrays.byte_class(bytes(b for b in range(0x21, 0x7F) if b not in _LETTERS + b"0123456789"))
_SIGN_BEFORE = _SIGN & arrays.byte_class(b"'", invert=True)  # 's and the like are pieces of their own
_PLAIN = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
# Byte-level BPE writes a byte that is no printable character of Latin-1 as the next free character from 256 on.
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_AS_TEXT = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}

_SPACE = chr(_AS_TEXT[32])
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # masks of the first bytes of a little-endian number


def vocabulary_path(name: str = VOCABULARY) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def unit_starts(data: np.ndarray, bounds: np.ndarray, letters: bool = True) -> np.ndarray:
    """Where units start: at each text's start, at white space after a character that surely is none, and, with
    ``letters``, between ASCII punctuation and letters of ASCII or Latin-1."""
    space = ~arrays.NOT_SPACE[data]
    safe = ~_ODD[data]
    if len(data) > 2:  # white space beyond ASCII ends in these bytes; anything that looks like it is not split off
        a, b, c = data[:-2], data[1:-1], data[2:]
        wide = ((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80))
        safe[2:] &= ~(wide & (c >= 0x80))
    if len(data) > 1:
        safe[1:] &= ~((data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0)))
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    first = first[:-1]
    first[1:] |= space[1:] & safe[:-1]
    if letters:
        letter = _LETTER[data]
        first[1:] |= letter[1:] & _SIGN_BEFORE[data[:-1]]
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        first[1:] |= _SIGN[data[1:]] & letter[:-1]
    return np.flatnonzero(first)


def _short_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(first eight bytes, next seven and size, place in the table)`` of units. Longer units are
    never in the table."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))  # the eight bytes from each byte on
    sizes = ends - starts
    first = eight[starts] & _FIRST[np.minimum(sizes, 8)]
    second = (eight[starts + 8] & _FIRST[np.clip(sizes - 8, 0, 7)]) | (np.minimum(sizes, _SHORT + 1).astype(np.uint64) << np.uint64(56))
    place = (arrays.mix(first ^ arrays.mix(second)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
    return first, second, place


def _left(text: bytes, starts: np.ndarray, ends: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    """Which units are not known, their bytes, and the distinct ones of these."""
    rest = np.flatnonzero(~known)
    own = [text[s:e] for s, e in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
    return rest, own, list(dict.fromkeys(own))


class Encoder:
    """Ids of texts with a memory of the units met so far."""

    def __init__(self, vocabulary: str | None = None) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(vocabulary or vocabulary_path())
        self.special = [t.content.encode() for t in self.model.get_added_tokens_decoder().values()]
        self._empty()

    def _empty(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.offsets = np.zeros(1 << 16, np.int64)
        self.pool = np.empty(1 << 20, np.uint32)
        self.used = 0
        # Units by the hash of their bytes: the first eight, the next seven and the size, the slot. A size of 0 is a free place.
        self.first, self.second = np.zeros(1 << TABLE_BITS, np.uint64), np.zeros(1 << TABLE_BITS, np.uint64)
        self.held = np.zeros(1 << TABLE_BITS, np.int32)

    def _learn(self, units: list[bytes]) -> None:
        bpe = self.model.model
        plain, other = [], []
        for u in units:
            (plain if _PLAIN.fullmatch(u) else other).append(u)
        shown = [(u.decode("ascii").replace(" ", _SPACE) if u.isascii() else u.decode("latin-1").translate(_AS_TEXT)) for u in plain]
        ids = [[t.id for t in bpe.tokenize(u)] for u in shown]
        ids += [e.ids for e in self.model.encode_batch_fast([u.decode("utf-8", "replace") for u in other], add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))
        slot, end = len(self.slots), self.used + len(flat)
        while slot + len(ids) + 1 > len(self.offsets):
            self.offsets = np.concatenate([self.offsets, np.zeros(len(self.offsets), np.int64)])
        while end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(len(self.pool), np.uint32)])
        self.pool[self.used:end] = flat
        self.offsets[slot + 1:slot + len(ids) + 1] = self.used + np.cumsum(sizes)
        self.used = end
        self.slots.update(zip(plain + other, range(slot, slot + len(ids)), strict=True))

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, bounds)``: text i has ``ids[bounds[i]:bounds[i + 1]]``. No end ids are added."""
        text = data.tobytes()
        starts = unit_starts(data, bounds, letters=not any(t in text for t in self.special))
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(bounds), np.int64)
        ends = np.append(starts[1:], len(data))
        first, second, place = _short_keys(data, starts, ends)
        short = ends - starts <= _SHORT
        known = short & (self.first[place] == first) & (self.second[place] == second)  # the bytes themselves are compared, no hash of them
        rest, own, units = _left(text, starts, ends, known)
        if len(self.slots) + len(units) > CACHED_UNITS:
            self._empty()
            known[:] = False
            rest, own, units = _left(text, starts, ends, known)
        if new := [u for u in units if u not in self.slots]:
            self._learn(new)
        slots = self.held[place].astype(np.int64)
        slots[rest] = np.fromiter(map(self.slots.__getitem__, own), np.int64, len(own))
        new_short = rest[short[rest]]
        at, one = np.unique(place[new_short], return_index=True)  # one unit for each place
        new_short = new_short[one]
        self.first[at], self.second[at], self.held[at] = first[new_short], second[new_short], slots[new_short]
        sizes = self.offsets[slots + 1] - self.offsets[slots]
        after = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.pool[np.repeat(self.offsets[slots] - after[:-1], sizes) + np.arange(after[-1])]
        return ids, after[np.searchsorted(starts, bounds)]


@lru_cache(maxsize=1)
def encoder(vocabulary: str | None = None) -> Encoder:
    """This worker's encoder."""
    return Encoder(vocabulary)


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """The same with the end id after each text, as little-endian unsigned 32-bit integers."""
    n = len(bounds) - 1
    out = np.full(len(ids) + n, end_id, "<u4")
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(bounds))] = ids
    return out, bounds + np.arange(n + 1)
