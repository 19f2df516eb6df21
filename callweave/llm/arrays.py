"""Texts of an Arrow batch as numpy arrays: words, hashes of spans, rolling hashes and sampled anchors.

All functions work on one slice of a batch at a time, so memory follows the slice, or one text where that is longer.
Hashes have 64 bits and do not depend on the process, so equal spans meet wherever they are computed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            one = np.ones(1, np.uint64)
            inverse = pow(_BASE, -1, 1 << 64)
            self.up = np.concatenate([one, np.cumprod(np.full(size - 1, _BASE, np.uint64))])
            self.down = np.concatenate([one, np.cumprod(np.full(size - 1, inverse, np.uint64))])
        return self.up[:n], self.down[:n]


_powers = _Powers()


def text_slices(column: pa.Array, limit: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, bounds)`` of consecutive rows of a text column; null counts as the empty text.

    Text i of a slice is ``bytes[bounds[i]:bounds[i + 1]]``. A slice has about ``limit`` bytes and ``rows`` rows at most.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, values = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1)
        last = min(last, n, first + rows)
        yield first, data[bounds[first]:bounds[last]], bounds[first:last + 1] - bounds[first]
        first = last


def byte_class(text: bytes, invert: bool = False) -> np.ndarray:
    """Lookup table: True for the given bytes."""
    table = np.zeros(256, bool)
    table[list(text)] = True
    return ~table if invert else table


#: Words of `[^\x20\x09-\x0D]+`: everything but ASCII white space.
NOT_SPACE = byte_class(b" \t\n\x0b\x0c\r", invert=True)
#: Words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` on lower-cased text: ASCII letters and digits, and all bytes of other characters.
ALPHANUMERIC = byte_class(b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)))
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, bounds: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, word bounds)`` of maximal runs of kept bytes that do not cross texts.

    Text i has the words ``word bounds[i] .. word bounds[i + 1]``.
    """
    inside = keep[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Sums that give the hash of any span of ``values`` by :func:`span_hash`.

    The sums are linear in the values, so values have to be mixed, and spans short: from some hundred items on there are
    pairs of different spans over two values that have equal sums whatever these are.
    """
    up, _ = _powers.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span; equal spans have equal hashes wherever they stand."""
    _, down = _powers.get(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_BASE))


#: Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_LONG = 256  # bytes of a word beyond which a cryptographic hash is taken


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word's bytes: eight at a time, mixed in one after the other.

    Mixing between steps leaves no arithmetic relation that a text could use: sums of powers modulo 2^64 would be equal for
    whole families of different words.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each byte on
    sizes = ends - starts
    out = mix((eight[starts] & _FIRST[np.minimum(sizes, 8)]) ^ mix(sizes.astype(np.uint64) * np.uint64(_BASE)))
    longer = np.flatnonzero(sizes > 8)
    for at in range(8, _LONG, 8):
        if not len(longer):
            break
        left = sizes[longer] - at
        out[longer] = mix(out[longer] * np.uint64(_BASE) + (eight[starts[longer] + at] & _FIRST[np.minimum(left, 8)]))
        longer = longer[left > 8]
    for k in np.flatnonzero(sizes > _LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k]:ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def gram_starts(bounds: np.ndarray, size: int) -> np.ndarray:
    """Positions at which ``size`` consecutive items of one text start. Bounds are those of items in texts."""
    n = int(bounds[-1])
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    return np.flatnonzero(left >= size)


def _sliding(x: np.ndarray, size: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """``pick`` over every run of ``size`` neighbours, in linear time: prefixes and suffixes of blocks meet."""
    n = len(x)
    blocks = -(-n // size)
    padded = np.full(blocks * size, fill, np.uint64)
    padded[:n] = x
    grid = padded.reshape(blocks, size)
    ahead = pick.accumulate(grid, axis=1).ravel()
    back = pick.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[:n - size + 1], ahead[size - 1:n])


def sampled_anchors(hashes: np.ndarray, bounds: np.ndarray, gram: int, window: int) -> np.ndarray:
    """Positions of grams that have the smallest hash in some window of one text.

    ``hashes[i]`` belongs to the gram of ``gram`` items at position i, for each item of the texts; what it holds where a gram
    would cross a text's end is not used. Equal windows choose equal grams at equal places, so two texts that share a window
    of ``window`` items share an anchor in it.
    """
    n, grams = int(bounds[-1]), window - gram + 1
    if n < window:
        return np.empty(0, np.int64)
    values = np.maximum(hashes, np.uint64(1))
    lowest = _sliding(values[:n - gram + 1], grams, np.minimum, 2**64 - 1)
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    lowest[left[:len(lowest)] < window] = 0
    padded = np.concatenate([np.zeros(grams - 1, np.uint64), lowest, np.zeros(grams - 1, np.uint64)])
    best = _sliding(padded, grams, np.maximum, 0)
    return np.flatnonzero(values[:len(best)] == best)


def runs(covered: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that do not cross texts."""
    n = len(covered)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = covered[:-1], covered[1:]
    return np.flatnonzero(covered & (~before | edge[:n])), np.flatnonzero(covered & (~after | edge[1:])) + 1


def cover(n: int, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """True for each of ``n`` items that lies in a span from ``starts`` on."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + length, n), -1)
    return np.cumsum(steps[:-1]) > 0
