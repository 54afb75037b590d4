"""Word splitting, hashing and windows over Arrow text, vectorised with numpy.

Everything works on the UTF-8 bytes of whole texts: all separators are ASCII,
and no byte of a multi-byte character is ASCII, so bytes and code points split
alike. Hashes have 64 bits and depend on the content alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are handled in chunks of about this many bytes; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

_MULT = np.uint64(0x9E3779B97F4A7C55)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_U = np.uint64

#: True for the bytes that separate words: space, and tab to carriage return.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: True for every ASCII byte but digits and lower-case letters.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[0x00:0x30] = NOT_ALNUM[0x3A:0x61] = NOT_ALNUM[0x7B:0x80] = True
_AS_IS = np.arange(256, dtype=np.uint8)
_LOWER = _AS_IS.copy()
_LOWER[65:91] += 32
ALNUM_TABLE = bytes(32 if NOT_ALNUM[b] else int(b) for b in _LOWER)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


_powers = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 8 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


_INV = pow(int(_MULT), -1, 1 << 64)


@dataclass
class Words:
    """The words of a chunk of texts: hashes, byte ranges and the texts' word counts."""

    data: np.ndarray
    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    counts: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """Index of each text's first word, and the number of words at the end."""
        return np.concatenate(([0], np.cumsum(self.counts)))

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @property
    def left(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        ends = np.repeat(self.first[1:], self.counts)
        return ends - np.arange(len(self.hashes))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def binary(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one array of bytes without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary()).fill_null(b"")


def pieces(column: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of chunks of the column."""
    array = binary(column)
    if not len(array):
        return
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(array):
        to = int(np.searchsorted(off, off[at] + size, "right")) - 1
        to = min(len(array), max(at + 1, to))
        yield at, to, raw[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def split(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES, lower: bool = False) -> Words:
    """The words between separators of each text; offsets has one more entry than texts."""
    data = np.take(_LOWER, raw) if lower else raw
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none.astype(np.uint64), none, none, np.zeros(len(offsets) - 1, np.int64))
    inside = ~np.take(separators, data)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    begins[offsets[:-1][full]] = inside[offsets[:-1][full]]
    ends[offsets[1:][full] - 1] = inside[offsets[1:][full] - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    counts = np.diff(np.searchsorted(start, offsets))
    return Words(data, range_hashes(data, start, end), start, end, counts)


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes in each range."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * _power(int(_MULT), n), out=total[1:])
    hashes = (total[end] - total[start]) * _power(_INV, n)[np.minimum(start, n - 1)] if n else total[end]
    return mix(hashes + (end - start).astype(np.uint64) * _STEP)


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of that many words, wherever its words lie; built by doubling."""
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    have, parts, at = {1: hashes}, [], 1
    while at * 2 <= length:
        one = have[at]
        have[2 * at] = one[: len(one) - at] * _U(pow(int(_STEP), at, 1 << 64)) + one[at:]
        at *= 2
    out, done = have[at], at
    parts = length - at
    while parts:
        step = 1 << (parts.bit_length() - 1)
        right = have[step][done:]
        n = min(len(out), len(right))
        out = out[:n] * _U(pow(int(_STEP), step, 1 << 64)) + right[:n]
        done, parts = done + step, parts - step
    return mix(out[: len(hashes) - length + 1] + _U(length))


def least_in_window(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the least of each run of `width` values, the leftmost of equals."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, where, at = values, np.arange(len(values)), 1
    while at < width:
        step = min(at, width - at)
        a, b = best[:-step], best[step:]
        keep = a <= b
        best, where, at = np.where(keep, a, b), np.where(keep, where[:-step], where[step:]), at + step
    return where[:n]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.int64).view(np.uint64)
