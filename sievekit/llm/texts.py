"""Words, lines and 64-bit hashes of Arrow text columns, in numpy and in bounded pieces.

Everything works on UTF-8 bytes. A hash depends on the bytes of a word only, not on where
it stands, and is the same on every executor. Two different words, lines or shingles of a
corpus of n share a hash with a chance near n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at once; a longer single text is a piece of its own.
PIECE = 1 << 20

BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII that is neither a letter nor a digit.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = [not chr(i).isalnum() for i in range(128)]

_U = np.uint64
_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)


@lru_cache(maxsize=2)
def _byte_values(fold: bool) -> np.ndarray:
    values = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
    if fold:
        values[65:91] = values[97:123]
    return values


class _Powers:
    """Powers of an odd number modulo 2^64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.known = _U(base), np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.known) < n:
            self.known = np.concatenate([self.known, self.known * (self.known[-1:] * self.base)])
        return self.known[:n]


FORWARD, BACK = _Powers(_P), _Powers(_INVERSE)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(29))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(32))


def ranges(buf: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool) -> np.ndarray:
    """Hash of every byte range of a buffer."""
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_byte_values(fold)[buf] * FORWARD.upto(len(buf)), out=sums[1:])
    return mix((sums[end] - sums[start]) * BACK.upto(len(buf) + 1)[start])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


@dataclass
class Piece:
    """Some whole texts: rows ``first`` to ``last`` (exclusive) of a batch."""

    first: int
    last: int
    buf: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return self.last - self.first

    def words(self, apart: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of each word, and for each text the index of its first word."""
        inside = np.zeros(len(self.buf) + 2, bool)
        inside[1:-1] = ~apart[self.buf]
        cut = np.zeros(len(self.buf) + 1, bool)
        cut[self.offsets] = True  # a text's end ends its last word
        start = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
        end = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
        return start, end, np.searchsorted(start, self.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of each line (cut at \\n), and for each text the index of its first line."""
        breaks = np.flatnonzero(self.buf == 10)
        start = np.sort(np.concatenate([self.offsets[:-1], breaks + 1]), kind="stable")
        end = np.sort(np.concatenate([self.offsets[1:], breaks]), kind="stable")
        count = np.diff(np.searchsorted(breaks, self.offsets)) + 1
        return start, end, np.concatenate([[0], np.cumsum(count)])


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[Piece]:
    """A text column in pieces of whole texts of about ``limit`` bytes."""
    buf, offsets = buffers(column)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield Piece(row, last, buf[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row])
        row = last


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words (of one text or of several that lie behind each other)."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * _U(_P) + words[k : k + n]
    return mix(out + _U(size))


def digest(hashes: np.ndarray) -> np.uint64:
    """Hash of a sequence of hashes."""
    return mix(np.array([np.sum(hashes * FORWARD.upto(len(hashes)), dtype=np.uint64) + _U(len(hashes))], np.uint64))[0]
