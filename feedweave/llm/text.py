"""Vectorised word splitting and hashing over the buffers of Arrow string columns.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D; A-Z are lower-cased.
Words get 64-bit hashes that are equal in every process, so that they can be
shuffled, counted and compared in place of the words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step handles; a longer text is one step of its own.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_VALUE_EXACT = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_VALUE = _VALUE_EXACT[_FOLD]
_BASE = 0x9E3779B97F4A7C15
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def release() -> None:
    """Return memory that this process has freed, which a kept Python worker would hold on to."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x2545F4914F6CDD1D) + (b ^ np.uint64(0xA0761D6478BD642F)))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES)
        inverse = pow(_BASE, -1, 1 << 64)
        out = []
        for base in (_BASE, inverse):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers = (out[0], out[1])
    return _powers[0][:n], _powers[1][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes, or of one row."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(n, max(high, low + 1))
        yield low, high
        low = high


class Ranges:
    """Hashes of any ranges of a text, A-Z in lower case; equal bytes have equal hashes."""

    def __init__(self, text: np.ndarray, values: np.ndarray = _VALUE):
        power, self.inverse = _power(len(text))
        self.total = np.empty(len(text) + 1, np.uint64)
        self.total[0] = 0
        np.cumsum(values[text] * power, out=self.total[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of the ranges that begin at each start, before the end of the text."""
        return mix((self.total[ends] - self.total[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Words of some rows in order: `bounds[i]:bounds[i + 1]` are those of row i."""

    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    ranges: Ranges


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the rows at `offsets` of `data`; starts and ends are offsets in data, the
    ranges are those of the rows' bytes from the first on."""
    base, n = int(offsets[0]), len(offsets) - 1
    text = data[base : int(offsets[-1])]
    local = offsets - base
    ranges = Ranges(text)
    if not len(text):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(n + 1, np.int64), none, none, np.zeros(0, np.uint64), ranges)
    space = _SPACE[text]
    before = np.empty(len(text), bool)
    before[0], before[1:] = True, space[:-1]
    after = np.empty(len(text), bool)
    after[-1], after[:-1] = True, space[1:]
    inner = local[(local > 0) & (local < len(text))]
    before[inner] = True
    after[inner - 1] = True
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(after & ~space) + 1
    bounds = np.searchsorted(starts, local)
    return Words(bounds, starts + base, ends + base, ranges.hashes(starts, ends), ranges)


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """Word hashes of each text, as `words` gives them."""
    data, offsets = buffers(pa.array(texts, pa.large_string()))
    w = words(data, offsets)
    return [w.hashes[a:b] for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
