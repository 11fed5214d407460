"""Vectorised text primitives over Arrow buffers.

A word is a maximal run of bytes other than white space (bytes 9-13 and 32).  Every
function works on whole texts; a batch is cut between rows only, to bound memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21

_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, 1 << 16, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_GRAM = _rng.integers(1, 1 << 63, 64, dtype=np.int64).astype(np.uint64) | np.uint64(1)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix: a bijection with full avalanche."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch between rows so that each part holds about ``limit`` bytes of text."""
    n = batch.num_rows
    if not n:
        return
    text = batch.column(batch.schema.get_field_index(column))
    offsets = _offsets(text)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield batch.slice(at, end - at)
        at = end


def _offsets(text: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type) else np.int32
    buffer = text.buffers()[1]
    if buffer is None or len(text) == 0:
        return np.zeros(len(text) + 1, dtype=np.int64)
    return np.frombuffer(buffer, dtype=kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)


def raw(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and the rows' offsets in them; null is empty."""
    if text.null_count:
        text = text.fill_null("")
    offsets = _offsets(text)
    data = text.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(text) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a slice: byte span of each, and the first word of each row."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    between: np.ndarray
    value: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        lo = int(self.start[0])
        span = self.data[lo:]
        place = np.arange(len(span), dtype=np.int64)
        begins = self.start - lo
        place -= np.repeat(begins, np.diff(np.append(begins, len(span))))
        value = self.value[span]
        value[self.between[span]] = 0
        value *= _PLACE[place & 0xFFFF]
        total = np.add.reduceat(value, begins)
        return mix(total + (self.end - self.start).astype(np.uint64) * _GRAM[63])


def words(text: pa.Array, between: np.ndarray = IS_SPACE, value: np.ndarray = _BYTE) -> Words:
    """Words, parted by the bytes of ``between``; ``value`` is what a byte adds to a word's hash."""
    data, offsets = raw(text)
    if not len(data):
        return Words(data, offsets, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64), between, value)
    space = between[data]
    begin = ~space
    begin[1:] &= space[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    begin[cuts] = ~space[cuts]
    stop = ~space
    stop[:-1] &= space[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    stop[last] = ~space[last]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets), between, value)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position; the last n-1 positions of the array have none."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    m = len(hashes) - n + 1
    total = hashes[:m] * _GRAM[0]
    for k in range(1, n):
        total = total + hashes[k : k + m] * _GRAM[k % 62]
        if k % 62 == 61:
            total = mix(total)
    return mix(total)


def gram_positions(first: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n-grams that lie within one row."""
    counts = np.maximum(np.diff(first) - (n - 1), 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    base = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return np.arange(total, dtype=np.int64) + base


def char_offsets(data: np.ndarray) -> np.ndarray:
    """For each byte offset 0..len, the number of characters that begin before it."""
    return np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))


def order_by_hash(keys: np.ndarray) -> np.ndarray:
    """An order in which equal 64-bit hashes are adjacent.

    The top bits and the index are sorted as one integer, which is several times faster than an
    argsort; runs of equal top bits with unequal keys are put right afterwards.
    """
    n = len(keys)
    if n < 2:
        return np.arange(n)
    bits = int(n - 1).bit_length()
    low = np.uint64((1 << bits) - 1)
    packed = np.sort((keys & ~low) | np.arange(n, dtype=np.uint64))
    order = (packed & low).astype(np.int64)
    top = packed & ~low
    same_top = top[1:] == top[:-1]
    wrong = same_top & (keys[order[1:]] != keys[order[:-1]])
    if wrong.any():
        edge = np.flatnonzero(np.concatenate(([True], ~same_top, [True])))
        for r in np.unique(np.searchsorted(edge, np.flatnonzero(wrong), side="right") - 1):
            run = order[edge[r] : edge[r + 1]]
            order[edge[r] : edge[r + 1]] = run[np.argsort(keys[run], kind="stable")]
    return order


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Bounds of runs of equal values: run r is bounds[r]:bounds[r+1]."""
    if not len(sorted_keys):
        return np.zeros(1, dtype=np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1], [True])))


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... count[0] values, then those of start[1], and so on."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    base = np.repeat(start - np.concatenate(([0], np.cumsum(count)[:-1])), count)
    return np.arange(total, dtype=np.int64) + base


_NOT_ALNUM = np.ones(256, dtype=bool)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _NOT_ALNUM[_c] = False
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]


def alnum_words(text: pa.Array) -> Words:
    """Runs of ASCII letters and digits; their hashes don't depend on case."""
    return words(text, _NOT_ALNUM, _FOLDED)
