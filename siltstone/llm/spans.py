"""Vectorised word spans and 64-bit span hashes over Arrow string batches.

Texts stay one UTF-8 buffer; words are byte ranges found with a class table, and a
span's hash is a difference of prefix sums, so no Python object is made per word.
Hashes only route or pre-filter: operators that promise exact results compare bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Text bytes that are worked on at once inside a task.
CHUNK_BYTES = 1 << 20
#: Text bytes that are hashed at once, each taking eight for its prefix sum and eight for its power.
HASH_BYTES = 1 << 18

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: dict[int, np.ndarray] = {}


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a worker gives the memory that it freed back to the system, where the C library can.

    Workers live for many tasks of many kinds, and would keep the largest of what each one used.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)
            pa.default_memory_pool().release_unused()

    return tidied


def space_class() -> np.ndarray:
    """True for bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def alnum_class() -> np.ndarray:
    """True for bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x61:0x7B] = True
    table[0x80:] = True
    return table


def ascii_lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        values = np.full(max(n, 1 << 16), base, np.uint64)
        values[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(values)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that low and high bits are both usable."""
    h = h.copy()
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _hash_piece(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(data)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_CODES[data] * _powers(_MULTIPLIER, n)[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * _powers(_INVERSE, n + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[start:end]``; starts ascending. Works through large buffers piecewise."""
    if len(data) <= HASH_BYTES or not len(starts):
        return _hash_piece(data, starts, ends) if len(starts) else np.empty(0, np.uint64)
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + HASH_BYTES)))
        low, high = int(starts[at]), int(ends[at:to].max())
        out[at:to] = _hash_piece(data[low:high], starts[at:to] - low, ends[at:to] - low)
        at = to
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and ``first``: document i has words first[i]:first[i + 1]."""
    inside = table[data]
    n = len(data)
    edge = np.empty(n + 1, bool)
    if n:
        edge[0], edge[n] = inside[0], inside[n - 1]
        np.not_equal(inside[1:], inside[:-1], out=edge[1:n])
    else:
        edge[0] = False
    starts = np.flatnonzero(edge[:n] & inside)
    ends = np.flatnonzero(edge[1:] & inside) + 1
    # a document's end also ends a word
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    cuts = cuts[inside[cuts] & inside[cuts - 1]] if len(cuts) else cuts
    if len(cuts):
        cuts = np.unique(cuts)
        starts = np.sort(np.concatenate([starts, cuts]))
        ends = np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(starts, offsets)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string array as bytes and offsets (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` text bytes, of one row at least."""
    offsets = text_buffer(batch.column(text))[1] if batch.num_rows else np.zeros(1, np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    if len(values) < width:
        return values[:0]
    low, span = values, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` consecutive word hashes (order matters)."""
    if len(words) < size:
        return words[:0]
    n = len(words) - size + 1
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    return mix(total)


class Interner:
    """Open-addressing table from 64-bit hashes to small numbers, filled and probed in bulk.

    It takes no more keys than ``most``: later ones are told apart by the caller batch by batch.
    """

    def __init__(self, bits: int = 21) -> None:
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.numbers = np.full(1 << bits, -1, np.int32)
        self.size, self.most = 0, (1 << bits) // 2

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int32)
        at = (keys & self.mask).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            number, seen = self.numbers[at], self.keys[at]
            hit = (seen == keys[left]) & (number >= 0)
            out[left[hit]] = number[hit]
            go = ~hit & (number >= 0)
            left, at = left[go], (at[go] + 1) & int(self.mask)
        return out

    def add(self, keys: np.ndarray) -> int:
        """Number distinct new keys from ``size`` on, as far as there is room; how many went in."""
        keys = keys[: max(0, self.most - self.size)]
        numbers = np.arange(self.size, self.size + len(keys), dtype=np.int32)
        self.size += len(keys)
        at, left = (keys & self.mask).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = self.numbers[at] < 0
            self.numbers[at[free]] = numbers[left[free]]
            done = free & (self.numbers[at] == numbers[left])
            self.keys[at[done]] = keys[left[done]]
            left, at = left[~done], (at[~done] + 1) & int(self.mask)
        return len(numbers)
