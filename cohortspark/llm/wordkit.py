"""Numpy kernels over the texts of Arrow batches: bytes, words, rolling hashes and sliding minima.

Hashes are 64-bit sums of unit codes times powers of an odd base, so the hash of any run of units is a difference of
two running sums. All functions work on one portion of rows; none keeps state between portions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C13
INVERSE = pow(BASE, -1, 1 << 64)
#: Text bytes that one portion holds; a longer text is a portion of its own.
PORTION = 1 << 20

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
BYTE_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit codes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = max(n, 1 << 16)
        known = np.full(size, base, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if size <= 8 * PORTION:
            _POWERS[base] = known
    return known[:n]


def running(codes: np.ndarray) -> np.ndarray:
    """Running sums from which `span_hash` takes the hash of any run."""
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(BASE, len(codes)), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of the units [start, stop), independent of where they stand."""
    return mix((sums[stop] - sums[start]) * powers(INVERSE, len(sums))[start])


def gram_hash(sums: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k units that begin at each position; empty when there are fewer."""
    n = len(sums) - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((sums[k:] - sums[:n]) * powers(INVERSE, n))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins (one more at the end); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def portions(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PORTION) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds at most `limit` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


@dataclass
class Words:
    """Words of a portion: byte range of each, and the first word of each row (one more at the end)."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, data: np.ndarray | None = None) -> np.ndarray:
        """Hash of each word, of `data` in place of the bytes if given."""
        return span_hash(running(BYTE_CODE[self.data if data is None else data]), self.start, self.stop)


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Maximal runs of bytes other than space and the controls 9 to 13; no run goes over the end of a row."""
    n = len(data)
    inside = ~SEPARATOR[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    stop = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(data, offsets, start, stop, np.searchsorted(start, offsets))


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (count[i] of them) for all i, one after the other."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(count) - count
    return np.arange(total) - np.repeat(begin - first, count)


def covered(size: int, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Flags of the positions that lie in one of the ranges [start, start + length)."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:size]) > 0


def window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each `width` neighbours, by minima from both ends of blocks."""
    n = len(x)
    if n < width:
        return x[:0]
    blocks = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - width + 1], left[width - 1:n])
