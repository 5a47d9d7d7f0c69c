"""Whole-column text kernels in numpy: a batch's texts lie end to end in one byte array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MASK = (1 << 64) - 1
#: Odd multiplier of the rolling word hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
#: Bytes of text worked on at once; a longer single text is still taken whole.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64((seed * 2 + 1) & MASK) + np.uint64(0x632BE59BD9B4E019))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Powers:
    """Powers of BASE and of its inverse, grown as texts need them."""

    def __init__(self):
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + 1)
            step = np.full(size, BASE, dtype=np.uint64)
            step[0] = 1
            self.up = np.multiply.accumulate(step)
            step[1:] = BASE_INV
            self.down = np.multiply.accumulate(step)
        return self.up, self.down


POWERS = Powers()


def prefix_hash(buf: np.ndarray, table: np.ndarray) -> np.ndarray:
    """c with c[j] - c[i] the weighted sum of bytes i..j; see span_hash."""
    up, _ = POWERS.get(len(buf) + 1)
    c = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(table[buf] * up[: len(buf)], out=c[1:])
    return c


def span_hash(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span's bytes, the same wherever the span lies."""
    _, down = POWERS.get(len(c))
    return mix((c[ends] - c[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    n = len(column)
    if n == 0:
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    _, off, data = column.buffers()
    offs = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return offs - offs[0], raw[offs[0] : offs[-1]]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets from 0, bytes) for runs of rows of at most limit bytes, one row at least."""
    offs, raw = buffers(column)
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, offs[i : j + 1] - offs[i], raw[offs[i] : offs[j]]
        i = j


def word_spans(offs: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each text) of the runs of non-space bytes; a word never spans two texts."""
    inside = ~IS_SPACE[raw]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    if len(raw):
        after[-1] = False
        edge = offs[:-1][offs[:-1] < len(raw)]
        before[edge] = False
        edge = offs[1:][offs[1:] > 0] - 1
        after[edge] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def long_list(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """list<int64> with counts[i] of the values in row i."""
    off = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64)))
