"""Vectorised work on whole texts as UTF-8 bytes.

A batch of texts is one ``uint8`` array with row offsets.  ``hashes`` sums the mixed
eight-byte pieces of each slice, so words and windows of any length are hashed without
a Python object each, and no string is like another by construction.  ``prefix`` and
``slices`` (a polynomial modulo 2**64, any slice in constant time) are for short slices
of many overlapping windows only: strings of 1,024 bytes can agree by construction there.
"""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = pow(int(BASE), -1, 1 << 64)
TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, (1 << 20) + 4096)
        for k, base in enumerate((BASE, np.uint64(_INV))):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0][:n], _powers[1][:n]


def prefix(data: np.ndarray, table: np.ndarray = TABLE) -> np.ndarray:
    """``p`` with ``len(data) + 1`` entries; see ``slices``."""
    power, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * power[: len(data)], out=out[1:])
    return out


def slices(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[start:end]``; equal slices have equal hashes wherever they lie."""
    _, inverse = powers(len(p))
    return mix((p[end] - p[start]) * inverse[start] + (end - start).astype(np.uint64))


_STEP, _SIZE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9FB21C651E98DF25)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[start:end]``: the sum of their mixed pieces of eight bytes, each mixed with its place."""
    n = end - start
    packed = np.zeros(len(data) // 8 + 2, np.uint64)
    packed.view(np.uint8)[: len(data)] = data

    def load(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        k, low = at >> 3, ((at & 7) << 3).astype(np.uint64)
        piece = packed[k] >> low
        piece |= np.where(low > 0, packed[k + 1] << (np.uint64(64) - np.maximum(low, np.uint64(1))), np.uint64(0))
        return piece & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - np.minimum(left, 8)) << 3).astype(np.uint64))

    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n > 0)
    out[full] = mix(load(start[full], n[full]) ^ _STEP)
    more = np.flatnonzero(n > 8)
    if len(more):
        count = (n[more] - 1) >> 3
        edge = np.cumsum(count) - count
        k = np.arange(1, int(count.sum()) + 1) - np.repeat(edge, count)
        at = np.repeat(start[more], count) + 8 * k
        rest = mix(load(at, np.repeat(end[more], count) - at) ^ mix((k + 1).astype(np.uint64) * _STEP))
        out[more] += np.add.reduceat(rest, edge)
    return mix(out + n.astype(np.uint64) * _SIZE)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches, most: int = 1 << 20, column: str | int = "text"):
    """Arrow batches cut by rows to about ``most`` bytes of text; a longer text stays whole, alone."""
    for batch in batches:
        col = batch.column(column)
        lengths = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
        total, at = 0, 0
        for i, n in enumerate(lengths):
            if i > at and total + n > most:
                yield batch.slice(at, i - at)
                total, at = 0, i
            total += n
        if at < batch.num_rows:
            yield batch.slice(at)
    release()


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def release() -> None:
    """Give freed memory back to the system: a worker outlives its tasks, and the JVM beside it needs the room."""
    pa.default_memory_pool().release_unused()
    if libc := _libc():
        libc.malloc_trim(0)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True):
    """Runs without ``[\\x20\\x09-\\x0D]``, never across rows, A-Z lower-cased: (start, end, row, hash)."""
    data = _LOWER[data] if lower else data
    start, end, row = runs(~_SPACE[data], offsets)
    return start, end, row, hashes(data, start, end)


def lists(values: np.ndarray, counts: np.ndarray, kind) -> pa.Array:
    """A list column of consecutive runs of ``values``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of marked bytes, never across rows: (start, end, row)."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(inside))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, "right") - 1
