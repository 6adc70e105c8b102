"""Words, shingles and hashes of whole columns of text in NumPy, straight from Arrow's buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Hashes are 64-bit: a polynomial over a
random value per byte, brought to the word's start and mixed. They depend on nothing but the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is taken alone.
SLICE = 1 << 19
_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M = np.uint64(0xD1342543DE82EF95)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _R)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, r in enumerate((_R, _RINV)):
            x = np.full(n, r)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    out = _powers[0][:n], _powers[1][:n]
    if n > 4 * SLICE:
        _powers[:] = [_powers[0][:SLICE].copy(), _powers[1][:SLICE].copy()]
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a column of strings; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets in them) of runs of rows of about SLICE bytes."""
    if not len(column):
        return
    raw, at = buffers(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE, "right")) - 1)
        j = min(j, n)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def small(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """The rows in batches of ``rows``, so that few texts are Python strings at a time."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def words(raw: np.ndarray, at: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: its hash, its text's row, its first byte and the byte after it."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    ink = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)  # a text starts here
    edge[at] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, ink[:-1]
    first = np.flatnonzero(ink & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, ink[1:]
    last = np.flatnonzero(ink & (~after | edge[1:])) + 1
    up, down = _power(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[raw] * up, out=total[1:])
    h = mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64) * _M)
    return h, np.searchsorted(at, first, "right") - 1, first, last


def shingles(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word of every run of ``k`` words of a text; fewer words make one shingle of all."""
    n = len(h)
    if not n:
        return h, row, np.zeros(0, np.int64)
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    size = np.diff(np.r_[start, n])
    left = np.repeat(start + size, size) - np.arange(n)  # words from here to the text's end
    whole = np.repeat(size, size)
    take = (left >= k) | ((whole < k) & (left == whole))
    pos = np.flatnonzero(take)
    acc = np.zeros(len(pos), np.uint64)
    p = np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(k):
            there = left[pos] > j
            acc += np.where(there, h[np.minimum(pos + j, n - 1)], np.uint64(0)) * p
            p = p * _M
    return mix(acc), row[pos], pos


def distinct(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes, ascending in each row, and the rows' offsets among them."""
    if len(h):
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        keep = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]
        h, row = h[keep], row[keep]
    return h, np.searchsorted(row, np.arange(rows + 1))


def reduce_rows(op: np.ufunc, values: np.ndarray, at: np.ndarray, empty) -> np.ndarray:
    """``op.reduceat`` over each row's values; ``empty`` for a row without any."""
    out = np.full(len(at) - 1, empty, values.dtype)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        out[full] = op.reduceat(values, at[full])
    return out
