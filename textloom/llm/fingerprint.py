"""Document fingerprints by one-permutation MinHash.

Every distinct five-word shingle of a text is hashed once; the hash's top bits name one of BINS bins, its
other bits are the value, and a bin keeps its smallest value. An empty bin is filled by optimal
densification: it draws bins from a sequence seeded by its own number, the same for every text, until it
meets one that was full, and copies that value. The lowest BITS bits of each bin, packed and written as hex,
are the fingerprint. Two fingerprints agree in a bin by chance with probability 2**-BITS, so their likeness
is (share of equal bins - 2**-BITS) / (1 - 2**-BITS), held within 0 and 1.

A null or blank text has no shingle: its fingerprint is the empty string, which is as likely as 1.0 to
another empty one and 0.0 to any other. Fewer than five words make one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W

SHINGLE, BIN_BITS, BITS = 5, 9, 4
BINS = 1 << BIN_BITS
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _densify(low: np.ndarray) -> np.ndarray:
    """Fill the bins that no shingle fell into; ``low`` has a row for each text with at least one shingle."""
    todo = low == _EMPTY
    full = ~todo
    row, col = np.nonzero(todo)
    out = low.copy()
    draw = np.uint64(0)
    while len(row):
        draw += np.uint64(1)
        pick = (W.mix(col.astype(np.uint64) * np.uint64(0x1000003) + draw) % np.uint64(BINS)).astype(np.int64)
        hit = full[row, pick]
        out[row[hit], col[hit]] = low[row[hit], pick[hit]]
        row, col = row[~hit], col[~hit]
    return out


def bins(column: pa.Array, k: int = SHINGLE) -> np.ndarray:
    """A row of BINS values of BITS bits for each text, -1 throughout for a text without words."""
    parts = []
    for i, j, raw, at in W.slices(column):
        h, row, _, _ = W.words(raw, at)
        h, row, _ = W.shingles(h, row, k)
        low = np.full((j - i) * BINS, _EMPTY)
        # the values of a bin meet by a sort of (bin, value), of which only the first of a bin counts
        cell = row * BINS + (h >> np.uint64(64 - BIN_BITS)).astype(np.int64)
        value = h & np.uint64((1 << (64 - BIN_BITS)) - 1)
        order = np.lexsort((value, cell))
        cell, value = cell[order], value[order]
        first = np.r_[True, cell[1:] != cell[:-1]] if len(cell) else np.zeros(0, bool)
        low[cell[first]] = value[first]
        low = low.reshape(j - i, BINS)
        some = (low != _EMPTY).any(axis=1)
        out = np.full((j - i, BINS), -1, np.int8)
        if some.any():
            out[some] = (_densify(low[some]) & np.uint64((1 << BITS) - 1)).astype(np.int8)
        parts.append(out)
    return np.concatenate(parts) if parts else np.zeros((0, BINS), np.int8)


def packed(b: np.ndarray) -> list[str]:
    """The fingerprints as hex, two bins to a byte."""
    byte = ((b[:, 0::2].astype(np.uint8) & 15) << 4) | (b[:, 1::2].astype(np.uint8) & 15)
    return [x.tobytes().hex() if r[0] >= 0 else "" for x, r in zip(byte, b, strict=True)]


def unpacked(fingerprints: list[str]) -> np.ndarray:
    """The bins of fingerprints that ``packed`` made."""
    out = np.full((len(fingerprints), BINS), -1, np.int8)
    for i, f in enumerate(fingerprints):
        if f:
            byte = np.frombuffer(bytes.fromhex(f), np.uint8)
            out[i, 0::2], out[i, 1::2] = byte >> 4, byte & 15
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The estimated Jaccard similarity of the texts behind two arrays of bins, row by row."""
    chance = 2.0**-BITS
    j = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)
    return np.where((a[:, 0] < 0) | (b[:, 0] < 0), ((a[:, 0] < 0) & (b[:, 0] < 0)).astype(float), j)


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of ``text_col`` as column ``out_col``."""
    docs = docs.drop(out_col)
    schema = docs.select("*", F.lit("").alias(out_col)).schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(packed(bins(b.column(at))), pa.string())], names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)


def likenesses(pairs: DataFrame, a: str, b: str, out_col: str = "likeness") -> DataFrame:
    """``pairs`` with the likeness of two columns of fingerprints; null where one is null."""
    pairs = pairs.drop(out_col)
    schema = pairs.select("*", F.lit(None).cast("double").alias(out_col)).schema
    i, j = pairs.columns.index(a), pairs.columns.index(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            p, q = x.column(i).to_pylist(), x.column(j).to_pylist()
            v = likeness(unpacked([y or "" for y in p]), unpacked([y or "" for y in q]))
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array([None if s is None or t is None else float(y) for s, t, y in zip(p, q, v, strict=True)], pa.float64())], names=[f.name for f in schema])

    return pairs.mapInArrow(run, schema)
