"""Substring dedup by content-defined chunking with a gear rolling hash.

A gear hash rolls over each text's bytes; its value at the end of a word depends on the last 16 bytes only.
A chunk ends after a word whose value is smaller than that of the REACH words on either side, so chunks have
REACH + 1 words at least, about 2 * REACH + 1 on average, and are cut alike wherever a passage stands: an
insertion moves the cuts next to it and no others. Where that leaves more than LONGEST words (texts that repeat
a word or a few have no smallest value), a cut follows every LONGEST / 2 words from the chunk's start on.

A run is the least stretch of neighbouring chunks, onward or back from a chunk, that has MIN_WORDS words. Runs are
compared by the digest of their chunks, so what is cut out is a stretch of MIN_WORDS words or more that stands as
a whole in one earlier place: an earlier document, by doc_id, or earlier in the same text. The first copy stays.
A repeated passage of 50 words is longer than that even without the partial chunks at its ends, which stay.

Null texts stay null, blank ones are left as they are. Rows with a null id neither give nor lose chunks.
Rows of one id are one document: each of its texts, told apart by 26 bits of a hash, loses what earlier
documents hold, they take nothing from each other. Columns pass through; n_chars, if there is one, follows the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._tables import table

REACH, MIN_WORDS, LONGEST = 3, 20, 32
_GEAR = W.mix(np.arange(7001, 7257, dtype=np.uint64))
_P = np.uint64(0xA0761D6478BD642F)
_PINV = np.uint64(pow(0xA0761D6478BD642F, -1, 1 << 64))
#: A place is one number: version of the text, first word (30 bits), words (6 bits, LONGEST + MIN_WORDS fits), whether the text has the run before.
_WORD, _VERSION = 7, 37


def gear(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, over the 16 bytes up to it that belong to its text."""
    h = _GEAR[raw]
    place = np.arange(len(raw)) - np.repeat(at[:-1], np.diff(at))
    for s in (1, 2, 4, 8):
        before = np.zeros_like(h)
        before[s:] = h[:-s] << np.uint64(s)
        before[place < s] = 0
        h = h + before
    return h & np.uint64(0xFFFF)


def cut(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each chunk: its text's row, its first word's number in the text, its number of words, its digest."""
    h, row, _, last = W.words(raw, at)
    n = len(h)
    if not n:
        return row, row, row, h
    # ties would make neighbours of equal words cut or not by place, so the word itself breaks none: no cut
    value = gear(raw, at)[last - 1].astype(np.int64)
    least = np.full(n + 2 * REACH, 1 << 62)
    least[REACH:-REACH] = value
    rows = np.full(n + 2 * REACH, -1)
    rows[REACH:-REACH] = row
    end = np.ones(n, bool)
    for s in range(1, REACH + 1):
        for d in (-s, s):
            other = slice(REACH + d, REACH + d + n)
            end &= (value < least[other]) | (rows[other] != row)
    end |= np.r_[row[1:] != row[:-1], True]
    stop = np.flatnonzero(end) + 1
    start = np.r_[0, stop[:-1]]
    half = LONGEST // 2
    more = np.where(stop - start > LONGEST, (stop - start - 1) // half, 0)  # cuts inside a chunk that is too long
    if more.any():
        k = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        stop = np.sort(np.r_[stop, np.repeat(start, more) + (k + 1) * half])
        start = np.r_[0, stop[:-1]]
    first = np.searchsorted(row, row[start])
    return row[start], start - first, stop - start, W.mix(_joined(h, start, stop))


def _joined(h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """One hash for each stretch of ``h``."""
    power = np.full((2, len(h) + 1), 1, np.uint64)
    power[0, 1:], power[1, 1:] = _P, _PINV
    power = np.multiply.accumulate(power, axis=1)
    total = np.r_[np.zeros(1, np.uint64), np.cumsum(h * power[0, :-1])]
    return (total[stop] - total[start]) * power[1, start]


def runs(row: np.ndarray, first: np.ndarray, n: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of the chunks of ``cut``: its row, first word, words, digest, and whether its text has it before."""
    k = np.arange(len(row))
    lo, hi = np.searchsorted(row, row, "left"), np.searchsorted(row, row, "right")
    words = np.r_[0, np.cumsum(n)]
    stop = np.searchsorted(words, words[:-1] + MIN_WORDS)
    start = np.searchsorted(words, words[1:] - MIN_WORDS, "right") - 1
    onward, back = stop <= hi, start >= lo
    # backward runs that are onward ones, too, count once
    again = np.zeros(len(k), bool)
    again[back] = onward[start[back]] & (stop[start[back]] == k[back] + 1)
    back &= ~again
    i, j = np.r_[k[onward], start[back]], np.r_[stop[onward], k[back] + 1]
    h = W.mix(_joined(digest, i, j) + (words[j] - words[i]).astype(np.uint64) * W._M)
    own = np.zeros(len(i), bool)
    if len(i):
        order = np.lexsort((first[i], h, row[i]))
        own[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (row[i][order[1:]] == row[i][order[:-1]])
    return row[i], first[i], words[j] - words[i], h, own


def version(c: str) -> Column:
    """What tells the texts of one id apart."""
    return F.shiftrightunsigned(F.xxhash64(c), 64 - 26)


def all_runs(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, place) of documents (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, versions = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for i, _, raw, at in W.slices(b.column(2)):
                row, first, n, digest, own = runs(*cut(raw, at))
                place = (versions[i + row] << _VERSION) + (first << _WORD) + (n << 1) + own
                yield pa.RecordBatch.from_arrays([pa.array(digest.view(np.int64)), pa.array(ids[i + row]), pa.array(place)], names=["digest", "doc_id", "place"])

    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), version("text").alias("version"), "text").mapInArrow(run, "digest long, doc_id long, place long")


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, places): the places of the runs that stand in an earlier document or earlier in their text."""
    held = all_runs(docs.select("doc_id", "text"))
    own = F.col("place") % 2 == 1
    first = held.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max(own.cast("int")).alias("own")).where("first < last or own = 1").select("digest", "first")
    first = table(first, "first")  # both sides of the join are then plain exchanges, which adaptive execution splits where a digest is hot
    later = held.join(first, "digest").where((F.col("doc_id") > F.col("first")) | own)
    return later.groupBy("doc_id").agg(F.sort_array(F.collect_set("place")).alias("places"))


def spans(places: list[int]) -> list[tuple[int, int]]:
    """The words (from, to) that the runs at ``places`` cover, in order."""
    out: list[list[int]] = []
    for p in places:
        first = p >> _WORD & (1 << _VERSION - _WORD) - 1
        stop = first + (p >> 1 & 63)
        if out and first <= out[-1][1]:
            out[-1][1] = max(stop, out[-1][1])
        else:
            out.append([first, stop])
    return [(a, b) for a, b in out]


def removed(text: str, gone: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """``text`` without the words of ``gone``, and the bytes (from, to) that went; the white space after a
    span goes with it, at the end of the text that before it."""
    data = text.encode()
    raw = np.frombuffer(data, np.uint8)
    _, _, first, _ = W.words(raw, np.array([0, len(raw)]))
    keep, done, went = [], 0, []
    for a, b in gone:
        if a >= len(first):
            break
        i, j = int(first[a]), int(first[b]) if b < len(first) else len(data)
        keep.append(data[done:i])
        done = j
        went.append((i, j))
    keep.append(data[done:])
    out = b"".join(keep)
    return (out.rstrip(b" \t\n\x0b\f\r") if done == len(data) else out).decode(), went


def substring_dedup(docs: DataFrame, out_col: str = "cut_spans") -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text`` and ``out_col``, the bytes that went; a column of
    that name is replaced."""
    docs = docs.drop(out_col)
    columns = docs.columns
    found = repeats(docs).toDF("_textloom_id", "_textloom_places")
    joined = docs.join(found, F.col("doc_id").cast("long") == F.col("_textloom_id"), "left").drop("_textloom_id")
    mine = F.filter("_textloom_places", lambda p: F.shiftrightunsigned(p, _VERSION) == version("text"))
    schema = docs.select("*", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("stop"))).alias(out_col)).schema
    t, c = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for b in batches:
            cols = list(b.columns)
            places, went = cols.pop(), [[] for _ in range(b.num_rows)]
            mask, texts = np.zeros(b.num_rows, bool), []
            for i in np.flatnonzero(pc.fill_null(pc.greater(pc.list_value_length(places), 0), False).to_numpy(zero_copy_only=False)):
                text, cut_out = removed(cols[t][i].as_py(), spans(places[i].as_py()))
                mask[i], went[i] = True, [{"start": x, "stop": y} for x, y in cut_out]
                texts.append(text)
            if texts:
                cols[t] = pc.replace_with_mask(cols[t], pa.array(mask), pa.array(texts, cols[t].type))
                if c is not None:
                    cols[c] = pc.replace_with_mask(cols[c], pa.array(mask), pa.array(list(map(len, texts)), cols[c].type))
            yield pa.RecordBatch.from_arrays([*cols, pa.array(went, kind)], names=[*columns, out_col])

    return joined.select(*columns, mine.alias("_textloom_places")).mapInArrow(run, schema)


def op1(spark, sf_dir: str) -> DataFrame:
    """Every document's text without its repeated passages, and what was cut."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    gone = F.aggregate("cut_spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return substring_dedup(docs).select("doc_id", "text", "cut_spans", gone.alias("cut_bytes"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages; a document of which nothing is left goes."""
    return substring_dedup(docs, "_textloom_cut").where("size(_textloom_cut) = 0 or trim(text) <> ''").select(*docs.columns)


QUERIES = {"op1_substring_dedup": op1}
