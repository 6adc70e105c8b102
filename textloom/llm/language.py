"""Language identification by bit-sliced Bloom filters that answer with a mask of languages.

``learn`` finds, for each language, the n-grams that stand in at least SHARE of its documents, and in at least CONTRAST of
the share that they have in any language. It reads about SAMPLE documents of each language (those whose hash of
id and length lies in the language's share of the range; a documented bound, whole texts), counts n-grams by document inside tasks and sums the counts in Spark; what is left is
bounded by the texts' length over SHARE. Every language has a Bloom filter of the same size and the same hash functions, and the filters lie
side by side: a cell holds one bit of each, so that the cells of an n-gram, joined by and, are the mask of all languages
that contain it.

``predicted`` looks up every n-gram of a text and counts each language's bits. A language whose filter is full to f has a
share p = f ** HASHES of false positives, so of n n-grams with c bits it has about (c - n * p) / (1 - p). The language with the most
decides (the first by name on a tie), and its part of all languages' counts is the score. An n-gram is NGRAMS code
points of the lower-cased text, all letters, or all but the first, or all but the last.

Null texts and texts without a letter are ``und`` with score 0. A text with letters and no known n-gram gets the most
frequent learned language and score 0; without any learned language everything is ``und``. Null languages teach nothing; a null
id hashes as null. Repeated rows and rows of one id are taken one by one. Columns other than id, text and
language are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W

NGRAMS, SAMPLE, SHARE, CONTRAST = (2, 3, 4), 1000, 0.02, 0.5
#: Hash functions and cells for each n-gram of the largest language.
HASHES, CELLS = 3, 8
#: Code points of a text that are worked on at once; a longer text is taken in pieces that overlap by an n-gram.
PIECE = 1 << 19
_R = np.uint64(0x9E3779B97F4A7C15)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of lower-cased code points with each one's text, a space before and after each text. Pieces of one run overlap
    by all but one code point of the longest n-gram, and only n-grams that start before the overlap belong to a piece."""
    low = [t.lower() for t in texts]
    code = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "replace"), np.uint32)
    row = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
    row = np.r_[row, len(low) - 1]  # a space belongs to the text after it
    for i in range(0, len(code), PIECE):
        yield code[i : i + PIECE + max(NGRAMS) - 1], row[i : i + PIECE + max(NGRAMS) - 1]


def grams(code: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hash and text of the n-grams that start in the first PIECE code points, for each length."""
    ink = letters()[code]
    c = np.where(ink, code, 0x20).astype(np.uint64)
    for n in NGRAMS:
        m = min(len(c) - n + 1, PIECE)
        if m <= 0:
            continue
        inside = ink[1 : m + 1].copy() if n > 2 else np.ones(m, bool)
        for k in range(2, n - 1):
            inside &= ink[k : m + k]
        at = np.flatnonzero(inside & (ink[:m] | ink[n - 1 : m + n - 1]))
        h = np.full(len(at), np.uint64(n))
        for k in range(n):
            h = h * _R + c[at + k]
        yield W.mix(h), row[np.where(ink[at], at, at + 1)]


def masks(filters: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The masks of languages for hashes of n-grams: (planes, n-grams), eight languages to a plane."""
    size = np.uint64(filters.shape[1] - 1)
    step = (h >> np.uint64(32)) | np.uint64(1)
    out = filters[:, (h & size).astype(np.int64)]
    for k in range(1, HASHES):
        out &= filters[:, ((h + np.uint64(k) * step) & size).astype(np.int64)]
    return out


def filled(h: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Filters (planes, cells) for n-grams of hash ``h`` with their masks (planes, n-grams)."""
    most = max(1, int(max(((mask >> b) & 1).sum(axis=1).max() for b in range(8)))) if len(h) else 1
    cells = 1 << (CELLS * most - 1).bit_length()
    out = np.zeros((len(mask), cells), np.uint8)
    step = (h >> np.uint64(32)) | np.uint64(1)
    for k in range(HASHES):
        at = ((h + np.uint64(k) * step) & np.uint64(cells - 1)).astype(np.int64)
        for p in range(len(mask)):
            np.bitwise_or.at(out[p], at, mask[p])
    return out


@dataclass
class Model:
    """Learned languages in the order of their bits, their filters and false-positive shares, and the most frequent one."""

    names: list[str]
    filters: np.ndarray
    wrong: np.ndarray
    usual: str

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: its n-grams, and the bits of each language among their masks."""
        planes = len(self.filters)
        seen, hits = np.zeros(len(texts), np.int64), np.zeros((len(texts), planes * 8))
        bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
        for code, row in pieces(texts):
            for h, r in grams(code, row):
                seen += np.bincount(r, minlength=len(texts))
                for p, m in enumerate(masks(self.filters, h)):
                    table = np.bincount(r * 256 + m, minlength=256 * len(texts)).reshape(len(texts), 256)
                    hits[:, 8 * p : 8 * p + 8] += table @ bits
        return seen, hits[:, : len(self.names)]

    def decide(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language and score of each text."""
        if not self.names or not texts:
            return ["und"] * len(texts), [0.0] * len(texts)
        seen, hits = self.counts([t or "" for t in texts])
        true = np.maximum(0.0, hits - seen[:, None] * self.wrong) / np.maximum(1e-12, 1 - self.wrong)
        best, total = true.argmax(axis=1), true.sum(axis=1)
        names, scores = [], []
        for k, t in enumerate(texts):
            some = bool(t) and any(map(str.isalpha, t))
            names.append("und" if not some else self.names[best[k]] if total[k] > 0 else self.usual)
            scores.append(float(true[k, best[k]] / total[k]) if some and total[k] > 0 else 0.0)
        return names, scores


def _documents_of_grams(sample: DataFrame) -> DataFrame:
    """(lang, gram, n): in how many texts of ``sample`` (lang, text) of a task's batch each n-gram stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                found = []
                for k in np.flatnonzero(langs == lang):
                    parts = [h for code, row in pieces([b.column(1)[int(k)].as_py()]) for h, _ in grams(code, row)]
                    found.append(np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64))
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    return sample.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")


def learn(docs: DataFrame, sample: int = SAMPLE, share: float = SHARE, contrast: float = CONTRAST) -> Model:
    """The filters of the languages of ``docs`` (doc_id, text, lang), all of which may be learned from."""
    known = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    total = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not total:
        return Model([], np.zeros((1, 1), np.uint8), np.zeros(0), "und")
    names = sorted(total)
    # each language's share of the range of hashes: no sort and no task that a language meets in
    rates = F.create_map(*(x for k, v in total.items() for x in (F.lit(k), F.lit(min(1.0, sample / v)))))
    mark = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 40)) / float(1 << 40)
    picked = known.where(mark < F.element_at(rates, F.col("lang")))
    size = {r.lang: r.n for r in picked.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not size:
        return Model([], np.zeros((1, 1), np.uint8), np.zeros(0), "und")
    counted = _documents_of_grams(picked.repartition("lang", F.xxhash64("doc_id", "text"))).groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    parts = F.create_map(*(x for k, v in size.items() for x in (F.lit(k), F.lit(float(v)))))
    rows = counted.withColumn("share", F.col("n") / F.element_at(parts, F.col("lang"))).groupBy("gram").agg(F.max("share").alias("most"), F.collect_list(F.struct("lang", "share")).alias("of"))
    kept = F.transform(F.filter("of", lambda x: (x["share"] >= share) & (x["share"] >= contrast * F.col("most"))), lambda x: x["lang"])
    found = rows.where(F.col("most") >= share).select("gram", kept.alias("langs")).toArrow()  # at most n-grams of a text over SHARE for each language
    h = np.asarray(found.column("gram")).view(np.uint64)
    mask = np.zeros((-(-len(names) // 8), len(h)), np.uint8)
    langs = found.column("langs").combine_chunks()
    at = np.asarray(langs.offsets, np.int64)
    number = {x: k for k, x in enumerate(names)}
    code = np.array([number[x] for x in langs.values.to_pylist()], np.int64)
    gram = np.repeat(np.arange(len(h)), np.diff(at))
    np.bitwise_or.at(mask, (code // 8, gram), (1 << (code % 8)).astype(np.uint8))
    filters = filled(h, mask)
    full = np.array([((filters[k // 8] >> (k % 8)) & 1).mean() for k in range(len(names))])
    return Model(names, filters, full**HASHES, min(names, key=lambda x: (-total[x], x)))


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of documents (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # cells are bounded by learn()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.small(batches):
            names, scores = held.value.decide(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op12(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return predicted(docs, learn(docs.where(~held))).select("doc_id", held.alias("held_out"), "lang_pred", "score")


QUERIES = {"op12_language_id": op12}
