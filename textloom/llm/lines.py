"""Line dedup by pairwise alignment of documents that share rare lines.

Lines are compared by a hash of their trimmed text. A ``run`` is the least stretch of neighbouring lines, onward
or back from a line, that has MIN_WORDS words; most are one line. Overlapping documents are found through runs:
a rare one (in RARE documents at most) makes the later document a partner of the nearest earlier document with it and of
the first, a more frequent one of the first only. So pairs are at most twice as many as a document's own runs, and no
line is too frequent to be followed. Only the places of shared runs are shuffled, never another document's lines.

A later document takes its partners one by one, that first with which it shares most, each run counting as one over its
documents, and is aligned with each over what no partner before has: by patience diff, whose anchors are the runs that are
unique on both sides and stand in the same order (longest increasing subsequence), the stretches between them in the same
way; of a run that a document has more than once, the k-th meets the k-th. The diff decides: aligned runs that overlap or touch in
both documents are one block, and its lines are deleted from the later document. What the diff leaves, as its order is
another, is aligned once more up to REMAINDERS times, and of that only blocks of MOVED lines or more are deleted: a single line
that stands elsewhere stays.

Null and blank texts have no lines and stay as they are, rows with a null id too. Rows of one id are one document:
each of its texts loses what earlier documents hold, they take nothing from each other. Blank lines belong to a
run only between its lines. Columns pass through; n_chars, if there is one, follows the text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _words as W
from ._tables import table

MIN_WORDS, RARE, REMAINDERS, MOVED = 5, 32, 3, 2
_WS = "[\\x20\\x09-\\x0D]+"
_P = np.uint64(0xA0761D6478BD642F)
_PINV = np.uint64(pow(0xA0761D6478BD642F, -1, 1 << 64))


def hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, version, lines): of each line its hash and number of words, 0 for a blank one."""
    line = lambda x: F.struct(F.xxhash64(x).alias("h"), F.when(x == "", 0).otherwise(F.size(F.split(x, " "))).alias("n"))
    tidy = F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, _WS, " ")))
    d = docs.where("doc_id is not null and text is not null")
    return d.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), F.transform(tidy, line).alias("lines"))


def runs(h: np.ndarray, n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run: its document, the numbers there of its first line and of the line after it, the hash of it and of how
    often the document has had it.
    ``h``, ``n``: hashes and words of all lines; ``at``: where the documents start among them, and the end."""
    full = np.flatnonzero(n > 0)
    doc = np.searchsorted(at, full, "right") - 1
    lo, hi = np.searchsorted(doc, doc, "left"), np.searchsorted(doc, doc, "right")
    words = np.r_[0, np.cumsum(n[full], dtype=np.int64)]
    k = np.arange(len(full))
    stop = np.searchsorted(words, words[:-1] + MIN_WORDS)  # onward from line k
    start = np.searchsorted(words, words[1:] - MIN_WORDS, "right") - 1  # back from line k
    onward, back = stop <= hi, start >= lo
    pairs = np.unique(np.r_[np.c_[k, stop][onward], np.c_[start, k + 1][back]], axis=0)
    i, j = pairs[:, 0], pairs[:, 1]
    power = np.full((2, len(full) + 1), 1, np.uint64)
    power[0, 1:], power[1, 1:] = _P, _PINV
    power = np.multiply.accumulate(power, axis=1)
    total = np.r_[np.zeros(1, np.uint64), np.cumsum(h[full] * power[0, :-1])]
    digest = W.mix((total[j] - total[i]) * power[1, i] + (j - i).astype(np.uint64) * W._M)
    # the k-th time that a document has a run is a run of its own
    order = np.lexsort((i, digest, doc[i])) if len(i) else i
    again = np.zeros(len(i), np.uint64)
    if len(i):
        fresh = np.r_[True, (digest[order][1:] != digest[order][:-1]) | (doc[i][order][1:] != doc[i][order][:-1])]
        start_of = np.maximum.accumulate(np.where(fresh, np.arange(len(i)), 0))
        again[order] = (np.arange(len(i)) - start_of).astype(np.uint64)
    digest = np.where(again > 0, W.mix(digest + again * W._M), digest)
    first = at[doc[i]] if len(i) else i
    return doc[i], full[i] - first, full[j - 1] + 1 - first, digest


def all_runs(docs: DataFrame) -> DataFrame:
    """(h, doc_id, version, p, q): the runs of every document, lines p to q - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            at, line = lists.offsets.to_numpy().astype(np.int64), lists.values
            h, n = line.field(0).to_numpy().view(np.uint64), line.field(1).to_numpy().astype(np.int64)
            doc, p, q, digest = runs(h[at[0]:at[-1]], n[at[0]:at[-1]], at - at[0])
            ids = [b.column(k).to_numpy()[doc] for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(digest.view(np.int64)), *map(pa.array, ids), pa.array(p.astype(np.int32)), pa.array(q.astype(np.int32))], names=["h", "doc_id", "version", "p", "q"])

    return hashed(docs).mapInArrow(run, "h long, doc_id long, version long, p int, q int")


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of ``pairs`` (ascending by the first) that ascends by the second, too."""
    tails: list[int] = []
    where: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        back.append(where[p - 1] if p else -1)
        tails[p:p + 1] = [j]
        where[p:p + 1] = [k]
    out, k = [], where[-1] if where else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _numbered(x: list[int]) -> Iterator[tuple[int, int]]:
    """Each item with the number of its equals before it."""
    seen: Counter = Counter()
    for v in x:
        yield v, seen[v]
        seen[v] += 1


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """The aligned places (in a, in b), ascending."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i2, j, j2 = todo.pop()
        while i < i2 and j < j2 and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            out.append((i2, j2))
        if i == i2 or j == j2:
            continue
        na, nb = Counter(a[i:i2]), Counter(b[j:j2])
        place = {b[q]: q for q in range(j, j2) if nb[b[q]] == 1}
        anchors = _increasing([(p, place[a[p]]) for p in range(i, i2) if na[a[p]] == 1 and a[p] in place])
        if not anchors:  # no line is unique on both sides: the k-th of a line meets the k-th
            place = {x: q for q, x in zip(range(j, j2), _numbered(b[j:j2]), strict=True)}
            anchors = _increasing([(p, place[x]) for p, x in zip(range(i, i2), _numbered(a[i:i2]), strict=True) if x in place])
        p0, q0 = i, j
        for p, q in anchors:
            out.append((p, q))
            todo.append((p0, p, q0, q))
            p0, q0 = p + 1, q + 1
        if anchors:
            todo.append((p0, i2, q0, j2))
    return sorted(out)


def _blocks(mine: list[tuple], theirs: list[tuple]) -> list[list[tuple[tuple, tuple]]]:
    """The aligned runs of ``mine`` (p, q, h) and ``theirs`` (place, lines, h), by blocks that overlap or touch in both documents."""
    out: list[list] = []
    for i, j in patience([x[2] for x in mine], [x[2] for x in theirs]):
        x, y = mine[i], theirs[j]
        if out:
            first, last = out[-1][0], max(z[0][1] for z in out[-1])
        if out and first[0][0] <= x[0] <= last and y[0] - first[1][0] == x[0] - first[0][0]:
            out[-1].append((x, y))
        else:
            out.append([(x, y)])
    return out


def aligned(shared: list[tuple[int, int, int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The blocks (start, stop, other, start in other) to delete from a document; ``shared``: its runs (p, q, hash,
    partner, place in the partner, documents with the run)."""
    gone: set[int] = set()
    out: list[tuple[int, int, int, int]] = []
    by: dict[int, list[tuple[int, int, int, int]]] = {}
    weight: dict[int, dict[int, float]] = {}
    for p, q, h, other, place, df in shared:
        by.setdefault(other, []).append((p, q, h, place))
        weight.setdefault(other, {})[h] = 1 / df
    for other in sorted(by, key=lambda e: (-round(sum(weight[e].values()), 9), e)):
        mine = sorted({x[:3] for x in by[other] if not all(k in gone for k in range(x[0], x[1]))})
        theirs = sorted({(place, q - p, h) for p, q, h, place in by[other]})
        for step in range(1 + REMAINDERS):
            found = _blocks(mine, theirs)
            if step:
                found = [x for x in found if max(m[1] for m, _ in x) - x[0][0][0] >= MOVED]
            if not found:
                break
            for block in found:
                p, q = block[0][0][0], max(m[1] for m, _ in block)
                out.append((p, q, other, block[0][1][0]))
                gone.update(range(p, q))
            met = {m for block in found for m, _ in block}, {t for block in found for _, t in block}
            mine, theirs = [x for x in mine if x not in met[0] and not all(k in gone for k in range(x[0], x[1]))], [x for x in theirs if x not in met[1]]
    return sorted(out)


def deletions(docs: DataFrame) -> DataFrame:
    """(doc_id, version, gone, kept, blocks): the numbers of the lines to delete, whether each line up to the last of
    them stays, and the aligned blocks."""
    held = table(all_runs(docs), "runs")
    first = held.groupBy("h").agg(F.min("doc_id").alias("other"), F.min_by("p", "doc_id").alias("place"), F.max("doc_id").alias("last"), F.count("*").alias("df")).where("other < last").drop("last")
    first = table(first, "holders")  # both sides of the join are then plain exchanges, which adaptive execution splits where a run is hot
    later = held.join(first, "h").where("doc_id > other")
    # the nearest earlier document with a rare run, if it is not the first: at most RARE documents in a group. The group is
    # named by another number than the join's key, so its rows are dealt out after the join, which is then free to be split
    # where a run is hot
    rare = later.where(F.col("df") <= RARE).withColumn("_group", F.col("h").bitwiseXOR(F.lit(1)))
    before = Window.partitionBy("_group").orderBy("doc_id").rangeBetween(Window.unboundedPreceding, -1)
    near = rare.withColumn("_near", F.max(F.struct("doc_id", (-F.col("p")).alias("back"))).over(before)).where("_near is not null")
    later = later.unionByName(near.select("h", "doc_id", "version", "p", "q", F.col("_near.doc_id").alias("other"), (-F.col("_near.back")).alias("place"), "df"))
    mine = later.groupBy("doc_id", "version").agg(F.collect_set(F.struct("p", "q", "h", "other", "place", "df")).alias("shared"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("other", pa.int64()), ("place", pa.int32())]))
        for b in batches:
            gone, kept, blocks = [], [], []
            for i in range(b.num_rows):
                shared = b.column(2)[i].values
                found = aligned(list(zip(*(shared.field(k).to_pylist() for k in range(6)), strict=True)))
                lost = {k for p, q, _, _ in found for k in range(p, q)}
                gone.append(sorted(lost))
                kept.append([k not in lost for k in range(max(lost) + 1)])
                blocks.append([dict(zip(("start", "stop", "other", "place"), f, strict=True)) for f in found])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(gone, pa.list_(pa.int32())), pa.array(kept, pa.list_(pa.bool_())), pa.array(blocks, block)], names=["doc_id", "version", "gone", "kept", "blocks"])

    return mine.mapInArrow(run, "doc_id long, version long, gone array<int>, kept array<boolean>, blocks array<struct<start:int,stop:int,other:long,place:int>>")


def line_dedup(docs: DataFrame, out_col: str = "gone", blocks_col: str | None = None) -> DataFrame:
    """``docs`` without the lines that ``deletions`` names, whose numbers come as ``out_col``, null where none go, and
    the aligned blocks as ``blocks_col``, if it is given; columns of these names are replaced."""
    docs = docs.drop(out_col, *[blocks_col] * bool(blocks_col))
    found = deletions(docs.select("doc_id", "text")).toDF("_textloom_id", "_textloom_version", "_textloom_gone", "_textloom_kept", "_textloom_blocks")
    d = docs.join(found, (F.col("doc_id").cast("long") == F.col("_textloom_id")) & (F.xxhash64("text") == F.col("_textloom_version")), "left")
    kept = F.filter(F.split("text", "\n"), lambda x, i: F.coalesce(F.get("_textloom_kept", i), F.lit(True)))
    text = F.when(F.col("_textloom_kept").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    d = d.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        d = d.withColumn("n_chars", F.when(F.col("_textloom_kept").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    more = [F.col("_textloom_blocks").alias(blocks_col)] if blocks_col else []
    return d.select(*docs.columns, F.col("_textloom_gone").alias(out_col), *more)


def op8(spark, sf_dir: str) -> DataFrame:
    """Every document's text without the blocks that earlier documents hold, and those blocks."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs, blocks_col="blocks").select("doc_id", "text", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted_lines"), "gone", "blocks")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated blocks of lines; a document of which nothing is left goes."""
    out = line_dedup(docs, "_textloom_out")
    return out.where(F.col("_textloom_out").isNull() | F.col("text").rlike("[^\\x20\\x09-\\x0D]")).select(*docs.columns)


QUERIES = {"op8_line_dedup": op8}
