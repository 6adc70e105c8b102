"""Fingerprints of every document, of its edited text and their likeness to it and to the next document.

Documents are dealt into ranges of ascending id, one for each shuffle partition, and the first document of each
range is also given to the range before it, so every task can read its rows in order and hold two at a time.

Null texts are empty. Null ids are left out. Rows of one id follow each other in the order of their texts; the last
document's next one is the first. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from . import fingerprint as P

#: Rows that are worked on at once.
BATCH = 64


def edited(text: str, after: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``after`` as there is."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` (doc_id, text) in ascending order inside tasks, each range followed by its successor's
    first row, which has ``extra`` = 1. Rows of one id are ordered by their text; null ids are left out."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("doc_id is not null")
    least, cuts = d.agg(F.min("doc_id"), F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()
    # the ranges' first ids, all of them ids of rows: one literal, in which a row's range is found by binary search
    firsts = sorted({least, *((cuts or []) if n > 1 else [])} - {None}) or [0]
    known = F.split(F.lit(",".join(map(str, firsts))), ",").cast("array<long>")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(firsts).bit_length()))))
    place = F.aggregate(steps, F.lit(0), lambda p, s: F.when((p + s <= len(firsts)) & (F.get(known, p + s - 1) <= F.col("doc_id")), p + s).otherwise(p))
    d = d.withColumn("range", place - 1)
    first = F.get(known, F.col("range")) == F.col("doc_id")
    heads = d.where(first).groupBy("doc_id", F.pmod(F.col("range") - 1, F.lit(len(firsts))).cast("int").alias("range")).agg(F.min("text").alias("text"))
    both = d.withColumn("extra", F.lit(0)).unionByName(heads.withColumn("extra", F.lit(1)))
    return both.repartitionById(len(firsts), F.col("range")).sortWithinPartitions("extra", "doc_id", "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare(ordered: DataFrame) -> DataFrame:
    """The fingerprints and likenesses of the rows of ``with_next``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of the range, the last without its successor yet

        def work(rows: list[tuple]) -> pa.RecordBatch:
            """``rows`` in order; the last is only a successor."""
            texts = [r[1] for r in rows]
            made = [edited(t, u) for t, u in zip(texts, texts[1:], strict=False)]
            own, new = P.bins(pa.array(texts, pa.large_string())), P.bins(pa.array(made, pa.large_string()))
            return pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows[:-1]], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(m.encode()).hexdigest() for m in made], pa.string()),
                pa.array(P.packed(own[:-1]), pa.string()), pa.array(P.packed(new), pa.string()),
                pa.array(P.likeness(own[:-1], new)), pa.array(P.likeness(own[:-1], own[1:])),
            ], names=[f.split()[0] for f in SCHEMA.split(", ")])

        for b in W.small(batches, BATCH):
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(row)
                if len(held) > BATCH:
                    yield work(held)
                    held = held[-1:]
        if len(held) > 1:
            yield work(held)

    return ordered.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op4(spark, sf_dir: str) -> DataFrame:
    """Every document, its edited text and the next document."""
    return compare(with_next(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op4_document_fingerprints": op4}
