"""Sentences of a text laid over the boxes of its layout, which may cut it at other places."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Characters of a document's key in one bucket of the overlap join, and of a part's key at least.
BUCKET, LEAST = 256, 3


def _parts(sentences: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, part, key): a sentence's lines that are not blank, or the sentence if all are."""
    lines = F.filter(F.transform(F.split("sentence", "[\\n\\r]+"), T.strip), lambda x: x != "")
    d = sentences.select("doc_id", "sent_idx", F.posexplode(F.when(F.size(lines) > 0, lines).otherwise(F.array("sentence"))).alias("part", "_text"))
    return d.select("doc_id", "sent_idx", "part", T.align_key("_text").alias("key"))


def spans(sentences: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, part, start, stop): where the key of each part of a sentence stands in its document's key (doc_id,
    key). Each is looked for after the one before it, then from the start; what is nowhere, or shorter than LEAST, has no row.
    A short one that stands right after the one before it moves the place, so that no later one is found inside it."""
    parts = _parts(sentences).where(F.length("key") > 0)
    told = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_idx", "part", F.col("key").alias("of")))).alias("parts"))  # of one document
    schema = "doc_id long, sent_idx int, part int, start int, stop int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                doc_id, key, at, out = b.column(0)[k].as_py(), b.column(1)[k].as_py(), 0, []
                for p in b.column(2)[k].as_py():
                    if len(p["of"]) < LEAST:
                        at += len(p["of"]) if key.startswith(p["of"], at) else 0
                        continue
                    found = key.find(p["of"], at)
                    if found < 0:
                        found = key.find(p["of"])
                    if found >= 0:
                        at = found + len(p["of"])
                        out.append((doc_id, p["sent_idx"], p["part"], found, at))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), *[pa.int32()] * 4), strict=True)], names=["doc_id", "sent_idx", "part", "start", "stop"])

    return keys.select(F.col("doc_id").cast("long"), "key").join(told, "doc_id").mapInArrow(run, schema)


def aligned(sentences: DataFrame, boxes: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, part, box_idx) of sentences (doc_id, sent_idx, sentence) and boxes (doc_id, box_idx, text) in reading
    order: the boxes that a part of a sentence lies in, those without letters between them included.

    Boxes and parts are ranges of the document's key, which is the text without white space and marks; ranges that
    overlap meet by document and bucket of BUCKET characters, so a document's sentences are not compared with all its boxes.
    Null texts are empty; rows with a null id have no place.
    """
    b = boxes.where("doc_id is not null and box_idx is not null").select("doc_id", "box_idx", T.align_key(F.coalesce("text", F.lit(""))).alias("_key"))
    before = Window.partitionBy("doc_id").orderBy("box_idx").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("_to", F.sum(F.length("_key")).over(before).cast("int")).withColumn("_from", F.col("_to") - F.length("_key"))
    keys = b.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("box_idx", "_key"))), lambda x: x["_key"]), "").alias("key"))
    s = spans(sentences.where("doc_id is not null and sentence is not null"), keys)
    bucket = lambda c: F.floor(F.col(c) / BUCKET).cast("int")
    last = lambda c: F.floor((F.col(c) - 1) / BUCKET).cast("int")
    s = s.withColumn("_bucket", F.explode(F.sequence(bucket("start"), last("stop"))))
    b = b.select("doc_id", "box_idx", "_from", "_to", F.explode(F.sequence(bucket("_from"), F.greatest(bucket("_from"), last("_to")))).alias("_bucket"))
    j = s.join(b, ["doc_id", "_bucket"]).where((F.col("_from") < F.col("stop")) & (F.col("_to") > F.col("start")) & (F.col("_bucket") == F.greatest(bucket("start"), bucket("_from"))))
    return j.select("doc_id", "sent_idx", "part", "box_idx")
