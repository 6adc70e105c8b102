"""Packing into optimal length buckets and token-budget batches.

A document's length is its number of words. The global histogram of lengths goes through a dynamic programme that
chooses the ``buckets`` boundaries with the least padding. Up to EXACT every length is a row of the histogram; above
it lengths share one of 128 rows for each doubling, which bounds the histogram whatever the corpus, and a row has
its largest length and the sum of its lengths. So padding is counted exactly, every boundary is the length of a
document, and only the choice of boundaries above EXACT is among 128 for each doubling. Documents then form batches inside
their bucket, in ascending doc_id: a batch of a bucket with boundary b has budget // b documents, one at
least, so its padded size stays within the budget unless a single document exceeds that.

Null and blank texts have length 0 and are packed with the shortest. Ties and null ids take any order among
themselves, repeated rows are packed one by one. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tables import join_small, table

BUCKETS, BUDGET, EXACT = 12, 16384, 2048


def boundaries(lengths: list[int], counts: list[int], buckets: int = BUCKETS, sums: list[int] | None = None) -> list[int]:
    """At most ``buckets`` ascending boundaries, each one of ``lengths``, that pad the histogram least. ``sums``: the sum
    of the lengths of each row, if a row's documents are not all of its length but of that at most."""
    if not lengths:
        return []
    x, c = np.array(lengths, np.int64), np.array(counts, np.int64)
    n, k = len(x), min(buckets, len(lengths))
    docs, words = np.r_[0, np.cumsum(c)], np.r_[0, np.cumsum(c * x if sums is None else np.array(sums, np.int64))]
    best = x * docs[1:] - words[1:]  # one bucket for the first lengths, up to each
    cut = np.zeros((k, n), np.int64)
    for level in range(1, k):
        new = best.copy()
        for j in range(level, n):
            # the last bucket has the lengths i + 1 .. j
            cost = best[level - 1:j] + x[j] * (docs[j + 1] - docs[level:j + 1]) - (words[j + 1] - words[level:j + 1])
            i = int(np.argmin(cost))
            new[j], cut[level, j] = cost[i], i + level - 1
        new[:level] = 0
        cut[level, :level] = np.arange(level) - 1
        best = new
    out, j = [], n - 1
    for level in range(k - 1, -1, -1):
        if j < 0:
            break
        out.append(int(x[j]))
        j = int(cut[level, j]) if level else -1
    return out[::-1]


def stepped(c: Column) -> Column:
    """``c`` as it is up to EXACT, above it rounded up to a multiple of 1/128 of the power of two below it."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(c, F.lit(1)).cast("double"))) - 7).cast("long")
    return F.when(c <= EXACT, c).otherwise(F.expr("0L") + F.ceil(c / step) * step).cast("long")


def packed(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(doc_id, n_tokens, bucket, padded_to, batch, in_batch) of every row."""
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")
    lengths = table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n_tokens")), "lengths")
    histogram = lengths.groupBy(stepped(F.col("n_tokens")).alias("step")).agg(F.max("n_tokens").alias("top"), F.count("*").alias("n"), F.sum("n_tokens").alias("sum")).orderBy("step").collect()  # bounded by stepped()
    tops = boundaries([r.top for r in histogram], [r.n for r in histogram], buckets, [r.sum for r in histogram]) or [0]
    below = sum((F.col("n_tokens") > t).cast("int") for t in tops[:-1]) if len(tops) > 1 else F.lit(0)
    d = lengths.withColumn("bucket", below).withColumn("padded_to", F.element_at(F.array(*map(F.lit, tops)), F.col("bucket") + 1).cast("long"))
    # numbers in a bucket: places in a globally ordered table less the bucket's first
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = table(d.repartitionByRange(parts, "bucket", "doc_id").sortWithinPartitions("bucket", "doc_id").withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.expr("at >> 33")), "ordered")
    runs = d.groupBy("part", "bucket").agg(F.min("at").alias("from"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = join_small(d, runs.withColumn("shift", before - F.col("from")).select("part", "bucket", "shift"), ["part", "bucket"], "inner")
    rank, size = F.col("at") + F.col("shift"), F.greatest(F.lit(1), F.expr(f"{budget} div greatest(padded_to, 1)"))
    d = d.withColumn("_rank", rank).withColumn("_size", size)
    return d.select("doc_id", "n_tokens", "bucket", "padded_to", F.expr("_rank div _size").alias("batch"), F.expr("_rank % _size").alias("in_batch"))


def op2(spark, sf_dir: str) -> DataFrame:
    """Every document's bucket and batch."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The buckets and batches of all documents that are left."""
    return packed(docs)


QUERIES = {"op2_packing": op2}
