"""Clustered, paired and row bootstrap, and corrections for many tests.

A replicate gives each unit (a topic or a row) a Poisson weight of mean 1 from a hash of unit and replicate, which is what
drawing with replacement comes to when units are many. A unit's weights need nothing but its own key, so each task adds
weight times value of all its units into one array of sums for each value, and a row for each task and replicate is all
that is shuffled: no row count grows with replicates times units. Weights are the same everywhere; a unit of several rows
is summed first, and systems that share a call share their resamples.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: A weight is the number of these that a hash below 2**32 reaches: the distribution of Poisson with mean 1.
STEPS = [math.floor(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(9)]
#: Multipliers of the hash of a unit's mark and a replicate's number.
SPREAD, MIX = 2654435761, 73244475
#: Weights that a task holds at a time.
_CELLS = 1 << 18


def weights(marks: np.ndarray, replicates: int) -> np.ndarray:
    """(units, replicates) weights of units by their marks below 2**32."""
    x = (marks.astype(np.uint64)[:, None] + np.arange(replicates, dtype=np.uint64) * np.uint64(SPREAD)) & np.uint64(0xFFFFFFFF)
    for _ in range(2):
        x ^= x >> np.uint64(16)
        x = (x * np.uint64(MIX)) & np.uint64(0xFFFFFFFF)
    x ^= x >> np.uint64(16)
    return np.searchsorted(np.array(STEPS, np.uint64), x, side="right")


def replicated(units: DataFrame, key: str, sums: list[str], replicates: int, seed: str = "r") -> DataFrame:
    """(replicate, sums...): whole-number columns of ``units`` summed with each unit's weights. Null values count as 0."""
    names = ["replicate", *sums]
    d = units.select(T.bucket(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 2**32).alias("mark"), *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((replicates, len(sums)), np.int64)
        rows = max(1, _CELLS // max(1, replicates))
        for b in batches:
            cols = [np.asarray(c, np.int64) for c in b.columns]
            for i in range(0, b.num_rows, rows):
                total += weights(cols[0][i : i + rows], replicates).T @ np.stack([c[i : i + rows] for c in cols[1:]], axis=1)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates, dtype=np.int32)), *(pa.array(x) for x in total.T)], names=names)

    part = d.mapInArrow(run, ", ".join(["replicate int", *(f"{c} long" for c in sums)]))
    every = units.sparkSession.range(replicates).select(F.col("id").cast("int").alias("replicate"), *[F.lit(0).cast("long").alias(c) for c in sums])
    return part.unionByName(every).groupBy("replicate").agg(*[F.sum(c).alias(c) for c in sums])


def weight_sql(mark: str, replicate: str) -> str:
    """``weights`` in SQL, for a mark and a replicate that are expressions."""
    x = f"(({mark}) + ({replicate}) * {SPREAD}::BIGINT) % 4294967296"
    for _ in range(2):
        x = f"(xor({x}, ({x}) >> 16) * {MIX}::BIGINT) % 4294967296"
    return f"len(list_filter({STEPS}::BIGINT[], lambda step: xor({x}, ({x}) >> 16) >= step))"


def interval(value: str, low: float = 0.025, high: float = 0.975) -> list[Column]:
    return [F.round(F.percentile(value, F.lit(low)), 9).alias("lo"), F.round(F.percentile(value, F.lit(high)), 9).alias("hi")]


def two_sided(diff: str) -> Column:
    """Twice the smaller share of differences on either side of 0, at most 1."""
    return F.round(F.least(F.lit(1.0), 2 * F.least(F.avg((F.col(diff) <= 0).cast("double")), F.avg((F.col(diff) >= 0).cast("double")))), 9)


def holm(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """``tests`` (name, p) with its rank, its own alpha / (m - rank), whether it is below it, and whether it and
    all before it are (the step-down form)."""
    w = Window.orderBy("p", "name")  # tests are few
    d = tests.withColumn("rank", F.row_number().over(w)).withColumn("m", F.count("*").over(Window.partitionBy()))
    d = d.withColumn("alpha", F.lit(alpha) / (F.col("m") - F.col("rank") + 1)).withColumn("below", F.col("p") <= F.col("alpha"))
    return d.withColumn("stepdown", F.min(F.col("below").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("m")
