"""Balanced samples and leak-free splits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def balanced(df: DataFrame, target: int, domain: str, label: str, key: str, seed: str = "42") -> DataFrame:
    """Per domain the same number of rows of each label: the target, or what the rarer label has."""
    have = df.groupBy(domain, label).agg(F.count("*").alias("n")).groupBy(domain).agg(F.min("n").alias("n"), F.count("*").alias("k"))
    have = have.select(domain, F.when(F.col("k") < 2, 0).otherwise(F.least(F.col("n"), F.lit(target))).alias("_take"))
    draw = F.row_number().over(Window.partitionBy(domain, label).orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key))
    # the target first: tasks then cut their own rows to it before they are shuffled
    return df.withColumn("_r", draw).where(F.col("_r") <= target).join(have, domain).where(F.col("_r") <= F.col("_take")).drop("_r", "_take")


def sample(df: DataFrame, n: int, key: str, seed: str = "42") -> DataFrame:
    """``n`` rows by a hash of their key."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key).limit(n)


def hash_split(topic: str | Column, train: int = 80, val: int = 10) -> Column:
    """train, val or test from a hash of the topic, so a topic is never in two."""
    b = T.bucket(topic, 100)
    return F.when(b < train, "train").when(b < train + val, "val").otherwise("test")


def deficit_step(want: list[float]) -> Callable[[int], str]:
    """Of each topic's rows in turn the split that lacks most rows of ``want`` (train, val, test); ties go to the earlier split."""

    def step(n: int) -> str:
        k = max(range(3), key=lambda i: (round(want[i], 6), -i))
        want[k] -= n
        return ("train", "val", "test")[k]

    return step


def lightest_step(k: int) -> Callable[[int], int]:
    """Of each topic's rows in turn the fold that has fewest so far, the first of equals."""
    have = [0] * k

    def step(n: int) -> int:
        fold = min(range(k), key=lambda i: (have[i], i))
        have[fold] += n
        return fold

    return step


def folded(counts: DataFrame, key: str, order: list[Column], make: Callable[[], Callable], out: str, kind: str) -> DataFrame:
    """(key, out): a fold over the rows of ``counts`` (key, n) in an order. They are sorted in ranges over all tasks, and one task
    streams through the ranges in turn and keeps nothing of them but the step's few numbers, so memory does not
    grow with the topics; a fold, in which each choice depends on those before it, has no other parallel form."""
    schema = f"{key} {dict(counts.dtypes)[key]}, {out} {kind}"
    d = counts.select(key, "n").orderBy(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([step(n) for n in b.column(1).to_pylist()], pa.string() if kind == "string" else pa.int32())], names=[key, out])

    return d.coalesce(1).mapInArrow(run, schema)


def topic_split(df: DataFrame, topic: str, seed: str = "42", shares: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """``df`` with ``split``: a fold over the topics' counts in the order of a hash of their name, each to the split that lacks
    most rows; rows follow by a join."""
    counts = df.groupBy(topic).agg(F.count("*").alias("n"))
    total = df.count()
    m = folded(counts, topic, [F.md5(F.concat(F.col(topic), F.lit(seed))), F.col(topic)], lambda: deficit_step([s * total for s in shares]), "split", "string")
    return df.join(m, topic)


def percent_rank(df: DataFrame, by: str, order: str, width: int = 65_536) -> DataFrame:
    """``df`` with ``percent_rank`` of a whole number in each group. Rows are ranked inside parts of ``width`` numbers,
    and only the parts' counts are summed along a group, so no task takes a group of any size."""
    d = df.withColumn("_part", F.floor(F.col(order) / width))
    parts = d.groupBy(F.col(by).alias("_by"), F.col("_part").alias("_at")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_by").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_by", "_at", before.alias("_before"), F.sum("n").over(Window.partitionBy("_by")).alias("_all"))
    d = d.withColumn("_rank", F.rank().over(Window.partitionBy(by, "_part").orderBy(order)))
    j = d.join(parts, F.col(by).eqNullSafe(F.col("_by")) & F.col("_part").eqNullSafe(F.col("_at")))
    share = F.when(F.col("_all") > 1, (F.col("_before") + F.col("_rank") - 1) / (F.col("_all") - 1)).otherwise(0.0)
    return j.withColumn("percent_rank", share).select(*df.columns, "percent_rank")


def leaks(df: DataFrame, topic: str, split: str = "split") -> DataFrame:
    """Topics that stand in more than one split; there should be none."""
    return df.groupBy(topic).agg(F.countDistinct(split).alias("n")).where("n > 1")


def group_folds(df: DataFrame, topic: str, k: int = 5, rows: str | None = None) -> DataFrame:
    """``df`` with ``fold``: topics by the number of their rows, largest first (the last by name of equals), each to the fold
    with fewest rows so far. So no topic is in two folds and folds are of about one size. A row of ``df``
    counts as often as its column ``rows`` says, if that is given."""
    counts = df.groupBy(topic).agg((F.sum(rows) if rows else F.count("*")).alias("n"))
    return df.join(folded(counts, topic, [F.desc("n"), F.desc(topic)], lambda: lightest_step(k), "fold", "int"), topic)
