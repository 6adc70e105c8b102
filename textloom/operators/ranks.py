"""Places of rows in an order, without a task that takes a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import table


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "place") -> DataFrame:
    """``df`` with each row's place from 0 in its group, by ``order``. Rows are dealt into ranges of group and order, so a
    large group lies in many tasks; places are those in the range plus the rows of the group in earlier ranges, of which
    there is one number for each range and group."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id())
    d = table(d.withColumn("_part", F.expr("_at >> 33")), "ranges")
    runs = d.groupBy(*by, "_part").agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], F.col("_part").alias("_of"), (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_from")).alias("_shift"))
    same = F.col("_part") == F.col("_of")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    return d.join(runs, same).select(*df.columns, (F.col("_at") + F.col("_shift")).alias(name))


def bounds(df: DataFrame, column: str, parts: int) -> list[float]:
    """Fewer than ``parts`` ascending values of a column of numbers that cut its rows into runs of about one size, from a
    mergeable sketch; a value that many rows have is one of them once."""
    cuts = df.agg(F.percentile_approx(column, [k / parts for k in range(1, parts)], 20 * parts)).first()[0]
    return sorted({float(x) for x in cuts or [] if x == x})


def range_of(column: Column, cuts: list[float]) -> Column:
    """How many of the ascending ``cuts`` a number reaches, by binary search; 0 for null."""
    if not cuts:
        return F.lit(0)
    known = F.split(F.lit(",".join(map(repr, cuts))), ",").cast("array<double>")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda p, s: F.when((p + s <= len(cuts)) & (F.get(known, p + s - 1) <= column), p + s).otherwise(p))
