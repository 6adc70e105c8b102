"""Evaluation over long frames: (label, score) and any grouping columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import bounds, range_of


def confusion(label: str = "label", score: str | Column = "score", threshold: Column | float = 0.5) -> list[Column]:
    """Aggregates tn, fp, fn, tp."""
    hit, pos = (F.col(score) if isinstance(score, str) else score) >= threshold, F.col(label) == 1
    return [F.count_if(~hit & ~pos).alias("tn"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(hit & pos).alias("tp")]


def ratio(a, b) -> Column:
    """a / b, 0.0 where b is 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b == 0, F.lit(None)).otherwise(b))


def rates(df: DataFrame) -> DataFrame:
    """``df`` with tn, fp, fn, tp, extended by accuracy, precision, recall, f1, macro_f1 and fpr."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    f1, f0 = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    return df.withColumns({"accuracy": F.round(ratio(tp + tn, tn + fp + fn + tp), 9), "precision": F.round(ratio(tp, tp + fp), 9), "recall": F.round(ratio(tp, tp + fn), 9), "f1": F.round(f1, 9), "macro_f1": F.round((f1 + f0) / 2, 9), "fpr": F.round(ratio(fp, fp + tn), 9)})


def threshold_grid(df: DataFrame, low: int, high: int, label: str = "label", score: str = "score") -> DataFrame:
    """(t, tn, fp, fn, tp) at every threshold low/100 .. high/100; rows are counted by the last one they reach."""
    k = F.floor(F.col(score) * 100).cast("int")
    k = k + F.when(F.col(score) >= (k + 1) / F.lit(100.0), 1).when(F.col(score) < k / F.lit(100.0), -1).otherwise(0)
    c = df.groupBy(F.least(F.greatest(k, F.lit(low - 1)), F.lit(high)).alias("k")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))
    grid = df.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("t"))
    over = F.col("k") >= F.col("t")
    parts = (("tn", ~over, "n"), ("fp", over, "n"), ("fn", ~over, "p"), ("tp", over, "p"))
    return grid.crossJoin(F.broadcast(c)).groupBy("t").agg(*[F.coalesce(F.sum(F.when(x, F.col(v))), F.lit(0)).alias(n) for n, x, v in parts])  # at most high - low + 2 counts


def threshold_search(df: DataFrame, low: int, high: int, label: str = "label", score: str = "score") -> DataFrame:
    """The threshold among low/100 .. high/100 with the best macro F1, the lowest on ties.

    Scores are counted per hundredth at which they cross first, so the data are read once and not once per
    threshold: only the grid and the counts meet.
    """
    at = F.least(F.greatest(F.floor(F.col(score) * 100 + 1e-9), F.lit(low - 1)), F.lit(high)).cast("int")
    c = df.groupBy(at.alias("k")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))
    grid = df.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("t"))
    g = grid.crossJoin(F.broadcast(c)).groupBy("t")  # at most high - low + 2 counts
    over = F.col("k") >= F.col("t")
    g = g.agg(*[F.coalesce(F.sum(F.when(x, F.col(v))), F.lit(0)).alias(n) for n, x, v in (("tp", over, "p"), ("fp", over, "n"), ("fn", ~over, "p"), ("tn", ~over, "n"))])
    best = rates(g).agg(F.max_by("t", F.struct("macro_f1", -F.col("t"))).alias("t"), F.max("macro_f1").alias("macro_f1"))
    return best.select((F.col("t") / 100.0).alias("threshold"), "macro_f1")


#: Ranges of scores in which curves are summed before their ranges are put together.
PARTS = 256


def roc(df: DataFrame, by: list[str] | None = None, label: str = "label", score: str = "score", digits: int | None = None) -> DataFrame:
    """A row for each distinct score, descending: tp and fp up to it, their totals, tpr and fpr.

    Ties share a point. Counts are summed per score, then inside ranges that hold about as many distinct scores each, wherever
    the scores lie, and the ranges' sums are put together over one row for each; so no task takes all scores of a
    curve. ``digits`` rounds scores first.
    """
    by = by or []
    if digits is not None:
        df = df.withColumn(score, F.round(score, digits))
    c = df.groupBy(*by, score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))
    c = c.withColumn("_part", range_of(F.col(score).cast("double"), bounds(c, score, PARTS)))
    parts = c.groupBy(*by, "_part").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    above, every = Window.partitionBy(*by).orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    before = lambda x: F.coalesce(F.sum(x).over(above), F.lit(0))
    parts = parts.select(*[F.col(x).alias(f"_by{k}") for k, x in enumerate(by)], F.col("_part").alias("_at"), before("_p").alias("_tp"), before("_n").alias("_fp"), F.sum("_p").over(every).alias("pos"), F.sum("_n").over(every).alias("neg"))
    w = Window.partitionBy(*by, "_part").orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    r = c.withColumns({"tp": F.sum("p").over(w), "fp": F.sum("n").over(w)})
    same = F.col("_part").eqNullSafe(F.col("_at"))
    for k, x in enumerate(by):
        same = same & F.col(x).eqNullSafe(F.col(f"_by{k}"))
    r = r.join(parts, same).withColumns({"tp": F.col("tp") + F.col("_tp"), "fp": F.col("fp") + F.col("_fp")})
    return r.select(*by, score, "p", "n", "tp", "fp", "pos", "neg").withColumns({"tpr": ratio("tp", "pos"), "fpr": ratio("fp", "neg")})


def auc(df: DataFrame, by: list[str] | None = None, label: str = "label", score: str = "score") -> DataFrame:
    """The chance that a positive outranks a negative, ties half: sums over distinct scores."""
    r = roc(df, by, label, score)
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") + F.col("p") / 2)) / F.expr("nullif(max(pos) * max(neg), 0)")
    return r.groupBy(*(by or [])).agg(F.round(area, 9).alias("auc"))


def average_precision(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    r = roc(df, None, label, score)
    return r.agg(F.round(F.sum(F.col("p") / F.expr("nullif(pos, 0)") * F.col("tp") / (F.col("tp") + F.col("fp"))), 9).alias("average_precision"))


def pr_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """The trapezoids under precision over recall, from recall 0 at precision 1."""
    r = roc(df, None, label, score).withColumns({"rec": ratio("tp", "pos"), "pre": F.col("tp") / (F.col("tp") + F.col("fp"))})
    # the point before: without this one's own counts
    tp, fp = F.col("tp") - F.col("p"), F.col("fp") - F.col("n")
    r = r.withColumns({"rec0": ratio(tp, "pos"), "pre0": F.when(tp + fp == 0, F.lit(1.0)).otherwise(ratio(tp, tp + fp))})
    return r.agg(F.round(F.sum((F.col("rec") - F.col("rec0")) * (F.col("pre") + F.col("pre0")) / 2), 9).alias("pr_auc"))


def tpr_at_fpr(df: DataFrame, most: float, label: str = "label", score: str = "score") -> DataFrame:
    """The best tpr on the curve within an fpr; 0.0 at its origin."""
    r = roc(df, None, label, score)
    return r.agg(F.round(F.coalesce(F.max(F.when(F.col("fpr") <= most, F.col("tpr"))), F.lit(0.0)), 9).alias("tpr"))


def tpr_by_rank(df: DataFrame, share: float, label: str = "label", score: str = "score") -> DataFrame:
    """The tpr at the negatives' score of rank floor(share * n) + 1, descending; ties may exceed the share."""
    r = roc(df, None, label, score)
    k = F.least(F.floor(F.col("neg") * share + 1e-9) + 1, F.col("neg"))
    at = r.agg(F.max(F.when(F.col("fp") >= k, F.col(score))).alias("t"))
    return df.crossJoin(F.broadcast(at)).agg(F.round(ratio(F.count_if((F.col(label) == 1) & (F.col(score) >= F.col("t"))), F.count_if(F.col(label) == 1)), 9).alias("tpr"))


def reliability(df: DataFrame, bins: int = 10, label: str = "label", score: str = "score") -> DataFrame:
    """(bin, n, confidence, accuracy): equal widths, the last closed; edges as NumPy's linspace gives them."""
    edges = [k * (1.0 / bins) for k in range(1, bins)]
    b = sum(((F.col(score) >= e).cast("int") for e in edges[1:]), (F.col(score) >= edges[0]).cast("int"))
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("confidence"), F.avg(F.col(label).cast("double")).alias("accuracy"))


def ece(df: DataFrame, bins: int = 10, label: str = "label", score: str = "score") -> DataFrame:
    r = reliability(df, bins, label, score)
    return r.agg(F.round(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n"), 9).alias("ece"))
