"""Per-document analysis: smoothing, pooling, sections, percentages, stylometry, signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def neighbours(df: DataFrame, value: str = "score", key: str = "doc_id", order: str = "sent_idx") -> DataFrame:
    """``df`` with ``prev`` and ``next``, the neighbours' values, itself at a document's edge."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("prev", F.coalesce(F.lag(value).over(w), F.col(value))).withColumn("next", F.coalesce(F.lead(value).over(w), F.col(value)))


def smoothed(df: DataFrame, value: str = "score", key: str = "doc_id", order: str = "sent_idx") -> DataFrame:
    """``df`` with ``smoothed``: 25/50/25 weights, 70/30 at the edges, unchanged below three sentences."""
    w = Window.partitionBy(key).orderBy(order)
    p, x, v, n = F.lag(value).over(w), F.lead(value).over(w), F.col(value), F.count("*").over(Window.partitionBy(key))
    d = df.withColumns({"_p": p, "_x": x, "_n": n})
    out = (F.when(F.col("_n") < 3, v).when(F.col("_p").isNull(), 0.7 * v + 0.3 * F.col("_x")).when(F.col("_x").isNull(), 0.7 * v + 0.3 * F.col("_p"))
           .otherwise(0.25 * F.col("_p") + 0.5 * v + 0.25 * F.col("_x")))
    return d.withColumn("smoothed", out).drop("_p", "_x", "_n")


def moving_average(df: DataFrame, width: int, value: str = "score", key: str = "doc_id", order: str = "sent_idx") -> DataFrame:
    """``df`` with ``average`` over a centred window that is cut off at the edges."""
    h = width // 2
    return df.withColumn("average", F.avg(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(-h, h)))


def pooled(df: DataFrame, value: str = "score", key: str = "doc_id", order: str = "sent_idx") -> DataFrame:
    """``df`` with ``pool_max``, ``pool_mean`` and ``pool_top2`` over a sentence and its neighbours."""
    d = neighbours(df, value, key, order)
    three = ["prev", value, "next"]
    total = sum((F.col(c) for c in three[1:]), F.col(three[0]))
    return d.withColumns({"pool_max": F.greatest(*three), "pool_mean": total / 3.0, "pool_top2": (total - F.least(*three)) / 2.0})


def sections(df: DataFrame, category: Column, key: str = "doc_id", order: str = "sent_idx") -> DataFrame:
    """``df`` with ``section_id``, from 1, and ``section``: a heading opens a section if its category is a new one; what
    stands first is in HEADER."""
    w = Window.partitionBy(key).orderBy(order)
    d = df.withColumn("_cat", category).withColumn("_first", F.row_number().over(w) == 1)
    d = d.withColumn("_cat", F.when(~F.col("_first"), F.col("_cat")))
    before = F.coalesce(F.last("_cat", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit("HEADER"))
    d = d.withColumn("_open", F.when(F.col("_cat").isNotNull() & (F.col("_cat") != before), 1).otherwise(0))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("section_id", 1 + F.sum("_open").over(upto).cast("long")).withColumn("section", F.coalesce(F.last("_cat", True).over(upto), F.lit("HEADER")))
    return d.drop("_cat", "_first", "_open")


def half_up(c: Column, digits: int) -> Column:
    """``c`` rounded; sums in another order that end a hair below a half round like it."""
    return F.round(c + 1e-9, digits)


def flagged_words(score: Column, n: Column) -> Column:
    """The words that count as flagged: all at .75, at least 85 % at .60, half at .50."""
    return F.when(score >= 0.75, n * 1.0).when(score >= 0.60, n * F.greatest(score, F.lit(0.85))).when(score >= 0.50, n * 0.5).otherwise(0.0)


def percent_flagged(score: str = "score", n: str = "n_words") -> Column:
    return half_up(F.least(F.lit(100.0), F.coalesce(100 * F.sum(flagged_words(F.col(score), F.col(n))) / F.expr(f"nullif(sum({n}), 0)"), F.lit(0.0))), 1)


def percent_weighted(score: str = "score", n: str = "n_words") -> Column:
    return half_up(F.coalesce(100 * F.sum(F.when(F.col(score) >= 0.60, F.col(score) * F.col(n)).otherwise(0.0)) / F.expr(f"nullif(sum({n}), 0)"), F.lit(0.0)), 1)


def percent_mean(score: str = "score") -> Column:
    return half_up(100 * F.avg(F.greatest(F.least(F.col(score), F.lit(1.0)), F.lit(0.0))), 2)


def burstiness(df: DataFrame, n: str = "n_words", key: str = "doc_id", order: str = "sent_idx") -> DataFrame:
    """Per document: the deviation of sentence lengths, the low-burstiness flag, the coefficient of variation.

    Lengths are added one by one in the order of the sentences, by the update of SQL's stddev_pop: where the deviation is exactly
    the flag's limit, its last bit decides, which another order or update would give otherwise.
    """
    lengths = F.transform(F.array_sort(F.collect_list(F.when(F.col(n).isNotNull(), F.struct(order, F.col(n).alias("n"))))), lambda x: x["n"].cast("double"))

    def add(s: Column, x: Column) -> Column:
        mean = s["mean"] + (x - s["mean"]) / (s["n"] + 1)
        return F.struct((s["n"] + 1).alias("n"), mean.alias("mean"), (s["squares"] + (x - mean) * (x - s["mean"])).alias("squares"))

    zero = F.struct(*(F.lit(0.0).alias(c) for c in ("n", "mean", "squares")))
    out = df.groupBy(key).agg(F.count("*").alias("n_sentences"), F.aggregate(lengths, zero, add, lambda s: F.when(s["n"] > 0, F.sqrt(s["squares"] / s["n"]))).alias("_s"), F.avg(n).alias("_m"))
    std = F.when(F.col("n_sentences") <= 1, F.lit(10.0)).otherwise(F.col("_s"))
    return out.select(key, "n_sentences", F.round(std, 6).alias("std"), ((F.col("n_sentences") >= 5) & (F.col("_s") < 4)).alias("low"), F.round(F.coalesce(100 * F.col("_s") / F.expr("nullif(_m, 0)"), F.lit(0.0)), 2).alias("cv"))


def lexical_diversity(docs: DataFrame) -> DataFrame:
    """Mean type-token ratio (percent) of segments of 100 words; a rest under 50 words counts only alone."""
    w = F.filter(F.transform(T.words(F.lower(F.col("text"))), lambda x: F.btrim(x, F.lit('.,!?;:"()[]{}'))), lambda x: x != "")
    parts = F.transform(F.sequence(F.lit(1), F.size("_w"), F.lit(100)), lambda i: F.slice("_w", i, 100))
    d = docs.select("doc_id", w.alias("_w")).where(F.size("_w") > 0).select("doc_id", F.transform(parts, lambda p: F.struct(F.size(p).alias("n"), F.size(F.array_distinct(p)).alias("k"))).alias("_p"), (F.size("_w") < 50).alias("_short"))
    d = d.withColumn("_p", F.filter("_p", lambda p: (p["n"] >= 50) | F.col("_short")))
    return d.select("doc_id", F.round(F.aggregate("_p", F.lit(0.0), lambda s, p: s + 100.0 * p["k"] / p["n"]) / F.size("_p"), 2).alias("mattr"))


#: A word of letters, digits and underscores stands on its own between these.
_ALONE = r"(?<![\p{L}\p{N}_])(%s)(?![\p{L}\p{N}_])"


def _hits(vocabulary: dict[str, str]) -> Column:
    low = F.lower(F.coalesce("text", F.lit("")))
    # most texts hold few of the entries, so each is looked for as it is before its ends are checked
    n = lambda w: F.when(F.contains(low, F.lit(w)), F.size(F.regexp_extract_all(low, F.lit(_ALONE % w), 1))).otherwise(0).cast("long")
    return F.array(*(F.struct(F.lit(w).alias("word"), F.lit(m).alias("model"), n(w).alias("n")) for w, m in vocabulary.items()))


def signature_counts(docs: DataFrame, vocabulary: dict[str, str]) -> DataFrame:
    """(doc_id, word, model, n) of the vocabulary's entries, which may be of several words."""
    return docs.select("doc_id", F.explode(F.filter(_hits(vocabulary), lambda x: x["n"] > 0)).alias("x")).select("doc_id", "x.*")


def signature_density(docs: DataFrame, vocabulary: dict[str, str]) -> DataFrame:
    """(doc_id, density, fingerprint): the vocabulary's hits per 1,000 words of ASCII letters, and whose style that is."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(_ALONE % "[a-z]+"), 1)
    of = lambda m: F.aggregate(F.filter("_h", lambda x: x["model"] == m), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    d = docs.select("doc_id", _hits(vocabulary).alias("_h"), F.size(words).alias("_n")).select("doc_id", of("Claude").alias("_c"), of("GPT").alias("_g"), "_n")
    per = F.when(F.col("_n") > 0, (F.col("_c") + F.col("_g")) / F.col("_n") * F.lit(1000.0)).otherwise(0.0)
    name = F.when((per > 4.5) & (F.col("_c") > F.col("_g")), "Claude Writing Fingerprint").when(per > 4.5, "GPT Writing Fingerprint").when(per > 1.5, "Mixed/Hybrid AI Signature").otherwise("Standard Academic Prose (Human-like)")
    return d.select("doc_id", F.round(per, 2).alias("density"), name.alias("fingerprint"))
