"""Studies built from labelled frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ranks import numbered


def drawn(m: Column, k: int, mark: Column) -> Column:
    """``k`` numbers below ``m`` as an array, by hashes of ``mark`` and their order: distinct ones, every set of them as likely
    as any other, if there are ``k``; else with replacement. Each number is drawn below a bound that grows by one, and one
    that is taken already gives way to the bound itself."""
    draw = lambda i, n: T.bucket(F.concat_ws(":", mark, i.cast("string")), 2**32) % F.greatest(n, F.lit(1))

    def add(got: Column, i: Column) -> Column:
        top = m - k + i
        return F.concat(got, F.array(F.when(m < k, draw(i, m)).when(F.array_contains(got, draw(i, top + 1)), top).otherwise(draw(i, top + 1))))

    return F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.array().cast("array<long>"), add)


def mixed_documents(df: DataFrame, size: int, inserted: list[int], topic: str = "source", domain: str = "lang") -> DataFrame:
    """(k, block, pos, inserted, score) for each k of ``inserted``: documents of ``size`` consecutive rows of label 0 by id, complete
    ones only, in which k rows at distinct places drawn by a hash are replaced by rows of label 1. Donors are all
    such rows of the topic of the document's first row, or of its domain if the topic has fewer than k, drawn
    without replacement inside a document, with it if the domain has fewer too; without donors a row stays.

    Places and donors are joins on ranks, so neither a topic nor the corpus meets in one task.
    """
    rows = numbered(df.where("label = 0").select("doc_id", "score", F.col(topic).alias("topic"), F.col(domain).alias("domain")), [], ["doc_id"])
    h = rows.select(F.expr(f"place div {size}").alias("block"), (F.col("place") % size).cast("int").alias("pos"), "score", "topic", "domain")
    whole = h.groupBy("block").agg(F.count("*").alias("_n"), F.min_by("topic", "pos").alias("_topic"), F.min_by("domain", "pos").alias("_domain")).where(F.col("_n") == size)
    donors = {}
    for name in ("topic", "domain"):
        d = df.where("label = 1").select(F.col(topic if name == "topic" else domain).alias("_group"), "doc_id", F.col("score").alias("_donor"))
        d = numbered(d.where("_group is not null"), ["_group"], ["doc_id"], "_rank").select("_group", "_rank", "_donor")
        have = d.groupBy(F.col("_group").alias(f"_{name}")).agg(F.count("*").alias(f"_have_{name}"))
        whole = whole.join(have, f"_{name}", "left")
        donors[name] = d
    own, other = F.coalesce("_have_topic", F.lit(0)), F.coalesce("_have_domain", F.lit(0))
    picks = None
    for k in inserted:
        by_topic = own >= k
        d = whole.select("block", F.lit(k).alias("k"), by_topic.alias("_by_topic"), F.when(by_topic, F.col("_topic")).otherwise(F.col("_domain")).alias("_group"), F.when(by_topic, own).otherwise(other).alias("_m"))
        d = d.where("_m > 0").select("k", "block", "_by_topic", "_group", F.posexplode(drawn(F.col("_m"), k, F.concat_ws(":", F.lit("donor"), "k", "block"))).alias("_i", "_rank"))
        picks = d if picks is None else picks.unionByName(d)
    got = picks.where("_by_topic").join(donors["topic"], ["_group", "_rank"]).unionByName(picks.where("not _by_topic").join(donors["domain"], ["_group", "_rank"])).select("k", "block", "_i", "_donor")
    each = h.join(whole.select("block"), "block").select(F.explode(F.array(*map(F.lit, inserted))).alias("k"), "block", "pos", "score")
    mark = F.md5(F.concat_ws(":", F.lit("place"), "k", "block", "pos"))
    each = each.withColumn("_i", F.row_number().over(Window.partitionBy("k", "block").orderBy(mark, "pos")) - 1)  # of one document
    d = each.join(got, ["k", "block", "_i"], "left")
    return d.select("k", "block", "pos", F.col("_donor").isNotNull().alias("inserted"), F.coalesce("_donor", "score").alias("score"))


def mixed_results(m: DataFrame, windows: tuple[int, ...], threshold: float = 0.5) -> DataFrame:
    """(k, w, tn, fp, fn, tp, detected) of the rows of ``mixed_documents``, smoothed in each document by every window;
    detected: the share of documents with a hit."""
    by = Window.partitionBy("k", "block").orderBy("pos")
    hit = lambda w: F.avg("score").over(by.rowsBetween(-(w // 2), w // 2)) >= threshold
    d = m.select("k", "block", "inserted", *[hit(w).alias(f"_h{w}") for w in windows])
    d = d.select("k", "block", "inserted", F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.col(f"_h{w}").alias("hit")) for w in windows])).alias("x")).select("k", "block", "inserted", "x.*")
    b = d.groupBy("k", "w", "block").agg(F.count_if(~F.col("hit") & ~F.col("inserted")).alias("tn"), F.count_if(F.col("hit") & ~F.col("inserted")).alias("fp"), F.count_if(~F.col("hit") & F.col("inserted")).alias("fn"), F.count_if(F.col("hit") & F.col("inserted")).alias("tp"))
    return b.groupBy("k", "w").agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")], F.avg((F.col("fp") + F.col("tp") > 0).cast("double")).alias("detected"))


def sanity(val_accuracy: Column, test_accuracy: Column, val_fpr: Column) -> Column:
    """The first that holds: near-perfect accuracy, a gap between validation and test, a high false positive rate."""
    return F.when((val_accuracy > 0.99) | (test_accuracy > 0.99), "possible leak").when(F.abs(val_accuracy - test_accuracy) > 0.05, "gap").when(val_fpr > 0.01, "fpr too high").otherwise("ok")
