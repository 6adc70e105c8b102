"""Evaluation: metrics, thresholds, curves, calibration, slices, bootstrap and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics as M
from ..operators import resample as R
from ..operators.scoring import ABLATIONS, heuristic_fusion
from .registry import WC, query, read

#: A labelled frame: quality as label, a hash of the id pulled towards it as score, source as topic, lang as domain.
EVAL = """l AS (SELECT d.doc_id, lang, source, quality AS label, (('0x' || substr(md5('s' || d.doc_id), 1, 8))::BIGINT % 1000 + 300 * quality) / 1300.0::DOUBLE AS score,
(('0x' || substr(md5('t' || d.doc_id), 1, 8))::BIGINT % 1000 + 200 * quality) / 1200.0::DOUBLE AS other FROM documents d JOIN labels USING (doc_id))"""


def frame(spark, d):
    j = read(spark, d, "documents").select("doc_id", "lang", "source").join(read(spark, d, "labels"), "doc_id")
    b = lambda k: T.bucket(F.concat(F.lit(k), "doc_id"), 1000)
    return j.select("doc_id", "lang", "source", F.col("quality").alias("label"), ((b("s") + 300 * F.col("quality")) / F.lit(1300.0)).alias("score"), ((b("t") + 200 * F.col("quality")) / F.lit(1200.0)).alias("other"))


CONF = """count(*) FILTER (WHERE score < {t} AND label <> 1) AS tn, count(*) FILTER (WHERE score >= {t} AND label <> 1) AS fp,
count(*) FILTER (WHERE score < {t} AND label = 1) AS fn, count(*) FILTER (WHERE score >= {t} AND label = 1) AS tp"""
RATES = """round(coalesce((tp + tn)::DOUBLE / nullif(tn + fp + fn + tp, 0), 0), 9) AS accuracy, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 9) AS precision,
round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1,
round((coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2.0::DOUBLE * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 9) AS macro_f1, round(coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0), 9) AS fpr"""
C5 = CONF.format(t="0.5")


@query("E01_confusion", f"WITH {EVAL} SELECT {C5} FROM l")
def e01(spark, d):
    return frame(spark, d).agg(*M.confusion())


@query("E02_rates", f"WITH {EVAL}, c AS (SELECT {C5} FROM l) SELECT *, {RATES} FROM c")
def e02(spark, d):
    return M.rates(frame(spark, d).agg(*M.confusion()))


@query("E03_macro_f1", f"WITH {EVAL}, c AS (SELECT {C5} FROM l), r AS (SELECT {RATES} FROM c) SELECT macro_f1 FROM r")
def e03(spark, d):
    return e02(spark, d).select("macro_f1")


@query("E04_fpr_tpr", f"WITH {EVAL}, c AS (SELECT source, {C5} FROM l GROUP BY source) SELECT source, {RATES} FROM c")
def e04(spark, d):
    return M.rates(frame(spark, d).groupBy("source").agg(*M.confusion())).drop("tn", "fp", "fn", "tp")


def _search(lo: int, hi: int) -> str:
    return f"""WITH {EVAL}, g AS (SELECT range AS t FROM range({lo}, {hi + 1})), c AS (SELECT t, {CONF.format(t='t / 100.0')} FROM g, (SELECT label, floor(score * 100 + 1e-9) / 100.0 AS score FROM l) GROUP BY t), r AS (SELECT t, {RATES} FROM c)
SELECT t / 100.0::DOUBLE AS threshold, macro_f1 FROM r ORDER BY macro_f1 DESC, t LIMIT 1"""


@query("E05_threshold_91", _search(5, 95))
def e05(spark, d):
    return M.threshold_search(frame(spark, d), 5, 95)


@query("E06_threshold_81", _search(10, 90))
def e06(spark, d):
    return M.threshold_search(frame(spark, d), 10, 90)


@query("J12_threshold_grid", f"WITH {EVAL}, g AS (SELECT range AS t FROM range(5, 96)) SELECT t::INTEGER AS t, {CONF.format(t='t / 100.0::DOUBLE')} FROM g, l GROUP BY t")
def j12(spark, d):
    return M.threshold_grid(frame(spark, d), 5, 95)


ROC = f"""WITH {EVAL}, c AS (SELECT score, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label <> 1) AS n FROM l GROUP BY score),
r AS (SELECT score, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM c WINDOW w AS (ORDER BY score DESC)) """


@query("E07_auc", ROC + "SELECT round(sum(n * (tp - p + p / 2.0::DOUBLE)) / (max(pos) * max(neg)), 9) AS auc FROM r")
def e07(spark, d):
    return M.auc(frame(spark, d))


@query("E08_roc", ROC + "SELECT score, round(tp / pos::DOUBLE, 9) AS tpr, round(fp / neg::DOUBLE, 9) AS fpr FROM r")
def e08(spark, d):
    return M.roc(frame(spark, d)).select("score", F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"))


@query("E09_average_precision", ROC + "SELECT round(sum(p / pos::DOUBLE * tp / (tp + fp)), 9) AS average_precision FROM r")
def e09(spark, d):
    return M.average_precision(frame(spark, d))


@query("E10_pr_auc", ROC + ", x AS (SELECT score, tp / pos::DOUBLE AS rec, tp / (tp + fp)::DOUBLE AS pre FROM r), y AS (SELECT *, coalesce(lag(rec) OVER w, 0) AS r0, coalesce(lag(pre) OVER w, 1) AS p0 FROM x WINDOW w AS (ORDER BY score DESC)) SELECT round(sum((rec - r0) * (pre + p0) / 2), 9) AS pr_auc FROM y")
def e10(spark, d):
    return M.pr_auc(frame(spark, d))


for _k, _x in (("1", 0.01), ("5", 0.05)):
    @query(f"E11_tpr_at_fpr_{_k}", ROC + f"SELECT round(coalesce(max(CASE WHEN fp / neg::DOUBLE <= {_x} THEN tp / pos::DOUBLE END), 0), 9) AS tpr FROM r")
    def e11(spark, d, x=_x):
        return M.tpr_at_fpr(frame(spark, d), x)


@query("E12_tpr_by_rank", ROC + ", k AS (SELECT max(CASE WHEN fp >= least(floor(neg * 0.05 + 1e-9) + 1, neg) THEN score END) AS t FROM r) SELECT round(count(*) FILTER (WHERE label = 1 AND score >= t)::DOUBLE / count(*) FILTER (WHERE label = 1), 9) AS tpr FROM l, k")
def e12(spark, d):
    return M.tpr_by_rank(frame(spark, d), 0.05)


_BIN = "(" + " + ".join(f"(score >= {k * 0.1!r}::DOUBLE)::INTEGER" for k in range(1, 10)) + ")"
_REL = f"WITH {EVAL}, b AS (SELECT {_BIN} AS bin, count(*) AS n, avg(score) AS confidence, avg(label::DOUBLE) AS accuracy FROM l GROUP BY 1) "


@query("E13_ece", _REL + "SELECT round(sum(n * abs(accuracy - confidence)) / sum(n), 9) AS ece FROM b")
def e13(spark, d):
    return M.ece(frame(spark, d))


@query("E14_reliability", _REL + "SELECT bin, n, round(confidence, 9) AS confidence, round(accuracy, 9) AS accuracy FROM b")
def e14(spark, d):
    return M.reliability(frame(spark, d)).select("bin", "n", F.round("confidence", 9).alias("confidence"), F.round("accuracy", 9).alias("accuracy"))


# --- slices ---

for _n, _by in (("B15_source_breakdown", "source"), ("B16_domain_breakdown", "lang")):
    @query(_n, f"WITH {EVAL}, c AS (SELECT {_by}, count(*) AS n, {C5} FROM l GROUP BY 1) SELECT *, {RATES} FROM c")
    def breakdown(spark, d, by=_by):
        return M.rates(frame(spark, d).groupBy(by).agg(F.count("*").alias("n"), *M.confusion()))


@query("B17_generator_recall", f"WITH {EVAL} SELECT source, count(*) AS n, round(avg((score >= 0.5)::INTEGER), 9) AS recall, round(avg(score), 9) AS mean FROM l WHERE label = 1 GROUP BY source")
def b17(spark, d):
    return frame(spark, d).where("label = 1").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg((F.col("score") >= 0.5).cast("int")), 9).alias("recall"), F.round(F.avg("score"), 9).alias("mean"))


@query("B18_length_bins", f"""WITH {EVAL}, b AS (SELECT unnest([1, 2, 3, 4]) AS bin), w AS (SELECT doc_id, {WC.format('text')} AS n_words FROM documents), d AS (SELECT CASE WHEN n_words <= 0 THEN NULL WHEN n_words <= 50 THEN 1 WHEN n_words <= 150 THEN 2 WHEN n_words <= 300 THEN 3 WHEN n_words <= 100000 THEN 4 END AS bin, ((score >= 0.5) = (label = 1))::INTEGER AS a, ((other >= 0.5) = (label = 1))::INTEGER AS b2 FROM l JOIN w USING (doc_id))
SELECT b.bin, count(a) AS n, round(avg(a), 9) AS accuracy_a, round(avg(b2), 9) AS accuracy_b FROM b LEFT JOIN d USING (bin) GROUP BY 1""")
def b18(spark, d):
    """Documents by words, right-closed and empty bins kept: how often each system is right."""
    n = F.col("n_words")
    j = frame(spark, d).join(read(spark, d, "documents").select("doc_id", T.n_words("text").alias("n_words")), "doc_id")
    right = lambda c: ((F.col(c) >= 0.5) == (F.col("label") == 1)).cast("int")
    c = j.select(F.when(n <= 0, None).when(n <= 50, 1).when(n <= 150, 2).when(n <= 300, 3).when(n <= 100000, 4).alias("bin"), right("score").alias("a"), right("other").alias("b"))
    c = c.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("a"), 9).alias("accuracy_a"), F.round(F.avg("b"), 9).alias("accuracy_b"))
    bins = spark.range(1, 5).select(F.col("id").cast("int").alias("bin"))
    return bins.join(F.broadcast(c), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "accuracy_a", "accuracy_b")  # one row a bin


@query("B19_token_buckets", f"WITH d AS (SELECT ({WC.format('text')} * 133) // 100 AS t FROM documents WHERE text IS NOT NULL) SELECT coalesce(t // 1000, -1) AS bucket, count(*) AS n, round(avg(t), 6) AS mean FROM d GROUP BY GROUPING SETS ((t // 1000), ())")
def b19(spark, d):
    """Documents by tokens, in half-open thousands; -1: all."""
    t = read(spark, d, "documents").where("text is not null").select(T.n_tokens("text").cast("long").alias("t")).withColumn("bucket", F.expr("t div 1000"))
    return t.groupingSets([["bucket"], []], "bucket").agg(F.count("*").alias("n"), F.round(F.avg("t"), 6).alias("mean")).withColumn("bucket", F.coalesce("bucket", F.lit(-1).cast("long")))


@query("F06_small_samples", f"WITH {EVAL} SELECT source, count(*) AS n, count(*) < 30 AS anecdotal FROM l GROUP BY source HAVING count(*) >= 10")
def f06(spark, d):
    return frame(spark, d).groupBy("source").agg(F.count("*").alias("n")).where("n >= 10").withColumn("anecdotal", F.col("n") < 30)


@query("F07_single_class", f"WITH {EVAL} SELECT source, count(*) AS n FROM l GROUP BY source HAVING min(label) <> max(label)")
def f07(spark, d):
    return frame(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").drop("a", "b")


@query("B28_class_weights", f"WITH {EVAL} SELECT label, round(sum(count(*)) OVER () / (count(*) OVER () * count(*))::DOUBLE, 9) AS weight FROM l GROUP BY label")
def b28(spark, d):
    c = frame(spark, d).groupBy("label").agg(F.count("*").alias("n"))
    t = c.agg(F.sum("n").alias("t"), F.count("*").alias("k"))
    return c.crossJoin(F.broadcast(t)).select("label", F.round(F.col("t") / (F.col("k") * F.col("n")), 9).alias("weight"))  # one row


# --- fusion studies ---

_ON = {n: set(u) for n, u in ABLATIONS.items()}
_FUSE = """CASE WHEN {meta} AND doc_id % 50 = 0 THEN 0.02::DOUBLE WHEN {transition} AND doc_id % 5 = 0 THEN least(0.99::DOUBLE, greatest(base, 0.65::DOUBLE) + 0.15::DOUBLE)
WHEN {low} AND doc_id % 4 = 0 AND base >= 0.35 THEN least(0.99::DOUBLE, base + 0.10::DOUBLE) WHEN {max} AND (score >= 0.38 OR other >= 0.38) THEN base ELSE 0.5::DOUBLE * other + 0.5::DOUBLE * score END"""


def _ablation(name: str, on: set) -> str:
    t = {n: "true" if k in on else "false" for n, k in (("meta", "metadata"), ("transition", "transition"), ("low", "low"), ("max", "max"))}
    return f"SELECT '{name}' AS condition, label, doc_id % 5 = 0 AS trans, {_FUSE.format(**t)} AS score FROM (SELECT *, greatest(score, other) AS base FROM l)"


def _fused(spark, d):
    f = frame(spark, d).withColumns({"trans": F.col("doc_id") % 5 == 0, "low": F.col("doc_id") % 4 == 0, "meta": F.col("doc_id") % 50 == 0})
    each = F.array(*[F.struct(F.lit(n).alias("condition"), heuristic_fusion("score", "other", "trans", "low", "meta", frozenset(u)).alias("score")) for n, u in ABLATIONS.items()])
    return f.select("doc_id", "label", "trans", F.explode(each).alias("x")).select("doc_id", "label", "trans", "x.condition", "x.score")


@query("D04_ablation_scores", f"WITH {EVAL} " + "SELECT condition, count(*) AS n, round(avg(score), 9) AS mean FROM (" + " UNION ALL ".join(_ablation(n, u) for n, u in _ON.items()) + ") GROUP BY 1")
def d04(spark, d):
    return _fused(spark, d).groupBy("condition").agg(F.count("*").alias("n"), F.round(F.avg("score"), 9).alias("mean"))


@query("E21_heuristic_ablation", f"WITH {EVAL}, a AS (" + " UNION ALL ".join(_ablation(n, u) for n, u in _ON.items()) + f"""), c AS (SELECT condition, {C5}, coalesce(count(*) FILTER (WHERE trans AND label <> 1 AND score >= 0.5)::DOUBLE / nullif(count(*) FILTER (WHERE trans AND label <> 1), 0), 0) AS ft,
coalesce(count(*) FILTER (WHERE NOT trans AND label <> 1 AND score >= 0.5)::DOUBLE / nullif(count(*) FILTER (WHERE NOT trans AND label <> 1), 0), 0) AS fo FROM a GROUP BY 1), r AS (SELECT *, {RATES} FROM c)
SELECT condition, accuracy, macro_f1, fpr, round(ft, 9) AS fpr_with, round(fo, 9) AS fpr_without, round(ft - fo, 9) AS disparity FROM r""")
def e21(spark, d):
    hit, neg = F.col("score") >= 0.5, F.col("label") != 1
    part = lambda t: M.ratio(F.count_if(hit & neg & t), F.count_if(neg & t))
    c = M.rates(_fused(spark, d).groupBy("condition").agg(*M.confusion(), part(F.col("trans")).alias("ft"), part(~F.col("trans")).alias("fo")))
    return c.select("condition", "accuracy", "macro_f1", "fpr", F.round("ft", 9).alias("fpr_with"), F.round("fo", 9).alias("fpr_without"), F.round(F.col("ft") - F.col("fo"), 9).alias("disparity"))


@query("D09_weighted_grid", f"""WITH {EVAL}, g AS (SELECT range * 5 AS w FROM range(21)), c AS (SELECT w, {CONF.format(t='0.5').replace('score', 's')} FROM (SELECT w, label, round(w / 100.0::DOUBLE * score + (100 - w) / 100.0::DOUBLE * other, 9) AS s FROM l, g) GROUP BY w), r AS (SELECT w, {RATES} FROM c)
SELECT w::INTEGER AS w, macro_f1 FROM r ORDER BY macro_f1 DESC, w LIMIT 1""")
def d09(spark, d):
    blend = lambda w: F.round(F.lit(w / 100.0) * F.col("score") + F.lit((100 - w) / 100.0) * F.col("other"), 9)
    one = frame(spark, d).agg(*[c.alias(f"{n}_{w}") for w in range(0, 101, 5) for n, c in zip(("tn", "fp", "fn", "tp"), M.confusion(score=blend(w)), strict=True)])
    each = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), *[F.col(f"{n}_{w}").alias(n) for n in ("tn", "fp", "fn", "tp")]) for w in range(0, 101, 5)]))
    r = M.rates(one.select(each.alias("x")).select("x.*"))
    return r.agg(F.max_by("w", F.struct("macro_f1", -F.col("w"))).alias("w"), F.max("macro_f1").alias("macro_f1"))


@query("D23_contrastive", f"WITH {EVAL} SELECT round(avg(pow(greatest(0, score - other), 2)), 9) AS loss FROM l")
def d23(spark, d):
    return frame(spark, d).agg(F.round(F.avg(F.pow(F.greatest(F.lit(0.0), F.col("score") - F.col("other")), F.lit(2))), 9).alias("loss"))


# --- resampling ---

TOPICS = f"""WITH {EVAL}, k AS (SELECT source AS topic, count(*) AS n, count(*) FILTER (WHERE (score >= 0.5) = (label = 1)) AS ok, count(*) FILTER (WHERE (other >= 0.5) = (label = 1)) AS ok2, count(*) FILTER (WHERE label <> 1) AS neg, count(*) FILTER (WHERE label <> 1 AND score >= 0.5) AS fp FROM l GROUP BY 1),
w AS (SELECT k.*, r.range AS replicate, {R.weight_sql("('0x' || substr(md5('r:' || topic), 1, 8))::BIGINT", "r.range")} AS w FROM k, range(1000) r),
b AS (SELECT replicate, sum(w * n) AS n, sum(w * ok) AS ok, sum(w * ok2) AS ok2, sum(w * neg) AS neg, sum(w * fp) AS fp FROM w GROUP BY 1) """


def _boot(spark, d):
    ok = lambda c: F.count_if((F.col(c) >= 0.5) == (F.col("label") == 1))
    neg = F.col("label") != 1
    k = frame(spark, d).groupBy(F.col("source").alias("topic")).agg(F.count("*").alias("n"), ok("score").alias("ok"), ok("other").alias("ok2"), F.count_if(neg).alias("neg"), F.count_if(neg & (F.col("score") >= 0.5)).alias("fp"))
    return R.replicated(k, "topic", ["n", "ok", "ok2", "neg", "fp"], 1000)


@query("E15_clustered_bootstrap", TOPICS + ", a AS (SELECT ok / nullif(n, 0)::DOUBLE AS acc FROM b) SELECT round(avg(acc), 9) AS mean, round(quantile_cont(acc, 0.025), 9) AS lo, round(quantile_cont(acc, 0.975), 9) AS hi FROM a")
def e15(spark, d):
    return _boot(spark, d).withColumn("acc", F.col("ok") / F.expr("nullif(n, 0)")).agg(F.round(F.avg("acc"), 9).alias("mean"), *R.interval("acc"))


@query("E15_bootstrap_fpr", TOPICS + ", a AS (SELECT fp / nullif(neg, 0)::DOUBLE AS v FROM b WHERE neg > 0) SELECT round(avg(v), 9) AS mean, round(quantile_cont(v, 0.025), 9) AS lo, round(quantile_cont(v, 0.975), 9) AS hi FROM a")
def e15b(spark, d):
    return _boot(spark, d).where("neg > 0").withColumn("v", F.col("fp") / F.col("neg")).agg(F.round(F.avg("v"), 9).alias("mean"), *R.interval("v"))


@query("E16_paired_bootstrap", TOPICS + ", a AS (SELECT (ok - ok2) / nullif(n, 0)::DOUBLE AS d FROM b) SELECT round(avg(d), 9) AS mean, round(quantile_cont(d, 0.025), 9) AS lo, round(quantile_cont(d, 0.975), 9) AS hi, round(least(1.0::DOUBLE, 2 * least(avg((d <= 0)::INTEGER), avg((d >= 0)::INTEGER))), 9) AS p FROM a")
def e16(spark, d):
    return _boot(spark, d).withColumn("d", (F.col("ok") - F.col("ok2")) / F.expr("nullif(n, 0)")).agg(F.round(F.avg("d"), 9).alias("mean"), *R.interval("d"), R.two_sided("d").alias("p"))


@query("J13_paired_replicates", TOPICS + "SELECT replicate::INTEGER AS replicate, round(ok / nullif(n, 0)::DOUBLE, 9) AS a, round(ok2 / nullif(n, 0)::DOUBLE, 9) AS b FROM b")
def j13(spark, d):
    return _boot(spark, d).select("replicate", F.round(F.col("ok") / F.expr("nullif(n, 0)"), 9).alias("a"), F.round(F.col("ok2") / F.expr("nullif(n, 0)"), 9).alias("b"))


def _rows(replicates: int) -> str:
    """Rows as units: n, hits of either system."""
    return f"""WITH {EVAL}, w AS (SELECT (score >= 0.5) = (label = 1) AS ok, (other >= 0.5) = (label = 1) AS ok2, r.range AS replicate, {R.weight_sql("('0x' || substr(md5('r:' || doc_id), 1, 8))::BIGINT", "r.range")} AS k FROM l, range({replicates}) r),
a AS (SELECT replicate, sum(CASE WHEN ok THEN k ELSE 0 END) / nullif(sum(k), 0)::DOUBLE AS acc, (sum(CASE WHEN ok THEN k ELSE 0 END) - sum(CASE WHEN ok2 THEN k ELSE 0 END)) / nullif(sum(k), 0)::DOUBLE AS d FROM w GROUP BY 1) """


def _row_boot(spark, d, replicates):
    hit = lambda c: ((F.col(c) >= 0.5) == (F.col("label") == 1)).cast("long")
    return R.replicated(frame(spark, d).select("doc_id", F.lit(1).alias("n"), hit("score").alias("ok"), hit("other").alias("ok2")), "doc_id", ["n", "ok", "ok2"], replicates)


@query("E17_row_bootstrap", _rows(100) + "SELECT round(avg(acc), 9) AS mean, round(quantile_cont(acc, 0.025), 9) AS lo, round(quantile_cont(acc, 0.975), 9) AS hi FROM a")
def e17(spark, d):
    a = _row_boot(spark, d, 100)
    return a.withColumn("acc", F.col("ok") / F.expr("nullif(n, 0)")).agg(F.round(F.avg("acc"), 9).alias("mean"), *R.interval("acc"))


@query("E17_paired_rows", _rows(1000) + "SELECT round(avg(d), 9) AS mean, round(quantile_cont(d, 0.025), 9) AS lo, round(quantile_cont(d, 0.975), 9) AS hi, greatest(0.001::DOUBLE, round(least(1.0::DOUBLE, 2 * least(avg((d <= 0)::INTEGER), avg((d >= 0)::INTEGER))), 9)) AS p FROM a")
def e17b(spark, d):
    """Both systems on one resample of rows, 1000 times; a p of 0 is given as 0.001, which 1000 replicates can tell."""
    a = _row_boot(spark, d, 1000).withColumn("d", (F.col("ok") - F.col("ok2")) / F.expr("nullif(n, 0)"))
    return a.agg(F.round(F.avg("d"), 9).alias("mean"), *R.interval("d"), F.greatest(F.lit(0.001), R.two_sided("d")).alias("p"))


@query("E18_holm", f"WITH {EVAL}, t AS (SELECT source AS name, round(abs(avg(score) - avg(other)) / 10, 9) AS p FROM l GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, name) AS rank, count(*) OVER () AS m FROM t), a AS (SELECT *, 0.05::DOUBLE / (m - rank + 1) AS alpha FROM r) SELECT name, p, rank::INTEGER AS rank, round(alpha, 9) AS alpha, p <= alpha AS below, min((p <= alpha)::INTEGER) OVER (ORDER BY p, name) = 1 AS stepdown FROM a")
def e18(spark, d):
    t = frame(spark, d).groupBy(F.col("source").alias("name")).agg(F.round(F.abs(F.avg("score") - F.avg("other")) / 10, 9).alias("p"))
    return R.holm(t).withColumn("alpha", F.round("alpha", 9))


@query("D14_holm_rank", f"WITH {EVAL}, t AS (SELECT source AS name, round(abs(avg(score) - avg(other)) / 10, 9) AS p FROM l GROUP BY 1) SELECT name, (row_number() OVER (ORDER BY p, name))::INTEGER AS rank FROM t")
def d14(spark, d):
    return e18(spark, d).select("name", "rank")


# --- multi-seed and verdicts ---

SEEDS = f"WITH {EVAL}, s AS (SELECT source, doc_id % 3 AS seed, avg((score >= 0.5)::INTEGER)::DOUBLE AS recall, coalesce(avg((other >= 0.5)::INTEGER)::DOUBLE, 0) AS fpr FROM l GROUP BY ALL), m AS (SELECT source, avg(recall) AS recall, stddev_pop(recall) AS std_pop, coalesce(stddev_samp(recall), 0) AS std, count(*) AS n, avg(fpr) AS fpr FROM s GROUP BY 1) "


def _seeds(spark, d):
    s = frame(spark, d).groupBy("source", (F.col("doc_id") % 3).alias("seed")).agg(F.avg((F.col("score") >= 0.5).cast("int")).alias("recall"), F.avg((F.col("other") >= 0.5).cast("int")).alias("fpr"))
    return s.groupBy("source").agg(F.avg("recall").alias("recall"), F.stddev_pop("recall").alias("std_pop"), F.coalesce(F.stddev_samp("recall"), F.lit(0.0)).alias("std"), F.count("*").alias("n"), F.avg("fpr").alias("fpr"))


@query("B21_multi_seed", SEEDS + "SELECT source, round(recall, 9) AS recall, round(std_pop, 9) AS std FROM m")
def b21(spark, d):
    return _seeds(spark, d).select("source", F.round("recall", 9).alias("recall"), F.round("std_pop", 9).alias("std"))


@query("B22_multi_seed_ci", SEEDS + "SELECT source, round(recall, 9) AS recall, round(std, 9) AS std, round(recall - 1.96::DOUBLE * std / sqrt(n), 9) AS lo, round(recall + 1.96::DOUBLE * std / sqrt(n), 9) AS hi FROM m")
def b22(spark, d):
    e = 1.96 * F.col("std") / F.sqrt("n")
    return _seeds(spark, d).select("source", F.round("recall", 9).alias("recall"), F.round("std", 9).alias("std"), F.round(F.col("recall") - e, 9).alias("lo"), F.round(F.col("recall") + e, 9).alias("hi"))


_LOO = SEEDS + ", r AS (SELECT avg(recall) AS r0, avg(fpr) AS f0 FROM m), x AS (SELECT source, round(100 * (recall - r0), 6) AS d_recall, round(100 * (fpr - f0), 6) AS d_fpr, recall, fpr FROM m, r) "


@query("J15_reference_deltas", _LOO + "SELECT source, d_recall, d_fpr FROM x")
def j15(spark, d):
    return _loo(spark, d).select("source", "d_recall", "d_fpr")


def _loo(spark, d):
    m = _seeds(spark, d)
    r = m.agg(F.avg("recall").alias("r0"), F.avg("fpr").alias("f0"))
    return m.crossJoin(F.broadcast(r)).withColumns({"d_recall": F.round(100 * (F.col("recall") - F.col("r0")), 6), "d_fpr": F.round(100 * (F.col("fpr") - F.col("f0")), 6)})  # one row


@query("E22_leave_one_out_verdict", _LOO + "SELECT source, CASE WHEN (d_recall >= -10 OR recall >= 0.85) AND (d_fpr <= 5 OR fpr <= 0.1) THEN 'ALLOWED' ELSE 'LIMITATION' END AS verdict FROM x")
def e22(spark, d):
    ok = ((F.col("d_recall") >= -10) | (F.col("recall") >= 0.85)) & ((F.col("d_fpr") <= 5) | (F.col("fpr") <= 0.1))
    return _loo(spark, d).select("source", F.when(ok, "ALLOWED").otherwise("LIMITATION").alias("verdict"))


_HALF = "('0x' || substr(md5('half' || doc_id), 1, 8))::BIGINT % 2 = 0"


@query("E24_sanity_verdict", f"""WITH {EVAL}, c AS (SELECT source, {_HALF} AS val, {C5} FROM l GROUP BY ALL), r AS (SELECT source, val, {RATES} FROM c),
v AS (SELECT source, max(accuracy) FILTER (WHERE val) AS va, max(accuracy) FILTER (WHERE NOT val) AS ta, max(fpr) FILTER (WHERE val) AS vf FROM r GROUP BY source)
SELECT source, CASE WHEN va > 0.99 OR ta > 0.99 THEN 'possible leak' WHEN abs(va - ta) > 0.05 THEN 'gap' WHEN vf > 0.01 THEN 'fpr too high' ELSE 'ok' END AS verdict FROM v""")
def e24(spark, d):
    """The first that holds of a validation and a test half, here of each source."""
    val = T.bucket(F.concat(F.lit("half"), "doc_id"), 2) == 0
    r = M.rates(frame(spark, d).groupBy("source", val.alias("val")).agg(*M.confusion()))
    v = r.groupBy("source").agg(F.max(F.when(F.col("val"), F.col("accuracy"))).alias("va"), F.max(F.when(~F.col("val"), F.col("accuracy"))).alias("ta"), F.max(F.when(F.col("val"), F.col("fpr"))).alias("vf"))
    from ..operators.studies import sanity

    return v.select("source", sanity(F.col("va"), F.col("ta"), F.col("vf")).alias("verdict"))


@query("F04_leave_one_group_out", f"WITH {EVAL} SELECT source, count(*) AS n FROM l WHERE source <> 'src0' GROUP BY source")
def f04(spark, d):
    return frame(spark, d).where("source <> 'src0'").groupBy("source").agg(F.count("*").alias("n"))


@query("S08_worst_false_positives", f"WITH {EVAL} SELECT doc_id, score FROM l WHERE label <> 1 AND score >= 0.5 ORDER BY score DESC, doc_id LIMIT 25")
def s08(spark, d):
    return frame(spark, d).where("label <> 1 and score >= 0.5").orderBy(F.desc("score"), "doc_id").limit(25).select("doc_id", "score")


_K = {10: 1, 25: 2, 50: 5}
#: Whole documents of ten rows of label 0, and donors of label 1 by their rank in a topic or domain.
_DONORS = f"""WITH {EVAL}, host AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM l WHERE label = 0),
h AS (SELECT place // 10 AS block, place % 10 AS pos, score, source, lang FROM host WHERE place // 10 < (SELECT count(*) FROM host) // 10),
dt AS (SELECT source, score, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rank FROM l WHERE label = 1), dd AS (SELECT lang, score, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS rank FROM l WHERE label = 1),
nt AS (SELECT source, count(*) AS m FROM dt GROUP BY 1), nd AS (SELECT lang, count(*) AS m FROM dd GROUP BY 1),
b AS (SELECT h.block, h.source, h.lang, coalesce(nt.m, 0) AS mt, coalesce(nd.m, 0) AS md FROM h LEFT JOIN nt USING (source) LEFT JOIN nd USING (lang) WHERE pos = 0)"""


def _mixed(k: int) -> str:
    """Table m{k}: k places by a hash, k donors by drawing below m - k + 1, m - k + 2, ... where one that is taken gives way to the bound."""
    hash_ = lambda i: f"('0x' || substr(md5('donor:{k}:' || block || ':{i}'), 1, 8))::BIGINT"
    cols, taken = [], []
    for i in range(k):
        bound = f"(m - {k} + {i})"
        inside = f"CASE WHEN list_contains([{', '.join(taken)}]::BIGINT[], {hash_(i)} % ({bound} + 1)) THEN {bound} ELSE {hash_(i)} % ({bound} + 1) END"
        cols.append(f"CASE WHEN m < {k} THEN {hash_(i)} % m ELSE {inside} END AS c{i}")
        taken.append(f"c{i}")
    steps = f"g{k}_0 AS (SELECT block, source, lang, mt >= {k} AS own, CASE WHEN mt >= {k} THEN mt ELSE md END AS m FROM b WHERE CASE WHEN mt >= {k} THEN mt ELSE md END > 0)"
    for i, c in enumerate(cols):
        steps += f", g{k}_{i + 1} AS (SELECT *, {c} FROM g{k}_{i})"
    return f"""{steps}, u{k} AS (SELECT block, source, lang, own, unnest([{', '.join(taken)}]) AS rank, unnest(range({k})) AS i FROM g{k}_{k}),
s{k} AS (SELECT u.block, u.i, coalesce(dt.score, dd.score) AS donor FROM u{k} u LEFT JOIN dt ON u.own AND dt.source = u.source AND dt.rank = u.rank LEFT JOIN dd ON NOT u.own AND dd.lang = u.lang AND dd.rank = u.rank),
p{k} AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY md5('place:{k}:' || block || ':' || pos), pos) - 1 AS i FROM h),
m{k} AS (SELECT p.block, p.pos, s.donor IS NOT NULL AS inserted, coalesce(s.donor, p.score) AS score FROM p{k} p LEFT JOIN s{k} s USING (block, i))"""


@query("J10_donor_match", f"{_DONORS}, {_mixed(5)} SELECT block, pos::INTEGER AS pos, inserted, round(score, 9) AS score FROM m5")
def j10(spark, d):
    from ..operators.studies import mixed_documents

    return mixed_documents(frame(spark, d), 10, [5]).select("block", "pos", "inserted", F.round("score", 9).alias("score"))


def _mixed_row(percent: int, w: int) -> str:
    return f"""SELECT {percent} AS percent, {w} AS w, count(*) FILTER (WHERE inserted AND s >= 0.5) AS tp, count(*) FILTER (WHERE inserted AND s < 0.5) AS fn, count(*) FILTER (WHERE NOT inserted AND s >= 0.5) AS fp, count(*) FILTER (WHERE NOT inserted AND s < 0.5) AS tn, count(DISTINCT block) FILTER (WHERE s >= 0.5) / nullif(count(DISTINCT block), 0)::DOUBLE AS detected
FROM (SELECT *, avg(score) OVER (PARTITION BY block ORDER BY pos ROWS BETWEEN {w // 2} PRECEDING AND {w // 2} FOLLOWING) AS s FROM m{_K[percent]}) HAVING count(*) > 0"""


@query("E20_mixed_authorship", f"{_DONORS}, {', '.join(map(_mixed, _K.values()))}, g AS ({' UNION ALL '.join(_mixed_row(p, w) for p in _K for w in (1, 3, 5))}), r AS (SELECT percent, w, detected, {RATES} FROM g) SELECT percent, w, macro_f1, recall, fpr, round(detected, 9) AS detected FROM r")
def e20(spark, d):
    """Documents of ten rows with 10, 25 or 50 % inserted, smoothed by windows of 1, 3 and 5."""
    from ..operators.studies import mixed_documents, mixed_results

    r = mixed_results(mixed_documents(frame(spark, d), 10, list(_K.values())), (1, 3, 5))
    percent = F.element_at(F.create_map(*(F.lit(x) for p, k in _K.items() for x in (k, p))), F.col("k"))
    return M.rates(r).select(percent.alias("percent"), "w", "macro_f1", "recall", "fpr", F.round("detected", 9).alias("detected"))
