"""Resampling, curves, folds, ensembles and trained models on cases that are worked by hand or by plain Python."""

import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import metrics as M
from textloom.operators import resample as R
from textloom.operators import sampling as S
from textloom.operators import scoring as K
from textloom.operators import studies as U
from textloom.operators import training as L
from textloom.operators.ranks import bounds, numbered


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_weights_are_poisson():
    w = R.weights(np.arange(4000) * 1_000_003 % 2**32, 200)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    share = np.bincount(w.reshape(-1), minlength=5)[:5] / w.size
    assert np.allclose(share, [math.exp(-1) / math.factorial(k) for k in range(5)], atol=0.005)
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06


def test_replicates_are_sums_of_vectors(spark):
    """Each replicate is the weighted sum by plain Python; tasks yield a row for each replicate, and nothing explodes."""
    rows = [(f"t{i}", i, i % 3, None if i % 7 == 0 else 1) for i in range(200)]
    d = spark.createDataFrame(rows, "topic string, a long, b int, c long").repartition(5)
    got = R.replicated(d, "topic", ["a", "b", "c"], 50)
    marks = [r.m for r in d.select("topic", T.bucket(F.concat_ws(":", F.lit("r"), "topic"), 2**32).alias("m")).orderBy(F.expr("cast(substr(topic, 2) as int)")).collect()]
    want = R.weights(np.array(marks), 50).T @ np.array([[a, b, c or 0] for _, a, b, c in rows])
    assert [tuple(r)[1:] for r in got.orderBy("replicate").collect()] == [tuple(x) for x in want.tolist()]
    assert "Generate" not in plan(got) and "CartesianProduct" not in plan(got) and "NestedLoop" not in plan(got)
    assert R.replicated(d.limit(0), "topic", ["a"], 3).agg(F.sum("a")).first()[0] == 0


@pytest.mark.parametrize("least", [0.0, 0.999])
def test_curve_ranges_follow_the_scores(spark, least):
    rng = random.Random(4)
    rows = [(rng.randrange(2), least + (1 - least) * rng.random()) for _ in range(4000)]
    d = spark.createDataFrame(rows, "label int, score double")
    cuts = np.array(bounds(d, "score", M.PARTS))
    sizes = Counter(np.searchsorted(cuts, [s for _, s in rows], "right").tolist())
    assert len(sizes) > 200 and max(sizes.values()) < 80
    got = {r.score: (r.tp, r.fp) for r in M.roc(d).collect()}
    tp = fp = 0
    for y, s in sorted(rows, key=lambda r: -r[1]):
        tp, fp = tp + y, fp + 1 - y
        assert got[s] == (tp, fp)


def test_numbered(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(1000), k) for k in range(500)]
    d = spark.createDataFrame(rows, "g string, x int, k int")
    got = [tuple(r) for r in numbered(d, ["g"], ["x", "k"]).collect()]
    for g in ("a", "b", None):
        own = sorted((x, k) for h, x, k in rows if h == g)
        assert sorted((p, x, k) for h, x, k, p in got if h == g) == [(p, x, k) for p, (x, k) in enumerate(own)]


def test_folds_stream_over_many_ranges(spark):
    """Over ranges that are not put together: the fold in one order, by plain Python, and folds of about one size."""
    rng = random.Random(3)
    counts = {f"t{i:03}": rng.randrange(1, 40) for i in range(300)}
    d = spark.createDataFrame([(t,) for t, n in counts.items() for _ in range(n)], "topic string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.topic: r.fold for r in S.group_folds(d, "topic").distinct().collect()}
        split = {r.topic: r.split for r in S.topic_split(d, "topic").distinct().collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    step, have = S.lightest_step(5), Counter()
    for t, n in sorted(counts.items(), key=lambda x: (x[1], x[0]), reverse=True):
        assert got[t] == step(n)
        have[got[t]] += n
    assert max(have.values()) - min(have.values()) <= 2
    import hashlib

    total = sum(counts.values())
    step = S.deficit_step([0.8 * total, 0.1 * total, 0.1 * total])
    for t in sorted(counts, key=lambda t: (hashlib.md5(f"{t}42".encode()).hexdigest(), t)):
        assert split[t] == step(counts[t])


def test_group_folds_by_size(spark):
    """Groups of 9, 7, 6, 5, 3, 2 over three folds: 9; 7 and 3; 6 and 5; the last to the first."""
    d = spark.createDataFrame([(g,) for g, n in zip("abcdef", (9, 7, 6, 5, 3, 2), strict=True) for _ in range(n)], "g string")
    assert {r.g: r.fold for r in S.group_folds(d, "g", 3).distinct().collect()} == {"a": 0, "b": 1, "c": 2, "d": 2, "e": 1, "f": 0}


def test_drawn_numbers(spark):
    d = spark.range(3000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 9 + 1).alias("m"))
    five = Counter()
    for r in d.select("m", U.drawn(F.col("m"), 5, F.col("k")).alias("x")).collect():
        assert len(r.x) == 5 and all(0 <= v < r.m for v in r.x)
        assert r.m < 5 or len(set(r.x)) == 5
        if r.m == 6:
            five[tuple(sorted(r.x))] += 1
    assert len(five) == 6 and max(five.values()) < 2 * min(five.values())


def test_mixed_documents(spark):
    """Complete documents only, distinct places all over them, donors of the topic, else of the domain, else none."""
    rows = [(i, 0, "s0" if i < 20 else "s1" if i < 40 else "s2", "en" if i < 40 else "fr", 0.1) for i in range(57)]
    rows += [(100 + i, 1, "s0", "en", 0.5 + i / 1000) for i in range(30)] + [(200, 1, "s1", "en", 0.9)]
    d = spark.createDataFrame(rows, "doc_id long, label int, source string, lang string, score double")
    m = U.mixed_documents(d, 10, [1, 5]).collect()
    assert {(r.k, r.block) for r in m} == {(k, b) for k in (1, 5) for b in range(5)} and len(m) == 100
    for k in (1, 5):
        for b in range(5):
            own = [r for r in m if r.k == k and r.block == b]
            hit = [r for r in own if r.inserted]
            assert sorted(r.pos for r in own) == list(range(10)) and len(hit) == (0 if b == 4 else k)
            assert len({r.score for r in hit}) == len(hit) and all((r.score == 0.1) != r.inserted for r in own)
            if b in (2, 3):
                assert all(r.score == 0.9 for r in hit) if k == 1 else len(hit) == 5  # of the topic one donor; five come from the domain
    assert len({r.pos for r in m if r.inserted}) > 6


def test_simplex_and_gate(spark):
    rng = random.Random(12)
    rows = []
    for _ in range(400):
        y = rng.randrange(2)
        rows.append((y, min(1.0, max(0.0, rng.gauss(0.35 + 0.3 * y, 0.2))), min(1.0, max(0.0, rng.gauss(0.4 + 0.2 * y, 0.25)))))
    d = spark.createDataFrame(rows, "label int, mb double, pool double").repartition(3)
    w, b = L.gate(d, ["mb", "pool"])
    # the gate is where the gradient of the penalised loss is null
    x, y = np.array([r[1:] for r in rows]), np.array([r[0] for r in rows])
    p = 1 / (1 + np.exp(-(x @ np.array(w) + b)))
    assert np.allclose(x.T @ (p - y) + np.array(w), 0, atol=0.02) and abs((p - y).sum()) < 0.02
    g = d.withColumn("g", T.sigmoid(F.lit(w[0]) * F.col("mb") + F.lit(w[1]) * F.col("pool") + F.lit(b)))
    counted = L.simplex_counts(g, {"t": ("mb", "pool", "g")})
    assert len(L.SIMPLEX) == 231 and counted.count() == 231 and "Generate" not in plan(counted)
    best = (-1.0, None)
    for i, j, k in L.SIMPLEX:
        hit = np.round(i / 20 * x[:, 0] + j / 20 * x[:, 1] + k / 20 * p, 9) >= 0.5
        f = [2 * (hit & (y == 1)).sum() / (hit.sum() + (y == 1).sum()), 2 * (~hit & (y == 0)).sum() / ((~hit).sum() + (y == 0).sum())]
        if sum(f) / 2 > best[0] + 1e-9:
            best = sum(f) / 2, (i / 20, j / 20, k / 20)
    r = L.best_simplex(g, {"t": ("mb", "pool", "g")}).first()
    assert (r.w1, r.w2, round(r.w3, 9)) == best[1] and abs(r.macro_f1 - best[0]) < 1e-6


def test_fusion_of_all_inputs_round_trips(spark, monkeypatch):
    monkeypatch.setattr(L, "ITERATIONS", 15)
    rng = random.Random(2)
    rows = [(i // 8, i % 8, f"t{i // 40}", i % 2, rng.random() * 0.6 + 0.4 * (i % 2), rng.random(), rng.randrange(3, 30)) for i in range(320)]
    f = K.fusion_features(spark.createDataFrame(rows, "doc_id int, sent_idx int, topic string, label int, score double, other double, n_words int"))
    m = L.train_fusion(f, list(K.FUSION_FEATURES), "topic")
    assert m["feature_names"] == list(K.FUSION_FEATURES) and len(m["coefficients"]) == 13
    again = K.load_model(json.dumps(m))
    scored = f.select("label", K.logistic_score(again).alias("score"), K.logistic_score(again, calibrated=True).alias("c"))
    assert M.auc(scored).first().auc > 0.8 and scored.where("c < 0 or c > 1").isEmpty()
    folds = L.out_of_fold(f, list(K.FUSION_FEATURES), "topic")
    assert folds.count() == 320 and M.auc(folds.select("label", F.col("p").alias("score"))).first().auc > 0.75


def test_tfidf_of_a_small_corpus(spark):
    docs = [(1, "Red fish blue fish"), (2, "the red bird, a red bird"), (3, None), (4, "of the")]
    v, terms = L.tfidf(spark.createDataFrame(docs, "doc_id int, text string"), 6)
    grams = {1: ["red", "fish", "blue", "fish", "red fish", "fish blue", "blue fish"], 2: ["red", "bird", "red", "bird", "red bird", "bird red", "red bird"]}
    total, df = Counter(g for x in grams.values() for g in x), Counter(g for x in grams.values() for g in set(x))
    kept = sorted(sorted(total, key=lambda g: (-total[g], g))[:6])
    assert {r.term: (r["index"], r.df) for r in terms.collect()} == {g: (k, df[g]) for k, g in enumerate(kept)}
    for r in v.collect():
        own = Counter(g for g in grams.get(r.doc_id, []) if g in kept)
        w = {kept.index(g): (1 + math.log(n)) * (1 + math.log(5 / (1 + df[g]))) for g, n in own.items()}
        size = math.sqrt(sum(x * x for x in w.values()))
        assert r.indices == sorted(w) and all(abs(a - w[i] / size) < 1e-12 for i, a in zip(r.indices, r.weights, strict=True))
    assert "Python" not in plan(v) and "Arrow" not in plan(v)


def test_tfidf_baseline_learns(spark, monkeypatch):
    monkeypatch.setattr(L, "ITERATIONS", 10)
    d = spark.createDataFrame([(i, ("good plain words here" if i % 3 else "other bad words there") + f" w{i}", int(i % 3 > 0)) for i in range(60)], "doc_id int, text string, label int")
    p = L.tfidf_baseline(d)
    assert "Python" not in plan(p.select("doc_id")) and all((r.p > 0.5) == (r.label == 1) for r in p.collect())


def test_batches_by_length(spark):
    """A scorer is loaded once for each task; scores do not depend on batches; sorting saves most of the padding."""
    rng = random.Random(7)
    texts = ["x" * rng.choice([5, 50, 500]) for _ in range(300)] + [None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "k int, text string").coalesce(1)
    loads = spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)
        return lambda batch: [len(t) / 1000 for t in batch]

    got = K.score_in_batches(d, load, "text", 32).collect()
    assert loads.value == 1 and all(r.score == len(r.text or "") / 1000 for r in got)
    one = K.score_in_batches(d, load, "text", 1).agg(F.sum("padded")).first()[0]
    assert one == sum(len(t or "") for t in texts)
    padded = sum(r.padded for r in got)
    assert one <= padded < 1.2 * one < sum(max(len(t or "") for t in texts[i : i + 32]) * len(texts[i : i + 32]) for i in range(0, 302, 32))
