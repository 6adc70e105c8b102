"""Cases with known results, and edges."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import citations as C
from textloom.operators import dedupe as U
from textloom.operators import document as D
from textloom.operators import metrics as M
from textloom.operators import robustness as B
from textloom.operators import sampling as S
from textloom.operators import segment as G
from textloom.sources import files as A


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first().y


@pytest.mark.parametrize(("x", "y"), [
    ("<p>Hello <b>world</b></p>", "Hello world"), ("Hello\x00 world\r\n", "Hello world"), ("“q” ‘s’", "\"q\" 's'"),
    ("## Header\n**bold** and _italic_", "Header\nbold and italic"), ("Too    much   space", "Too much space"), ("run `code` now", "run code now"), (None, ""),
])
def test_clean(spark, x, y):
    assert one(spark, x, T.clean("x")).replace("  ", " ") == y


def test_sentences_and_topics(spark):
    assert len(one(spark, "Hello world. This is a sentence! Does it work? Yes, indeed.", T.sentences("x"))) == 4
    assert one(spark, "Car-free Cities! (USA)", T.topic("x")) == "carfree_cities_usa"
    assert one(spark, "  ", T.topic("x")) == one(spark, None, T.topic("x")) == "unknown_topic"


@pytest.mark.parametrize(("x", "y"), [("see 10.1000/xyz123.", "10.1000/xyz123"), ("https://doi.org/10.1000/abc)", "10.1000/abc"), ("doi:10.1000/a.b;", "10.1000/a.b"), ("none", None)])
def test_doi(spark, x, y):
    assert one(spark, x, T.doi("x")) == y


def test_locks(spark):
    x = "The NASA study [1] found 45% of $a+b$ (Smith, 2020)."
    text, held = T.lock_text(x)
    assert T.restore_text(text, held) == x and "NASA" not in text
    r = spark.createDataFrame([(x,)], "x string").select(T.locked("x").alias("l")).select("l.*").select(T.restored("text", "held").alias("r"), T.locks_intact(T.restored("text", "held"), "held").alias("ok")).first()
    assert r.r == x and r.ok


def test_smoothing_edges(spark):
    d = spark.createDataFrame([(1, 0, 0.5), (2, 0, 0.0), (2, 1, 1.0), (3, 0, 0.0), (3, 1, 1.0), (3, 2, 0.0)], "doc_id int, sent_idx int, score double")
    got = {(r.doc_id, r.sent_idx): round(r.smoothed, 6) for r in D.smoothed(d).collect()}
    assert got == {(1, 0): 0.5, (2, 0): 0.0, (2, 1): 1.0, (3, 0): 0.3, (3, 1): 0.5, (3, 2): 0.3}
    assert [round(r.average, 4) for r in D.moving_average(d.where("doc_id = 3"), 3).orderBy("sent_idx").collect()] == [0.5, 0.3333, 0.5]


def test_sections_ignore_a_heading_in_the_first_row(spark):
    d = spark.createDataFrame([(1, i, t) for i, t in enumerate(["Abstract", "x text", "1. Introduction", "y text", "Introduction", "Results"])], "doc_id int, sent_idx int, sentence string")
    got = [(r.section_id, r.section) for r in D.sections(d, T.heading("sentence")).orderBy("sent_idx").collect()]
    assert got == [(1, "HEADER"), (1, "HEADER"), (2, "INTRO"), (2, "INTRO"), (2, "INTRO"), (3, "RESULTS")]


def test_dedupe_chain(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id int, text string")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a int, b int")
    classes = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "doc_id int, rep int")
    assert sorted(r.doc_id for r in U.greedy_keep(docs, pairs, classes).collect()) == [1, 3]


def test_dedupe_case(spark):
    rows = ["this is an example sentence number one", "this is an example sentence number one", "this is an example sentence number one!!", "this is an example sentence number two", "entirely other words stand in here today"]
    d = U.keep_first(spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string"), "text", ["doc_id"])
    assert U.greedy_keep(d, U.similar_pairs(d, 0.8), U.shingle_classes(d)).count() == 3


def test_copies_are_not_expanded_into_pairs(spark):
    texts = ["one two three four five six seven eight nine ten"] * 50 + ["one two three four five six seven eight nine ten eleven"] * 50 + ["", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [(r.a, r.b, r.jaccard) for r in U.similar_pairs(d, 0.8).collect()] == [(0, 50, 0.888888889)]
    assert Counter(r.rep for r in U.shingle_classes(d).collect()) == {0: 50, 50: 50}
    kept = U.greedy_keep(d, U.similar_pairs(d, 0.8), U.shingle_classes(d))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 100, 101]


def test_split_is_disjoint_and_whole(spark):
    d = spark.createDataFrame([(i, f"t{i % 5}") for i in range(100)], "doc_id int, topic string")
    s = S.topic_split(d, "topic")
    assert s.count() == 100 and S.leaks(s, "topic").isEmpty()


def test_style(spark):
    f = lambda x: C.style(spark.createDataFrame([(1, x)], "doc_id int, text string")).first()
    r = f("Shown in [1], [2] and [3], [5]–[7].\nReferences\n[1] A. B, Title.\n[2] C. D, Title.")
    assert r.style == "IEEE" and r.confidence >= 0.8
    assert f("So (Smith, 2020) and (Jones, 2019) say.").style == "APA"
    assert f("nothing here").style == "UNKNOWN" and f("nothing here").confidence == 0.0


def test_markers_and_matching(spark):
    d = spark.createDataFrame([(1, "See [1], [3], [4].\n[1] Smith, A title of one. 2019\n[2] Jones, A title of two. 2018\n[3] Brown, Another title. 2017")], "doc_id int, text string")
    body = d.withColumn("text", F.lit("See [1], [3], [4]."))
    m, un, left = C.matched(C.numbered_markers(body), C.references(d))
    assert sorted(r.number for r in m.collect()) == [1, 3] and [r.number for r in un.collect()] == [4] and [r.number for r in left.collect()] == [2]
    x = spark.createDataFrame([(1, "[3], [5]–[7], [12]")], "doc_id int, text string")
    assert sorted(r.number for r in C.numbered_markers(x).collect()) == [3, 5, 6, 7, 12]


def test_metadata_status(spark):
    d = spark.createDataFrame([("Smith, Deep Models of Text, 2019", "Deep Models of Text", "2019"), ("Smith, Deep Models of Text, 2018", "Deep Models of Text", "2019"), ("Other", "Deep Models of Text", "2019")], "r string, t string, y string")
    assert [x.s for x in d.select(C.metadata_status("r", "t", "y").alias("s")).collect()] == ["verified", "partial_match", "mismatch"]


def test_metrics_edges(spark):
    d = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)], "label int, score double")
    assert M.auc(d).first().auc == 0.625
    assert M.auc(d.where("label = 1")).first().auc is None
    e = spark.createDataFrame([(0, 0.0), (1, 1.0), (0, 0.1)], "label int, score double")
    assert {r.bin: r.n for r in M.reliability(e).collect()} == {0: 1, 1: 1, 9: 1}


def test_report_golden(spark):
    p = B.verdicts(spark.createDataFrame([("m", 90.0, 40.0)], "method string, original double, rewritten double"))
    r = B.report(p, ["method"]).where("method is null").first()
    assert (r.acc_original, r.acc_rewritten, r.flip_rate, r.mean_drop, r.ari) == (100.0, 0.0, 100.0, 50.0, 0.0)


def test_vocabulary(spark):
    assert "delve" not in one(spark, "We delve into the the realm and delve.", B.plain_words("x")).lower()
    assert one(spark, "We saw the the dog.", B.plain_words("x")) == "We saw the dog."


def test_vocabulary_has_the_whole_maps(spark):
    assert len(B.PHRASES) == 24 and len(B.SYNONYMS) == 20
    assert one(spark, "It is important to note that we  delve into a comprehensive framework.\nit grew, (Crucial).", B.plain_words("x")) in {f"Notably, we explore a thorough framework. It grew, ({w})." for w in ("Vital", "Essential", "Key")}
    for word, choice in B.SYNONYMS.items():
        got = {B.plainer(f"they {word}, so", str(k)) for k in range(40)}
        assert got == {f"They {w}, so" for w in choice}
    assert B.plainer("we utilize __LOCK_1_delve it", "k") == "We utilize __LOCK_1_delve it" and B.plainer(None, "k") is None
    two = spark.createDataFrame([(k, "a crucial point") for k in range(40)], "doc_id long, x string")
    assert {r.y for r in two.select(B.plain_words("x", "doc_id").alias("y")).collect()} == {f"A {w} point" for w in B.SYNONYMS["crucial"]}


@pytest.mark.parametrize("name", ["R01_contractions", "R02_punctuation", "R03_clauses", "R04_splits", "R05_vocabulary", "R06_openings", "R07_active_voice", "R08_combined", "R09_rule_based", "R11_attack_rows", "F05_held_out_family", "T18_signature_counts", "B29_signature_density"])
def test_perturbations_read_the_texts(spark, tmp_path, name):
    """Texts that are long, null or of several lines come out as the rules say."""
    from textloom import catalog

    hit = "It's a test: furthermore - we delve; moreover it is late, but we can't stop."
    texts = [None, "", hit, f"first line\n{hit}\nlast line", f"{hit} " * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = catalog.queries()[name](spark, str(tmp_path)).collect()
    if name.startswith(("R11", "F05")):
        for f, op in {"clean": lambda c, key: F.col(c), **B.ATTACKS}.items():
            want = {r.doc_id: r.x for r in docs.select("doc_id", op("text", "doc_id").alias("x")).collect()}
            got = {r.doc_id: r.attacked_text for r in rows if r.attack_family == f}
            assert got == (want if f == "vocabulary" or name.startswith("R11") else {})
    elif name.startswith("T18"):
        assert {r.word: r.n for r in rows if r.doc_id == 4} == {"delve": 400, "furthermore": 400, "moreover": 400}
    elif name.startswith("B29"):
        assert {r.doc_id for r in rows if r.density > 0} == {2, 3, 4} and len(rows) == 5
        assert {r.fingerprint for r in rows if r.doc_id > 1} == {"Claude Writing Fingerprint"}
    else:
        out = {r.doc_id: r.out for r in rows}
        assert len(out) == 5 and out[0] is None and out[1] == ""
        if not name.startswith(("R03", "R04")):
            assert len(out[4]) > 20_000


@pytest.mark.parametrize(("rule", "text", "outcomes"), [
    (B.contractions, "It's late, we do not stop.", {"it is late, we do not stop.", "It's late, we don't stop."}),
    (B.punctuation, "a; b: c", {"a. b: c", "a — b: c", "a. b — c", "a — b — c", "a, b: c", "a. b, c", "a, b, c"}),
    (B.clauses, "Although it rains, we go out!", {"Although it rains, we go out!", "We go out, although it rains!"}),
    (B.clauses, "Although it rains,\nwe go out", {"Although it rains,\nwe go out", "We go out, although it rains."}),
    (B.clauses, "We go out although it rains.", {"We go out although it rains."}),
    (B.splits, "One, this part has over twenty letters, but that one goes on too.", {"One, this part has over twenty letters, but that one goes on too.", "this part has over twenty letters. That one goes on too.", "this part has over twenty letters; but that one goes on too."}),
    (B.splits, "Too short, and so it stays.", {"Too short, and so it stays."}),
    (B.openings, "Furthermore, yes.  However, no.", {"in addition, yes. though, no.", "Furthermore, yes. though, no.", "in addition, yes. However, no.", "Furthermore, yes. However, no."}),
])
def test_coins_choose_between_the_outcomes(spark, rule, text, outcomes):
    d = spark.createDataFrame([(k, text) for k in range(300)], "doc_id long, text string")
    assert {r.out for r in d.select(rule("text", "doc_id").alias("out")).collect()} == outcomes


@pytest.mark.parametrize(("tone", "text", "want"), [
    ("resume", "Collaborated on database query optimization, achieving a 25% reduction in API latency.  Built it.", "I worked on database query optimization to cut reduction by 25% in API latency. I built it."),
    ("academic", "Collaborated on  it.\nBuilt it.", "Collaborated on it. Built it."),
    ("resume", "Curve Number Method The method was introduced by us.", "The method was created by us."),
    ("resume", "", ""), ("resume", None, None),
])
def test_active_voice(spark, tone, text, want):
    assert one(spark, text, B.active_voice("x", tone)) == want


def test_combined_rewrite(spark):
    text = "Furthermore, it is crucial to delve into the multifaceted structure of models. Moreover, meticulous tuning underscores the gains."
    out = one(spark, text, B.combined("x"))
    assert "delve" not in out.lower() and "meticulous" not in out.lower() and "we must explore" in out


def test_heuristic_fusion_takes_the_first_rule(spark):
    """Worked by hand: transition, else low burstiness, else the larger, else the mean; single scores; metadata."""
    rows = [(.8, .1, True, True, False, .95), (.2, .1, True, False, False, .8), (.9, .95, True, False, False, .99), (.36, .3, False, True, False, .46), (.3, .2, False, True, False, .25), (.4, .1, False, False, False, .4),
            (.3, .2, False, False, False, .25), (.95, .9, False, True, False, .99), (.9, .9, True, True, True, .02), (None, .7, False, True, False, .7), (.5, None, True, False, False, .77), (None, None, False, False, False, .02)]
    d = spark.createDataFrame(rows, "a double, b double, t boolean, l boolean, m boolean, want double")
    from textloom.operators.scoring import heuristic_fusion

    for r in d.select("want", heuristic_fusion("a", "b", "t", "l", "m").alias("got")).collect():
        assert abs(r.want - r.got) < 1e-9
    off = d.limit(1).select(heuristic_fusion("a", "b", "t", "l", "m", frozenset()).alias("got")).first().got
    assert abs(off - .45) < 1e-9


def test_a_stored_model_of_thirteen_inputs_scores(spark):
    import json

    from textloom.operators import scoring as K

    names = list(K.FUSION_FEATURES)
    m = K.load_model(json.dumps({"model_type": "x", "feature_names": names, "coefficients": [1.0] + [0.0] * 11 + [2.0], "intercept": 0.5, "scaler_mean": [0.25] + [0.0] * 12, "scaler_scale": [0.5] + [1.0] * 12, "val_threshold": 0.59, "calibrator_x": [k / 100 for k in range(101)], "calibrator_y": [0.0] * 51 + [1.0] * 50}))
    d = spark.createDataFrame([(1, 0, 3, .5, .9), (1, 1, 4, .1, .2)], "doc_id long, sent_idx int, n_words long, score double, other double")
    f = K.fusion_features(d)
    r = {x.sent_idx: x for x in f.withColumn("p", K.logistic_score(m)).withColumn("c", K.logistic_score(m, True)).collect()}
    import math

    assert abs(r[0].p - 1 / (1 + math.exp(-(0.5 + (.5 - .25) / .5 + 2 * .9)))) < 1e-9 and r[0].c == 1.0
    assert (r[0].prev_prob_rob, r[0].next_prob_rob, r[1].next_prob_mb, r[0].word_len) == (.5, .1, .2, 3.0) and abs(r[0].neighbor_mean_mb - .55) < 1e-9


def test_trained_fusion_model(spark):
    import random

    from textloom.operators.training import train_fusion

    rng = random.Random(3)
    rows = []
    for k in range(400):
        y = rng.random() < 0.5
        rows.append((k, f"t{k % 20}", int(y), min(1.0, max(0.0, rng.gauss(.65 if y else .35, .2))), rng.random()))
    m = train_fusion(spark.createDataFrame(rows, "doc_id long, topic string, label int, score double, other double"), ["score", "other"], "topic")
    assert m["coefficients"][0] > 1 > abs(m["coefficients"][1]) and 0.05 <= m["val_threshold"] <= 0.95
    y = m["calibrator_y"]
    assert len(y) == 101 and y == sorted(y) and 0 <= y[0] < 0.3 and 0.7 < y[-1] <= 1
    mean = sum(r[3] for r in rows) / 400
    assert abs(m["scaler_mean"][0] - mean) < 1e-9


def test_csv_discovery(spark, tmp_path):
    (tmp_path / "x.csv").write_text('essay,generated,prompt_name\n"a, b\nc",1,P\nd,0,Q\n')
    r = A.read_corpus(spark, f"file://{tmp_path}/x.csv").orderBy("label").collect()
    assert [(x.text, x.label, x.topic_id) for x in r] == [("d", 0, "Q"), ("a, b\nc", 1, "P")]
    with pytest.raises(ValueError, match="no column for label"):
        A.discover(spark.createDataFrame([("a",)], "text string"))


def test_bibliography(spark):
    d = spark.createDataFrame([(1, "First one. Second one.\nReferences\n[1] A. [2] B.")], "doc_id int, text string")
    got = [(r.part, r.piece) for r in G.bibliography_split(d).orderBy("part", "idx").collect()]
    assert got == [("body", "First one."), ("body", "Second one."), ("reference", "[1] A."), ("reference", "[2] B.")]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "doc_id long, text string")
    assert U.similar_pairs(e, 0.8).count() == 0 and C.style(e).count() == 0 and G.token_windows(e, 8, 4, 2).count() == 0


def test_stream_matches_batch(spark, tmp_path):
    from conftest import DATA

    from textloom.streaming.documents import counted_events, score_stream, scored_documents

    got = score_stream(spark, f"{DATA}/documents.parquet", f"file://{tmp_path}/out")
    want = scored_documents(spark.read.parquet(f"{DATA}/documents.parquet"))
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    assert counted_events(spark.read.parquet(f"{DATA}/events.parquet")).agg(F.sum("n")).first()[0] == 1000


def test_percent_rank_of_parts_is_that_of_the_group(spark):
    import random

    from pyspark.sql import Window

    rng = random.Random(5)
    d = spark.createDataFrame([(rng.choice(["a", "b", None]), rng.randrange(60)) for _ in range(200)] + [("one", 3)], "g string, k long")
    want = d.withColumn("percent_rank", F.percent_rank().over(Window.partitionBy("g").orderBy("k")))
    key = lambda r: (str(r.g), r.k, round(r.percent_rank, 12))
    assert sorted(map(key, S.percent_rank(d, "g", "k", 8).collect())) == sorted(map(key, want.collect()))


def test_curves_over_parts_equal_one_window(spark):
    """Scores at and around the borders of parts, and outside the unit."""
    import random

    rng = random.Random(6)
    rows = [(rng.randrange(2), rng.choice([rng.random(), rng.randrange(1025) / 1024, -0.5, 1.5])) for _ in range(400)]
    got = {r.score: (r.tp, r.fp, r.pos, r.neg) for r in M.roc(spark.createDataFrame(rows, "label int, score double")).collect()}
    pos = sum(y for y, _ in rows)
    assert got == {s: (sum(y for y, x in rows if x >= s), sum(1 - y for y, x in rows if x >= s), pos, 400 - pos) for _, s in rows}


def test_tex_locks_by_priority():
    text = "\\documentclass{x}\n\\begin{document}\nA \\cite{a, b} and $x + y$ \\textbf{bold}.\n\\begin{table}\n\\begin{tabular}{l} $z$ \\end{tabular}\n\\end{table}\n\\section{S} \\item[1] \\maketitle 100%"
    out, held = T.lock_text(text, T.TEX_LOCKS, nested=True)
    assert "tabular" not in out and "maketitle" not in out and "bold" not in out and out.startswith("__LOCK_0__\nA __LOCK_") and out.endswith(" 100%")
    table = next(v for v in held.values() if v.startswith("\\begin{table}"))
    assert "$z$" not in table and held[re.search("__LOCK_[0-9]+__", table)[0]] == "$z$"  # taken before the block it stands in
    assert len(T.TEX_LOCKS) == 19 and T.restore_text(out, held) == text
    assert T.lock_text(None, T.TEX_LOCKS, nested=True) == ("", {})
    many = " ".join(f"$a_{k}$" for k in range(30))
    assert T.restore_text(*T.lock_text(many, T.TEX_LOCKS, nested=True)) == many


def test_locks_are_put_back_by_expressions(spark):
    text = "\\begin{table} $x$ \\end{table} \\cite{a} " + " ".join(f"$a_{k}$" for k in range(15))
    d = spark.createDataFrame([(text,), ("plain",), (None,)], "t string").select("t", T.locked("t", T.TEX_LOCKS, nested=True).alias("l"))
    r = d.select("t", T.restored(F.col("l.text"), F.col("l.held")).alias("back"), F.col("l.text").alias("out")).collect()
    assert [x.back for x in r] == [text, "plain", ""] and "cite" not in r[0].out


def test_masked_math_and_locked_tokens():
    out, held = T.mask_math("a $x. y$ b. \\[ z\nw \\] and \\(q\\) $$m$$ end.")
    assert out == "a __LOCK_0__ b. __LOCK_1__ and __LOCK_2__ __LOCK_3__ end." and held["__LOCK_1__"] == "\\[ z\nw \\]"
    out, held = T.lock_text("NASA said 12.5% (Smith, 2020) [1, 2] in \\cite{x}.")
    assert set(held.values()) == {"NASA", "12.5%", "(Smith, 2020)", "[1, 2]", "\\cite{x}"} and T.restore_text(out, held).startswith("NASA said")


def test_calibration_golden(spark):
    from textloom.operators.training import isotonic, platt

    d = spark.createDataFrame([(0, .1), (1, .2), (0, .3), (1, .4)], "label int, score double")
    assert [r.calibrated for r in isotonic(d).orderBy("score").collect()] == [0.0, 0.5, 0.5, 1.0]
    p = [r.calibrated for r in platt(d).orderBy("score").collect()]
    assert p == sorted(p) and 0 < p[0] < 0.5 < p[-1] < 1


def test_tfidf_is_sublinear_and_normed(spark):
    import math

    from textloom.operators.training import tfidf

    d = spark.createDataFrame([(1, "cat cat cat dog"), (2, "cat bird"), (3, "dog bird")], "doc_id int, text string")
    v, terms = tfidf(d)
    r = next(x for x in v.collect() if x.doc_id == 1)
    w = dict(zip(r.indices, r.weights, strict=True))
    at = {x.term: x["index"] for x in terms.collect()}
    # both words stand in two of three documents, so only the damped counts differ
    assert abs(w[at["cat"]] / w[at["dog"]] - (1 + math.log(3))) < 1e-9 and abs(sum(x * x for x in w.values()) - 1) < 1e-9


def test_calibration_comparison_and_text_forms(spark):
    from conftest import DATA
    from textloom import catalog

    r = catalog.queries()["E19_calibration_comparison"](spark, DATA).first()
    assert 0 <= r.isotonic <= r.uncalibrated and abs(r.reduction_percent - 100 * (r.uncalibrated - r.isotonic) / r.uncalibrated) < 1e-5
    assert one(spark, "ﬁ ① ｘ", T.nfkc("x")) == "fi 1 x"
