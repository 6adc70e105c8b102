"""Cases of a review that gave other rows than SQL, or more work than needed."""

from pyspark.sql import functions as F

from textloom import catalog
from textloom.operators import document as D


def _documents(spark, path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")}).coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


def _duck(path):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
    return c


def test_a_deviation_at_the_limit_is_that_of_sql(spark, tmp_path):
    from parity import same

    lengths = [[8, 6, 3, 7, 1, 3, 14], [3, 1, 14, 7, 3, 8, 6], [14, 8, 7, 6, 3, 3, 1]]
    d = _documents(spark, tmp_path, [" ".join("w" + " w" * (k - 1) + "." for k in x) for x in lengths])
    same(catalog.queries()["B02_burstiness"](spark, d), _duck(d), catalog.oracle_sql()["B02_burstiness"])
    one = spark.createDataFrame([(1, 0, None), (1, 1, 3), (1, 2, 5)], "doc_id int, sent_idx int, n_words long")
    assert D.burstiness(one).first().std == 1.0


def test_a_short_sentence_is_no_part_of_the_next(spark, tmp_path):
    """Ab. is too short to be looked for; Abab. after it starts where it ends, not inside it."""
    from parity import same

    d = _documents(spark, tmp_path, ["Ab.\nAbab. One more.", "Re re.\nOn.\nOnon on. End here.", "E. E. E.\nEeee. E.\nEeeee."])
    same(catalog.queries()["J11_sentence_boxes"](spark, d), _duck(d), catalog.oracle_sql()["J11_sentence_boxes"])


def test_only_blanks_are_trimmed_where_sql_trims_blanks(spark, tmp_path):
    from parity import same

    run = ",\nThis part has over twenty letters"
    texts = [f"One{run}, and that\none goes on too.", f"One{run}\n , but that one goes on too\n.", f"One{run}, and that one goes on too.\n\n", f"One{run}, and that one goes on too.\r\n", f"One{run}, so that\x0bone goes on too."]
    texts += ["Although it rains\n, we go out \n.", "Although it\x0brains , we go out.\n\n", "while\t it rains\t, we go out \t", "Since we are, we go\r"]
    d = _documents(spark, tmp_path, [t for t in texts for _ in range(40)])
    for name in ("R03_clauses", "R04_splits"):
        same(catalog.queries()[name](spark, d), _duck(d), catalog.oracle_sql()[name])


def test_candidates_meet_in_blocks(spark, monkeypatch):
    """Pairs of one group are the same however its sets are dealt over blocks, and whether copies are broadcast or not."""
    from textloom.operators import dedupe as U

    words = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(words[:k] + [f"x{i}"] + words[k + 1 :])) for i, k in enumerate([0, 1, 2, 57, 58, 59, 0, 59])] + [(20, " ".join(words)), (21, " ".join(words)), (22, None), (23, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(58)} for i, t in rows if t and i != 21}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    for block, broadcast in ((128, 1_000_000), (2, 0)):
        monkeypatch.setattr(U, "BLOCK", block)
        monkeypatch.setattr(U, "BROADCAST_ROWS", broadcast)
        got = [(r.a, r.b) for r in U.similar_pairs(d, 0.8).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_python_takes_few_texts_at_a_time(spark):
    """A task's texts come a hundred at a time, not in batches of Arrow that hold ten thousand of them."""
    from textloom.functions import text as T
    from textloom.operators import robustness as B

    d = spark.createDataFrame([(1, "a $x$ b")], "doc_id long, x string")
    for c in (B.plain_words("x", "doc_id"), T.locked("x")["text"], T.nfkc("x")):
        plan = d.select(c.alias("y"))._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_a_held_out_family_leaves_the_others_alone(spark, tmp_path):
    plan = catalog.queries()["F05_held_out_family"](spark, _documents(spark, tmp_path, ["a b; c"]))._jdf.queryExecution().optimizedPlan().toString()
    assert "semicolon" not in plan and "contract:" not in plan


def test_terms_are_counted_in_rows(spark):
    """Terms of a text, and of two texts with one key, whose counts are summed."""
    from textloom.operators.training import tfidf

    d = spark.createDataFrame([(1, "red blue red red"), (2, ""), (3, None), (4, "blue"), (4, "blue green")], "doc_id int, text string")
    v, terms = tfidf(d)
    assert {(r.term, r.df) for r in terms.collect()} == {("red", 1), ("blue", 2), ("green", 1), ("red blue", 1), ("blue red", 1), ("red red", 1), ("blue green", 1)}
    got = {r.doc_id: r for r in v.collect()}
    assert len(got[1].indices) == 5 and got[2].indices == got[3].indices == [] and len(got[4].indices) == 3
    from textloom.operators.training import _counted

    one = spark.createDataFrame([(["b", "a", "b"],), ([],), (None,)], "g array<string>").select(_counted(F.col("g")).alias("c"))
    assert [r.c and [tuple(x) for x in r.c] for r in one.collect()] == [[("a", 1), ("b", 2)], None, None]


def test_rules_run_only_where_one_may_match(spark, monkeypatch):
    """A text without any part of a rule is not told apart into sentences and no phrase is searched in it; its result is that of all rules."""
    from textloom.operators import robustness as B

    texts = ["", " \n", "In it, across. It  plays.\nSo\tit is ", "a.  b!\n\nc? ", "no end  ", "end.\u0085", "Built it. In it.", "We saw. Leveraging it,\nachieving a 40% reduction in x.", "So. However, no.", "a \x0b. b", None]
    texts += ["The X method, introduced by the Y of the United States in 1954.", "Cut.  built b.\nTeamed up on c.", "in conclusion  that is\nall.", "Soil Conservation Service of the United States"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, x string")
    made = lambda: d.select("doc_id", B.active_voice("x", "resume").alias("a"), B.active_voice("x").alias("b"), B.openings("x", "doc_id").alias("c")).orderBy("doc_id").collect()
    fast = made()
    few = d.select("doc_id", B._may_be_active("x").alias("a"), B._may_open("x").alias("o")).where("a or o").orderBy("doc_id").collect()
    assert [r.doc_id for r in few] == [6, 7, 8, 11, 12, 13, 14]
    monkeypatch.setattr(B, "_may_be_active", lambda c: F.lit(True))
    monkeypatch.setattr(B, "_may_open", lambda c: F.lit(True))
    assert made() == fast

    class Never:
        def sub(self, *_):
            raise AssertionError("searched")

    monkeypatch.setattr(B, "_PHRASES", [(first, parts, Never(), b) for first, parts, _, b in B._PHRASES])
    assert B.plainer("it is in play, across all: as to  that role of of it. so", "k") == "It is in play, across all: as to that role of it. So"


def test_terms_of_a_text_are_not_shuffled(spark, monkeypatch):
    """Only sums of terms move: vectors are made inside rows, with other columns beside them, and rows of one key share a vector."""
    from textloom.operators import training as L

    d = spark.createDataFrame([(1, "red blue red red", 1.0), (2, "", 0.0), (3, None, 0.0), (4, "blue", 1.0), (5, "blue green", 0.0)], "doc_id int, text string, label double")
    v, terms, many = L._weighted(d, 100, "doc_id")
    plan = v._jdf.queryExecution().executedPlan().toString()
    assert not many and "Exchange" not in plan and "Aggregate" not in plan and v.columns == ["doc_id", "label", "features"]
    got = {r.doc_id: (r.label, r.features) for r in v.collect()}
    assert got[1][0] == 1.0 and got[1][1].numNonzeros() == 5 and abs(got[1][1].norm(2) - 1) < 1e-12 and got[2][1].numNonzeros() == got[3][1].numNonzeros() == 0
    v, terms, many = L._weighted(d.union(spark.createDataFrame([(4, "blue green", 1.0)], d.schema)), 100, "doc_id")
    rows = [r for r in v.collect() if r.doc_id == 4]
    assert many and len(rows) == 2 and rows[0].features == rows[1].features and rows[0].features.numNonzeros() == 3 and {r.term: r.df for r in terms.collect()}["blue"] == 3
    none, terms = L.tfidf(spark.createDataFrame([(1, ""), (2, None)], "doc_id int, text string"))
    assert [r.indices for r in none.collect()] == [[], []] and terms.count() == 0


def test_fits_read_vectors_that_are_written_once(spark, monkeypatch):
    """The penalty of standardised inputs without scaled copies of the rows; out-of-fold scores are one pass, whether folds are broadcast or not."""
    import random

    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from textloom.operators import training as L

    rng = random.Random(5)
    rows = [(k, f"t{k % 11}", k % 2, rng.gauss(5 + k % 2, 2), rng.random() * 100, 3.0) for k in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, topic string, label int, a double, b double, c double")
    names = ["a", "b", "c"]
    m = L.train_fusion(d, names, "topic")
    z = d.select(F.col("label").cast("double").alias("label"), *[((F.col(n) - mean) / s).alias(n) for n, mean, s in zip(names, m["scaler_mean"], m["scaler_scale"], strict=True)])
    want = LogisticRegression(regParam=1 / 300, standardization=False, maxIter=L.ITERATIONS).fit(VectorAssembler(inputCols=names, outputCol="features").transform(z))
    assert all(abs(x - y) < 1e-6 for x, y in zip([*m["coefficients"], m["intercept"]], [*want.coefficients, want.intercept], strict=True)) and m["coefficients"][2] == 0
    one = L.out_of_fold(d, names, "topic")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and one.columns == [*d.columns, "p"]
    got = {r.doc_id: r.p for r in one.collect()}
    monkeypatch.setattr(L, "FEW_TOPICS", 0)
    again = {r.doc_id: r.p for r in L.out_of_fold(d, names, "topic").collect()}
    assert len(got) == 300 and all(abs(again[k] - p) < 1e-9 and 0 < p < 1 for k, p in got.items())


def test_a_csv_keeps_blanks_empty_texts_and_nulls(spark, tmp_path):
    """Blanks at the ends, line ends, empty texts, nulls and quotes after a zero character come back as they were."""
    from textloom.sources import files

    texts = [None, "", " ", " a ", "\n", "a\n", "\r", "a\r\n", 'x"\r\n', "\ta\t", '"', '""', 'a\0"b', "\0", "\\", 'a\\"', "a,b", "null", "\x1f", '"\n"']
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(100 + k, "t") for k in range(len(texts))] + [(None, "t")], "doc_id long, text string")
    docs = docs.withColumn("source", F.element_at(F.array(*map(F.lit, texts)), (F.coalesce("doc_id", F.lit(0)) % 100 + 1).cast("int")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = [tuple(r) for r in docs.select("text", (F.col("doc_id") % 2).cast("int"), "source", "source").collect()]
    got = [tuple(r) for r in catalog.queries()["A01_csv_scan"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    (tmp_path / "x.csv").write_text('essay,generated\r\n"",""\r\n,1\r\n')
    assert {tuple(r) for r in files.read_corpus(spark, f"file://{tmp_path}/x.csv").collect()} == {("", None, None, None), (None, 1, None, None)}


def test_similar_sets_move_about_once(spark, monkeypatch):
    """Parities are kept once for a set, long sets have more of them, so that long texts that are not alike are no candidates, and a set is
    moved once to its neighbours; the pairs are those of all sets against all."""
    from textloom.operators import dedupe as U

    made = {}
    monkeypatch.setattr(U, "table", lambda df, label, f=U.table: made.setdefault(label, [f(df, label)])[0])
    monkeypatch.setattr(U, "drop", lambda *_: None)
    long = lambda i: " ".join(f"v{i}x{k}" for k in range(4000))
    words = [f"w{k}" for k in range(120)]
    rows = [(i, " ".join(words[:k] + [f"x{i}"] + words[k + 1 :])) for i, k in enumerate(range(0, 120, 4))]
    rows += [(100 + i, f"one two three {long(i)}") for i in range(4)] + [(200, long(0)), (201, long(0) + " end")] + [(300 + i, " ".join(f"u{k}" for k in range(1030 - i))) for i in range(12)]
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, t in rows for w in (t.split(),)}
    every = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    want = {p: j for p, j in every.items() if j >= 0.8}
    got = U.similar_pairs(spark.createDataFrame(rows, "doc_id long, text string"), 0.8).collect()
    assert {(r.a, r.b) for r in got} == set(want) and len(got) == len(want) > 300 and all(abs(r.jaccard - want[r.a, r.b]) < 1e-9 for r in got)
    assert made["prefixes"][0].count() == len(rows)
    assert not made["candidates"][0].where("a between 101 and 103 or b between 101 and 103").count()
    assert made["ends"][0].count() == len({i for p in want for i in p})
    assert {len(r.parities) for r in made["prefixes"][0].collect()} == {16, 32, 64}


def test_many_candidates_of_one_neighbourhood_are_dealt_out(spark, monkeypatch):
    """A neighbourhood of few shingles and many candidates is several tasks' work, and its pairs are all there."""
    from textloom.operators import dedupe as U

    made = {}
    monkeypatch.setattr(U, "table", lambda df, label, f=U.table: made.setdefault(label, f(df, label)))
    monkeypatch.setattr(U, "drop", lambda *_: None)
    monkeypatch.setattr(U, "PAIRS", 100)
    words = [f"w{k}" for k in range(60)]
    d = spark.createDataFrame([(i, " ".join([*words, f"x{i}"])) for i in range(50)], "doc_id long, text string")
    got = [(r.a, r.b) for r in U.similar_pairs(d, 0.8).collect()]
    assert sorted(got) == [(a, b) for a in range(50) for b in range(a + 1, 50)]
    assert max(r["count"] for r in made["blocks"].groupBy("k").count().collect()) < 700


def test_classes_read_texts_once(spark):
    """Classes of equal sets are told from a written table of hashes and sizes, not from texts on both sides of a join."""
    from textloom.operators import dedupe as U

    c = U.shingle_classes(spark.createDataFrame([(3, "a b c d"), (1, "A b, c d"), (2, "a b c"), (4, ""), (5, None), (6, "a b c")], "doc_id long, text string"))
    assert {tuple(r) for r in c.collect()} == {(1, 1), (3, 1), (2, 2), (6, 2)}
    assert "regexp_extract_all" not in c._jdf.queryExecution().optimizedPlan().toString()
