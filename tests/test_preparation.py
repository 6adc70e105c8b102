"""Similar pairs, greedy keep, alignment, citations and streams against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from textloom import tables
from textloom.operators import citations as C
from textloom.operators import dedupe as U
from textloom.operators.alignment import aligned


def test_components_of_long_chains(spark):
    """Rounds grow with the logarithm, for ascending chains too."""
    rounds = []
    edges = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(9000, 9001), (9001, 8999)], "a long, b long"))
    got = {r.node: r.component for r in tables.components(edges, "chain", rounds).collect()}
    assert all(got[k] == 0 for k in range(3001)) and got[9000] == got[9001] == got[8999] == 8999 and len(rounds) < 20
    assert tables.components(edges.limit(0)).count() == 0


def test_greedy_keep_of_components(spark, monkeypatch):
    """A chain keeps every other id, in one pass or by rounds."""
    docs = spark.range(60).select(F.col("id").alias("doc_id"))
    classes = docs.select("doc_id", F.col("doc_id").alias("rep"))
    pairs = docs.where("doc_id < 40").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"))
    pairs = pairs.union(spark.createDataFrame([(50, 52), (50, 53), (52, 53), (53, 54)], "a long, b long"))
    want = {*range(0, 41, 2), *range(41, 60)} - {52, 53}
    for edges in (1_000_000, 10):
        monkeypatch.setattr(U, "EDGES", edges)
        assert {r.doc_id for r in U.greedy_keep(docs, pairs, classes).collect()} == want


@pytest.mark.parametrize("most", [2048, 3])
def test_similar_pairs_equal_brute_force(spark, monkeypatch, most):
    """Also where lists are dealt over several keys and frequent shingles come last."""
    monkeypatch.setattr(U, "LIST", most)
    rng = random.Random(11)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(5, 60))] for _ in range(12)]
    rows = []
    for k in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(5)}"
        rows.append((k, " ".join(w)))
    sets = {k: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for k, t in rows for w in [t.split()]}
    first = {}
    for k, s in sets.items():
        first.setdefault(frozenset(s), k)
    want = {(a, b) for (s, a), (t, b) in itertools.combinations(sorted(first.items(), key=lambda x: x[1]), 2) if len(s & t) >= 0.8 * len(s | t) - 1e-9}
    got = {(r.a, r.b) for r in U.similar_pairs(spark.createDataFrame(rows, "doc_id long, text string"), 0.8).collect()}
    assert got == want and len(want) > 20


def test_alignment_with_boxes(spark, monkeypatch):
    """Sentences that layout cuts elsewhere, boxes without letters, a sentence that comes once more and is found from the start, one that is not there."""
    boxes = ["The first sen-", "tence is here. It", "--", "is here. Again", "it is here.", "Tail"]
    sentences = ["The first sentence is here.", "It is here.", "Again it is here.", "It is here.", "No such words", "a", "Tail\nThe first"]
    s = spark.createDataFrame([(1, i, x) for i, x in enumerate(sentences)] + [(2, 0, "Tail"), (None, 0, "x")], "doc_id long, sent_idx int, sentence string")
    b = spark.createDataFrame([(1, i, x) for i, x in enumerate(boxes)] + [(2, 0, None), (3, 0, "Tail")], "doc_id long, box_idx int, text string")
    want = {0: {0, 1}, 1: {1, 2, 3}, 2: {3, 4}, 3: {1, 2, 3}, 6: {5, 0}}
    got = {}
    for bucket in (256, 3):
        monkeypatch.setattr("textloom.operators.alignment.BUCKET", bucket)
        rows = [tuple(r) for r in aligned(s, b).collect()]
        assert len(rows) == len(set(rows)) and {r[0] for r in rows} == {1}
        got = {k: {r[3] for r in rows if r[1] == k} for k in {r[1] for r in rows}}
        assert got == want


def test_surnames_in_any_case(spark):
    """The last entry of a surname is cited; the one before it and those without a citation are left."""
    refs = spark.createDataFrame([(1, 0, None, "Smith", "2001", "Smith A"), (1, 1, None, "SMITH", "2002", "Smith B"), (1, 2, None, "Lee", "2003", "Lee"), (1, 3, None, None, "2004", "anon")], "doc_id int, idx int, number int, author string, year string, raw string")
    markers = spark.createDataFrame([(1, "smith", "2002"), (1, "Brown", "1999")], "doc_id int, author string, cited string")
    m, un, left = C.matched(markers, refs, "author")
    assert [(r.idx, r.author) for r in m.collect()] == [(1, "SMITH")] and [r.author for r in un.collect()] == ["Brown"]
    assert sorted(r.idx for r in left.collect()) == [0, 2, 3]


def test_statuses_of_lookups(spark):
    rows = [("A, Deep, models of text, 2019", "Deep models: of text!", "2019", "found"), ("A, 2019", "", "2019", "found"), ("A, 2019", "!?", None, "found"), ("A", None, None, "not_found"), ("A", None, None, "lookup_failed")]
    d = spark.createDataFrame(rows, "r string, t string, y string, l string")
    assert [x.s for x in d.select(C.metadata_status("r", "t", "y", "l").alias("s")).collect()] == ["verified", "mismatch", "mismatch", "doi_not_found", "lookup_failed"]


def test_cache_of_a_stream(spark, tmp_path):
    """Files one by one, a text in two of them, a replay of all: each text is analysed once."""
    from textloom.streaming.documents import cache_stream

    src, cache = f"file://{tmp_path}/src", f"file://{tmp_path}/cache"
    for k, texts in enumerate((["One. Two.", "a b c"], ["a b c", "new text here"], [None, "One. Two."])):
        spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(src)
    once = sorted((r.n_sentences, r.n_words) for r in cache_stream(spark, src, cache, files=1).collect())
    assert once == [(1, 3), (1, 3), (2, 2)]
    assert sorted((r.n_sentences, r.n_words) for r in cache_stream(spark, src, cache).collect()) == once


def test_late_events_on_a_stream(spark, tmp_path):
    """The watermark has passed when the last file comes: its late row is dropped, closed windows are there, open ones are not."""
    from textloom.streaming.documents import counted_events

    src = f"file://{tmp_path}/events"
    files = [[("2024-01-01 12:01:00", "a", 1.0), ("2024-01-01 12:02:00", "a", 2.0)], [("2024-01-01 12:40:00", "a", 4.0)], [("2024-01-01 12:41:00", "b", 8.0)], [("2024-01-01 12:03:00", "a", 100.0)], [("2024-01-01 13:30:00", "a", 16.0)]]
    for rows in files:
        d = spark.createDataFrame(rows, "t string, event_type string, value double")
        d.select(F.to_timestamp("t").alias("ts"), "event_type", "value").coalesce(1).write.mode("append").parquet(src)
        __import__("time").sleep(1.1)  # files come in the order of their times
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(src)
    q = counted_events(stream).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((str(r.start)[11:16], r.event_type, r.n, r.total) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    assert got == [("12:00", "a", 2, 3.0), ("12:40", "a", 1, 4.0), ("12:40", "b", 1, 8.0)]
