"""MinHash near-duplicates by a signature-coordinate inverted join.

Every document gets a signature of COORDS coordinates. A coordinate's value is the joint hash of the minima
of JOINED independent orders of the document's shingles, so two documents of similarity j agree in it with
probability j**JOINED: common shingles alone seldom make a value, and lists stay short as the corpus grows.
A document is posted under its coordinate-value pairs. A pair of documents of similarity 0.8 agrees in at
least MATCHES coordinates (it misses that with a chance of about 1e-5; one of 0.5 does so with 7 in 100), so

* a document that shares fewer than MATCHES of its postings with anyone is skipped;
* of a document's postings, ordered by how many documents share them, only the rarest
  COORDS - MATCHES + 1 (the prefix) can be the first that two such documents meet in, so the long lists of
  common shingles are skipped and never merged;
* documents that meet are retained when they collide in MATCHES coordinates or more, and linked when their
  full shingle sets confirm the threshold.

Documents with one and the same shingle set are one class from the start, named by a hash of the set; all that
follows is about classes. No list of postings is expanded
into all its pairs. First every document is compared with that of its lists' centres (a list's centre is the
first of its members in a random order) that it collides with most often; then the lists' documents are dealt
into blocks, where collisions are counted for all of them and only links that join are let out. What is found is
contracted into components after each step. What then remains are lists whose members are in different components:
documents that hang together by lists of more than LONG members count collisions block by block with every block,
the others pair by pair inside the join. The match threshold decides in all steps which full sets are compared, and
nothing is capped: every pair that could join two components has its collisions counted.

Nulls and blank texts have an empty set: they are linked with nothing and kept. Rows with a null id are one
document each in no component's way: they come out with a null component and are kept. Rows of one id are one
document: what any of its texts is near to is linked through it. Columns besides id and text are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._tables import components, drop, join_small, table

COORDS, JOINED, MATCHES, STARS, DEALS, BLOCK, LONG = 48, 5, 4, 1, 2, 384, 64
_A = W.mix(np.arange(1, COORDS * JOINED + 1, dtype=np.uint64)) | np.uint64(1)


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for i, j, raw, at in W.slices(column):
        h, row, _, _ = W.words(raw, at, lower=True)
        h, row, _ = W.shingles(h, row, k)
        yield j - i, *W.distinct(h, row, j - i)


def signatures(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, d1, d2, sig): d1 and d2 are sums over the set, equal for equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for rows, h, at in _sets(b.column(1), k):
                out[0].append(np.diff(at))
                out[1].append(W.reduce_rows(np.add, h, at, np.uint64(0)))
                out[2].append(W.reduce_rows(np.add, W.mix(h ^ W._M), at, np.uint64(0)))
                sig = np.empty((rows, COORDS), np.uint64)
                for c in range(COORDS):
                    v = np.full(rows, c, np.uint64)
                    for o in range(c * JOINED, (c + 1) * JOINED):
                        v = W.mix(v * W._M + W.reduce_rows(np.minimum, h * _A[o], at, np.uint64(0)))
                    sig[:, c] = v
                out[3].append(sig)
            if out[0]:
                n, d1, d2, sig = (np.concatenate(x) for x in out)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, COORDS, dtype=np.int32)), pa.array(sig.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), lists], names=["doc_id", "n_shingles", "d1", "d2", "sig"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, sig array<long>")


def _class() -> Column:
    """The name of a shingle set."""
    return F.xxhash64("n_shingles", "d1", "d2")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(node, shingles): the sorted distinct shingle hashes of documents (text), and the name of that set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, h, at in _sets(b.column(0), k):
                sums = [W.reduce_rows(np.add, x, at, np.uint64(0)).view(np.int64) for x in (h, W.mix(h ^ W._M))]
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(at)), *map(pa.array, sums), lists], names=["n_shingles", "d1", "d2", "shingles"])

    found = docs.select("text").mapInArrow(run, "n_shingles long, d1 long, d2 long, shingles array<long>")
    return found.select(_class().alias("node"), "shingles")


def _collisions(a: str, b: str) -> Column:
    """In how many coordinates two signatures agree; a value names its coordinate, so that is a set's size."""
    return F.size(F.array_intersect(a, b))


def _confirmed(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that collide in MATCHES coordinates and whose full sets reach the threshold."""
    one = lambda s: held.select(F.col("node").alias(s), F.col("sig").alias(f"sig_{s}"), F.col("shingles").alias(f"set_{s}"))
    met = pairs.join(one("a"), "a").join(one("b"), "b").where(_collisions("sig_a", "sig_b") >= MATCHES)
    both = F.size(F.array_intersect("set_a", "set_b"))
    return met.where(100 * both >= percent * (F.size("set_a") + F.size("set_b") - both)).select("a", "b")


def _linked_in_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components among the rows (node, v, part, component, sig, shingles) of one v and part.

    Collisions are counted for all pairs there that are in different components, and the full sets of those with
    MATCHES are compared. A group is as large as two blocks, whose documents were dealt by a hash; a link is let out
    only if it joins two components.
    """

    def joined(ids: list[int], names: list[int], sigs: list[np.ndarray], sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        root = {n: n for n in names}

        def find(n: int) -> int:
            while root[n] != n:
                root[n] = root[root[n]]
                n = root[n]
            return n

        most = Counter(names).most_common(1)[0][0]
        sig = np.stack(sigs)
        for i in range(len(ids)):
            if names[i] == most:
                continue  # those outside the largest component are compared with all
            for j in np.flatnonzero((sig == sig[i]).sum(axis=1) >= MATCHES):
                x, y = find(names[i]), find(names[int(j)])
                if x != y:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                        root[x] = y
                        yield ids[i], ids[int(j)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, names, sigs, sets = None, [], [], [], []

        def out() -> pa.RecordBatch:
            links = list(joined(ids, names, sigs, sets)) if len(set(names)) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

        for b in batches:
            doc, v, part, name = (b.column(k).to_pylist() for k in range(4))
            for i in range(b.num_rows):
                if (v[i], part[i]) != key:
                    if len(ids) > 1:
                        yield out()
                    key, ids, names, sigs, sets = (v[i], part[i]), [], [], [], []
                ids.append(doc[i])
                names.append(name[i])
                sigs.append(b.column(4)[i].values.to_numpy().copy())
                sets.append(b.column(5)[i].values.to_numpy().copy())
        yield out()

    return rows.select("node", "v", "part", "component", "sig", "shingles").repartition(F.col("v"), F.col("part")).sortWithinPartitions("v", "part").mapInArrow(run, "a long, b long")


def _merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` (node, component) after ``links`` (a, b), whose ends may be new nodes."""
    named = lambda s: label.select(F.col("node").alias(s), F.col("component").alias(f"c{s}"))
    ends = links.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = components(ends)
    to = joined.select(F.col("node").alias("component"), F.col("component").alias("to"))
    known = label.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    new = table(known.unionByName(joined.join(label.select("node"), "node", "left_anti")), "label")
    drop(label, joined)
    return new


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: ``k`` words to a shingle, linked from ``percent``."""
    feats = table(signatures(docs, k, id_col, text_col).withColumn("node", F.when(F.col("n_shingles") > 0, _class())), "sig")
    full = feats.where("node is not null and doc_id is not null")
    copies = full.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    classed = join_small(full, copies, ["node"]).select("doc_id", "node", "rep", "sig")
    # one row for each class: its only one, or one of those with its first id
    reps = classed.where("rep is null").union(classed.where("rep = doc_id").dropDuplicates(["node"])).select("node", F.coalesce("rep", "doc_id").alias("rep"), "sig")
    reps = table(reps, "reps")

    posts = table(reps.select("node", F.explode("sig").alias("v")), "posts")
    shared = posts.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    ranked = (posts.join(shared, "v").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("p"))
              .where(F.size("p") >= MATCHES))
    prefix = table(ranked.select("node", F.explode(F.slice("p", 1, F.size("p") - MATCHES + 1)).alias("p")).select("node", "p.v"), "prefix")
    drop(posts)

    met = reps.join(prefix.select("node").distinct(), "node", "left_semi")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = shingle_sets(texts.join(met.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), k)
    held = table(sets.join(met.select("node", "sig"), "node").dropDuplicates(["node"]), "sets")

    label = table(met.select("node", F.col("node").alias("component")), "label")
    for turn in range(STARS + DEALS + 2):
        # a list whose members are in one component has nothing more to find
        at = prefix.join(label, "node")
        lists = at.groupBy("v").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"), F.min_by(F.struct("node", "component"), F.xxhash64("node", F.lit(turn))).alias("x")).where("lo < hi")
        if turn < STARS:
            met = at.join(lists.select("v", "x"), "v").where("component <> x.component").groupBy("node", "x.node").agg(F.count("*").alias("n")).toDF("node", "x", "n")
            one = met.groupBy("node").agg(F.max_by("x", F.struct("n", "x")).alias("x"))
            links = _confirmed(one.select(F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b")).distinct(), held, percent)
        elif turn < STARS + DEALS:
            by = F.struct("size", "v") if turn == STARS else F.struct(F.xxhash64("v", F.lit(turn)), "v")
            open_lists = table(at.join(lists.select("v", "size"), "v").groupBy("node").agg(F.max_by("v", by).alias("v")), "open")
            groups = open_lists.groupBy("v").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
            dealt = open_lists.join(groups, "v").select("node", "v", F.pmod(F.xxhash64("node", F.lit(turn)), "parts").cast("string").alias("part"))
            links = _linked_in_blocks(dealt.join(label, "node").join(held, "node"), percent)
        elif turn == STARS + DEALS:
            # long lists: what hangs together by them is compared block by block with all of its blocks
            long = at.join(lists.where(F.col("size") > LONG).select("v", F.col("x.node").alias("x")), "v")
            hangs = components(long.select(F.col("node").alias("a"), F.col("x").alias("b")))
            parts = hangs.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
            own = hangs.join(parts, "component").select("node", F.col("component").alias("v"), "parts", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("p"))
            own = own.select("node", "v", "p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q"))
            dealt = own.select("node", "v", F.concat_ws("-", F.least("p", "q"), F.greatest("p", "q")).alias("part"))
            links = _linked_in_blocks(dealt.join(label, "node").join(held, "node"), percent)
        else:
            # a pair is let out of the one list that is the first it shares, and only if it collides often enough
            mine = prefix.groupBy("node").agg(F.sort_array(F.collect_list("v")).alias("lists"))
            left = table(at.join(lists.where(F.col("size") <= LONG).select("v"), "v", "left_semi").join(mine, "node").join(held.select("node", "sig"), "node"), "left")
            one = lambda s: left.select("v", F.col("node").alias(s), F.col("component").alias(f"c{s}"), F.col("lists").alias(f"l{s}"), F.col("sig").alias(f"s{s}"))  # noqa: B023, E731
            met_first = (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (F.get(F.array_intersect("la", "lb"), F.lit(0)) == F.col("v"))
            pairs = one("a").join(one("b").withColumnRenamed("v", "w"), (F.col("v") == F.col("w")) & met_first & (_collisions("sa", "sb") >= MATCHES)).select("a", "b")
            links = _confirmed(pairs, held, percent)
        links = table(links, "links")
        if not links.isEmpty():
            label = _merged(label, links)
        drop(links)
    drop(prefix, held)

    # the texts of one id hang together
    several = full.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("doc_id", "a")
    same = table(full.select("doc_id", F.col("node").alias("b")).join(several, "doc_id").where("a <> b").select("a", "b").distinct(), "same")
    if not same.isEmpty():
        label = _merged(label, same)
    firsts = label.join(reps.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    final = table(label.join(firsts, "component").select("node", "component_id"), "final")
    named = join_small(feats.select("doc_id", "n_shingles", "node"), copies, ["node"]).join(final, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "rep", "doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op9(spark, sf_dir: str) -> DataFrame:
    """Two-word shingles of lower-cased whole texts, linked at 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


QUERIES = {"op9_minhash_near_dup": op9}
