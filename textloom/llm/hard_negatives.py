"""Hard negatives by ball trees: for each anchor its best rows of the same label, and for each of those the best rows of
other labels whose score lies in a window under it.

Rows are dealt by a hash of their id over parts of at most MOST rows, and each part has a ball tree over integer
vectors. Anchors go to every part in blocks, and all queries of a block walk through the tree together: a node bounds
their inner products above and below (centre's product, plus and minus the query's length times the radius), and a query
leaves a node whose upper bound is strictly beneath its current k-th score or its window, whose lower bound is above the
window, or whose labels do not concern it. Nodes split by label first, so that one label's rows stand together. The parts' best
rows meet in one small sort for each anchor. Nothing is approximate: a bound has a margin for rounding, a tie with the
k-th score is followed, and scores are integers (float products where these are exact, 64-bit integers beyond).

Rows with a null id, label or vector take no part. Rows equal in id, label and vector count once; rows that share an id
but differ are rows of their own, ties in any order among them. A shorter vector counts as filled up with zeros. Products must
fit 64 bits. An anchor without another row of its label gives nothing. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import table

#: Rows of a leaf; rows of a part at least, if there are tasks enough, and at most; queries that walk together.
LEAF, LEAST, MOST, BLOCK = 128, 4096, 1 << 18, 1024
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95


class BallTree:
    """Nodes over rows (id, mark, label, vector), children after their parent; leaves are runs of rows."""

    def __init__(self, ids: np.ndarray, marks: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        n = len(ids)
        order, exact = np.arange(n), x.astype(np.float64)
        self.start, self.stop, self.left, self.right, centres, radii, low, high = [], [], [], [], [], [], [], []
        todo = [(0, n, -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            rows, node = order[a:b], len(self.start)
            if parent >= 0:
                (self.left, self.right)[side][parent] = node
            own = labels[rows]
            centre = exact[rows].mean(axis=0)
            away = np.sqrt(((exact[rows] - centre) ** 2).sum(axis=1))
            self.start.append(a), self.stop.append(b), self.left.append(-1), self.right.append(-1)
            centres.append(centre), radii.append(away.max()), low.append(own.min()), high.append(own.max())
            if b - a <= LEAF:
                continue
            if low[-1] < high[-1]:
                by = np.argsort(own, kind="stable")
                edges = np.flatnonzero(np.diff(own[by])) + 1
                half = int(edges[np.argmin(np.abs(edges - (b - a) // 2))])
            else:
                p = exact[rows[away.argmax()]]
                q = exact[rows[((exact[rows] - p) ** 2).sum(axis=1).argmax()]]
                by, half = np.argsort(exact[rows] @ (q - p), kind="stable"), (b - a) // 2
            order[a:b] = rows[by]
            todo += [(a, a + half, node, 0), (a + half, b, node, 1)]
        self.ids, self.marks, self.labels, self.x = ids[order], marks[order], labels[order], x[order]
        self.centres, self.radii, self.low, self.high = np.array(centres), np.array(radii), np.array(low), np.array(high)
        self.most = int(np.abs(x).max()) if x.size else 0
        self.by_kind: dict = {}

    def search(self, q: np.ndarray, ids: np.ndarray, marks: np.ndarray, labels: np.ndarray, owner: np.ndarray, least: np.ndarray, top: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the best ``k`` rows for each query, best first; the largest 64-bit id stands where there are fewer. ``owner``: a query's
        row of ``q``, ``ids``, ``marks`` and ``labels``; ``least`` and ``top``: its window; ``same``: rows of its own label
        (itself excluded) or of all others."""
        kind = exact_kind(self.most, int(np.abs(q).max()) if q.size else 0, q.shape[1])
        none = np.iinfo(np.int64).min + 1 if kind is np.int64 else -np.inf
        x = self.by_kind.setdefault(kind, self.x.astype(kind))
        y = q.astype(kind)
        size = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        middle = q.astype(np.float64) @ self.centres.T
        slack = size[:, None] * self.radii * (1 + 1e-9) + 1e-9 * (np.abs(middle) + size[:, None] * np.sqrt((self.centres**2).sum(axis=1))) + 1e-6
        upper, lower = middle + slack, middle - slack
        least, top = least.astype(np.float64 if kind is not np.int64 else kind), top.astype(np.float64 if kind is not np.int64 else kind)
        best = np.full((len(owner), k), none, np.float64 if kind is not np.int64 else np.int64)
        whose = np.full((len(owner), k), np.iinfo(np.int64).max)
        mine = labels[owner]
        todo = [(0, np.arange(len(owner)))]
        while todo:
            node, act = todo.pop()
            lo, hi = self.low[node], self.high[node]
            own = mine[act]
            act = act[(own >= lo) & (own <= hi)] if same else act[(own != lo) | (lo != hi)]
            above = upper[owner[act], node]
            act = act[(above >= best[act, -1]) & (above >= least[act]) & (lower[owner[act], node] <= top[act])]
            if not len(act):
                continue
            if self.left[node] >= 0:
                u = owner[act]
                near, far = self.left[node], self.right[node]
                if middle[u, near].sum() < middle[u, far].sum():
                    near, far = far, near
                todo += [(far, act), (near, act)]
                continue
            a, b = self.start[node], self.stop[node]
            rows, at = np.unique(owner[act], return_inverse=True)
            s = (y[rows] @ x[a:b].T)[at]
            ok = (s >= np.maximum(best[act, -1], least[act])[:, None]) & (s <= top[act][:, None])
            if lo != hi:
                alike = self.labels[None, a:b] == mine[act][:, None]
                ok &= alike if same else ~alike
            if same:
                ok &= (self.ids[None, a:b] != ids[owner[act]][:, None]) | (self.marks[None, a:b] != marks[owner[act]][:, None])
            some = np.flatnonzero(ok.any(axis=1))
            if len(some):
                act = act[some]
                both = np.concatenate([best[act], np.where(ok[some], s[some], none)], axis=1)
                who = np.concatenate([whose[act], np.where(ok[some], self.ids[None, a:b], np.iinfo(np.int64).max)], axis=1)
                first = np.lexsort((who, -both), axis=1)[:, :k]
                best[act], whose[act] = np.take_along_axis(both, first, 1), np.take_along_axis(who, first, 1)
        return best, whose


def exact_kind(a: int, b: int, dims: int) -> type:
    """The fastest type in which inner products of integers up to ``a`` and ``b`` are exact."""
    most = a * b * max(1, dims)
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A row for each list, zeros beyond its end."""
    at = np.asarray(column.offsets, np.int64)
    size, values = np.diff(at), np.asarray(column.values, np.int64)[at[0] : at[-1]]
    if (size == dims).all():
        return values.reshape(len(size), dims)
    out = np.zeros((len(size), dims), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(values)) - np.repeat(at[:-1] - at[0], size)] = values
    return out


_FOUND = "array<struct<less:long,id:long>>"


def searched(rows: DataFrame, anchors: DataFrame, k: int, same: bool, dims: int, parts: int) -> DataFrame:
    """(id, mark, place, found) for each window of ``anchors`` (id, mark, label, vec, windows): the best ``k`` of ``rows``."""
    columns = ["id", "mark", "label", "vec", "windows"]
    kind = "array<struct<least:long,top:long>>"
    held = rows.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("asks"), *columns[:4], F.lit(None).cast(kind).alias("windows"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("asks"), *columns)
    dealt = held.unionByName(asked).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, gathered = None, []
        for b in batches:
            asks = np.asarray(b.column(1))
            cut = int(np.searchsorted(asks, 1))
            if cut:
                gathered.append(tuple(np.asarray(b.column(c).slice(0, cut), np.int64) for c in (2, 3, 4)) + (_matrix(b.column(5).slice(0, cut), dims),))
            if tree is None and cut < b.num_rows and gathered:
                tree = BallTree(*map(np.concatenate, zip(*gathered, strict=True)))
                gathered = []
            for i in range(cut, b.num_rows if tree else 0, BLOCK):
                s = b.slice(i, min(BLOCK, b.num_rows - i))
                windows = s.column(6)
                at = np.asarray(windows.offsets, np.int64)
                owner = np.repeat(np.arange(len(s)), np.diff(at))
                if not len(owner):
                    continue
                least, top = (np.asarray(windows.values.field(c), np.int64)[at[0] : at[-1]] for c in (0, 1))
                ids, marks, labels = (np.asarray(s.column(c), np.int64) for c in (2, 3, 4))
                best, whose = tree.search(_matrix(s.column(5), dims), ids, marks, labels, owner, least, top, k, same)
                good = whose != np.iinfo(np.int64).max
                keep = good.any(axis=1)
                ends = np.r_[0, np.cumsum(good[keep].sum(axis=1))]
                found = pa.StructArray.from_arrays([pa.array(-best[keep][good[keep]].astype(np.int64)), pa.array(whose[keep][good[keep]])], names=["less", "id"])
                place = np.arange(len(owner)) - (at[owner] - at[0])
                yield pa.RecordBatch.from_arrays([pa.array(ids[owner][keep]), pa.array(marks[owner][keep]), pa.array(place[keep].astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)], names=["id", "mark", "place", "found"])

    partial = dealt.select("part", "asks", *columns).mapInArrow(run, f"id long, mark long, place int, found {_FOUND}")
    # parts times k rows at most for each window
    return partial.groupBy("id", "mark", "place").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found"))


def mined(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors among ``rows`` (vec_id,
    label, vec array<long>); negatives n of a positive p satisfy low * p <= 100 * n <= high * p."""
    spark = rows.sparkSession
    own = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vec").cast("array<long>").alias("vec"), is_anchor.alias("asks"))
    own = own.where("id is not null and label is not null and vec is not null").withColumn("mark", F.xxhash64("label", "vec"))
    held = table(own.dropDuplicates(["id", "mark"]), "vectors")
    n, dims = held.agg(F.count("*"), F.max(F.size("vec"))).first()
    dims = max(1, dims or 1)
    parts = max(1, -(-n // MOST), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // LEAST)))
    anchors = held.where("asks").select("id", "mark", "label", "vec")
    ends = F.array(F.struct(F.lit(-(1 << 62)).alias("least"), F.lit(1 << 62).alias("top")))
    best = searched(held, anchors.withColumn("windows", ends), positives, True, dims, parts).select("id", "mark", F.col("found").alias("positives"))
    best = table(best, "positives")
    # low * p <= 100 * n <= high * p, as bounds of n: a ceiling and a floor
    div = lambda x, y: F.call_function("div", x, F.lit(y))
    down = lambda x, f: div(x - F.pmod(x, F.lit(100)), 100) * f + div(F.pmod(x, F.lit(100)) * f, 100)
    window = F.transform("positives", lambda f: F.struct((-down(f["less"], low)).alias("least"), down(-f["less"], high).alias("top")))
    got = searched(held, anchors.join(best.select("id", "mark", window.alias("windows")), ["id", "mark"]), negatives, False, dims, parts)
    d = got.join(best, ["id", "mark"]).select(F.col("id").alias("anchor_id"), F.get("positives", F.col("place")).alias("positive"), F.posexplode("found").alias("at", "negative"))
    return d.select("anchor_id", F.col("positive.id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("negative.id").alias("negative_id"), (-F.col("positive.less")).alias("positive_score"), (-F.col("negative.less")).alias("negative_score"))


def op13(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor (an id divisible by 50) against all rows."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    e = e.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vec = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    return mined(e.select("vec_id", label.alias("label"), vec.alias("vec")), F.col("vec_id") % 50 == 0)


SQL = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""

QUERIES = {"op13_hard_negatives": op13}
ORACLES = {"op13_hard_negatives": SQL}
