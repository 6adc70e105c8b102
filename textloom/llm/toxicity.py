"""Toxic spans by a linear-chain conditional random field, learned from labelled documents.

``learn`` takes at most SAMPLE_TOXIC toxic and SAMPLE_CLEAN clean labelled rows of at most LONGEST characters (the
first by a hash of id and text; a documented bound, the corpus may be any size) and drops near copies among them. Labels
are of texts, so those of tokens are latent: a text is toxic if one of its tokens is. ``latent`` fits that likelihood
(a noisy or over a text's words, each by its features) and a token of a toxic text counts as toxic if its posterior,
given that the text is, reaches one half. The field has two states, weights for a token's form, beginnings,
endings and shape (hashed) and for transitions, and is fitted to windows of tokens by gradient steps: six at most
spread over all toxic or like tokens of a text and two at random ones, or a text of under WINDOW words as a whole.

``tagged`` runs forward and backward over each whole text; a token's marginal is the probability of its being
toxic. A document's score is that one of the tokens at or above NOTED is toxic, or the largest marginal if
none is; tokens at or above 0.5 are its spans. Null, empty and blank texts score 0. A label that is null is
no label; repeated rows count once each. Language, source, id and labels are no inputs of a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from . import fingerprint as P

SAMPLE_TOXIC, SAMPLE_CLEAN, LONGEST, WINDOW, EPOCHS, RATE, DECAY, PRIOR = 1000, 2000, 10_000, 15, 60, 0.5, 1e-6, 3e-5
DIMS, NOTED = 1 << 18, 0.1
PREFIXES, SUFFIXES = (3, 4, 5, 6, 7, 8), (3, 4, 5)
FEATURES = 1 + len(PREFIXES) + len(SUFFIXES) + 3
_INK = np.zeros(256, bool)  # letters and digits: ASCII, and all bytes of longer characters
_INK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class _Words:
    """The cores of words, lower-cased and without what is no letter or digit at their ends, as byte ranges of
    ``raw``, and hashes of any part of them."""

    def __init__(self, raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        low = raw.copy()
        low[(raw >= 65) & (raw <= 90)] += 32
        after = np.r_[False, raw[:-1] == 0xC3] if len(raw) else np.zeros(0, bool)
        low[after & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)] += 32  # capital letters of Latin-1
        n = len(raw)
        place = np.arange(n)
        ahead = np.minimum.accumulate(np.where(_INK[raw], place, n)[::-1])[::-1] if n else place
        behind = np.maximum.accumulate(np.where(_INK[raw], place, -1)) if n else place
        self.first, self.last, self.raw = first, last, raw
        self.start = np.minimum(ahead[first], last) if n else first
        self.stop = np.maximum(behind[last - 1] + 1, self.start) if n else last
        self.size = self.stop - self.start
        up, self.down = W._power(max(1, n))
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(W._BYTE[low] * up[:n], out=self.total[1:])

    def hash(self, a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
        h = (self.total[b] - self.total[a]) * self.down[np.minimum(a, len(self.down) - 1)]
        return W.mix(h + np.uint64(salt * int(W._M) & 0xFFFFFFFFFFFFFFFF))

    def features(self) -> np.ndarray:
        """FEATURES numbers below DIMS of each word; 0 stands for none."""
        cols = [self.hash(self.start, self.stop, 1)]
        for k in PREFIXES:
            cols.append(np.where(self.size >= k, self.hash(self.start, np.minimum(self.start + k, self.stop), 10 + k), 0))
        for k in SUFFIXES:
            cols.append(np.where(self.size >= k, self.hash(np.maximum(self.stop - k, self.start), self.stop, 30 + k), 0))
        head = self.raw[self.first] if len(self.raw) else self.first
        cols.append(W.mix(np.minimum(self.size, 16).astype(np.uint64) + np.uint64(100)))
        cols.append(W.mix(((head >= 65) & (head <= 90)).astype(np.uint64) + np.uint64(200)))
        cols.append(W.mix(np.minimum(self.last - self.first - self.size, 6).astype(np.uint64) + np.uint64(300)))
        x = np.stack(cols, axis=1)
        return np.where(x == 0, 0, 1 + (x % np.uint64(DIMS - 1)).astype(np.int64))


def latent(texts: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Weights of features under which a text is toxic if one of its words is; ``texts``: of each the features of its
    distinct words (words, FEATURES). The last weight is the bias."""
    w = np.zeros(DIMS + 1)
    w[DIMS] = -6.0
    full = [k for k, x in enumerate(texts) if len(x)]
    x = np.concatenate([texts[k] for k in full])
    size = np.array([len(texts[k]) for k in full])
    at = np.r_[0, np.cumsum(size)[:-1]]
    label = np.repeat(toxic[full], size).astype(bool)
    total = np.full_like(w, 1e-8)
    for _ in range(EPOCHS):
        p = _likely(w, x)
        none = np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-9)), at)  # log of the chance that no word is toxic
        odds = np.exp(none) / np.maximum(1e-9, -np.expm1(none))
        pull = np.where(label, -np.repeat(odds, size) * p, p) / len(full)
        grad = np.r_[np.bincount(x.reshape(-1), np.repeat(pull, FEATURES), DIMS), pull.sum()] + PRIOR * w
        grad[0] = 0
        total += grad * grad
        w -= RATE * grad / np.sqrt(total)
    return w


def _likely(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The chance of each word to be toxic."""
    return 1 / (1 + np.exp(-np.clip(w[x].sum(axis=1) + w[DIMS], -30, 30)))


class Field:
    """The field: unary weights of the toxic state, log transitions [from][to], log start."""

    def __init__(self) -> None:
        self.w = np.zeros(DIMS)
        self.t = np.zeros((2, 2))
        self.s = np.zeros(2)

    def fit(self, groups: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Each group: windows of one length, x: windows, tokens, FEATURES; y: windows, tokens. AdaGrad on the
        conditional log-likelihood of all."""
        n = sum(len(y) for _, y in groups)
        sums = [np.full_like(p, 1e-8) for p in (self.w, self.t, self.s)]
        for _ in range(EPOCHS):
            gw, gt, gs = (sum(g) for g in zip(*(self._gradients(x, y) for x, y in groups), strict=True))
            for value, grad, total2 in zip((self.w, self.t, self.s), (gw / n + DECAY * self.w, gt / n, gs / n), sums, strict=True):
                total2 += grad * grad
                value -= RATE * grad / np.sqrt(total2)
            self.w[0] = 0

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, length = y.shape
        u = self.w[x].sum(axis=2)
        e = np.stack([np.zeros_like(u), u], axis=2)
        f, b = np.empty((n, length, 2)), np.zeros((n, length, 2))
        f[:, 0] = self.s + e[:, 0]
        for k in range(1, length):
            f[:, k] = e[:, k] + np.logaddexp(f[:, k - 1, :1] + self.t[0], f[:, k - 1, 1:] + self.t[1])
        for k in range(length - 2, -1, -1):
            z = e[:, k + 1] + b[:, k + 1]
            b[:, k] = np.stack([np.logaddexp(self.t[i, 0] + z[:, 0], self.t[i, 1] + z[:, 1]) for i in (0, 1)], axis=1)
        total = np.logaddexp(f[:, -1, 0], f[:, -1, 1])
        p = np.exp(f + b - total[:, None, None])
        gt = np.zeros((2, 2))
        for k in range(1, length):
            for i in (0, 1):
                for j in (0, 1):
                    gt[i, j] += np.exp(f[:, k - 1, i] + self.t[i, j] + e[:, k, j] + b[:, k, j] - total).sum()
            np.add.at(gt, (y[:, k - 1], y[:, k]), -1.0)
        gs = p[:, 0].sum(axis=0) - np.array([(y[:, 0] == 0).sum(), (y[:, 0] == 1).sum()])
        return np.bincount(x.reshape(-1), np.repeat((p[:, :, 1] - y).reshape(-1), FEATURES), DIMS), gt, gs

    def marginals(self, u: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The probability of the toxic state of each token; ``u``: its unary, ``row``: its text."""
        n = len(u)
        if not n:
            return np.zeros(0)
        psi = np.exp(np.clip(u, -30, 30))
        a, s = np.exp(self.t), np.exp(self.s)
        first = np.r_[True, row[1:] != row[:-1]]
        m = np.empty((n, 2, 2))
        m[:, :, 0] = np.where(first[:, None], s[0], a[:, 0])
        m[:, :, 1] = np.where(first[:, None], s[1], a[:, 1]) * psi[:, None]
        ahead = _scan(m)
        after = np.ones((n, 2, 2))  # what follows a text's last token does not matter
        after[:-1][~first[1:]] = m[1:][~first[1:]]
        behind = _scan(after[::-1].transpose(0, 2, 1))[::-1]
        both = ahead * behind
        return both[:, 1] / both.sum(axis=1)


def _scan(m: np.ndarray) -> np.ndarray:
    """(1, 1) times the product of the matrices up to each, normed. Blocks of tokens go side by side: products
    inside all blocks are built step by step, then each block takes up the vector that the one before ends with."""
    n = len(m)
    size = max(1, math.isqrt(n))
    blocks = -(-n // size)
    full = np.zeros((blocks * size, 2, 2))
    full[:, 0, 0] = full[:, 1, 1] = 1
    full[:n] = m
    full = full.reshape(blocks, size, 2, 2)
    out = np.empty_like(full)
    now = full[:, 0] / full[:, 0].max(axis=(1, 2), keepdims=True)
    out[:, 0] = now
    for k in range(1, size):
        x = full[:, k]
        p, q, r, s = now[:, 0, 0], now[:, 0, 1], now[:, 1, 0], now[:, 1, 1]
        nxt = np.empty_like(now)
        nxt[:, 0, 0] = p * x[:, 0, 0] + q * x[:, 1, 0]
        nxt[:, 0, 1] = p * x[:, 0, 1] + q * x[:, 1, 1]
        nxt[:, 1, 0] = r * x[:, 0, 0] + s * x[:, 1, 0]
        nxt[:, 1, 1] = r * x[:, 0, 1] + s * x[:, 1, 1]
        now = nxt / nxt.max(axis=(1, 2), keepdims=True)
        out[:, k] = now
    carry = np.ones((blocks, 2))
    for b in range(1, blocks):
        v = carry[b - 1] @ out[b - 1, -1]
        carry[b] = v / v.sum()
    got = np.einsum("bi,bkij->bkj", carry, out).reshape(-1, 2)[:n]
    return got / got.sum(axis=1, keepdims=True)


def _sample(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """The texts and labels to learn from, in a fixed order: at most SAMPLE_TOXIC and SAMPLE_CLEAN, whatever repeats."""
    known = labels.where(F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)).select("doc_id", "toxic").distinct()
    texts = docs.where(F.length("text") <= LONGEST).select("doc_id", "text", F.xxhash64("text").alias("h"))
    each = texts.select("doc_id", "h").join(known, "doc_id").distinct()  # a row for each text of an id, however often it is there
    mark = F.xxhash64("doc_id", "h")
    picked = each.where("toxic = 1").orderBy(mark, "doc_id", "h").limit(SAMPLE_TOXIC).union(each.where("toxic = 0").orderBy(mark, "doc_id", "h").limit(SAMPLE_CLEAN))
    # SAMPLE_TOXIC + SAMPLE_CLEAN rows at most
    rows = texts.join(F.broadcast(picked), ["doc_id", "h"]).groupBy("doc_id", "h", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id", "toxic", "h").collect()
    return [(r.text, r.toxic) for r in rows]


def learn(sample: list[tuple[str, int]]) -> Field:
    """A field fitted to labelled texts; without both kinds of label it finds nothing toxic."""
    field = Field()
    field.s[1] = -8.0
    field.t[0, 1] = -8.0
    if len({y for _, y in sample}) < 2:
        return field
    b = P.bins(pa.array([t for t, _ in sample], pa.large_string()))[:, :64]
    keep: list[int] = []
    held = np.empty_like(b)
    for i in range(len(sample)):
        if not keep or ((held[: len(keep)] == b[i]).mean(axis=1) < 0.5).all():
            held[len(keep)] = b[i]
            keep.append(i)
    read = {i: _read(sample[i][0]) for i in keep}
    feats = {i: read[i].features().astype(np.int32) for i in keep}
    once = {i: np.unique(feats[i][:, 0], return_index=True, return_inverse=True)[1:] for i in keep}  # distinct forms
    if not any(len(feats[i]) for i in keep):
        return field
    w = latent([feats[i][once[i][0]] for i in keep], np.array([sample[i][1] for i in keep]))
    rng = np.random.default_rng(7)
    groups: dict[int, tuple[list, list]] = {}
    for i in keep:
        x, y = feats[i], sample[i][1]
        n = len(x)
        if not n:
            continue
        p = _likely(w, x[once[i][0]])
        given = p / max(1e-9, -np.expm1(np.log1p(-np.minimum(p, 1 - 1e-9)).sum()))  # the posterior in a toxic text
        like = (given >= 0.5)[once[i][1]]
        # in a clean text the words that look toxic teach what is none
        spots = [*_spread(np.flatnonzero(like)), *rng.integers(0, n, 2).tolist()]
        size = min(n, WINDOW)
        xs, ys = groups.setdefault(size, ([], []))
        for k in spots if n > WINDOW else spots[:1]:
            lo = max(0, min(k - WINDOW // 2, n - size))
            xs.append(x[lo:lo + size])
            ys.append((like[lo:lo + size] & bool(y)).astype(np.int64))
    if groups:
        field = Field()
        field.fit([(np.stack(xs), np.stack(ys)) for _, (xs, ys) in sorted(groups.items())])
    return field


def _spread(hits: np.ndarray) -> list[int]:
    """Six of the places at most, evenly spread from the first to the last."""
    return hits[np.unique(np.linspace(0, len(hits) - 1, 6).round().astype(int))].tolist() if len(hits) else []


def _read(text: str) -> _Words:
    raw = np.frombuffer(text.encode(), np.uint8)
    _, _, first, last = W.words(raw, np.array([0, len(raw)]))
    return _Words(raw, first, last)


def tagged(docs: DataFrame, field: Field, spans: bool = True) -> DataFrame:
    """(doc_id, score, spans) of documents (doc_id, text): spans are characters (start, stop) with the marginal."""
    weights, kind = field.w.astype(np.float32), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("p", pa.float64())]))
    light = Field()
    light.w, light.t, light.s = np.zeros(1), field.t, field.s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for i, j, raw, at in W.slices(b.column(1)):
                h, row, first, last = W.words(raw, at)
                _, where, code = np.unique(h, return_index=True, return_inverse=True)
                u = weights[_Words(raw, first[where], last[where]).features()].sum(axis=1).astype(np.float64)
                p = light.marginals(u[code], row)
                off = np.searchsorted(row, np.arange(j - i + 1))
                most = W.reduce_rows(np.maximum, p, off, 0.0)
                none = W.reduce_rows(np.add, np.where(p >= NOTED, np.log1p(-np.minimum(p, 1 - 1e-12)), 0.0), off, 0.0)
                score = np.where(most >= NOTED, 1 - np.exp(none), most)
                out: list[list] = [[] for _ in range(j - i)]
                if spans:
                    chars = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
                    for k in np.flatnonzero(p >= 0.5):
                        start = chars[at[row[k]]]
                        out[row[k]].append({"start": int(chars[first[k]] - start), "stop": int(chars[last[k]] - start), "p": float(p[k])})
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, j - i), pa.array(score), pa.array(out, kind)], names=["doc_id", "score", "spans"])
                done += j - i

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, score double, spans array<struct<start:long,stop:long,p:double>>")


def op6(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    field = learn(_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return tagged(docs, field).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"))


QUERIES = {"op6_toxicity": op6}
