"""Fill-in-middle, language identification and hard negatives against plain Python, and on awkward tables."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from textloom.llm import fill_middle as M
from textloom.llm import hard_negatives as H
from textloom.llm import language as L

ALPHABET = ["a", "b c", "<", "P", ">", "<P", "<S>", "M>", "\n", "\x00", "\x1f", "\x7f", "é", "ß", "߿", "ࠀ", "中", "文", "￿", "🙂", "\U0010ffff"]


def test_places_are_those_of_code_points():
    rng = random.Random(5)
    scanner = M.Scanner()
    for _ in range(400):
        text = "".join(rng.choices(ALPHABET, k=rng.randrange(30)))
        e = scanner.scan(text.encode())
        assert e.n == len(text)
        assert [e.place(k) for k in range(len(text) + 1)] == [len(text[:k].encode()) for k in range(len(text) + 1)]
        assert [x for _, x in e.sentinels] == [text[i : i + 3] for i in range(len(text)) if text[i : i + 3] in M.SENTINELS]


def test_events_are_sparse():
    """Runs of one width cost one event, whatever their length."""
    for text in ("x" * 10_000, "中" * 10_000, "é" * 500 + "z" * 500 + "🙂" * 500):
        assert len(M.Scanner().scan(text.encode()).at) <= 4


def brute_cut(doc_id, text):
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_equals_plain_slicing(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randrange(40))) for _ in range(300)] + ["", None, "only <M> here", "é" * 70_000]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "no id", 1, "x"), (3, "another of id three", 1, "x"), (3, "another of id three", 1, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, n long, form string").repartition(5)
    got = Counter(tuple(r) for r in M.restored(M.transformed(d)).collect())
    assert got == Counter((i, *brute_cut(i, t or ""), t or "") for i, t, *_ in rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_sentinels_are_checked():
    with pytest.raises(ValueError):
        M.Scanner(("<", "<S>"))


def grams(text):
    t = f" {''.join(c if c.isalpha() else ' ' for c in text.lower())} "
    return [t[i : i + n] for n in L.NGRAMS for i in range(len(t) - n + 1) if " " not in t[i + 1 : i + n - 1] and (t[i] != " " or t[i + n - 1] != " ")]


def test_ngrams_equal_plain_slicing(monkeypatch):
    texts = ["Der Hund, ÄÖÜ!", "", "a", "12 34", "x1y", "中文 テスト", "İstanbul ß"]
    for piece in (1 << 19, 7, 3):
        monkeypatch.setattr(L, "PIECE", piece)
        seen = Counter()
        for code, row in L.pieces(texts):
            for h, r in L.grams(code, row):
                seen.update(zip(r.tolist(), h.tolist(), strict=True))
        per = Counter()
        for (r, _), n in seen.items():
            per[r] += n
        assert dict(per) == {i: len(grams(t)) for i, t in enumerate(texts) if grams(t)}
        assert len({h for _, h in seen}) == len({g for t in texts for g in grams(t)})


def test_masks_hold_every_language_and_few_others():
    """No false negative, and about as many false positives as the correction takes off; more languages than a plane has."""
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    mask = rng.integers(0, 256, (2, 20_000)).astype(np.uint8)
    filters = L.filled(h, mask)
    assert (L.masks(filters, h) & mask == mask).all()
    other = L.masks(filters, rng.integers(0, 1 << 63, 50_000, dtype=np.uint64))
    for k in range(16):
        expected = ((filters[k // 8] >> (k % 8)) & 1).mean() ** L.HASHES
        assert abs(((other[k // 8] >> (k % 8)) & 1).mean() - expected) < 0.01


def test_learned_sets_equal_counts_of_documents(spark):
    """The n-grams of each language are those of enough of its documents and of enough of the greatest share."""
    rng = random.Random(9)
    vocabulary = {x: ["".join(rng.choices(s, k=4)) for _ in range(30)] for x, s in {"xa": "abcde", "xb": "defgh", "xc": "ijkla"}.items()}
    rows = [(i, " ".join(rng.choices(vocabulary[x], k=8)), x) for i, x in enumerate(sorted(vocabulary) * 20)]
    m = L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), share=0.2)
    count = {x: Counter(g for _, t, y in rows if y == x for g in set(grams(t))) for x in vocabulary}
    h = {}
    for g in {g for c in count.values() for g in c}:
        padded = [x for code, row in L.pieces([g]) for y, _ in L.grams(code, row) for x in y.tolist()]
        inner = [x for x, y in zip(padded, grams(g), strict=True) if y == g]
        h[g] = inner[0] if inner else None
    names = sorted(vocabulary)
    assert m.names == names
    for g, x in h.items():
        if x is None or g != g.strip():
            continue
        share = [count[n][g] / 20 for n in names]
        want = sum(1 << k for k, s in enumerate(share) if s >= 0.2 and s >= 0.5 * max(share))
        assert int(L.masks(m.filters, np.array([x], np.uint64))[0, 0]) & want == want
    got = m.decide([rows[0][1], "", None, "123 !?", "中", "a"])
    assert got[0][0] == rows[0][2] and got[0][1:4] == ["und"] * 3 and got[1][1:4] == [0.0] * 3 and got[0][4] == m.usual and got[1][4] == 0.0
    assert all(0 <= s <= 1 for s in got[1])


def test_nothing_to_learn_from(spark):
    d = spark.createDataFrame([(1, "text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert sorted(tuple(r) for r in L.predicted(d, L.learn(d)).collect()) == [(1, "und", 0.0), (2, "und", 0.0)]


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    j = L.op12(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = j.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 30 and right / n >= 0.98


def brute_negatives(rows, is_anchor):
    """rows: distinct (id, label, vector)."""
    dims = max((len(v) for _, _, v in rows), default=0)
    full = [(i, y, [*v, *[0] * (dims - len(v))]) for i, y, v in rows]
    out = []
    for a in full:
        if not is_anchor(a[0]):
            continue
        score = [(-sum(p * q for p, q in zip(a[2], b[2], strict=True)), b[0], b[1]) for b in full if b is not a]
        for s, i, _ in sorted(x for x in score if x[2] == a[1])[:5]:
            fit = sorted(x for x in score if x[2] != a[1] and 50 * -s <= 100 * -x[0] <= 95 * -s)[:3]
            out += [(a[0], i, k + 1, n[1], -s, -n[0]) for k, n in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize(("scale", "labels", "leaf", "parts"), [(3, 4, 8, 1), (40, 3, 16, 4), (200_000, 2, 8, 3), (1 << 28, 5, 4, 2)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, scale, labels, leaf, parts):
    """Ties, negative scores, large components (64-bit products), several parts and deep trees."""
    monkeypatch.setattr(H, "LEAF", leaf)
    monkeypatch.setattr(H, "MOST", 300 // parts + 1)
    rng = np.random.default_rng(scale % 97)
    x = rng.integers(-scale, scale + 1, (300, 6)) + scale // 2
    rows = [(i, int(rng.integers(labels)), [int(c) for c in x[i]]) for i in range(300)]
    rows += [(300 + k, rows[k][1], rows[k][2]) for k in range(20)]  # equal vectors
    rows.append((7, labels + 9, [1, 2]))  # a shorter vector, of an id that is taken
    d = spark.createDataFrame([*rows, *rows[:30], (None, 1, [1] * 6), (900, None, [1] * 6), (901, 1, None)], "vec_id long, label int, vec array<long>")
    got = sorted(tuple(r) for r in H.mined(d, F.col("vec_id") % 10 == 0).collect())
    assert got == brute_negatives(rows, lambda i: i % 10 == 0) and len(got) > 50


def test_nodes_are_pruned():
    """Far clusters are never opened: a tree of 64 leaves, a query whose best rows lie in one of them."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-1000, 1000, (64, 8)) * 10
    x = np.repeat(centres, H.LEAF, axis=0) + rng.integers(-3, 4, (64 * H.LEAF, 8))
    n = len(x)
    tree = H.BallTree(np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), x)
    opened = []

    class Counted(np.ndarray):
        def __getitem__(self, k):
            if isinstance(k, slice):
                opened.append(k)
            return super().__getitem__(k)

    tree.by_kind = {H.exact_kind(tree.most, 10_000, 8): x.astype(np.float64)[:0].view(Counted)}
    tree.by_kind = {k: tree.x.astype(k).view(Counted) for k in tree.by_kind}
    q = centres[:1]
    best, whose = tree.search(q, np.array([-1]), np.array([0]), np.array([0]), np.array([0]), np.array([-(1 << 62)]), np.array([1 << 62]), 5, True)
    score = x @ q[0]
    assert best[0].tolist() == sorted(score.tolist(), reverse=True)[:5] and len(opened) <= 16


def test_no_vectors(spark):
    d = spark.createDataFrame([], "vec_id long, label int, vec array<long>")
    assert H.mined(d, F.col("vec_id") % 50 == 0).count() == 0
