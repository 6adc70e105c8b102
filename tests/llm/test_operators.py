"""The corpus operators against brute force, exact round trips and held-out labels, and on awkward tables."""

import binascii
import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from parity import same
from pyspark.sql import functions as F

from textloom.llm import _words as W
from textloom.llm import bpe, chat, chunks, fill_middle, fingerprint, html_text, language, lines, near_dup, neighbours, packing, quality, registry, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig string, v long, places string, gone string, component string, kept string"


def words(rng, n, vocabulary=3000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and blank texts, a very long one, repeated rows, repeated ids, columns of clashing names."""
    rng = random.Random(3)
    long = " ".join(words(rng, 60_000))
    passage = " ".join(words(rng, 60))
    texts = [None, "", " \n\t ", "one", "one two", long, passage, f"a b c\n{passage}\nd e f", f"{passage} tail end", "é ü 中文 🙂  x", "a" * 50_000, "\n".join(["same line of eight words is here now"] * 5)]
    rows = [(i, t, ("en", None)[i % 5 == 4], ("src0", None)[i % 7 == 6], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, "a row without an id but with words", "en", "src0", 5), (3, "another text of the id three", None, None, None)]
    return spark.createDataFrame([(*r, "x", 1, "y", "z", "c", "k") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def flat(df):
    return sorted((tuple(map(repr, r)) for r in df.collect()))


OPS = {
    "near": near_dup.near_duplicates, "fingerprints": fingerprint.fingerprints, "neighbours": lambda d: neighbours.compare(neighbours.with_next(d)), "packing": packing.packed,
    "chunks": chunks.substring_dedup, "lines": lines.line_dedup, "quality": lambda d: quality.judged(quality.features(d), quality.fences(quality.features(d))),
    "bpe": lambda d: bpe.digests(d, _path()), "toxicity": lambda d: toxicity.tagged(d, toxicity.learn([])),
    "fill_middle": lambda d: fill_middle.restored(fill_middle.transformed(d)), "language": lambda d: language.predicted(d, language.learn(d)),
    "stage3": lambda d: quality.stage(None, d, ""), "stage8": lambda d: lines.stage(None, d, ""), "stage9": lambda d: near_dup.stage(None, d, ""), "stage1": lambda d: chunks.stage(None, d, ""), "stage2": lambda d: packing.stage(None, d, ""),
}


def _path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", OPS)
def test_awkward_and_empty_tables(awkward, empty, name):
    assert OPS[name](empty).count() == 0
    got = OPS[name](awkward)
    n = awkward.count()
    if name.startswith("stage"):
        assert got.count() <= n
        if name != "stage2":
            assert got.columns == awkward.columns
    elif name == "neighbours":
        assert got.count() == n - 1  # without the row that has no id
    else:
        assert got.count() == n


def test_awkward_pages_and_conversations(spark):
    """Op 7 and 10: nulls in any column, repeated rows, a very long text, an empty table, columns of clashing names."""
    long = "word " * 200_000
    rows = [(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (None, None, None), (2, None, ""), (3, "v", f"<article><p>{long}</p></article>")]
    d = spark.createDataFrame([(*r, "x", 7) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = flat(html_text.main_text(d))
    assert got == sorted(tuple(map(repr, r)) for r in [(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0), (2, None, "", 0), (3, "v", long.strip(), len(long) - 1)])
    assert html_text.main_text(d.limit(0)).count() == 0
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, None, None), (None, None, "assistant", "b"), (2, 5, "assistant", long)]
    c = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, turns string, formatted string")
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.read_back(chat.formatted(chat.turns(c)).drop("turns")).collect()}
    assert got == {1: [("user", "a", False)] * 2 + [("", "", False)], None: [("assistant", "b", True)], 2: [("assistant", long, True)]}
    assert chat.read_back(chat.formatted(chat.turns(c.limit(0)))).count() == 0


def test_contents_of_the_awkward_table(spark, awkward):
    """What every operator makes of nulls, blanks, repeated rows and two texts of one id."""
    by = lambda d: sorted(((r.doc_id, r.text) for r in d.collect()), key=repr)
    rows = by(awkward)
    passage = next(t for i, t in rows if i == 6)
    assert by(lines.line_dedup(awkward)) == sorted([(i, "a b c\nd e f" if i == 7 else t) for i, t in rows], key=repr)
    cut = dict(by(chunks.substring_dedup(awkward)))
    assert cut[0] is None and cut[1] == "" and cut[6] == passage and len(cut[8].split()) < 30
    near = {r.doc_id: r for r in near_dup.near_duplicates(awkward).collect()}
    assert near[0].n_shingles == near[1].n_shingles == 0 and {i for i in near if not near[i].kept} == {7, 8} and near[7].component_id == near[8].component_id == 6
    counts = Counter((r.doc_id, r.n_words, r.kept) for r in OPS["quality"](awkward).collect())
    assert counts[7, 66, True] == 3 and counts[0, 0, False] == 1
    packs = Counter((r.doc_id, r.n_tokens) for r in packing.packed(awkward).collect())
    assert packs[7, 66] == 3 and packs[3, 1] == packs[3, 6] == 1 and packs[None, 8] == 1
    tokens = Counter((r.doc_id, r.n_tokens) for r in bpe.digests(awkward, _path()).collect())
    assert tokens[0, 0] == tokens[1, 0] == 1 and sum(tokens.values()) == len(rows)
    f = toxicity.learn([("you scumbag go away now", 1), ("a good day to you all", 0)] * 20)
    scores = {(r.doc_id, r.score) for r in toxicity.tagged(awkward, f).collect()}
    assert {(0, 0.0), (1, 0.0), (2, 0.0)} <= scores


def test_sample_of_labels_is_bounded(spark, monkeypatch):
    """Many rows of few labelled ids, texts that are too long to learn from, repeated rows: the bound holds, and is met by what is left."""
    monkeypatch.setattr(toxicity, "SAMPLE_TOXIC", 20)
    monkeypatch.setattr(toxicity, "SAMPLE_CLEAN", 30)
    ids = [i for i in range(1, 30) if binascii.crc32(str(i).encode()) % 5][:4]
    rows = [(ids[k % 3], f"text {k // 2}") for k in range(5000)] + [(ids[3], "x" * 10_001)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(ids[0], 1), (ids[1], 0), (ids[2], 0), (ids[3], 1)] * 2, "doc_id long, toxic int")
    got = toxicity._sample(docs, labels)
    assert sum(y for _, y in got) == 20 and len(got) == 50 and len(set(got)) == 50


def test_registry():
    assert {int(re.match(r"op(\d+)_", k)[1]) for k in registry.QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    same(registry.QUERIES[name](spark, DATA), duck, registry.ORACLES[name])


# --- near-duplicates ---

def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[i] = {tuple(w[a:a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(rng):
    rows = []
    for group in range(6):
        base = words(rng, rng.choice([3, 40, 120]))
        for _ in range(12):
            t = list(base)
            for _ in range(rng.randrange(0, max(2, len(t) // 18))):
                t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(t))
    rows += ["", "A b", "a B", "one", None]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_are_the_components(spark, k):
    rows = near_copies(random.Random(k))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k).collect()}
    assert got == brute_components(rows, k, 80)


def test_near_duplicates_with_several_texts_of_an_id(spark):
    """Rows of one id hang together, whichever of its texts is near another document."""
    rng = random.Random(41)
    x, y, z = (words(rng, 80) for _ in range(3))
    change = lambda w: " ".join([*w[:40], "other", *w[41:]])
    rows = [(5, " ".join(x)), (5, " ".join(y)), (5, " ".join(y)), (9, change(y)), (3, change(x)), (8, " ".join(z)), (7, change(z)), (7, ""), (None, " ".join(z)), (11, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()), key=repr)
    want = [(5, 76, 3, False)] * 3 + [(9, 76, 3, False), (3, 76, 3, True), (8, 76, 7, False), (7, 76, 7, True), (7, 0, 7, True), (None, 76, None, True), (11, 0, 11, True)]
    assert got == sorted(want, key=repr)


def test_near_duplicates_in_long_lists(spark, monkeypatch):
    """Every branch: lists count as long from two members, and blocks hold a few documents."""
    monkeypatch.setattr(near_dup, "LONG", 2)
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    rows = near_copies(random.Random(9))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == brute_components(rows, 2, 80)


# --- fingerprints ---

def test_fingerprints_estimate_similarity():
    rng = random.Random(1)
    a = words(rng, 900)
    for share in (0.2, 0.5, 0.9):
        b = a[:int(900 * share)] + words(rng, 900 - int(900 * share))
        sets = [{tuple(x[i:i + 5]) for i in range(len(x) - 4)} for x in (a, b)]
        true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        f = fingerprint.bins(pa.array([" ".join(a), " ".join(b)]))
        assert abs(fingerprint.likeness(f[:1], f[1:])[0] - true) < 0.1
    f = fingerprint.bins(pa.array(["short", "short", "", None, "x y"]))
    p = fingerprint.packed(f)
    assert p[0] == p[1] and p[2] == p[3] == "" and p[4] not in ("", p[0])
    assert (fingerprint.unpacked(p) == f).all()
    assert fingerprint.likeness(f[:3], f[1:4]).tolist() == [1.0, 0.0, 1.0]


def plain_fingerprint(text):
    """One-permutation MinHash with optimal densification, one shingle and one bin at a time."""
    raw = np.frombuffer(text.encode(), np.uint8)
    h, row, _, _ = W.words(raw, np.array([0, len(raw)]))
    hashes = {int(x) for x in W.shingles(h, row, 5)[0]}
    low = {}
    for x in hashes:
        low[x >> 55] = min(low.get(x >> 55, 1 << 64), x & ((1 << 55) - 1))
    out = []
    for k in range(512 if low else 0):
        draw, at = 0, k
        while at not in low:
            draw += 1
            at = int(W.mix(np.array([(k * 0x1000003 + draw) % 2**64], np.uint64))[0]) % 512
        out.append(low[at] & 15)
    return "".join(f"{x:x}" for x in out)


def test_fingerprints_equal_a_plain_reference(spark):
    """The whole query: fingerprints of texts and edited texts, and both likenesses."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    got = {r.doc_id: r for r in registry.QUERIES["op4_document_fingerprints"](spark, DATA).collect()}
    like = lambda a, b: float(a == b) if not a or not b else min(1.0, max(0.0, (sum(x == y for x, y in zip(a, b, strict=True)) / 512 - 1 / 16) / (15 / 16)))
    plain = [plain_fingerprint(t) for _, t in rows]
    for k, (i, t) in enumerate(rows):
        nxt = (k + 1) % len(rows)
        new = plain_fingerprint(neighbours.edited(t, rows[nxt][1]))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (plain[k], new)
        assert abs(got[i].near_edited - like(plain[k], new)) < 1e-12 and abs(got[i].near_next - like(plain[k], plain[nxt])) < 1e-12


def test_neighbours_follow_the_order_of_ids(spark):
    rows = [(i * 3, t) for i, t in enumerate(["alpha beta", "", "x", "gamma delta epsilon", None, "y" * 9])]
    assert neighbours.compare(neighbours.with_next(spark.createDataFrame(rows[:1], "doc_id long, text string"))).first().near_next == 1.0
    got = {r.doc_id: r for r in neighbours.compare(neighbours.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))).collect()}
    texts = [t or "" for _, t in rows]
    for k, (i, _) in enumerate(rows):
        t, u = texts[k], texts[(k + 1) % len(rows)]
        want = t[:len(t) - len(t) // 2] + u[:len(t) // 2]
        assert got[i].edited_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[i].n_chars == len(t)


def test_neighbours_over_a_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    got = {r.doc_id: r.edited_sha256 for r in registry.QUERIES["op4_document_fingerprints"](spark, DATA).collect()}
    assert got == {i: hashlib.sha256(neighbours.edited(t, rows[(k + 1) % len(rows)][1]).encode()).hexdigest() for k, (i, t) in enumerate(rows)}


# --- tokens ---

def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    theirs, ours = Tokenizer.from_file(_path()), bpe.tokenizer(_path())
    rng = random.Random(5)
    some = "abcdeABC  \n\t'!?.0123éßñÇ中文🙂​\x1c\x85 ½²<|>日本ÀŸ \r"
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["<|endoftext|>a<|endoftext|>", "'s 's don't I'LL", " " * 50, "a" * 500, "the" * 200, "-" * 300]
    texts += [r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    for t in texts:
        want = theirs.encode(t, add_special_tokens=False).ids
        assert ours.encode(t) == want
        assert ours.decode(want) == theirs.decode(want, skip_special_tokens=False)
        n, ids, _ = ours.digests(t)
        assert (n, ids) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())


def test_automaton_equals_merging():
    """On random merges the automaton's path is what merging pair by pair gives."""
    rng = random.Random(2)
    for _ in range(60):
        vocab = {bytes([97 + i]): i for i in range(3)}
        merges = []
        while len(merges) < 14:
            a, b = rng.choice(list(vocab)), rng.choice(list(vocab))
            if a + b not in vocab and len(a + b) < 9:
                merges.append((a, b))
                vocab[a + b] = len(vocab)
        m = bpe.Automaton(vocab, merges)
        for _ in range(40):
            w = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 14)))
            t = [bytes([x]) for x in w]
            for a, b in merges:
                i, out = 0, []
                while i < len(t):
                    if i + 1 < len(t) and (t[i], t[i + 1]) == (a, b):
                        out.append(a + b)
                        i += 2
                    else:
                        out.append(t[i])
                        i += 1
                t = out
            assert [m.label[x] for x in m.encode(w)] == t


# --- toxicity ---

def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    f = toxicity.Field()
    f.t, f.s = rng.normal(size=(2, 2)), rng.normal(size=2)
    u, row = rng.normal(size=14), np.array([0] * 5 + [1] * 1 + [2] * 8)
    want = []
    for r in range(3):
        x = u[row == r]
        mass = np.zeros(len(x))
        total = 0.0
        for y in itertools.product((0, 1), repeat=len(x)):
            e = f.s[y[0]] + sum(x[i] for i in range(len(x)) if y[i]) + sum(f.t[a, b] for a, b in itertools.pairwise(y))
            total += np.exp(e)
            mass += np.exp(e) * np.array(y)
        want += (mass / total).tolist()
    assert np.allclose(f.marginals(u, row), want)


def test_scores_equal_enumeration(spark):
    """A text's score and spans from the sum over all its taggings."""
    f = toxicity.learn([(" ".join([*words(random.Random(i), 6, 50), *["scumbag"] * (i % 2)]), i % 2) for i in range(120)])
    texts = ["you scumbag here", "a good day", "scumbag, scumbag!", "w1 w2 w3 w4 scumbag w5", "x"]
    got = {r.doc_id: r for r in toxicity.tagged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), f).collect()}
    for i, t in enumerate(texts):
        u = f.w.astype(np.float32)[toxicity._read(t).features()].sum(axis=1)
        mass, total = np.zeros(len(u)), 0.0
        for y in itertools.product((0, 1), repeat=len(u)):
            e = math.exp(f.s[y[0]] + sum(x for x, k in zip(u, y, strict=True) if k) + sum(f.t[a, b] for a, b in itertools.pairwise(y)))
            total += e
            mass += e * np.array(y)
        p = mass / total
        noted = p[p >= toxicity.NOTED]
        assert abs(got[i].score - (1 - np.prod(1 - noted) if len(noted) else p.max())) < 1e-6
        starts = [m.start() for m in WORD.finditer(t)]
        assert [s.start for s in got[i].spans] == [a for a, x in zip(starts, p, strict=True) if x >= 0.5]
    assert got[0].score > 0.5 > got[1].score


def test_toxic_spans_of_held_out_texts(spark):
    rng = random.Random(4)
    bad = ["idiot", "scumbag", "worthless"]
    def text(toxic):
        w = words(rng, 60)
        for _ in range(3 * toxic):
            w[rng.randrange(60)] = rng.choice(bad) + rng.choice(["", ".", "!"])
        return " ".join(w)
    f = toxicity.learn([(text(i % 4 == 0), int(i % 4 == 0)) for i in range(400)])
    rows = [(i, text(i % 2)) for i in range(100)] + [(1000, ""), (1001, None)]
    for r in toxicity.tagged(spark.createDataFrame(rows, "doc_id long, text string"), f).collect():
        t = dict(rows)[r.doc_id] or ""
        if r.doc_id >= 1000:
            assert r.score == 0.0 and not r.spans
        else:
            assert (r.score >= 0.5) == (r.doc_id % 2 == 1)
            assert all(toxicity and any(b in t[s.start:s.stop] for b in bad) for s in r.spans)


def test_toxicity_learns_from_short_texts(spark):
    rng = random.Random(32)
    text = lambda toxic: " ".join([*words(rng, rng.randrange(4, 9), 200), *["scumbag"] * toxic, *words(rng, 2, 200)])
    f = toxicity.learn([(text(i % 2), i % 2) for i in range(400)] + [("", 0), ("", 1)])
    got = toxicity.tagged(spark.createDataFrame([(i, text(i % 2)) for i in range(60)], "doc_id long, text string"), f).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in got)


def test_windows_spread_over_all_hits():
    assert toxicity._spread(np.arange(0, 1010, 10)) == [0, 200, 400, 600, 800, 1000]
    assert toxicity._spread(np.array([3, 5])) == [3, 5] and toxicity._spread(np.array([], int)) == []


def test_toxicity_contract(spark):
    import zlib

    got = registry.QUERIES["op6_toxicity"](spark, DATA).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count()


# --- chat ---

def test_escape_is_reversible(spark):
    parts = ["<", "|", "\\", "[", "INST]", "/INST]", "s>", "/s>", "end", ">", "\n", "é"]
    rng = random.Random(6)
    rows = [("".join(rng.choice(parts) for _ in range(rng.randrange(12))),) for _ in range(2000)]
    d = spark.createDataFrame(rows, "t string").select("t", chat.escape("t").alias("e")).withColumn("u", chat.unescape("e"))
    assert d.where("t <> u").count() == 0
    assert d.where(F.col("e").rlike(r"<\||\[/?INST\]|</?s>")).count() == 0


def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", "<|end|>\n<|turn|>x"), (1, 0, "user", None), (1, None, None, "first"), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (None, 0, "user", "n")]
    d = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    f = chat.formatted(chat.turns(d))
    back = {r.conv_id: [(t.role, t.text, t.learned) for t in r.turns] for r in chat.read_back(f.drop("turns")).collect()}
    assert back == {1: [("", "first", False), ("user", "", False), ("assistant", "<|end|>\n<|turn|>x", True)], 2: [("assistant", "", True)] * 2, None: [("user", "n", False)]}
    assert chat.turns(d.limit(0)).count() == 0


@pytest.mark.parametrize(("record", "layout", "turns"), [
    ('{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "id": 3}', "messages", [("user", "a"), ("assistant", "b")]),
    ('{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}', "sharegpt", [("user", "a"), ("assistant", "b")]),
    ('{"instruction": "do", "input": "it", "output": "ok"}', "instruction_input", [("user", "do\n\nit"), ("assistant", "ok")]),
    ('{"output": "ok", "instruction": "do"}', "instruction", [("user", "do"), ("assistant", "ok")]),
    ('{"prompt": "p", "completion": null}', "prompt", [("user", "p"), ("assistant", "")]),
    ('{"prompt": "p", "response": "r", "system": "s"}', "prompt_system", [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ('{"messages": []}', "messages", []),
    ('{"messages": [{"role": "user"}, {"role": "assistant", "content": "b"}], "prompt": "p", "answer": "x"}', "messages", [("user", ""), ("assistant", "b")]),
    ('{"prompt": "p", "question": "q", "answer": "a", "completion": "c"}', "prompt", [("user", "p"), ("assistant", "c")]),
    ('{"messages": [{"role": "user", "content": {"nested": 1}}]}', "messages", [("user", '{"nested":1}')]),
    ('{"messages": null, "question": "q", "answer": "a"}', "question", [("user", "q"), ("assistant", "a")]),
    ('{"messages": "text"}', None, None), ('{"messages": [1, 2]}', None, None), ("", None, None), ("[]", None, None),
    ('{"other": 1}', None, None), ("not json", None, None), (None, None, None),
])
def test_layouts(spark, record, layout, turns):
    r = chat.turns_of_json(spark.createDataFrame([(record,)], "record string")).first()
    assert r.layout == layout and (r.turns if turns is None else [tuple(t) for t in r.turns]) == turns


def test_layouts_of_typed_frames_and_clashing_columns(spark):
    d = spark.createDataFrame([(1, "q", "a", "x", "y", "z", "w")], "conv_id long, question string, answer string, _prompt string, _messages string, layout string, turns string")
    assert chat.layout_of(d) == "question" and [tuple(x) for x in chat.turns(d).first().turns] == [("user", "q"), ("assistant", "a")]
    j = spark.createDataFrame([('{"prompt": "p", "response": "r"}', "keep", "old", "old", "k")], "record string, _prompt string, layout string, turns string, _p string")
    r = chat.turns_of_json(j).first()
    assert r._prompt == "keep" and r._p == "k" and r.layout == "prompt_response" and len(r.turns) == 2
    f = chat.formatted(chat.turns_of_json(j)).drop("turns")
    back = chat.read_back(f).first()
    assert back._p == "k" and [(t.role, t.text) for t in back.turns] == [("user", "p"), ("assistant", "r")]
    with pytest.raises(ValueError, match="no layout"):
        chat.layout_of(d.select("conv_id", "question"))


# --- html ---

@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("plain  text", "plain text"),
    ("<nav>menu</nav><article><h1>T</h1><p>a &amp; b<br>c</p><script>var t='</p>'</script><p>d</article><footer>f</footer>", "T\n\na & b c\n\nd"),
    ('<div class="cookie-notice"><p>We use cookies on this site</p></div><div id="main-content"><p>First part of it.</p><form><p>Mail</p></form><p>Second part.</p><section id="comments"><p>nice!</p></section></div><aside>x</aside>', "First part of it.\n\nSecond part."),
    ("<body><header><h1>Site</h1></header><main><p>aa  bb</p></main></body>", "aa bb"),
    ("<![odd[ <p>x", None), ("<p>unclosed <b>bold", "unclosed bold"),
])
def test_main_text(page, text):
    got = html_text.extract(page)
    assert text is None or got == text


_LONG = "Long prose of the article that runs on for many words and holds most of its characters. " * 4


@pytest.mark.parametrize(("page", "text"), [
    (f"<nav>menu</nav><article><section><p>{_LONG * 3}</p></section><section><p>{_LONG}</p></section></article>", [_LONG * 3, _LONG]),
    (f"<article><header><h1>T</h1></header><div class=body><p>{_LONG}</p><p>{_LONG}</p></div></article><footer>f</footer>", ["T", _LONG, _LONG]),
    (f"<main><h1>T</h1><article><p>{_LONG * 4}</p></article><article><p>{_LONG}</p></article></main>", ["T", _LONG * 4, _LONG]),
    (f"<article><p>{_LONG * 4}</p></article><article><p>{_LONG}</p></article>", [_LONG * 4, _LONG]),
    (f"<div><h1>T</h1><div><div><p>{_LONG * 3}</p></div><div><p>{_LONG}</p></div></div></div>", ["T", _LONG * 3, _LONG]),
    *[(f"<nav>menu</nav><div><p>Intro</p>{a}{_LONG * 3}{b}</div>", ["Intro", _LONG * 3]) for a, b in (("<ul><li>", "</ul>"), ("<table><tr><td>", "</table>"), ("<blockquote>", "</blockquote>"))],
])
def test_main_text_keeps_every_block_of_the_article(page, text):
    assert html_text.extract(page) == "\n\n".join(t.strip() for t in text)


@pytest.mark.parametrize(("page", "text"), [
    ('<article><p>a</p><p class="advert">Buy now!</p><p>b</p><p class="comment">nice!</p><h2 id="share-this">x</h2><p>c</p></article>', "a b c"),
    ('<article><p>a</p><section class="discussion"><p>b</p></section><section class="search results"><p>c</p></section></article>', "a b c"),
    ('<article><ul><li>a<li class="related">gone<li>b<li>c</ul><p>d</article>', "a b c d"),
    ('<article><p>a<p class="advert">gone<p>b<div class="sponsored">gone</div><p>c</article>', "a b c"),
    ('<article><table><tr><td>a<td class="ad">b<tr class="promo"><td>gone<tr><td>c</table><dl><dt>d<dd class="ad">gone<dt>e</dl></article>', "a c d e"),
    ("<article><p>a</p><canvas><p>b</p><p>c</p></article><footer>f</footer>", "a b c"),
    ("<article><p>a <svg><p>b</p><audio>c<p>d <canvas>gone</canvas></p><video>e</article>", "a b c d e"),
    ("<article><p>Press <button>OK</button> to go</p><button>Share</button></article>", "Press OK to go"),
    ("<head><title>t</title><article><p>a</p></article>", "a"),
    ("<article><ul><li>a<ul><li>b</ul><li>c</ul></article></section></p></div><p>d</p>", "a b c"),
])
def test_main_text_of_messy_markup(page, text):
    got = html_text.extract(page)
    assert got.split() == text.split()


_MENU = "".join(f'<a href="/{k}">Section {k}</a> ' for k in range(8))


@pytest.mark.parametrize(("page", "text"), [
    # no name tells what is what here: only the clusters do
    (f"<body><div>{_MENU * 30}</div><div><h1>T</h1><p>{_LONG}</p><p>Short one.</p><p>{_LONG * 2}</p></div><div>{_MENU}</div><div>(c) 2020</div><div>All rights</div><div>kept</div></body>", ["T", _LONG, "Short one.", _LONG * 2]),
    (f"<body><div>Site</div><div>of things</div><div>since 2020</div><table><tr><td>{_MENU}</td></tr></table><p>{_LONG}</p><div>{_MENU}</div><p>{_LONG * 2}</p></body>", [_LONG, _LONG * 2]),
    (f"<body><div>Site</div><div>of things</div><div><ul><li><a>Home</a></li><li><a>News</a></li><li><a>Mail</a></li></ul></div><h2>T</h2><p>{_LONG * 2}</p><ul><li>one</li><li>two</li></ul><p>{_LONG}</p></body>", ["T", _LONG * 2, "one", "two", _LONG]),
])
def test_clusters_select_the_text(page, text, monkeypatch):
    want = "\n\n".join(t.strip() for t in text)
    assert html_text.extract(page) == want
    monkeypatch.setattr(html_text, "clustered", lambda ratios: [True] * len(ratios))
    assert html_text.extract(page) != want


@pytest.mark.parametrize(("page", "text"), [
    ('<article><p>a <span class="ad">Buy now!</span> b</p><p>c <i class="sponsored-link">d <i>e</i> f</i> g</p></article>', "a b c g"),
    ('<article><p>a <span class="ad">never closed</p><p>b</p></article>', "a b"),
    ('<article><p class="reply-policy">a</p><section class="tags-history">b</section><div class="skip-lists">c</div><p class="byline">d</p><p class="ad-hoc">e</p></article>', "a b c d e"),
    ('<article><p>a</p><p hidden>x</p><div style="display:none">y</div><p>b<span style="visibility: hidden">z</span></p></article>', "a b"),
    (f'<body><article><h1>T</h1><p>{_LONG}</p></article><section id="reactions"><article><p>{_LONG}</p></article></section></body>', f"T {_LONG}"),
    (f'<body><article><h1>T</h1><p>{_LONG}</p></article><article class="more"><h2>Next</h2><p>teaser</p></article></body>', f"T {_LONG}"),
    (f'<body><article><h1>T</h1><p>{_LONG}</p><div><article><p>a reader says so</p></article></div></article></body>', f"T {_LONG}"),
    (f'<body><article><h1>T</h1><p>{_LONG}</p></article><div><article><h2>Next</h2><p>teaser of another</p></article></div></body>', f"T {_LONG}"),
])
def test_inline_adverts_hidden_text_and_several_articles(page, text):
    assert html_text.extract(page).split() == text.split()


def test_pages_without_names(spark):
    """The clusters find the article when element names say nothing, too: the share of pages whose text stays the same."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    div = lambda h, names: re.sub(rf"<(/?)({names})(?=[\s>])", r"<\1div", h)
    bare = lambda h: re.sub(r' (class|id|role)="[^"]*"', "", h)
    want = [html_text.extract(h) for h in pages]
    share = lambda f: sum(html_text.extract(f(h)) == w for h, w in zip(pages, want, strict=True)) / len(pages)
    assert share(lambda h: div(h, "article|main")) >= 0.99
    assert share(lambda h: bare(div(h, "article|main"))) >= 0.95
    assert share(lambda h: bare(div(h, "article|main|nav|aside|header|footer|form"))) >= 0.95


@pytest.mark.parametrize("part", ["<li>x", "<div>", "<p>x", "<td>x", "<ul><li>", "<svg>", "<h1>x", "<b>", "</div>", "<div></p>", "<li></li>", "<article>"])
def test_main_text_is_linear(part):
    import time

    page = "<article><p>first</p>" + part * 40_000 + "<p>last</p>"
    began = time.process_time()
    assert html_text.extract(page).startswith("first") and time.process_time() - began < 8


@pytest.mark.parametrize("bad", ["<![odd[ x ]]>", "<![odd>", "<![ 5 [x]>", "<![&>", "<![if x]>", "<![CDATA[ x ]]>"])
def test_main_text_survives_bad_declarations(bad):
    assert html_text.extract(f"<!DOCTYPE html><article><p>a</p>{bad}<p>b</p></article><!-- c --><footer>f</footer>") == "a\n\nb"
    assert html_text.extract(f"<!DOCTYPE html><article><p>a</p></article>{bad[:-1]}").startswith("a")


def test_main_text_never_raises():
    assert html_text.extract(f"<p>a &#{'9' * 5000}; &#{'0' * 5000}65; b</p>") == "a \ufffd A b"
    rng = random.Random(30)
    parts = ["<!", "<![", "[", "]", "]]>", ">", "<!--", "--", "<", "</", "p", "odd", "if", "cdata", "&#", "&#x110000;", "&amp", ";", " ", '"', "'", "=", "<?", "<!doctype", "div", "script", "\x00", "é", "/"]
    for _ in range(20_000):
        assert html_text.extract("".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))) is not None


def test_pages_equal_their_articles(spark):
    import html as H

    n = 0
    for r in html_text.main_text(spark.read.parquet(f"{DATA}/pages.parquet")).join(spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(H.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
        n += 1
    assert n == 50


# --- substring dedup ---

def plain_chunks(text):
    """Words and cuts of one text, from the gear hash of each word's last 16 bytes, word by word."""
    data = text.encode()
    found = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    value = [sum(int(chunks._GEAR[x]) << (len(data[max(0, j - 16):j]) - 1 - k) for k, x in enumerate(data[max(0, j - 16):j])) & 0xFFFF for _, j in found]
    out, start = [], 0
    for k in range(len(found)):
        near = [value[x] for x in range(max(0, k - 3), min(len(found), k + 4)) if x != k]
        if k + 1 == len(found) or all(value[k] < v for v in near):
            size = k + 1 - start
            marks = [start, *range(start + 16, k + 1, 16), k + 1] if size > 32 else [start, k + 1]
            out += list(itertools.pairwise(marks))
            start = k + 1
    return [data[i:j].decode() for i, j in found], out


def brute_substring(rows):
    """Chunks one text at a time; of each least run of 20 words all earlier places."""
    held = {}
    for key, (i, t) in enumerate(rows):
        w, cuts = plain_chunks(t or "") if i is not None else ([], [])
        found = set()
        for a in range(len(cuts)):
            for order in (range(a, len(cuts)), range(a, -1, -1)):
                for b in order:
                    lo, hi = cuts[min(a, b)][0], cuts[max(a, b)][1]
                    if hi - lo >= 20:
                        found.add((lo, hi, tuple(tuple(w[x:y]) for x, y in cuts[min(a, b):max(a, b) + 1])))
                        break
        held[key] = (w, found)
    out = []
    for key, (i, t) in enumerate(rows):
        w, found = held[key]
        drop = set()
        for lo, hi, run in found:
            if any(r == run and rows[other][0] < i for other, (_, theirs) in held.items() for _, _, r in theirs) or any(r == run and x < lo for x, _, r in found):
                drop.update(range(lo, hi))
        out.append([x for k, x in enumerate(w) if k not in drop])
    return out


def test_substring_dedup_equals_brute_force(spark):
    """Also with ids that have several texts, or one of them twice, and with texts that repeat a word or a few."""
    rng = random.Random(8)
    passages = [words(rng, n) for n in (55, 70, 200)]
    rows = [(i, " ".join(words(rng, 80) + (passages[i % 3] if i % 2 else []) + words(rng, 30))) for i in range(40)]
    rows += [(100, rows[3][1]), (101, ""), (7, rows[3][1]), (9, "short text here"), (9, "short text here"), (102, None), (None, rows[5][1])]
    rows += [(200 + k, " ".join(["spam"] * n)) for k, n in enumerate((30, 70, 200))] + [(210, " ".join(["a b c"] * 60)), (211, " ".join(["é ü"] * 80))]
    clean = len(rows)
    # parts of a text whose words stand in two earlier documents, 12 from each: no 20 of them ever stood together
    a, b = words(rng, 60), words(rng, 60)
    rows += [(300, " ".join(a)), (301, " ".join(b)), (302, " ".join(words(rng, 20) + a[20:32] + b[20:32] + words(rng, 20)))]
    got = chunks.substring_dedup(spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, at long")).collect()
    got = {r.at: r for r in got}
    want = [x if rows[k][0] is not None else WORD.findall(rows[k][1]) for k, x in enumerate(brute_substring(rows))]
    assert [WORD.findall(got[k].text or "") for k in range(len(rows))] == want
    assert got[40].text == "" and got[45].text is None and got[clean + 2].text == rows[-1][1]
    for k, (i, t) in enumerate(rows[:40]):
        w = WORD.findall(t)
        if i % 2 and i > 5:  # a later copy of a passage keeps fewer than 20 words of it
            assert len(w) - len(want[k]) >= len(passages[i % 3]) - 35
        else:
            assert w == want[k]


def test_chunks_resist_insertions():
    rng = random.Random(12)
    w = words(rng, 400)
    digests = []
    for t in (w, [*w[:200], "inserted", *w[200:]]):
        raw = np.frombuffer(" ".join(t).encode(), np.uint8)
        digests.append(Counter(chunks.cut(raw, np.array([0, len(raw)]))[3].tolist()))
    assert sum((digests[0] & digests[1]).values()) >= sum(digests[0].values()) - 4


# --- line dedup ---

def test_line_dedup_deletes_aligned_blocks(spark):
    a = "alpha line with enough words to count as one\nsecond line of the block goes on for long"
    rows = [(1, f"top of one\n{a}\nend of one"), (2, f"other top\n{a}\nother end"), (3, "nothing shared in this text at all"), (4, f"{a}"), (5, "other top"), (6, None), (7, "")]
    got = {r.doc_id: r.text for r in lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "other top\nother end", 3: rows[2][1], 4: "", 5: "other top", 6: None, 7: ""}


def brute_runs(text):
    """(first line, line after the last, the lines and the number of equal runs before) of every least stretch of MIN_WORDS words."""
    t = [" ".join(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in text.split("\n")]
    full = [k for k, x in enumerate(t) if x]
    size = [len(t[k].split(" ")) for k in full]
    found = set()
    for k in range(len(full)):
        j = next((j for j in range(k + 1, len(full) + 1) if sum(size[k:j]) >= lines.MIN_WORDS), None)
        i = next((i for i in range(k, -1, -1) if sum(size[i:k + 1]) >= lines.MIN_WORDS), None)
        found |= ({(k, j)} if j else set()) | ({(i, k + 1)} if i is not None else set())
    seen, out = Counter(), []
    for i, j in sorted(found):
        key = tuple(t[k] for k in full[i:j])
        out.append((full[i], full[j - 1] + 1, (key, seen[key])))
        seen[key] += 1
    return out


def brute_lines(rows):
    """The lines to delete from each document, by partners found in all earlier documents; ids are distinct."""
    held = {i: brute_runs(t) for i, t in rows if i is not None and t is not None}
    where = {}
    for i in sorted(held):
        for p, _, key in held[i]:
            where.setdefault(key, []).append((i, p))
    number = {key: k for k, key in enumerate(where)}
    want = {}
    for i, found in held.items():
        shared = []
        for p, q, key in found:
            before = [x for x in where[key] if x[0] < i]
            near = before[-1:] if len(where[key]) <= lines.RARE else []
            shared += [(p, q, number[key], *x, len(where[key])) for x in {*before[:1], *near}]
        want[i] = {k for p, q, *_ in lines.aligned(shared) for k in range(p, q)}
    return want


def test_line_dedup_in_the_order_of_lines(spark):
    P, Q, R = (f"the passage named {x} has more words than eight in it" for x in "PQR")
    short = ["one two", "three four", "five six", "seven eight", "nine"]
    rows = [(1, f"{P}\n{Q}\n{R}"), (2, f"{R}\n{P}\n{Q}"), (3, f"{R}\n{P}\n{Q}"), (4, f"{Q}\n{R}\nown line of four\n{P}")]
    rows += [(10 + k, f"own {k}\n{x}\nend {k}") for k, x in enumerate(short)] + [(20, "\n".join(["b", *short, "c"])), (21, "\n".join(["d", *short, "e"]))]
    got = {r.doc_id: r.text for r in lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # in 2 a single line moved, which stays; what of 3 and 4 the first document leaves is aligned with the nearest one
    assert got == {**dict(rows), 2: R, 3: "", 4: "own line of four", 21: "d\ne"}
    left = lines.stage(None, spark.createDataFrame([(i, f"\n{t}\n") for i, t in rows], "doc_id long, text string"), "")
    assert {r.doc_id for r in left.collect()} == {i for i, _ in rows} - {3}


def test_a_block_that_moved_goes_and_a_line_stays():
    run = lambda p, h, place: (p, p + 1, h, 1, place, 2)
    assert lines.aligned([run(0, 7, 5), *(run(k, k, k - 1) for k in range(1, 5))]) == [(1, 5, 1, 0)]
    moved = [run(0, 7, 10), run(1, 8, 11), *(run(k, k, k) for k in range(2, 6))]
    assert lines.aligned(moved) == [(0, 2, 1, 10), (2, 6, 1, 2)]


def test_without_the_diff_nothing_goes(monkeypatch):
    rows = [(i, "\n".join(f"line {k} has quite enough words" for k in range(6))) for i in range(4)]
    assert all(len(x) == 6 for i, x in brute_lines(rows).items() if i)
    monkeypatch.setattr(lines, "patience", lambda a, b: [])
    assert not any(brute_lines(rows).values())


def test_alignment_is_as_long_as_can_be():
    """Two documents of single lines that are unique: as many lines go as the longest common ascent has, by plain dynamic
    programming, and of what is left only blocks of two lines."""
    rng = random.Random(31)
    for _ in range(300):
        n = rng.randrange(1, 12)
        b = rng.sample(range(20), n)
        shared = [(p, p + 1, h, 1, b.index(h), 2) for p, h in enumerate(rng.sample(b, n))]
        best = [0] * n
        for i in range(n):
            best[i] = 1 + max((best[j] for j in range(i) if shared[j][4] < shared[i][4]), default=0)
        found = lines.aligned(shared)
        gone = sum(q - p for p, q, _, _ in found)
        pairs = sum(shared[i + 1][4] == shared[i][4] + 1 for i in range(n - 1))
        assert gone >= max(best) and (gone == max(best) or pairs)
        assert all([x[2] for x in shared[p:q]] == b[place:place + q - p] for p, q, _, place in found)


@pytest.mark.parametrize("seed", [21, 22, 23])
def test_line_dedup_equals_all_partners(spark, seed, monkeypatch):
    """Runs, partners and order by brute force over all texts; a small bound of what is rare."""
    monkeypatch.setattr(lines, "RARE", 6)
    rng = random.Random(seed)
    pool = [" ".join(words(rng, rng.choice([1, 2, 3, 5, 9]))) for _ in range(25)]
    block = [rng.sample(pool, 4) for _ in range(8)]
    piece = lambda: rng.choice([[rng.choice(pool)], rng.choice(block), [""], [" ".join(words(rng, 4))]])
    rows = [(i, "\n".join(itertools.chain.from_iterable(piece() for _ in range(rng.randrange(1, 9))))) for i in range(70)]
    rows += [(None, rows[3][1]), (500, None), (501, "")]
    got = lines.line_dedup(spark.createDataFrame([(*r, r[1]) for r in rows], "doc_id long, text string, old string"), blocks_col="blocks").collect()
    want = brute_lines(rows)
    assert sum(map(len, want.values())) > 50 and len(got) == len(rows)
    texts = {i: (t or "").split("\n") for i, t in rows}
    words_of = lambda t: [x for x in t if x]
    for r in got:
        if r.doc_id is None or r.old is None:
            assert r.text == r.old and r.gone is None
            continue
        gone, old = set(r.gone or []), r.old.split("\n")
        assert gone == want[r.doc_id] and r.text == "\n".join(x for k, x in enumerate(old) if k not in gone)
        for b in r.blocks or []:  # what a block's partner holds
            mine = words_of(old[b.start:b.stop])
            assert b.other < r.doc_id and mine == words_of(texts[b.other][b.place:])[: len(mine)]


def test_texts_of_one_id_take_nothing_from_each_other(spark):
    a, b = "a first line that has enough words in it", "a second line that has enough words in it"
    rows = [(1, f"{a}\nx"), (1, f"y\n{a}"), (1, f"{a}\nx"), (2, f"{a}\n{b}"), (2, f"{b}\nz"), (2, f"{a}\n{b}")]
    got = Counter((r.doc_id, r.text) for r in lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([*rows[:3], (2, b), (2, f"{b}\nz"), (2, b)])


def test_alignment_pairs_blocks_in_order(spark):
    """A passage that stands twice in both documents is paired place by place; a line that moved stays."""
    x, y, z = (f"line {k} has quite enough words" for k in "xyz")
    rows = [(1, "\n".join([x, "a", y, "b", x, "c", z])), (2, "\n".join([z, "d", x, "e", y, "f", x]))]
    r = next(r for r in lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), blocks_col="blocks").collect() if r.doc_id == 2)
    assert r.text == f"{z}\nd\ne\nf" and [(b.start, b.stop) for b in r.blocks] == [(2, 3), (4, 5), (6, 7)]


def test_patience_is_a_common_subsequence():
    rng = random.Random(14)
    for _ in range(200):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(15))] for _ in range(2))
        m = lines.patience(a, b)
        assert all(a[i] == b[j] for i, j in m) and all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(m))
    assert lines.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]


def test_patience_aligns_repeated_lines(spark):
    assert [len(lines.patience(*x)) for x in (([7, 1, 7], [2, 7, 3]), ([2, 7, 3], [7, 1, 7]), ([1, 7, 8, 2, 7, 8, 3], [4, 7, 8, 5, 7, 8, 6]))] == [1, 1, 4]
    rng = random.Random(31)
    for _ in range(300):  # no stretch with a common line is abandoned
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        m = lines.patience(a, b)
        assert m or not set(a) & set(b)
        for (i, j), (i2, j2) in itertools.pairwise([(-1, -1), *m, (len(a), len(b))]):
            assert not set(a[i + 1:i2]) & set(b[j + 1:j2])
    P = "the passage named P has more words than eight in it"
    rows = [(1, f"{P}\nx\n{P}"), (2, f"y\n{P}\nz"), (3, f"u\n{P}\nv\n{P}\nw")]
    got = {r.doc_id: r.text for r in lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "y\nz", 3: "u\nv\nw"}


# --- packing ---

def test_boundaries_are_optimal():
    rng = random.Random(15)
    for _ in range(40):
        x = sorted(rng.sample(range(0, 60), rng.randrange(1, 9)))
        c = [rng.randrange(1, 9) for _ in x]
        cost = lambda tops: sum(n * (min(t for t in tops if t >= v) - v) for v, n in zip(x, c, strict=True))  # noqa: B023, E731
        k = rng.randrange(1, 5)
        best = min(cost([*s, x[-1]]) for r in range(min(k, len(x))) for s in itertools.combinations(x[:-1], r))
        got = packing.boundaries(x, c, k)
        assert got[-1] == x[-1] and len(got) <= k and got == sorted(got) and cost(got) == best
    assert packing.boundaries([], []) == []


def test_batches_keep_the_budget(spark):
    rng = random.Random(16)
    rows = [(i, " ".join(["w"] * rng.choice([0, 3, 50, 51, 700]))) for i in range(300)] + [(5, "a b c"), (None, "x"), (7, None)]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), buckets=3, budget=1400).collect()
    assert len(got) == len(rows) and all(r.n_tokens <= r.padded_to for r in got)
    sizes = Counter((r.bucket, r.batch) for r in got)
    top = {r.bucket: r.padded_to for r in got}
    for (b, _), n in sizes.items():
        assert n <= max(1, 1400 // max(1, top[b]))
    for b in top:  # all batches but the last are full, and ids ascend through them
        mine = sorted((r.batch, r.in_batch, -1 if r.doc_id is None else r.doc_id) for r in got if r.bucket == b)
        assert [i for *_, i in mine] == sorted(i for *_, i in mine)
        assert [x for x, *_ in mine] == [k // max(1, 1400 // max(1, top[b])) for k in range(len(mine))]


# --- quality ---

def test_fences_follow_the_source(spark):
    rng = random.Random(17)
    rows = [(i, " ".join(words(rng, 40)), "en", "clean") for i in range(80)] + [(100 + i, " ".join(f"{w}###" for w in words(rng, 40)), "en", "tags") for i in range(80)]
    rows += [(300, " ".join(f"{w}###" for w in words(rng, 40)), "en", "clean"), (301, "a b", "en", "clean"), (302, " ".join(["a b c d e f"] * 8), "en", "clean"), (303, None, "en", "clean")]
    f = quality.features(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    kept = {r.doc_id: r.kept for r in quality.judged(f, quality.fences(f)).collect()}
    assert not any(kept[i] for i in (300, 301, 302, 303)) and all(kept[i] for i in range(80)) and all(kept[100 + i] for i in range(80))


def test_sketches_merge(spark):
    """The sketch of all is the sum of the sketches of the parts."""
    f = quality.features(spark.read.parquet(f"{DATA}/documents.parquet")).cache()
    s = quality.sketches(f)
    own = s.where("source is not null").groupBy("measure", "value").agg(F.sum("n").alias("n"))
    assert own.exceptAll(s.where("lang is null").select("measure", "value", "n")).isEmpty()


# --- pipeline ---

def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "substring_dedup", "packing"]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, DATA)
        assert after.columns == docs.columns and after.count() <= now.count(), name
        now = spark.createDataFrame(after.collect(), docs.schema)
    assert flat(corpus_pipeline.run(spark, DATA).select("doc_id")) == flat(now.select("doc_id"))
    verdict = {r.doc_id: r.kept for r in registry.QUERIES["op3_quality_rules"](spark, DATA).collect()}
    first = corpus_pipeline.STAGES[0][1](spark, docs, DATA)
    assert {r.doc_id for r in first.collect()} == {i for i, k in verdict.items() if k}


def test_pipeline_equals_brute_force(spark, tmp_path):
    """All five stages on a fixture with every kind of case, against plain Python (and SQL for the first)."""
    import corpus_pipeline
    import duckdb

    rng = random.Random(77)
    line = lambda n: " ".join(words(rng, n))
    blocks = [[line(9), line(7)] for _ in range(4)]
    passages = [line(60) for _ in range(3)]
    texts = []
    for k in range(90):
        parts = [line(rng.randrange(8, 30)) for _ in range(rng.randrange(1, 5))]
        if k % 4 == 1:
            parts += rng.choice(blocks)
        if k % 5 == 2:
            parts[0] += " " + rng.choice(passages) + " " + line(12)
        texts.append("\n".join(parts))
    texts += [texts[3], texts[8], " ".join([*texts[12].split()[:-1], "changed"]), "\n".join(blocks[1]), passages[2]]  # copies, near copies, what is all in others
    texts += [line(5), "###" + " ### $$ ".join(words(rng, 60)), " ".join(["a b c d e f"] * 9), "", None]  # what the rules reject
    rng.shuffle(texts)
    rows = [(i * 2, t, rng.choice(["en", "fr", None]), "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    kept = dict(con.execute(f"select doc_id, kept from ({quality.SQL})").fetchall())
    now = [(i, t) for i, t, *_ in rows if kept[i]]
    assert len(now) < len(rows) - 4
    gone = brute_lines(now)
    after = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]), bool(gone[i])) for i, t in now]
    assert any(g for *_, g in after)
    now = [(i, t) for i, t, g in after if not g or t.split()]
    component = brute_components(now, 5, 80)
    assert any(c != i for i, (_, c) in component.items())
    now = [(i, t) for i, t in now if component[i][1] == i]
    left = brute_substring(now)
    assert sum(map(len, left)) < sum(len(t.split()) for _, t in now)
    want = {i: len(w) for (i, t), w in zip(now, left, strict=True) if w or not t.split()}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(want)
    tops = sorted({r.padded_to for r in got})
    assert all(r.n_tokens <= r.padded_to and (r.bucket == 0 or r.n_tokens > tops[r.bucket - 1]) for r in got) and tops[-1] == max(want.values())
