"""BPE by a tokenization automaton.

Merges are compiled, in their order, into a deterministic automaton over tokens that accepts a word's correct
tokenization and no other. It starts as one state with an arc to itself for every byte. The gadget for a merge
(u, v) -> w gives every state that has an arc u into a state with an arc v an arc w to where v led, and sends
the arcs u to a new state, a copy that lacks v. All arcs of one label lead to one state, so the automaton is
a target for each token and a tree of states, each its parent less one arc: it is built in one pass over the
merges and holds one state for each. An arc x leaves a state unless a state on the path to the root took away
the token that x began with at that time; whether a state is on that path is told by the numbers of a tour.

A pre-split word is encoded by its path: at each place the longest token whose arc leaves the state reached,
with a step back where none does. Transitions are read from a table (token, token) -> whether there is an arc, which
is filled from the compiled states as pairs are met and starts afresh beyond ARCS pairs, so a worker's memory is
bounded. Decoding emits the arcs' labels.

Null texts are empty; empty texts have no token. Rows are independent, other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from . import _words as W

#: Words whose tokens a worker remembers; it starts afresh beyond them.
REMEMBERED = 300_000
#: Transitions that a worker's table holds; it starts afresh beyond them.
ARCS = 500_000
#: The pattern of byte-level pre-splitting.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NEAR = 0x250  # below it the classes of characters are written out for the faster library


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out.update({chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))})
    return out


class Automaton:
    """The automaton of ``merges`` over the tokens of ``vocab`` (label in bytes: id)."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> None:
        self.ids = vocab
        n = max(vocab.values()) + 1
        self.label = [b""] * n
        for t, i in vocab.items():
            self.label[i] = t
        self.target = [0] * n
        self.made = [-1] * n  # the merge that made a token
        self.parts: list[tuple[int, int] | None] = [None] * n
        parent, self.state, self.rank = [-1], {}, {}
        for r, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            # no arc leads to what no merge could make; before the tour is numbered, ancestors are found by walking up
            if any(len(t) > 1 and self.parts[i] is None for t, i in ((a, u), (b, v))) or not self._arc(u, v, lambda s, t: self._above(parent, s, t)):
                continue  # no state has an arc u into a state with an arc v
            self.parts[w], self.made[w] = (u, v), r
            self.target[w] = self.target[v]
            parent.append(self.target[u])
            self.state[u, v] = self.target[u] = len(parent) - 1
            self.rank[u, v] = r
        children: list[list[int]] = [[] for _ in parent]
        for k, p in enumerate(parent[1:], 1):
            children[p].append(k)
        self.enter, self.leave = [0] * len(parent), [0] * len(parent)
        clock, todo = 0, [(0, False)]
        while todo:
            k, done = todo.pop()
            if done:
                self.leave[k] = clock
                continue
            clock += 1
            self.enter[k] = clock
            todo.append((k, True))
            todo.extend((c, False) for c in children[k])
        self.arcs: dict[int, bool] = {}
        self.size = n
        #: Tokens that stand on some path, and the length of the longest that starts with two bytes.
        self.reachable = {t: i for t, i in vocab.items() if len(t) == 1 or self.parts[i] is not None}
        self.reach: dict[bytes, int] = defaultdict(lambda: 1)
        for t in self.reachable:
            self.reach[t[:2]] = max(self.reach[t[:2]], len(t))

    @staticmethod
    def _above(parent: list[int], s: int, t: int) -> bool:
        # a state's parent is older, and so has the smaller number
        while t > s:
            t = parent[t]
        return s == t

    def _left(self, x: int) -> list[tuple[int, float]]:
        """What ``x`` begins with, longest first, and when that was merged on; no more than a token has bytes."""
        out, until = [], float("inf")
        while True:
            out.append((x, until))
            if self.parts[x] is None:
                return out
            until, x = self.made[x], self.parts[x][0]

    def _right(self, x: int) -> list[int]:
        out = [x]
        while self.parts[x] is not None:
            x = self.parts[x][1]
            out.append(x)
        return out

    def _arc(self, t: int, x: int, above) -> bool:
        """Whether an arc ``x`` leaves the state that arcs ``t`` lead to."""
        at, left = self.target[t], self._left(x)
        for p in self._right(t):
            for y, until in left:
                s = self.state.get((p, y))
                # the state that lost y, while x still began with y on its own
                if s is not None and self.rank[p, y] <= until and above(s, at):
                    return False
        return True

    def arc(self, t: int, x: int) -> bool:
        key = t * self.size + x
        found = self.arcs.get(key)
        if found is None:
            enter, leave = self.enter, self.leave
            if len(self.arcs) >= ARCS:
                self.arcs.clear()
            found = self.arcs[key] = self._arc(t, x, lambda s, k: enter[s] <= enter[k] <= leave[s])
        return found

    def encode(self, word: bytes) -> list[int]:
        """The tokens on the path that accepts ``word``."""
        ids, arcs, reach, n, most = self.reachable, self.arcs, self.reach, len(word), self.size
        whole = ids.get(word)
        if whole is not None:
            return [whole]
        out: list[int] = []
        dead = set()  # places that are reached but not left on the path
        at, size = 0, min(reach[word[:2]], n)
        while at < n:
            while size:
                x = ids.get(word[at:at + size])
                if x is not None and (not dead or at + size not in dead):
                    if not out:
                        break
                    ok = arcs.get(out[-1] * most + x)
                    if ok or (ok is None and self.arc(out[-1], x)):
                        break
                size -= 1
            if size:
                out.append(x)
                at += size
                size = min(reach[word[at:at + 2]], n - at) if at < n else 0
            else:
                dead.add(at)
                size = len(self.label[out.pop()])
                at -= size
                size -= 1
        return out


class Tokenizer:
    """Encodes texts and decodes ids as the file at ``path`` has it: byte-level BPE, special tokens split out first."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_chars()
        raw = lambda t: bytes(chars[c] for c in t)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.automaton = Automaton(vocab, [(raw(a), raw(b)) for a, b in merges])
        self.labels = dict(enumerate(self.automaton.label)) | {i: t.encode() for t, i in self.special.items()}
        self.known: dict[str, tuple[int, str, bytes]] = {}
        order = sorted(self.special, key=len, reverse=True)
        self.apart = re.compile("(" + "|".join(map(re.escape, order)) + ")") if order else None
        kinds = {"L": "", "N": ""}
        for k in range(_NEAR):
            if (c := unicodedata.category(chr(k))[0]) in kinds:
                kinds[c] += re.escape(chr(k))
        space = re.escape("".join(chr(k) for k in [*range(9, 14), 32, 0x85, 0xA0]))
        near = PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{kinds['L']}{kinds['N']}]").replace(r"\p{L}", f"[{kinds['L']}]").replace(r"\p{N}", f"[{kinds['N']}]").replace(r"(?!\S)", f"(?![^{space}])").replace(r"\s", f"[{space}]")
        self.near, self.far = re.compile(near), re.compile(f"[^\\x00-{chr(_NEAR - 1)}]")
        import regex

        self.full = regex.compile(PATTERN.replace(r"\S", r"\P{White_Space}").replace(r"[^\s\p{L}", r"[^\p{White_Space}\p{L}").replace(r"\s", r"\p{White_Space}"))

    def words(self, text: str) -> list[str]:
        return (self.full if self.far.search(text) else self.near).findall(text)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.apart.split(text) if self.apart else [text]:
            if part in self.special:
                out.append(self.special[part])
            else:
                for w in self.words(part):
                    out += self.automaton.encode(w.encode())
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")

    def _word(self, w: str) -> tuple[int, str, bytes]:
        ids = self.automaton.encode(w.encode())
        out = len(ids), ",".join(map(str, ids)), b"".join(map(self.labels.__getitem__, ids))
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[w] = out
        return out

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, digest of the ids, digest of what they decode to."""
        n, ids, data, known = 0, [], [], self.known
        for part in self.apart.split(text) if self.apart and any(s in text for s in self.special) else [text]:
            if part in self.special:
                found = [(1, str(self.special[part]), part.encode())]
            else:
                found = [known.get(w) or self._word(w) for w in self.words(part)]
            n += sum(x[0] for x in found)
            ids += [x[1] for x in found]
            data += [x[2] for x in found]
        decoded = b"".join(data).decode("utf-8", "replace").encode()
        return n, hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """One tokenizer for each file and worker; a name without a folder is one of the public tokenizers there."""
    if "/" not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    return Tokenizer(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) of documents (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in W.small(batches):
            ids = [t.encode(x or "") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([t.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of documents (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in W.small(batches):
            n, ids, decoded = zip(*(t.digests(x or "") for x in b.column(1).to_pylist()), strict=True) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5(spark, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), "byte_bpe_50k.json")


QUERIES = {"op5_bpe": op5}
