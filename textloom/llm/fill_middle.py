"""Fill-in-middle documents, cut at code points that are found from sparse events of UTF-8 bytes.

``Scanner`` holds one Aho-Corasick automaton over classes of bytes. Its patterns are the sentinels and the changes of
width: an ASCII character after longer ones, and the first byte of a longer character after ASCII or after characters of
another length. Between two such events all characters have one width, so a gap of b bytes has b / width units, and the
units before each event are sums over the gaps. The byte at which unit k starts follows from the last event that has at
most k units before it and the width that holds there: a search in a list that is as long as the changes are many, not
as the text is. The same scan says whether the text has a sentinel, and finds the sentinels of an output when the text is
rebuilt.

A null text is empty, and empty texts stay plain. A null id hashes as the empty string. Repeated rows and rows of
one id are transformed one by one. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
#: Of 100 documents so many are transformed, and of 100 of those so many start with the suffix.
TRANSFORMED, SUFFIX_FIRST, SEED = 90, 20, 1
_PLAIN, _MORE = "\x01", "\x02"
_LEAD = {2: "\x03", 3: "\x04", 4: "\x05"}
_WIDTH = {"\x03": 2, "\x04": 3, "\x05": 4}


class Scanner:
    """Events of texts for ``sentinels``, which are printable ASCII of two characters or more."""

    def __init__(self, sentinels: tuple[str, ...] = SENTINELS) -> None:
        own = sorted(set("".join(sentinels)))
        if not all("\x20" < c < "\x7f" for c in own) or min(map(len, sentinels)) < 2:
            raise ValueError("sentinels are printable ASCII of two characters or more")
        kind = [_PLAIN] * 0x80 + [_MORE] * 0x40 + [_LEAD[2]] * 0x20 + [_LEAD[3]] * 0x10 + [_LEAD[4]] * 0x10
        for c in own:
            kind[ord(c)] = c
        self.table = "".join(kind).encode("latin-1")
        self.automaton = ahocorasick.Automaton()
        one_byte = [_PLAIN, *own]
        for c in one_byte:  # class-changing ASCII
            self.automaton.add_word(_MORE + c, (1, ""))
        for c, (width, lead) in product(one_byte, _LEAD.items()):
            self.automaton.add_word(c + lead, (width, ""))
        for (v, before), (w, lead) in product(_LEAD.items(), _LEAD.items()):
            if v != w:
                self.automaton.add_word(before + _MORE * (v - 1) + lead, (w, ""))
        for s in sentinels:
            self.automaton.add_word(s, (0, s))
        self.automaton.make_automaton()

    def scan(self, data: bytes) -> Events:
        kinds = data.translate(self.table).decode("latin-1")
        at, widths, units, found = [0], [_WIDTH.get(kinds[:1], 1)], [0], []
        for end, (width, sentinel) in self.automaton.iter(kinds):
            if width:
                units.append(units[-1] + (end - at[-1]) // widths[-1])
                at.append(end)
                widths.append(width)
            else:
                found.append((end + 1 - len(sentinel), sentinel))
        return Events(at, widths, units, found, len(data))


class Events:
    """Where widths change, the width from there, the units before it; the places of sentinels; the bytes in all."""

    __slots__ = ("at", "widths", "units", "sentinels", "n")

    def __init__(self, at: list[int], widths: list[int], units: list[int], sentinels: list[tuple[int, str]], size: int) -> None:
        self.at, self.widths, self.units, self.sentinels = at, widths, units, sentinels
        self.n = units[-1] + (size - at[-1]) // widths[-1]

    def place(self, k: int) -> int:
        """The byte at which unit k starts; that after the text for k = n."""
        i = bisect_right(self.units, k) - 1
        return self.at[i] + (k - self.units[i]) * self.widths[i]


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """The four numbers that decide a document's cuts and form."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def cut(doc_id: int | None, data: bytes, scanner: Scanner, rate: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of a text's bytes."""
    events = scanner.scan(data)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not data or events.sentinels or h3 % 100 >= rate:
        return events.n, "plain", None, None, data
    i, j = sorted((h1 % (events.n + 1), h2 % (events.n + 1)))
    a, b = events.place(i), events.place(j)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    p, s, m = (x.encode() for x in SENTINELS)
    form, parts = ("spm", (s, suffix, p, prefix, m, middle)) if h4 % 100 < suffix_first else ("psm", (p, prefix, s, suffix, m, middle))
    return events.n, form, i, j - i, b"".join(parts)


def rebuilt(form: str, data: bytes, scanner: Scanner) -> bytes:
    """The text behind an output: its parts lie between the three sentinels, which stand in it once each."""
    if form == "plain":
        return data
    found = scanner.scan(data).sentinels
    stops = [at for at, _ in found[1:]] + [len(data)]
    part = {s: data[at + len(s) : stop] for (at, s), stop in zip(found, stops, strict=True)}
    return part[PREFIX] + part[MIDDLE] + part[SUFFIX]


def _each(df: DataFrame, schema: str, text: int, work: Callable[[dict, bytes, Scanner], tuple]) -> DataFrame:
    """``work`` over the rows of ``df``, whose column number ``text`` is bytes, by slices of bounded size."""
    types = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in batches:
            for i, j, raw, at in W.slices(b.column(text)):
                rest = [None if k == text else c.slice(i, j - i).to_pylist() for k, c in enumerate(b.columns)]
                data = raw.tobytes()
                rows = [work([None if c is None else c[k] for c in rest], data[at[k] : at[k + 1]], scanner) for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    return df.mapInArrow(run, types)


def transformed(docs: DataFrame, rate: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of documents (doc_id, text)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    out = _each(d, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary", 1, lambda r, data, scanner: (r[0], *cut(r[0], data, scanner, rate, suffix_first, seed)))
    return out.withColumn("output", F.col("output").cast("string"))


def restored(outputs: DataFrame) -> DataFrame:
    """The rows of ``transformed`` with the text rebuilt from form and output as column ``restored``."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    d = outputs.select(*names, F.col("output").cast("binary").alias("output"))
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary, restored binary"
    out = _each(d, schema, 5, lambda r, data, scanner: (*r[:5], data, rebuilt(r[2], data, scanner)))
    return out.withColumns({c: F.col(c).cast("string") for c in ("output", "restored")})


def op11(spark, sf_dir: str) -> DataFrame:
    """Every document's form, cuts and digests of its output and of the text rebuilt from it."""
    d = restored(transformed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    return d.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
o AS (SELECT *, substring(t, 1, i) AS p, substring(t, i + 1, j - i) AS m, substring(t, j + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256 FROM o"""

QUERIES = {"op11_fill_in_middle": op11}
ORACLES = {"op11_fill_in_middle": SQL}
