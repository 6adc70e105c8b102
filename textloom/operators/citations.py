"""Citation audit: style, markers, references, their matching and the comparison with resolved metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

_DASH = "[-–]"


#: Patterns of in-text markers, of reference lists and of their headers.
MARKS = {
    "ieee": r"\[\d+(?:\s*(?:,\s*\d+|[-–]\s*\d+))*\s*\]",
    "author_year": r"\(\s*[A-Z][A-Za-z]+(?:\s+et\s+al\.)?(?:\s*(?:and|&)\s*[A-Z][A-Za-z]+)?\s*,\s*\d{4}\s*\)",
    "author_page": r"\(\s*[A-Z][A-Za-z]+(?:\s*(?:et\s+al\.|and|&)\s*[A-Z][A-Za-z]+)*\s+\d{1,3}\s*\)",
}
TAIL = r"(?s)^(.*)\b(references|bibliography|works\s+cited|notes)\b(.*)$"
#: A title in quotes and an arXiv id.
QUOTED = "[\"“]([^\"”]+)[\"”]"
ARXIV = r"(?i)arXiv:(\d{4}\.\d{4,5}|[a-z\-]+(?:\.[A-Z]+)?/\d{7})"
NUMBERED = r"^(\[\d+\]|\d+\.)"
IN_PARENS, NO_PARENS = r"\b[A-Z][A-Za-z]+,\s*[A-Z]\.\s*\(\d{4}\)", r"\b[A-Z][A-Za-z]+,\s*[A-Z]\.\s*\d{4}\b"


def style(docs: DataFrame) -> DataFrame:
    """(doc_id, style, confidence, n_markers): the style with the best score, the first named on ties; UNKNOWN
    with 0.0 below 0.5. Markers are counted before the last header of a reference list, entries after it."""
    low, n = F.lower(F.col("text")), lambda c, p: F.size(F.regexp_extract_all(F.col(c), F.lit(p), F.lit(0)))
    d = docs.select("doc_id", "text", low.rlike(TAIL).alias("has"), F.regexp_extract(low, TAIL, 2).alias("header"), F.length(F.regexp_extract(low, TAIL, 1)).alias("at"))
    d = d.select("doc_id", "has", "header", F.when(F.col("has"), F.expr("substr(text, 1, at)")).otherwise(F.col("text")).alias("body"), F.when(F.col("has"), F.expr("substr(text, at + 1)")).otherwise("").alias("tail"))
    first = F.slice(F.filter(F.transform(F.split("tail", "\n"), T.strip), lambda x: x != ""), 1, 8)
    d = d.select("doc_id", "has", "header", *[n("body", p).alias(k) for k, p in MARKS.items()], (F.size(F.filter(first, lambda x: x.rlike(NUMBERED))) >= 2).alias("listed"), (n("tail", IN_PARENS) >= n("tail", NO_PARENS)).alias("parens"))
    many = lambda k: F.col(k) > 1
    alone = F.col("header").isin("bibliography", "notes") & ~many("ieee") & ~many("author_year") & ~many("author_page")
    scores = {
        "IEEE": F.when(many("ieee") & F.col("listed"), 0.95).when(many("ieee"), 0.8).when(F.col("listed"), 0.9).otherwise(0.0),
        "APA": F.when(~many("author_year"), 0.0).when(~F.col("has"), 0.8).when(F.col("parens"), 0.9).otherwise(0.7),
        "MLA": F.when(many("author_page") & F.col("header").rlike(r"^works\s+cited$"), 0.95).when(many("author_page"), 0.8).otherwise(0.0),
        "HARVARD": F.when(~many("author_year"), 0.0).when(F.col("has") & ~F.col("parens"), 0.9).otherwise(0.7),
        "CHICAGO": F.when(alone, 0.4).otherwise(0.0),
    }
    marks = {"IEEE": "ieee", "APA": "author_year", "MLA": "author_page", "HARVARD": "author_year"}
    each = [F.struct(v.alias("s"), F.lit(-i).alias("i"), F.lit(k).alias("k"), (F.col(marks[k]) if k in marks else F.lit(0)).alias("n")) for i, (k, v) in enumerate(scores.items())]
    d = d.select("doc_id", F.array_max(F.array(*each)).alias("best"))
    known = F.col("best.s") >= 0.5
    return d.select("doc_id", F.when(known, F.col("best.k")).otherwise("UNKNOWN").alias("style"), F.when(known, F.col("best.s")).otherwise(0.0).alias("confidence"), F.when(known, F.col("best.n")).otherwise(0).cast("long").alias("n_markers"))


def numbered_markers(docs: DataFrame) -> DataFrame:
    """(doc_id, number): [3], [1, 4-6] and [5]-[7], ranges spelled out. A range between brackets is taken first
    and its brackets are not read again."""
    span = rf"\[(\d+)\]\s*{_DASH}\s*\[(\d+)\]"
    d = docs.select("doc_id", F.regexp_replace("text", span, "[$1-$2]").alias("text"))
    inner = F.explode(F.regexp_extract_all("text", F.lit(r"\[(\d+(?:\s*[,\-–]\s*\d+)*)\]"), F.lit(1)))
    parts = d.select("doc_id", inner.alias("m")).select("doc_id", F.explode(F.split("m", r"\s*,\s*")).alias("p"))
    ends = parts.select("doc_id", F.transform(F.split("p", rf"\s*{_DASH}\s*"), lambda x: x.cast("int")).alias("e"))
    lo, hi = F.element_at("e", 1), F.element_at("e", -1)
    return ends.where(lo <= hi).select("doc_id", F.explode(F.sequence(lo, hi)).alias("number"))


#: Fixed values: (Author, Year) and (Author Page), with the author and the year or page as groups.
AUTHOR_YEAR = r"\(\s*([A-Z][A-Za-z]+)(?:\s+et\s+al\.)?(?:\s*(?:and|&)\s*[A-Z][A-Za-z]+)?\s*,\s*(\d{4})\s*\)"
AUTHOR_PAGE = r"\(\s*([A-Z][A-Za-z]+)(?:\s*(?:et\s+al\.|and|&)\s*[A-Z][A-Za-z]+)?\s+(\d{1,3})\s*\)"


def author_markers(docs: DataFrame, page: bool = False) -> DataFrame:
    """(doc_id, author, year or page): (Author, Year), or (Author Page)."""
    p = AUTHOR_PAGE if page else AUTHOR_YEAR
    m = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("m"))
    return m.select("doc_id", F.regexp_extract("m", p, 1).alias("author"), F.regexp_extract("m", p, 2).alias("page" if page else "year"))


def parsed_reference(raw) -> dict[str, Column]:
    """What a reference's text says: title (in quotes, else its second sentence), authors, year, DOI and arXiv id."""
    text = T.strip(F.regexp_replace(T._c(raw), r"^\[\d+\]\s*", ""))
    found = lambda p: F.when(F.regexp_extract(text, p, 1) != "", F.regexp_extract(text, p, 1))
    quoted, whole = F.regexp_extract(text, QUOTED, 1), F.regexp_extract(text, QUOTED, 0)
    parts = F.split(text, "[.]")
    plain = (F.size(parts) >= 2) & (F.length(parts[0]) < 100)
    before = F.split_part(text, whole, F.lit(1))
    title = F.when(F.length(quoted) > 5, quoted).when(plain, F.get(parts, F.lit(1))).otherwise(text)
    authors = F.when(F.length(quoted) > 5, F.regexp_replace(before, r"[,;]\s*$", "")).when(plain, parts[0]).otherwise("")
    title = T.strip(F.regexp_replace(T.strip(title), r"[,;.]\s*$", ""))
    authors = T.strip(authors)
    return {"title": F.when(title == "", text).otherwise(title), "authors": F.when(authors == "", "Unknown Authors").otherwise(authors), "year": found(r"\b(19\d{2}|20\d{2})\b"), "doi": T.doi(text), "arxiv": found(ARXIV)}


def references(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, number, author, year, raw): entries of a numbered list, one to a line."""
    d = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "raw")).withColumn("raw", T.strip("raw"))
    d = d.where(F.col("raw").rlike(r"^\[\d+\]") | ((F.length("raw") >= 15) & ~F.col("raw").rlike(r"^\d+$")))
    pick = lambda p: F.when(F.regexp_extract("raw", p, 1) != "", F.regexp_extract("raw", p, 1))
    return d.select("doc_id", "idx", pick(r"^\[(\d+)\]").cast("int").alias("number"), pick(r"^(?:\[\d+\]\s*)?([A-Z][a-zA-Z]+)").alias("author"), pick(r"\b((?:19|20)\d{2})\b").alias("year"), "raw")


def surname(c: str) -> Column:
    """The key of a name in any case."""
    return F.lower(F.col(c))


def matched(markers: DataFrame, refs: DataFrame, key: str = "number") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Markers with their reference (the last of a key), markers without one, references that none cites. ``key``: number, or
    author for styles that cite surnames, which match in any case; of several entries of one surname only the last can
    be cited, the others count as not referenced."""
    of = surname if key == "author" else F.col
    drop = ["author"] if key == "author" else []
    # the last entry of a document's key: few rows to a key, and no window over a document
    own = refs.where(F.col(key).isNotNull()).withColumn("_key", of(key))
    last = own.groupBy("doc_id", "_key").agg(F.max("idx").alias("_idx")).join(own, ["doc_id", "_key"]).where(F.col("idx") == F.col("_idx")).drop("_idx")
    asked = markers.withColumn("_key", of(key))
    hit = asked.drop(*drop).join(last.drop(*([] if drop else [key])), ["doc_id", "_key"]).drop("_key")
    cited = asked.select("doc_id", "_key").distinct().join(last.select("doc_id", "_key", "idx"), ["doc_id", "_key"]).select("doc_id", "idx")
    left = refs if key == "author" else last.drop("_key")
    return hit, asked.join(last.select("doc_id", "_key"), ["doc_id", "_key"], "left_anti").drop("_key"), left.join(cited, ["doc_id", "idx"], "left_anti")


def metadata_status(reference: str, title: str, year: str, lookup: str | None = None) -> Column:
    """verified, partial_match or mismatch of a reference text and a resolved title and year. The words of a title are runs of
    letters, digits and underscores; a title without any is like nothing. ``lookup``: a column that says how the lookup went,
    of which not_found is doi_not_found and lookup_failed stays."""
    ref, low = F.lower(F.col(reference)), F.lower(F.coalesce(F.col(title), F.lit("")))
    words = F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}_]+)"), 1)
    share = F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.contains(F.lower(F.col(reference)), w))) / F.greatest(F.size(words), F.lit(1))).otherwise(0.0)
    told = F.coalesce(F.col(year), F.lit(""))
    dated = (told == "") | F.contains(F.col(reference), told)
    s = F.when((low != "") & F.contains(ref, low), F.lit(1.0)).otherwise(share) * F.when(dated, 1.0).otherwise(0.9)
    out = F.when((s >= 0.70) & dated, "verified").when(s >= 0.35, "partial_match").otherwise("mismatch")
    return out if lookup is None else F.when(F.col(lookup) == "not_found", "doi_not_found").when(F.col(lookup) == "lookup_failed", "lookup_failed").otherwise(out)


def title_overlap(a: str, b: str, least: int = 4) -> Column:
    """The share of the words of ``a`` of ``least`` letters or more that stand in ``b``."""
    w = lambda c: F.array_distinct(F.filter(T.words(F.lower(F.col(c))), lambda x: F.length(x) >= least))
    return F.round(F.size(F.array_intersect(w(a), w(b))) / F.greatest(F.size(w(a)), F.lit(1)), 4)


def resolve(refs: DataFrame, known: DataFrame) -> DataFrame:
    """``refs`` with the metadata of their DOI: distinct DOIs are looked up once, in the table ``known`` (doi, title, year and,
    if it tells how lookups went, lookup), and joined back. A DOI that is not in the table is doi_not_found."""
    d = refs.withColumn("doi", T.doi("raw"))
    told = known if "lookup" in known.columns else known.withColumn("lookup", F.lit("found"))
    looked = d.select("doi").where("doi is not null").distinct().join(told, "doi", "left").withColumn("lookup", F.coalesce("lookup", F.lit("not_found")))
    j = d.join(looked, "doi", "left")
    return j.withColumn("status", F.when(F.col("doi").isNull(), "no_doi_present").otherwise(metadata_status("raw", "title", "year", "lookup"))).drop("lookup")


def health(bad, checked) -> Column:
    """100 less the percentage of suspicious references, 100 if none was checked."""
    return F.when(checked == 0, F.lit(100)).otherwise(F.greatest(F.lit(0), F.lit(100) - F.floor(100 * bad / F.greatest(checked, F.lit(1))))).cast("long")


def encoded(c: Column) -> Column:
    """``c`` in the query of an address: letters, digits and - _ . ! ~ * ' ( ) stay, a space is %20."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def formatted(raw: str = "raw", title: str = "title", authors: str = "authors", year: str = "year", doi: str = "doi", arxiv: str = "arxiv", index: Column | int = 1) -> dict[str, Column]:
    """A parsed reference (see ``parsed_reference``) as BibTeX, RIS, APA and IEEE, and where to search for it. The key of a BibTeX entry is the
    first author's last name, the year (2024 without one) and ``index``; fields that are not known are left out."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    t, a, y, d, x = (text(c) for c in (title, authors, year, doi, arxiv))
    n = (F.lit(index) if isinstance(index, int) else index).cast("string")
    line = lambda before, c, after: F.when(c != "", F.concat(F.lit(before), c, F.lit(after))).otherwise("")
    first = F.lower(F.element_at(F.split(F.get(F.split(a, ","), F.lit(0)), " "), -1))
    key = F.concat(F.when(first == "", "ref").otherwise(first), F.when(y == "", "2024").otherwise(y), F.lit("_"), n)
    asked = encoded(F.when(F.length(t) > 10, t).otherwise(text(raw)))
    return {
        "bibtex": F.concat(F.lit("@article{"), key, F.lit(",\n  title = {"), t, F.lit("},\n"), line("  author = {", a, "},\n"), line("  year = {", y, "},\n"), line("  doi = {", d, "},\n"), line("  eprint = {", x, "},\n"), F.lit("}")),
        "ris": F.concat(F.lit("TY  - JOUR\nTI  - "), t, F.lit("\n"), line("AU  - ", a, "\n"), line("PY  - ", y, "\n"), line("DO  - ", d, "\n"), line("UR  - https://arxiv.org/abs/", x, "\n"), F.lit("ER  - \n")),
        "apa": F.concat(a, F.lit(" "), F.when(y == "", "(n.d.).").otherwise(F.concat(F.lit("("), y, F.lit(")."))), F.lit(" "), t, F.lit("."), line(" https://doi.org/", d, "")),
        "ieee": F.concat(F.lit("["), n, F.lit("] "), a, F.lit(', "'), t, F.lit('"'), line(", ", y, ""), F.when(d == "", ".").otherwise(F.concat(F.lit(", doi: "), d, F.lit(".")))),
        "url": F.concat(F.lit("https://scholar.google.com/scholar?q="), asked),
        "semantic_url": F.concat(F.lit("https://www.semanticscholar.org/search?q="), asked),
    }
