"""Citation queries: no table has citations, so the texts are made from the documents' ids, alike on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import citations as C
from ..operators import segment as G
from .registry import query, read

#: A paper made of a document's id: markers in its body and a list of references.
_BODY = ["'Intro text [' || (doc_id % 4 + 1) || '] and [2]–[4], see [1, 3]. '", "'(Smith, ' || (2000 + doc_id % 20) || ') and ( Jones and Smith ' || (doc_id % 90 + 1) || ' ). (Smith and Jones, 2019) '",
         "'Body (Brown et al., 2011).' || chr(10) || 'References' || chr(10)", "'[1] Smith, Deep Models of Text. 2019. doi:10.1000/abc' || (doc_id % 5) || '.' || chr(10)", "'[8] Lee, K., “A Quoted Title of It,” arXiv:2101.0' || (1000 + doc_id % 9) || ', 2021.' || chr(10)",
         "'[2] Jones, Old Work on Things, 2005' || chr(10) || '[' || (doc_id % 7 + 3) || '] Brown, Third Entry 2011, https://doi.org/10.1000/xyz' || (doc_id % 3)"]
PAPER = " || ".join(_BODY)
SQLP = f"papers AS (SELECT doc_id, {PAPER} AS text FROM documents)"


def papers(spark, d):
    return read(spark, d, "documents").selectExpr("doc_id", f"{PAPER.replace('chr(10)', 'char(10)')} AS text")


@query("B26_citation_style", rf"""WITH {SQLP}, h AS (SELECT doc_id, text, regexp_matches(lower(text), '{C.TAIL}') AS has, regexp_extract(lower(text), '{C.TAIL}', 2) AS header, length(regexp_extract(lower(text), '{C.TAIL}', 1)) AS cut FROM papers),
p AS (SELECT doc_id, has, header, CASE WHEN has THEN substr(text, 1, cut) ELSE text END AS body, CASE WHEN has THEN substr(text, cut + 1) ELSE '' END AS tail FROM h),
n AS (SELECT doc_id, has, header, {", ".join(f"len(regexp_extract_all(body, '{p}')) AS {k}" for k, p in C.MARKS.items())},
len(list_filter(list_filter(list_transform(string_split(tail, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:8], lambda x: regexp_matches(x, '{C.NUMBERED}'))) >= 2 AS listed, len(regexp_extract_all(tail, '{C.IN_PARENS}')) >= len(regexp_extract_all(tail, '{C.NO_PARENS}')) AS parens FROM p),
s AS (SELECT doc_id, unnest([1, 2, 3, 4, 5]) AS i, unnest(['IEEE', 'APA', 'MLA', 'HARVARD', 'CHICAGO']) AS style, unnest([ieee, author_year, author_page, author_year, 0]) AS n,
unnest([CASE WHEN ieee > 1 AND listed THEN 0.95 WHEN ieee > 1 THEN 0.8 WHEN listed THEN 0.9 ELSE 0 END, CASE WHEN author_year <= 1 THEN 0 WHEN NOT has THEN 0.8 WHEN parens THEN 0.9 ELSE 0.7 END,
CASE WHEN author_page > 1 AND regexp_matches(header, '^works\s+cited$') THEN 0.95 WHEN author_page > 1 THEN 0.8 ELSE 0 END, CASE WHEN author_year <= 1 THEN 0 WHEN has AND NOT parens THEN 0.9 ELSE 0.7 END,
CASE WHEN header IN ('bibliography', 'notes') AND ieee <= 1 AND author_year <= 1 AND author_page <= 1 THEN 0.4 ELSE 0 END])::DOUBLE AS s FROM n),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, i) AS r FROM s)
SELECT doc_id, CASE WHEN s >= 0.5 THEN style ELSE 'UNKNOWN' END AS style, CASE WHEN s >= 0.5 THEN s ELSE 0.0::DOUBLE END AS confidence, CASE WHEN s >= 0.5 THEN n ELSE 0 END::BIGINT AS n_markers FROM b WHERE r = 1""")
def b26(spark, d):
    return C.style(papers(spark, d))


_MARK = r"""t AS (SELECT doc_id, regexp_replace(text, '\[(\d+)\]\s*[-–]\s*\[(\d+)\]', '[\1-\2]', 'g') AS text FROM papers), m AS (SELECT doc_id, unnest(regexp_extract_all(text, '\[(\d+(?:\s*[,\-–]\s*\d+)*)\]', 1)) AS m FROM t),
p AS (SELECT doc_id, unnest(regexp_split_to_array(m, '\s*,\s*')) AS p FROM m), e AS (SELECT doc_id, list_transform(regexp_split_to_array(p, '\s*[-–]\s*'), lambda x: x::INTEGER) AS e FROM p),
mk AS (SELECT doc_id, unnest(range(e[1], e[-1] + 1))::INTEGER AS number FROM e)"""
_REF = r"""ln AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM papers), rw AS (SELECT doc_id, regexp_replace(unnest(s), '^\s+|\s+$', '', 'g') AS raw, (generate_subscripts(s, 1) - 1)::INTEGER AS idx FROM ln),
rf AS (SELECT doc_id, idx, nullif(regexp_extract(raw, '^\[(\d+)\]', 1), '')::INTEGER AS number, nullif(regexp_extract(raw, '^(?:\[\d+\]\s*)?([A-Z][a-zA-Z]+)', 1), '') AS author, nullif(regexp_extract(raw, '\b((?:19|20)\d{2})\b', 1), '') AS year, raw FROM rw
WHERE regexp_matches(raw, '^\[\d+\]') OR (length(raw) >= 15 AND NOT regexp_matches(raw, '^\d+$'))),
la AS (SELECT * FROM rf WHERE number IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, number ORDER BY idx DESC) = 1)"""


@query("G06_ieee_markers", f"WITH {SQLP}, {_MARK} SELECT doc_id, number FROM mk")
def g06(spark, d):
    return C.numbered_markers(papers(spark, d))


@query("G07_apa_markers", f"WITH {SQLP}, m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{C.AUTHOR_YEAR}')) AS m FROM papers) SELECT doc_id, regexp_extract(m, '{C.AUTHOR_YEAR}', 1) AS author, regexp_extract(m, '{C.AUTHOR_YEAR}', 2) AS year FROM m")
def g07(spark, d):
    return C.author_markers(papers(spark, d))


@query("G08_mla_markers", f"WITH {SQLP}, m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{C.AUTHOR_PAGE}')) AS m FROM papers) SELECT doc_id, regexp_extract(m, '{C.AUTHOR_PAGE}', 1) AS author, regexp_extract(m, '{C.AUTHOR_PAGE}', 2) AS page FROM m")
def g08(spark, d):
    return C.author_markers(papers(spark, d), page=True)


@query("G05_reference_list", f"WITH {SQLP}, {_REF} SELECT doc_id, idx, number::VARCHAR AS number, author, year, raw FROM rf")
def g05(spark, d):
    return C.references(papers(spark, d)).withColumn("number", F.col("number").cast("string"))


def _three(spark, d):
    p = papers(spark, d)
    return C.matched(C.numbered_markers(p), C.references(p))


@query("J06_matched_markers", f"WITH {SQLP}, {_MARK}, {_REF} SELECT doc_id, number, author, year FROM mk JOIN la USING (doc_id, number)")
def j06(spark, d):
    return _three(spark, d)[0].select("doc_id", "number", "author", "year")


@query("J07_unmatched_markers", f"WITH {SQLP}, {_MARK}, {_REF} SELECT doc_id, number FROM mk WHERE (doc_id, number) NOT IN (SELECT (doc_id, number) FROM la)")
def j07(spark, d):
    return _three(spark, d)[1]


@query("J08_unreferenced", f"WITH {SQLP}, {_MARK}, {_REF} SELECT doc_id, number, author FROM la WHERE (doc_id, number) NOT IN (SELECT (doc_id, number) FROM mk)")
def j08(spark, d):
    return _three(spark, d)[2].select("doc_id", "number", "author")


# styles that cite surnames: the last entry of a surname, in any case, is the one that is cited
_SUR = rf"""sm AS (SELECT doc_id, regexp_extract(m, '{C.AUTHOR_YEAR}', 1) AS author, regexp_extract(m, '{C.AUTHOR_YEAR}', 2) AS year FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{C.AUTHOR_YEAR}')) AS m FROM papers)),
sl AS (SELECT *, lower(author) AS k FROM rf WHERE author IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, lower(author) ORDER BY idx DESC) = 1)"""


def _by_surname(spark, d):
    p = papers(spark, d)
    return C.matched(C.author_markers(p).withColumnRenamed("year", "cited_year"), C.references(p), "author")


@query("J06_matched_surnames", f"WITH {SQLP}, {_REF}, {_SUR} SELECT sm.doc_id, sm.year AS cited_year, sl.author, sl.idx FROM sm JOIN sl ON sl.doc_id = sm.doc_id AND sl.k = lower(sm.author)")
def j06s(spark, d):
    return _by_surname(spark, d)[0].select("doc_id", "cited_year", "author", "idx")


@query("J07_unmatched_surnames", f"WITH {SQLP}, {_REF}, {_SUR} SELECT doc_id, author, year AS cited_year FROM sm WHERE NOT EXISTS (SELECT 1 FROM sl WHERE sl.doc_id = sm.doc_id AND sl.k = lower(sm.author))")
def j07s(spark, d):
    return _by_surname(spark, d)[1].select("doc_id", "author", "cited_year")


@query("J08_unreferenced_surnames", f"WITH {SQLP}, {_REF}, {_SUR} SELECT doc_id, idx, author FROM rf WHERE (doc_id, idx) NOT IN (SELECT (sl.doc_id, sl.idx) FROM sl JOIN sm ON sl.doc_id = sm.doc_id AND sl.k = lower(sm.author))")
def j08s(spark, d):
    return _by_surname(spark, d)[2].select("doc_id", "idx", "author")


_DOI = r"nullif(regexp_replace(regexp_extract(raw, '\b(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)', 1), '[.,;)\]}]+$', ''), '')"
#: What a registry knows: a year that differs, a title with marks, an empty title, a lookup that failed; two DOIs are not in it.
_REGISTRY = [("10.1000/abc0", "Deep Models of Text", "2019", "found"), ("10.1000/abc1", "Deep Models of Text", "2018", "found"), ("10.1000/abc2", "Models: text; deep!", None, "found"), ("10.1000/abc3", "", "2019", "found"),
             ("10.1000/xyz0", "Something Else Entirely Here", "1999", "found"), ("10.1000/xyz1", None, None, "lookup_failed")]
_VALUES = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in r) + ")" for r in _REGISTRY)
_KNOWN = f"kn AS (SELECT * FROM (VALUES {_VALUES}) t(doi, title, year2, lookup))"
_STATUS = r"""wd AS (SELECT *, regexp_extract_all(lower(coalesce(title, '')), '[\p{L}\p{N}_]+') AS tw FROM j),
sh AS (SELECT *, CASE WHEN title <> '' AND contains(lower(raw), lower(title)) THEN 1.0::DOUBLE WHEN len(tw) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(tw, lambda w: contains(lower(raw), w)))::DOUBLE / len(tw) END AS base, coalesce(year2, '') = '' OR contains(raw, year2) AS dated FROM wd),
st AS (SELECT *, CASE WHEN doi IS NULL THEN 'no_doi_present' WHEN lookup IS NULL THEN 'doi_not_found' WHEN lookup = 'lookup_failed' THEN lookup WHEN base * CASE WHEN dated THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END >= 0.7 AND dated THEN 'verified' WHEN base * CASE WHEN dated THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END >= 0.35 THEN 'partial_match' ELSE 'mismatch' END AS status FROM sh)"""
_RESOLVED = f"WITH {SQLP}, {_REF}, {_KNOWN}, dd AS (SELECT *, {_DOI} AS doi FROM rf), j AS (SELECT dd.*, title, year2, lookup FROM dd LEFT JOIN kn USING (doi)), {_STATUS} "


@query("T23_doi", f"WITH {SQLP}, {_REF} SELECT doc_id, idx, {_DOI} AS doi FROM rf")
def t23(spark, d):
    return C.references(papers(spark, d)).select("doc_id", "idx", T.doi("raw").alias("doi"))


def _resolved(spark, d):
    known = spark.createDataFrame(_REGISTRY, "doi string, title string, year string, lookup string")
    return C.resolve(C.references(papers(spark, d)).drop("year"), known)


@query("J09_doi_lookup", _RESOLVED + "SELECT doc_id, idx, doi, title FROM st")
def j09(spark, d):
    return _resolved(spark, d).select("doc_id", "idx", "doi", "title")


@query("A18_metadata_lookup", _RESOLVED + "SELECT doc_id, idx, title, year2 AS year FROM st WHERE title IS NOT NULL")
def a18(spark, d):
    return _resolved(spark, d).where("title is not null").select("doc_id", "idx", "title", "year")


@query("T28_metadata_status", _RESOLVED + "SELECT doc_id, idx, status FROM st")
def t28(spark, d):
    return _resolved(spark, d).select("doc_id", "idx", "status")


@query("B27_citation_health", _RESOLVED + "SELECT doc_id, greatest(0, 100 - floor(100 * count(*) FILTER (WHERE status IN ('mismatch', 'doi_not_found')) / greatest(count(*) FILTER (WHERE doi IS NOT NULL), 1)::DOUBLE))::BIGINT AS health FROM st GROUP BY doc_id")
def b27(spark, d):
    r = _resolved(spark, d)
    return r.groupBy("doc_id").agg(C.health(F.count_if(F.col("status").isin("mismatch", "doi_not_found")), F.count("doi")).alias("health"))


_OV = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda w: length(w) >= {1}))"


@query("T29_title_overlap", _RESOLVED + f"SELECT doc_id, idx, round(len(list_intersect({_OV.format('title', 4)}, {_OV.format('raw', 4)})) / greatest(len({_OV.format('title', 4)}), 1)::DOUBLE, 4) AS overlap FROM st WHERE title IS NOT NULL")
def t29(spark, d):
    return _resolved(spark, d).where("title is not null").select("doc_id", "idx", C.title_overlap("title", "raw").alias("overlap"))


@query("T30_citation_check", _RESOLVED + f"SELECT doc_id, idx, CASE WHEN round(len(list_intersect({_OV.format('title', 1)}, {_OV.format('raw', 1)})) / greatest(len({_OV.format('title', 1)}), 1)::DOUBLE, 4) >= 0.5 THEN 'verified' ELSE 'hallucinated' END AS verdict FROM st WHERE title IS NOT NULL")
def t30(spark, d):
    return _resolved(spark, d).where("title is not null").select("doc_id", "idx", F.when(C.title_overlap("title", "raw", 1) >= 0.5, "verified").otherwise("hallucinated").alias("verdict"))


_PARSED = rf"""x AS (SELECT doc_id, idx, author, trim(regexp_replace(raw, '^\[\d+\]\s*', '')) AS t FROM rf),
q AS (SELECT *, regexp_extract(t, '{C.QUOTED}', 1) AS q, regexp_extract(t, '{C.QUOTED}', 0) AS whole, string_split(t, '.') AS parts FROM x),
k AS (SELECT *, length(q) > 5 AS quoted, len(parts) >= 2 AND length(parts[1]) < 100 AS plain FROM q),
r AS (SELECT *, trim(regexp_replace(trim(CASE WHEN quoted THEN q WHEN plain THEN parts[2] ELSE t END), '[,;.]\s*$', '')) AS ti, trim(CASE WHEN quoted THEN regexp_replace(split_part(t, whole, 1), '[,;]\s*$', '') WHEN plain THEN parts[1] ELSE '' END) AS au FROM k),
ps AS (SELECT doc_id, idx, coalesce(nullif(ti, ''), t) AS title, coalesce(nullif(au, ''), 'Unknown Authors') AS authors, nullif(regexp_extract(t, '\b(19\d{{2}}|20\d{{2}})\b', 1), '') AS year, {_DOI.replace('(raw,', '(t,')} AS doi, nullif(regexp_extract(t, '{C.ARXIV}', 1), '') AS arxiv FROM r)"""


def _parsed(spark, d):
    return C.references(papers(spark, d)).select("doc_id", "idx", *[c.alias(n) for n, c in C.parsed_reference("raw").items()])


@query("T24_reference_parse", f"WITH {SQLP}, {_REF}, {_PARSED} SELECT doc_id, idx, title, authors, year, doi, arxiv FROM ps")
def t24(spark, d):
    return _parsed(spark, d)


def _line(before: str, c: str, after: str) -> str:
    return f"CASE WHEN {c} <> '' THEN {before} || {c} || {after} ELSE '' END"


_N = "chr(10)"
_ASKED = "replace(replace(replace(replace(replace(url_encode(CASE WHEN length(t) > 10 THEN t ELSE raw END), '%21', '!'), '%2A', '*'), '%27', chr(39)), '%28', '('), '%29', ')')"


@query("T25_citation_formats", f"""WITH {SQLP}, {_REF}, {_PARSED}, x2 AS (SELECT ps.doc_id, ps.idx, authors AS a, coalesce(ps.year, '') AS y, title AS t, coalesce(doi, '') AS d, coalesce(arxiv, '') AS x, rf.raw, lower(string_split(string_split(authors, ',')[1], ' ')[-1]) AS first FROM ps JOIN rf ON rf.doc_id = ps.doc_id AND rf.idx = ps.idx)
SELECT doc_id, idx, '@article{{' || CASE WHEN first = '' THEN 'ref' ELSE first END || CASE WHEN y = '' THEN '2024' ELSE y END || '_' || (idx + 1) || ',' || {_N} || '  title = {{' || t || '}},' || {_N} || {_line("'  author = {'", 'a', "'},' || chr(10)")} || {_line("'  year = {'", 'y', "'},' || chr(10)")} || {_line("'  doi = {'", 'd', "'},' || chr(10)")} || {_line("'  eprint = {'", 'x', "'},' || chr(10)")} || '}}' AS bibtex,
'TY  - JOUR' || {_N} || 'TI  - ' || t || {_N} || {_line("'AU  - '", 'a', _N)} || {_line("'PY  - '", 'y', _N)} || {_line("'DO  - '", 'd', _N)} || {_line("'UR  - https://arxiv.org/abs/'", 'x', _N)} || 'ER  - ' || {_N} AS ris,
a || CASE WHEN y = '' THEN ' (n.d.). ' ELSE ' (' || y || '). ' END || t || '.' || {_line("' https://doi.org/'", 'd', "''")} AS apa,
'[' || (idx + 1) || '] ' || a || ', "' || t || '"' || {_line("', '", 'y', "''")} || CASE WHEN d = '' THEN '.' ELSE ', doi: ' || d || '.' END AS ieee,
'https://scholar.google.com/scholar?q=' || {_ASKED} AS url, 'https://www.semanticscholar.org/search?q=' || {_ASKED} AS semantic_url FROM x2""")
def t25(spark, d):
    r = C.references(papers(spark, d)).select("doc_id", "idx", "raw", *[c.alias(n) for n, c in C.parsed_reference("raw").items()])
    return r.select("doc_id", "idx", *[c.alias(n) for n, c in C.formatted(index=F.col("idx") + 1).items()])


@query("T19_headings", """WITH h AS (SELECT doc_id, doc_id % 6 AS k FROM documents)
SELECT doc_id, CASE k WHEN 0 THEN 'ABSTRACT' WHEN 1 THEN 'INTRO' WHEN 2 THEN 'RESULTS' WHEN 3 THEN 'GENERAL_SECTION' WHEN 4 THEN 'CONCLUSION' END AS category,
CASE k WHEN 0 THEN 'Abstract' WHEN 1 THEN '1. Introduction & Background' WHEN 2 THEN '4. Experimental Results & Evaluation' WHEN 3 THEN '3.2 Some own title' WHEN 4 THEN 'Conclusion' END AS title FROM h""")
def t19(spark, d):
    h = read(spark, d, "documents").selectExpr("doc_id", "CASE doc_id % 6 WHEN 0 THEN 'Abstract' WHEN 1 THEN '1. Introduction' WHEN 2 THEN 'IV. Results: all' WHEN 3 THEN '3.2 Some own title' WHEN 4 THEN 'Conclusion: all' ELSE 'plain line of text' END AS t")
    return h.select("doc_id", T.heading("t").alias("category"), T.heading_title("t").alias("title"))


_TAILED = r"(?is)^(.*)\b(references|bibliography|works cited)\b(.*)$"


@query("G02_bibliography_split", rf"""WITH {SQLP}, s AS (SELECT doc_id, regexp_matches(text, '{_TAILED}') AS f, regexp_extract(text, '{_TAILED}', 1) AS h, regexp_extract(text, '{_TAILED}', 3) AS t, text FROM papers),
b AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(CASE WHEN f THEN h ELSE text END, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM s),
r AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(CASE WHEN f THEN t ELSE '' END, '(\[\d+\])', chr(1) || '\1', 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM s)
SELECT doc_id, 'body' AS part, (generate_subscripts(p, 1) - 1)::INTEGER AS idx, unnest(p) AS piece FROM b UNION ALL SELECT doc_id, 'reference', (generate_subscripts(p, 1) - 1)::INTEGER, unnest(p) FROM r""")
def g02(spark, d):
    return G.bibliography_split(papers(spark, d))


@query("G09_paragraphs", rf"""WITH t AS (SELECT doc_id, regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '(\S)\s*(\b(?:{G.SECTIONS})\b[\s—\-.:]+)', '\1' || chr(10) || chr(10) || '\2', 'gi') AS t FROM documents),
b AS (SELECT doc_id, string_split(t, chr(10) || chr(10)) AS s FROM t), c AS (SELECT doc_id, generate_subscripts(s, 1) AS b, unnest(s) AS block FROM b),
l AS (SELECT doc_id, b, list_filter(list_transform(string_split(block, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM c),
x AS (SELECT doc_id, b, generate_subscripts(s, 1) AS i, unnest(s) AS x FROM l),
o AS (SELECT *, (i = 1 OR regexp_matches(x, '(?i){G.OPENS}') OR regexp_matches(x, '{G.ENTRY}') OR (length(x) < 70 AND x NOT LIKE '%.'))::INTEGER AS o FROM x),
k AS (SELECT *, sum(o) OVER (PARTITION BY doc_id ORDER BY b, i) AS k FROM o)
SELECT doc_id, (k - 1)::INTEGER AS paragraph_idx, string_agg(x, ' ' ORDER BY b, i) AS paragraph FROM k GROUP BY doc_id, k""")
def g09(spark, d):
    return G.paragraphs(read(spark, d, "documents"))
