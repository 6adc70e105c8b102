"""Corpus preparation: deduplication, sampling, splits and the joins between their frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedupe as U
from ..operators import sampling as S
from .evaluation import EVAL, frame
from .registry import SENT, query, read, sentences


@query("J01_exact_dedupe", "WITH " + SENT + " SELECT doc_id, sent_idx FROM (SELECT *, row_number() OVER (PARTITION BY sentence ORDER BY doc_id, sent_idx) AS n FROM sent) WHERE n = 1")
def j01(spark, d):
    return U.keep_first(sentences(spark, d), "sentence", ["doc_id", "sent_idx"]).select("doc_id", "sent_idx")


_PAIRS = r"""w AS (SELECT doc_id, regexp_extract_all(lower(text), '([A-Za-z0-9_]+)', 1) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) ELSE w END) AS x FROM w),
g AS (SELECT doc_id, count(*) AS n, md5(string_agg(x, chr(1) ORDER BY x)) AS h FROM s GROUP BY 1), classes AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY h, n) AS rep FROM g),
z AS (SELECT doc_id, n FROM classes WHERE doc_id = rep), i AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY ALL),
pairs AS (SELECT a, b, round(c / (u.n + v.n - c)::DOUBLE, 9) AS jaccard FROM i JOIN z u ON u.doc_id = a JOIN z v ON v.doc_id = b WHERE round(c / (u.n + v.n - c)::DOUBLE, 9) >= 0.8)"""


@query("J02_similar_pairs", f"WITH {_PAIRS} SELECT * FROM pairs")
def j02(spark, d):
    """Pairs of the first documents of classes of equal shingle sets."""
    return U.similar_pairs(read(spark, d, "documents"), 0.8)


@query("J02_similar_classes", f"WITH {_PAIRS} SELECT doc_id, rep FROM classes")
def j02c(spark, d):
    return U.shingle_classes(read(spark, d, "documents"))


# the greedy choice in SQL: what an earlier document that stays is like goes, decided in ascending order by a recursion over ranks
@query("J03_greedy_keep", f"""WITH RECURSIVE {_PAIRS}, r AS (SELECT rep, row_number() OVER (ORDER BY rep) AS k FROM (SELECT DISTINCT b AS rep FROM pairs)),
walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS gone UNION ALL SELECT w.k + 1, CASE WHEN EXISTS (SELECT 1 FROM pairs p WHERE p.b = r.rep AND NOT list_contains(w.gone, p.a)) THEN list_append(w.gone, r.rep) ELSE w.gone END FROM walk w JOIN r ON r.k = w.k + 1)
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM classes WHERE doc_id <> rep) AND doc_id NOT IN (SELECT unnest(gone) FROM (SELECT gone FROM walk ORDER BY k DESC LIMIT 1))""")
def j03(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    return U.greedy_keep(docs, U.similar_pairs(docs, 0.8), U.shingle_classes(docs)).select("doc_id")


@query("J16_contamination", r"""WITH f AS (SELECT doc_id AS k, regexp_extract_all(lower(text), '([A-Za-z0-9_]+)', 1) AS w FROM documents), g AS (SELECT item_id AS k, regexp_extract_all(lower(text), '([A-Za-z0-9_]+)', 1) AS w FROM benchmark),
a AS (SELECT DISTINCT k AS doc_id, unnest(CASE WHEN len(w) >= 8 THEN list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')) ELSE w END) AS x FROM f),
b AS (SELECT DISTINCT k AS item_id, unnest(CASE WHEN len(w) >= 8 THEN list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')) ELSE w END) AS x FROM g)
SELECT doc_id, item_id, count(*) AS shared FROM a JOIN b USING (x) GROUP BY ALL""")
def j16(spark, d):
    return U.contaminated(read(spark, d, "documents"), read(spark, d, "benchmark"))


_SPLIT = "CASE WHEN ('0x' || substr(md5(source || lang), 1, 8))::BIGINT % 100 < 80 THEN 'train' WHEN ('0x' || substr(md5(source || lang), 1, 8))::BIGINT % 100 < 90 THEN 'val' ELSE 'test' END"


@query("S01_balanced_sample", f"WITH {EVAL}, h AS (SELECT lang, min(n) AS n, count(*) AS k FROM (SELECT lang, label, count(*) AS n FROM l GROUP BY ALL) GROUP BY 1), r AS (SELECT l.*, CASE WHEN k < 2 THEN 0 ELSE least(n, 20) END AS take, row_number() OVER (PARTITION BY l.lang, label ORDER BY md5(doc_id || '42'), doc_id) AS r FROM l JOIN h USING (lang)) SELECT doc_id, lang, label FROM r WHERE r <= take")
def s01(spark, d):
    return S.balanced(frame(spark, d), 20, "lang", "label", "doc_id").select("doc_id", "lang", "label")


@query("S02_topic_split", """WITH RECURSIVE c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY md5(source || '42'), source) AS k, sum(n) OVER () AS t FROM c),
f AS (SELECT 0::BIGINT AS k, '' AS source, '' AS split, 0.8::DOUBLE * (SELECT max(t) FROM o) AS a, 0.1::DOUBLE * (SELECT max(t) FROM o) AS b, 0.1::DOUBLE * (SELECT max(t) FROM o) AS e
UNION ALL SELECT o.k, o.source, p, f.a - CASE WHEN p = 'train' THEN o.n ELSE 0 END, f.b - CASE WHEN p = 'val' THEN o.n ELSE 0 END, f.e - CASE WHEN p = 'test' THEN o.n ELSE 0 END
FROM f JOIN o ON o.k = f.k + 1, LATERAL (SELECT CASE WHEN round(f.a, 6) >= round(f.b, 6) AND round(f.a, 6) >= round(f.e, 6) THEN 'train' WHEN round(f.b, 6) >= round(f.e, 6) THEN 'val' ELSE 'test' END AS p))
SELECT doc_id, split FROM documents JOIN f USING (source)""")
def s02(spark, d):
    return S.topic_split(read(spark, d, "documents").select("doc_id", "source"), "source").select("doc_id", "split")


@query("S03_hash_split", f"SELECT doc_id, {_SPLIT} AS split FROM documents")
def s03(spark, d):
    return read(spark, d, "documents").select("doc_id", S.hash_split(F.concat("source", "lang")).alias("split"))


@query("S04_sample", "SELECT doc_id FROM documents ORDER BY md5(doc_id || '42'), doc_id LIMIT 200")
def s04(spark, d):
    return S.sample(read(spark, d, "documents").select("doc_id"), 200, "doc_id")


@query("S05_positional_split", "SELECT doc_id, CASE WHEN percent_rank() OVER (PARTITION BY source ORDER BY doc_id) < 0.85 THEN 'train' ELSE 'val' END AS split FROM documents")
def s05(spark, d):
    r = S.percent_rank(read(spark, d, "documents").select("doc_id", "source"), "source", "doc_id")
    return r.select("doc_id", F.when(F.col("percent_rank") < 0.85, "train").otherwise("val").alias("split"))


@query("S06_group_folds", """WITH RECURSIVE c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, source DESC) AS k FROM c),
f AS (SELECT 0::BIGINT AS k, '' AS source, -1 AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS have
UNION ALL SELECT o.k, o.source, p, list_transform(f.have, lambda x, i: CASE WHEN i = p + 1 THEN x + o.n ELSE x END) FROM f JOIN o ON o.k = f.k + 1, LATERAL (SELECT (list_position(f.have, list_min(f.have)) - 1)::INTEGER AS p))
SELECT doc_id, fold FROM documents JOIN f USING (source)""")
def s06(spark, d):
    return S.group_folds(read(spark, d, "documents"), "source").select("doc_id", "fold")


@query("S07_union", "SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'b' || item_id, text FROM benchmark")
def s07(spark, d):
    a = read(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    return a.unionByName(read(spark, d, "benchmark").select("text", F.concat(F.lit("b"), "item_id").alias("id")))


@query("S09_value_counts", "SELECT source, count(*) AS n, count(DISTINCT lang) AS n_langs FROM documents GROUP BY source")
def s09(spark, d):
    return read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("n_langs"))


@query("S10_length_sorted", "SELECT doc_id, n_chars FROM documents")
def s10(spark, d):
    return read(spark, d, "documents").select("doc_id", "n_chars").sortWithinPartitions("n_chars")


@query("S12_words_by_count", r"WITH t AS (SELECT lang, unnest(regexp_extract_all(lower(text), '([a-z]+)', 1)) AS word FROM documents), c AS (SELECT lang, word, count(*) AS n FROM t GROUP BY ALL) SELECT lang, word, n, (row_number() OVER (PARTITION BY lang ORDER BY n DESC, word))::INTEGER AS rank FROM c QUALIFY rank <= 20")
def s12(spark, d):
    c = read(spark, d, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where("rank <= 20")


@query("J04_split_membership", f"WITH t AS (SELECT DISTINCT source, lang, {_SPLIT} AS split FROM documents) SELECT doc_id FROM documents WHERE (source, lang) IN (SELECT (source, lang) FROM t WHERE split = 'train')")
def j04(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source", "lang")
    t = docs.select("source", "lang").distinct().where(S.hash_split(F.concat("source", "lang")) == "train")
    return docs.join(t, ["source", "lang"], "left_semi").select("doc_id")


@query("J05_leakage", f"SELECT source, count(DISTINCT split) AS n FROM (SELECT source, {_SPLIT} AS split FROM documents) GROUP BY 1 HAVING count(DISTINCT split) > 1")
def j05(spark, d):
    return S.leaks(s03(spark, d).join(read(spark, d, "documents").select("doc_id", "source"), "doc_id"), "source")


@query("G03_answers", "SELECT conv_id, text, (role = 'assistant')::INTEGER AS label FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> ''")
def g03(spark, d):
    """Both sides' texts that are not blank: a filter, as what an array holds stands in a row of its own here."""
    c = read(spark, d, "conversations").where(F.col("role").isin("user", "assistant") & (F.trim("text") != ""))
    return c.select("conv_id", "text", (F.col("role") == "assistant").cast("int").alias("label"))


@query("G04_unpivot", "SELECT doc_id, 0 AS label, text FROM documents UNION ALL SELECT doc_id, 1, text || ' (generated)' FROM documents")
def g04(spark, d):
    w = read(spark, d, "documents").select("doc_id", F.col("text").alias("real"), F.concat("text", F.lit(" (generated)")).alias("generated"))
    return w.selectExpr("doc_id", "stack(2, 0, real, 1, generated) as (label, text)")


@query("T_embedding_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(spark, d):
    """Every vector and that of the next id."""
    v = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    e = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda s, t: s + t)
    return e.select("vec_id", F.round(dot("x", "y") / F.sqrt(dot("x", "x") * dot("y", "y")), 6).alias("cosine"))
