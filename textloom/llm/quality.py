"""Quality rules with thresholds that follow the data, native throughout.

Base rules reject texts of fewer than ten words and texts of which more than a fifth of the words stand in
repeated five-word windows. Of the texts that pass, four measures (integers) go into mergeable quantile
sketches, one per language and source: a sketch counts values by their six leading bits, so it is exact below
64 and within 1/32 above, two sketches merge by adding counts, and the result depends on no order. Sketches
of a language's sources merge into the language's, those into the corpus's. The fences of a measure are
q3 + 3 * (q3 - q1) and, for the length of words, q1 - 3 * (q3 - q1), both quartiles of the text's own language and
source if at least MIN_TEXTS texts are behind them, else of the language, else of all; nothing about their place or
width is fixed beforehand. Because a measure that is mostly 0 has its fence at 0 and one mark is no flaw, a text is
rejected if VOTES measures lie beyond their fences.

Null and blank texts have no words and fail the base rules. A null language or source is a group of its own.
Each row is judged by itself: repeated rows get the same verdict. Other columns pass through unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import join_small, table

MIN_WORDS, WINDOW, MIN_TEXTS, SUB_BITS, VOTES = 10, 5, 50, 6, 2
#: Of each measure: whether it has a lower fence, too. Repeated words are the base rules' matter.
MEASURES = {"word_len": True, "symbols": False, "dup_lines": False, "capitals": False}
_NONE = "\x00"


def features(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts of the base rules and the measures, all long."""
    text = F.coalesce("text", F.lit(""))
    ink = lambda c: F.translate(c, " \t\n\x0b\f\r", "")
    d = docs.withColumn("_words", F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    d = d.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    d = d.withColumn("n_words", F.size("_h").cast("long")).drop("_words")
    window = F.transform(F.sequence(F.lit(0), F.size("_h") - WINDOW), lambda i: F.xxhash64(*[F.get("_h", i + j) for j in range(WINDOW)]))
    d = d.withColumn("_win", F.when(F.col("n_words") >= WINDOW, window).otherwise(F.array().cast("array<long>"))).drop("_h")
    d = d.withColumn("_again", F.size(F.array_distinct("_win")) < F.size("_win"))
    # windows that occur again stand next to each other once sorted; their places, in order
    d = d.withColumn("_win", F.when(F.col("_again"), F.array_sort(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda i, j: F.get("_win", i)["h"] == F.get("_win", j)["h"]
    d = d.withColumn("_win", F.array_sort(F.transform(F.filter("_win", lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False))), lambda x: x["i"])))
    covered = F.aggregate("_win", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")), lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["at"])).alias("n"), i.alias("at")), lambda s: s["n"])
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_win", "_again")
    d = d.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: ink(x) != ""))
    d = d.withColumn("_n_lines", F.size("_lines")).withColumn("n_dup_lines", (F.col("_n_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    d = d.withColumn("_ink", ink(text)).withColumn("word_chars", F.length("_ink").cast("long"))
    d = d.withColumn("n_symbols", (F.col("word_chars") - F.length(F.translate("_ink", "#*$%&|<>", ""))).cast("long"))
    d = d.withColumn("_caps", F.col("word_chars") - F.length(F.regexp_replace("_ink", "\\p{Lu}+", ""))).drop("_ink")
    # the partition's number, always true here, keeps filters above from being copied down through all of this
    d = d.withColumn("base_failed", ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))) & (F.spark_partition_id() >= 0))
    per = lambda a, b, k=1000: F.when(F.expr(f"{b} > 0"), F.expr(f"{k}L * {a} div {b}")).otherwise(F.lit(0).cast("long"))
    return d.withColumns({"word_len": per("word_chars", "n_words", 100), "symbols": per("n_symbols", "word_chars"), "dup_lines": per("n_dup_lines", "_n_lines"), "capitals": per("_caps", "word_chars")}).drop("_n_lines", "_caps")


def sketches(feats: DataFrame) -> DataFrame:
    """(lang, source, measure, value, n): the sketches of each language and source, of each language (source
    null) and of all (both null); a missing language or source is the character NUL."""
    long = feats.where("not base_failed").select(
        F.coalesce("lang", F.lit(_NONE)).alias("lang"), F.coalesce("source", F.lit(_NONE)).alias("source"),
        F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("x")) for m in MEASURES))).alias("m"))
    shift = F.greatest(F.length(F.bin("m.x")) - SUB_BITS, F.lit(0))
    long = long.withColumn("s", shift).select("lang", "source", "m.measure", F.expr("shiftleft(shiftright(m.x, s), s)").alias("value"))
    own = long.groupBy("lang", "source", "measure", "value").agg(F.count("*").alias("n"))
    return own.groupingSets([["lang", "source", "measure", "value"], ["lang", "measure", "value"], ["measure", "value"]], "lang", "source", "measure", "value").agg(F.sum("n").alias("n"))


def quantiles(sk: DataFrame) -> DataFrame:
    """(lang, source, measure, n, q1, q3) of every sketch: the least values that a quarter and three quarters
    of the counts do not exceed."""
    from pyspark.sql import Window

    by = Window.partitionBy("lang", "source", "measure")
    c = sk.withColumn("upto", F.sum("n").over(by.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(by))
    at = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("value")))
    return c.groupBy("lang", "source", "measure").agg(F.max("total").alias("n"), at(1).alias("q1"), at(3).alias("q3"))


def fences(feats: DataFrame) -> DataFrame:
    """(lang, source, hi_<measure>..., lo_word_len): the fences that hold for each language and source."""
    q = table(quantiles(sketches(feats)), "quantiles")
    wide = lambda w: w.groupBy("lang", "source").agg(F.max("n").alias("n"), *[x for m, low in MEASURES.items() for x in _fence(m, low)])
    own = wide(q.where("source is not null"))
    lang = wide(q.where("source is null and lang is not null")).drop("source")
    every = wide(q.where("lang is null")).drop("source", "lang")
    names = [c for c in own.columns if c[:3] in ("hi_", "lo_")]
    ren = lambda d, p: d.select(*[F.col(c).alias(c if c == "lang" else f"{p}{c}") for c in d.columns])
    all3 = own.join(ren(lang, "l_"), "lang", "left").crossJoin(F.broadcast(ren(every, "e_")))  # the right side is one row
    return all3.select("lang", "source", *[F.when(F.col("n") >= MIN_TEXTS, F.col(c)).when(F.col("l_n") >= MIN_TEXTS, F.col(f"l_{c}")).otherwise(F.col(f"e_{c}")).alias(c) for c in names])


def _fence(m: str, low: bool) -> list[Column]:
    q = lambda k: F.max(F.when(F.col("measure") == m, F.col(k)))
    reach = 3 * (q("q3") - q("q1"))
    return [(q("q3") + reach).alias(f"hi_{m}"), *([(q("q1") - reach).alias(f"lo_{m}")] if low else [])]


def judged(feats: DataFrame, fence: DataFrame) -> DataFrame:
    """``feats`` with ``kept``."""
    d = feats.withColumns({"_l": F.coalesce("lang", F.lit(_NONE)), "_s": F.coalesce("source", F.lit(_NONE))})
    d = join_small(d, fence.withColumnsRenamed({"lang": "_l", "source": "_s"}), ["_l", "_s"], "left")
    # no vote where a language and source has no fence: none of its texts passed the base rules
    beyond = [(F.col(m) > F.col(f"hi_{m}")) | (F.col(m) < F.col(f"lo_{m}") if low else F.lit(False)) for m, low in MEASURES.items()]
    votes = sum((F.when(v, 1).otherwise(0) for v in beyond), F.lit(0))
    return d.withColumn("kept", ~F.col("base_failed") & (votes < VOTES))


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def op3(spark, sf_dir: str) -> DataFrame:
    """The counts and the verdict for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    feats = table(features(docs).drop("text"), "features")
    return judged(feats, fences(feats)).select("doc_id", *_COUNTS, "kept")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. The measures are taken once and written beside the rows they are of."""
    d = docs.withColumn("_row", F.struct(*docs.columns)).select("text", "lang", "source", "_row")
    feats = table(features(d).drop("text"), "measured")
    return judged(feats, fences(feats)).where("kept").select("_row.*")


_Q = "','".join(MEASURES)
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS ls,
      regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g') AS ink FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
c AS (SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(ink)::BIGINT AS word_chars,
      (length(ink) - length(regexp_replace(ink, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
      (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls) AS nl,
      length(ink) - length(regexp_replace(ink, '\p{{Lu}}', '', 'g')) AS caps FROM w LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
      CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END AS word_len,
      CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END AS symbols,
      CASE WHEN nl > 0 THEN 1000 * n_dup_lines // nl ELSE 0 END AS dup_lines,
      CASE WHEN word_chars > 0 THEN 1000 * caps // word_chars ELSE 0 END AS capitals FROM c),
x AS (SELECT lang, source, unnest(['{_Q}']) AS measure, unnest([word_len, symbols, dup_lines, capitals])::BIGINT AS v FROM f WHERE NOT base_failed),
b AS (SELECT lang, source, measure, (v >> s) << s AS value FROM (SELECT *, greatest(length(bin(v)) - 6, 0) AS s FROM x)),
k AS (SELECT lang, source, measure, value, count(*) AS n, 2 AS lev FROM b GROUP BY ALL
      UNION ALL SELECT lang, NULL, measure, value, count(*), 1 FROM b GROUP BY ALL
      UNION ALL SELECT NULL, NULL, measure, value, count(*), 0 FROM b GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY lev, lang, source, measure ORDER BY value) AS upto, sum(n) OVER (PARTITION BY lev, lang, source, measure) AS total FROM k),
q AS (SELECT lev, lang, source, measure, max(total) AS n, min(CASE WHEN 4 * upto >= total THEN value END) AS q1, min(CASE WHEN 4 * upto >= 3 * total THEN value END) AS q3 FROM u GROUP BY ALL),
r AS (SELECT *, 3 * (q3 - q1) AS reach FROM q),
g AS (SELECT lev, lang, source, measure, n, q3 + reach AS hi, CASE WHEN measure = 'word_len' THEN q1 - reach END AS lo FROM r),
h AS (SELECT o.lang, o.source, o.measure, CASE WHEN o.n >= {MIN_TEXTS} THEN o.hi WHEN l.n >= {MIN_TEXTS} THEN l.hi ELSE e.hi END AS hi,
      CASE WHEN o.n >= {MIN_TEXTS} THEN o.lo WHEN l.n >= {MIN_TEXTS} THEN l.lo ELSE e.lo END AS lo
      FROM g o JOIN g l ON o.lang = l.lang AND o.measure = l.measure AND l.lev = 1 JOIN g e ON o.measure = e.measure AND e.lev = 0 WHERE o.lev = 2),
y AS (SELECT doc_id, lang, source, unnest(['{_Q}']) AS measure, unnest([word_len, symbols, dup_lines, capitals]) AS v FROM f),
bad AS (SELECT doc_id FROM y JOIN h USING (lang, source, measure) WHERE v > hi OR v < lo GROUP BY doc_id HAVING count(*) >= {VOTES})
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.doc_id IS NULL AS kept
FROM f LEFT JOIN bad USING (doc_id)
"""
QUERIES = {"op3_quality_rules": op3}
ORACLES = {"op3_quality_rules": SQL}
