"""Document analysis: sentences, smoothing, pooling, sections, percentages, stylometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import document as D
from ..tables import spread
from .registry import ORACLES, SCORED, SENT, SMOOTH, WC, query, read, scored, sentences


@query("G01_sentences", "WITH " + SENT + " SELECT doc_id, sent_idx, sentence FROM sent")
def g01(spark, d):
    return sentences(spark, d).select("doc_id", "sent_idx", "sentence")


@query("F02_length_filter", "WITH " + SENT + f" SELECT doc_id, sent_idx FROM sent WHERE length(sentence) >= 15 AND {WC.format('sentence')} >= 3")
def f02(spark, d):
    return sentences(spark, d).where((F.length("sentence") >= 15) & (T.n_words("sentence") >= 3)).select("doc_id", "sent_idx")


@query("D02_hash_score", "WITH " + SCORED + " SELECT doc_id, sent_idx, score FROM scored")
def d02(spark, d):
    return scored(spark, d).select("doc_id", "sent_idx", "score")


@query("D05_neighbour_scores", "WITH " + SCORED + " SELECT doc_id, sent_idx, coalesce(lag(score) OVER w, score) AS prev, coalesce(lead(score) OVER w, score) AS next FROM scored WINDOW w AS (PARTITION BY doc_id ORDER BY sent_idx)")
def d05(spark, d):
    return D.neighbours(scored(spark, d)).select("doc_id", "sent_idx", "prev", "next")


@query("D05_neighbour_turns", "SELECT conv_id, turn, coalesce(lag(text) OVER w, text) AS prev, coalesce(lead(text) OVER w, text) AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def d05b(spark, d):
    return D.neighbours(read(spark, d, "conversations"), "text", "conv_id", "turn").select("conv_id", "turn", "prev", "next")


@query("D06_weighted_smoothing", "WITH " + SMOOTH + " SELECT doc_id, sent_idx, round(smoothed, 9) AS smoothed, (smoothed >= 0.6)::INTEGER AS label FROM smooth")
def d06(spark, d):
    s = D.smoothed(scored(spark, d))
    return s.select("doc_id", "sent_idx", F.round("smoothed", 9).alias("smoothed"), (F.col("smoothed") >= 0.6).cast("int").alias("label"))


for _w in (1, 3, 5):
    @query(f"D07_moving_average_{_w}", "WITH " + SCORED + f" SELECT doc_id, sent_idx, round(avg(score) OVER (PARTITION BY doc_id ORDER BY sent_idx ROWS BETWEEN {_w // 2} PRECEDING AND {_w // 2} FOLLOWING), 9) AS average FROM scored")
    def d07(spark, d, w=_w):
        return D.moving_average(scored(spark, d), w).select("doc_id", "sent_idx", F.round("average", 9).alias("average"))


@query("D08_window_pooling", "WITH " + SCORED + """, n AS (SELECT *, coalesce(lag(score) OVER w, score) AS p, coalesce(lead(score) OVER w, score) AS x FROM scored WINDOW w AS (PARTITION BY doc_id ORDER BY sent_idx))
SELECT doc_id, sent_idx, greatest(p, score, x) AS pool_max, round((p + score + x) / 3.0::DOUBLE, 9) AS pool_mean, round((p + score + x - least(p, score, x)) / 2.0::DOUBLE, 9) AS pool_top2 FROM n""")
def d08(spark, d):
    return D.pooled(scored(spark, d)).select("doc_id", "sent_idx", "pool_max", F.round("pool_mean", 9).alias("pool_mean"), F.round("pool_top2", 9).alias("pool_top2"))


def heading_sql(c: str) -> str:
    """``T.heading`` in SQL."""
    trimmed = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    head = trimmed(f"substr({trimmed(c)}, 1, 80)")
    quoted = lambda x: x.replace("'", "''")
    cases = "".join(f" WHEN regexp_matches({head}, '(?i){quoted(p)}') THEN '{quoted(k)}'" for k, _, p in T.HEADINGS)
    return f"CASE{cases} WHEN regexp_matches({head}, '{quoted(T.OWN_HEADING)}') THEN 'GENERAL_SECTION' END"


#: A section starts at a sentence whose text is a heading of another category than the section's; the first sentence opens none.
_CUT = "WITH " + SCORED + f""", c AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx) > 1 THEN {heading_sql('sentence')} END AS cat FROM scored),
b AS (SELECT *, coalesce(last_value(cat IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY sent_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'HEADER') AS before FROM c),
s AS (SELECT *, 1 + sum(CASE WHEN cat IS NOT NULL AND cat <> before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY sent_idx)::BIGINT AS section_id,
coalesce(last_value(cat IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY sent_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'HEADER') AS section FROM b)"""


@query("D10_sections", _CUT + " SELECT doc_id, sent_idx, section_id, section FROM s")
def d10(spark, d):
    return D.sections(scored(spark, d), T.heading("sentence")).select("doc_id", "sent_idx", "section_id", "section")


_SEC = _CUT + ", p AS (SELECT doc_id, section_id, sum(n_words)::BIGINT AS words, count(*) AS sentences, round(100 * sum(n_words * score) / nullif(sum(n_words), 0) + 1e-9, 1) AS percent FROM s GROUP BY ALL) "


@query("B05_section_percent", _SEC + "SELECT *, CASE WHEN percent >= 65 THEN 'HIGH' WHEN percent >= 45 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM p")
def b05(spark, d):
    s = D.sections(scored(spark, d), T.heading("sentence"))
    p = s.groupBy("doc_id", "section_id").agg(F.sum("n_words").alias("words"), F.count("*").alias("sentences"), D.half_up(100 * F.sum(F.col("n_words") * F.col("score")) / F.expr("nullif(sum(n_words), 0)"), 1).alias("percent"))
    return p.withColumn("risk", T.risk("percent"))


@query("S11_best_section", _SEC + "SELECT doc_id, arg_max(section_id, percent * 100000 - section_id) AS highest, arg_min(section_id, percent * 100000 + section_id) AS lowest FROM p WHERE percent IS NOT NULL GROUP BY doc_id")
def s11(spark, d):
    return b05(spark, d).where("percent is not null").groupBy("doc_id").agg(F.max_by("section_id", F.struct("percent", -F.col("section_id"))).alias("highest"), F.min_by("section_id", F.struct("percent", "section_id")).alias("lowest"))


@query("D11_paragraph_index", """WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), q AS (SELECT doc_id, unnest(s) AS paragraph, generate_subscripts(s, 1) - 1 AS i FROM p)
SELECT doc_id, i::INTEGER AS position, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS paragraph_idx FROM q WHERE paragraph <> ''""")
def d11(spark, d):
    from pyspark.sql import Window

    p = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "paragraph")).where("paragraph <> ''")
    return p.select("doc_id", "position", (F.row_number().over(Window.partitionBy("doc_id").orderBy("position")) - 1).alias("paragraph_idx"))


@query("D13_blocks_of_ten", "WITH " + SCORED + """, b AS (SELECT *, ((row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx) - 1) // 10)::BIGINT AS block FROM scored)
SELECT doc_id, block, round(avg(score), 9) AS mean FROM b GROUP BY ALL HAVING count(*) = 10""")
def d13(spark, d):
    from pyspark.sql import Window

    b = scored(spark, d).withColumn("block", ((F.row_number().over(Window.partitionBy("doc_id").orderBy("sent_idx")) - 1) / 10).cast("long"))
    return b.groupBy("doc_id", "block").agg(F.round(F.avg("score"), 9).alias("mean"), F.count("*").alias("_n")).where("_n = 10").drop("_n")


@query("D15_first_lines", r"""SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1:8], '|') AS lines FROM documents""")
def d15(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_join(F.slice(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), 1, 8), "|").alias("lines"))


@query("B01_counts", "WITH " + SCORED + "SELECT doc_id, count(*) AS n_sentences, sum(n_words)::BIGINT AS n_words, sum(length(sentence))::BIGINT AS n_chars FROM scored GROUP BY doc_id")
def b01(spark, d):
    return scored(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum("n_words").alias("n_words"), F.sum(F.length("sentence")).alias("n_chars"))


@query("B02_burstiness", "WITH " + SCORED + "SELECT doc_id, count(*) AS n_sentences, round(CASE WHEN count(*) <= 1 THEN 10.0::DOUBLE ELSE stddev_pop(n_words) END, 6) AS std, count(*) >= 5 AND stddev_pop(n_words) < 4 AS low FROM scored GROUP BY doc_id")
def b02(spark, d):
    return D.burstiness(scored(spark, d)).drop("cv")


@query("B03_structural_burstiness", "WITH " + SCORED + "SELECT doc_id, round(coalesce(100 * stddev_pop(n_words) / nullif(avg(n_words), 0), 0), 2) AS cv FROM scored GROUP BY doc_id")
def b03(spark, d):
    return D.burstiness(scored(spark, d)).select("doc_id", "cv")


_TRIM = r"""regexp_replace(w, '^[.,!?;:"()\[\]{}]+|[.,!?;:"()\[\]{}]+$', '', 'g')"""


@query("B04_lexical_diversity", rf"""WITH w AS (SELECT doc_id, list_filter(list_transform(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> ''), lambda w: {_TRIM}), lambda w: w <> '') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS word, (generate_subscripts(ws, 1) - 1) // 100 AS seg FROM w), s AS (SELECT doc_id, seg, count(*) AS n, count(DISTINCT word) AS k FROM t GROUP BY ALL),
m AS (SELECT *, max(n) OVER (PARTITION BY doc_id) AS most FROM s) SELECT doc_id, round(avg(100.0::DOUBLE * k / n), 2) AS mattr FROM m WHERE n >= 50 OR most < 50 GROUP BY doc_id""")
def b04(spark, d):
    return D.lexical_diversity(read(spark, d, "documents"))


@query("B06_tier_counts", "WITH " + SMOOTH + "SELECT doc_id, count(*) FILTER (WHERE smoothed >= 0.75) AS high, count(*) FILTER (WHERE smoothed >= 0.6 AND smoothed < 0.75) AS medium, count(*) FILTER (WHERE smoothed < 0.6) AS low FROM smooth GROUP BY doc_id")
def b06(spark, d):
    s = D.smoothed(scored(spark, d)).withColumn("t", T.tier("smoothed"))
    return s.groupBy("doc_id").agg(*[F.count_if(F.col("t") == t).alias(t.lower()) for t in ("HIGH", "MEDIUM", "LOW")])


@query("B10_chunk_aggregate", "WITH " + SCORED + """, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sent_idx) AS k FROM scored)
SELECT doc_id, round(avg(score), 9) AS mean, max(score) AS max, round(avg(score) FILTER (WHERE k <= 3), 9) AS top3 FROM r GROUP BY doc_id""")
def b10(spark, d):
    three = F.slice(F.sort_array(F.collect_list("score"), False), 1, 3)
    s = scored(spark, d).groupBy("doc_id").agg(F.round(F.avg("score"), 9).alias("mean"), F.max("score").alias("max"), three.alias("t"))
    return s.select("doc_id", "mean", "max", F.round(F.aggregate("t", F.lit(0.0), lambda a, x: a + x) / F.size("t"), 9).alias("top3"))


@query("B11_combination", "WITH " + SCORED + "SELECT doc_id, round(0.5::DOUBLE * avg(score) + 0.5::DOUBLE * max(score), 9) AS combined FROM scored GROUP BY doc_id")
def b11(spark, d):
    return scored(spark, d).groupBy("doc_id").agg(F.round(0.5 * F.avg("score") + 0.5 * F.max("score"), 9).alias("combined"))


@query("B12_doc_percent", "WITH " + SMOOTH + """SELECT doc_id, round(least(100.0::DOUBLE, coalesce(100 * sum(CASE WHEN smoothed >= 0.75 THEN n_words * 1.0::DOUBLE WHEN smoothed >= 0.6 THEN n_words * greatest(smoothed, 0.85::DOUBLE)
WHEN smoothed >= 0.5 THEN n_words * 0.5::DOUBLE ELSE 0.0::DOUBLE END) / nullif(sum(n_words), 0), 0)) + 1e-9, 1) AS percent FROM smooth GROUP BY doc_id""")
def b12(spark, d):
    return D.smoothed(scored(spark, d)).groupBy("doc_id").agg(D.percent_flagged("smoothed").alias("percent"))


@query("T22_risk", f"SELECT doc_id, CASE WHEN percent >= 65 THEN 'HIGH' WHEN percent >= 45 THEN 'MEDIUM' ELSE 'LOW' END AS value FROM ({ORACLES['B12_doc_percent']})")
def t22(spark, d):
    return b12(spark, d).select("doc_id", T.risk("percent").alias("value"))


@query("T21_labels", f"""SELECT doc_id, CASE WHEN mattr >= 68 THEN 'HIGH' WHEN mattr >= 58 THEN 'MEDIUM' ELSE 'LOW' END AS diversity, CASE WHEN cv >= 45 THEN 'HIGH' WHEN cv >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS burstiness
FROM ({ORACLES['B04_lexical_diversity']}) JOIN ({ORACLES['B03_structural_burstiness']}) USING (doc_id)""")
def t21(spark, d):
    return b04(spark, d).join(b03(spark, d), "doc_id").select("doc_id", T.diversity_label("mattr").alias("diversity"), T.burstiness_label("cv").alias("burstiness"))


@query("B13_weighted_percent", "WITH " + SMOOTH + "SELECT doc_id, round(coalesce(100 * sum(CASE WHEN smoothed >= 0.6 THEN smoothed * n_words ELSE 0.0::DOUBLE END) / nullif(sum(n_words), 0), 0) + 1e-9, 1) AS percent FROM smooth GROUP BY doc_id")
def b13(spark, d):
    return D.smoothed(scored(spark, d)).groupBy("doc_id").agg(D.percent_weighted("smoothed").alias("percent"))


@query("B14_mean_percent", "WITH " + SMOOTH + "SELECT doc_id, round(100 * avg(greatest(least(smoothed, 1.0), 0.0)) + 1e-9, 2) AS percent FROM smooth GROUP BY doc_id")
def b14(spark, d):
    return D.smoothed(scored(spark, d)).groupBy("doc_id").agg(D.percent_mean("smoothed").alias("percent"))


@query("G10_token_windows", rf"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM documents),
c AS (SELECT doc_id, ws, unnest(range(0, greatest(len(ws), 1), 256)) AS start FROM w)
SELECT doc_id, start::INTEGER AS start, md5(array_to_string(ws[start + 1:start + 512], ' ')) AS chunk FROM c WHERE start = 0 OR len(ws) - start >= 32""")
def g10(spark, d):
    from ..operators.segment import token_windows

    return token_windows(read(spark, d, "documents"), 512, 256, 32).select("doc_id", "start", F.md5("chunk").alias("chunk"))


@query("G11_shingles", r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '([A-Za-z0-9_]+)', 1) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) ELSE w END AS s FROM w)
SELECT DISTINCT doc_id, unnest(s) AS shingle FROM s""")
def g11(spark, d):
    return read(spark, d, "documents").select("doc_id", F.explode(T.shingles("text")).alias("shingle"))


@query("G13_context_window", "WITH " + SENT + r", n AS (SELECT *, lag(sentence) OVER w AS p, lead(sentence) OVER w AS x FROM sent WINDOW w AS (PARTITION BY doc_id ORDER BY sent_idx)) SELECT doc_id, sent_idx, regexp_replace(concat_ws(' ', p, sentence, x), '^\s+|\s+$', '', 'g') AS context FROM n")
def g13(spark, d):
    from ..operators.segment import context

    return context(sentences(spark, d)).select("doc_id", "sent_idx", "context")


@query("G14_trim_paragraphs", r"""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), q AS (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) - 1 AS i FROM p),
k AS (SELECT *, len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')) * 133 // 100 AS n FROM q), c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM k)
SELECT doc_id, max(upto)::BIGINT AS n_tokens, string_agg(x, chr(10) ORDER BY i) AS text FROM c WHERE upto <= 800 GROUP BY doc_id HAVING max(upto) >= 100""")
def g14(spark, d):
    from ..operators.segment import trim_to_tokens

    return trim_to_tokens(read(spark, d, "documents"), 100, 800)


@query("F01_drop_blank", r"SELECT page_id FROM pages WHERE regexp_replace(coalesce(html, ''), '\s+', '', 'g') <> ''")
def f01(spark, d):
    return read(spark, d, "pages").where(T.strip(F.coalesce("html", F.lit(""))) != "").select("page_id")


@query("F03_min_chars", "SELECT doc_id FROM documents WHERE length(text) >= 30")
def f03(spark, d):
    return read(spark, d, "documents").where(F.length("text") >= 30).select("doc_id")


_NAME = "'doc' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX' WHEN 2 THEN '.doc' WHEN 3 THEN '.txt' ELSE '' END"


@query("F08_input_guards", f"SELECT doc_id, CASE WHEN lower(regexp_extract({_NAME}, '\\.([^.]*)$', 1)) NOT IN ('pdf', 'docx', 'doc') THEN 'unsupported' WHEN n_chars * 2000 > 26214400 THEN 'too_large' WHEN trim(coalesce(text, '')) = '' THEN 'empty' ELSE 'ok' END AS verdict FROM documents")
def f08(spark, d):
    """Documents as files: a name by id, and 2,000 bytes for a character, so that some are too large."""
    from ..sources.files import guarded

    return read(spark, d, "documents").select("doc_id", guarded(F.expr(_NAME), F.col("n_chars") * 2000, F.col("text")).alias("verdict"))


@query("D03_heuristic_fusion", "WITH " + SCORED + """, f AS (SELECT *, sent_idx % 5 = 0 AS trans, doc_id % 4 = 0 AS low, n_words < 2 AS meta, ((('0x' || substr(md5('b' || doc_id || ':' || sent_idx), 1, 8))::BIGINT % 1000) / 1000.0::DOUBLE) AS other FROM scored),
b AS (SELECT *, greatest(score, other) AS base FROM f)
SELECT doc_id, sent_idx, round(CASE WHEN meta THEN 0.02::DOUBLE WHEN trans THEN least(0.99::DOUBLE, greatest(base, 0.65::DOUBLE) + 0.15::DOUBLE) WHEN low AND base >= 0.35 THEN least(0.99::DOUBLE, base + 0.10::DOUBLE)
WHEN score >= 0.38 OR other >= 0.38 THEN base ELSE 0.5::DOUBLE * other + 0.5::DOUBLE * score END, 9) AS fused FROM b""")
def d03(spark, d):
    from ..operators.scoring import heuristic_fusion

    s = scored(spark, d).withColumns({"other": T.bucket(F.concat(F.lit("b"), "doc_id", F.lit(":"), "sent_idx"), 1000) / F.lit(1000.0), "trans": F.col("sent_idx") % 5 == 0, "low": F.col("doc_id") % 4 == 0, "meta": F.col("n_words") < 2})
    return s.select("doc_id", "sent_idx", F.round(heuristic_fusion("score", "other", "trans", "low", "meta"), 9).alias("fused"))


def _key(c: str) -> str:
    return f"lower(regexp_replace({c}, '" + T.ALIGN_DROPPED.replace("'", "''") + "', '', 'g'))"


@query("J11_sentence_boxes", "WITH " + SENT + f""", box AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
bk AS (SELECT *, {_key("t")} AS k FROM box), bx AS (SELECT *, sum(length(k)) OVER (PARTITION BY doc_id ORDER BY line) AS stop, sum(length(k)) OVER (PARTITION BY doc_id ORDER BY line) - length(k) AS start FROM bk),
ps AS (SELECT doc_id, sent_idx, sentence, list_filter(list_transform(regexp_split_to_array(sentence, '[\\n\\r]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS p FROM sent),
pt AS (SELECT doc_id, sent_idx, unnest(CASE WHEN len(p) > 0 THEN p ELSE [sentence] END) AS t, generate_subscripts(CASE WHEN len(p) > 0 THEN p ELSE [sentence] END, 1) - 1 AS part FROM ps),
pk AS (SELECT *, {_key("t")} AS k FROM pt), pn AS (SELECT *, sum(length(k)) OVER (PARTITION BY doc_id ORDER BY sent_idx, part) AS at FROM pk),
j AS (SELECT w.doc_id, w.sent_idx, b.line, length(b.t) AS wide FROM pn w JOIN bx b ON b.doc_id = w.doc_id AND b.start < w.at AND b.stop > w.at - length(w.k) WHERE length(w.k) >= 3)
SELECT doc_id, sent_idx, (line // 50)::INTEGER AS page, count(DISTINCT line) AS n_boxes, min(line % 50)::INTEGER * 12 AS y0, (max(line % 50)::INTEGER + 1) * 12 AS y1, (max(wide) * 6)::BIGINT AS x1 FROM j GROUP BY doc_id, sent_idx, page""")
def j11(spark, d):
    """Sentences of the documents over their lines, fifty to a page: the box around each sentence's lines on each page. As both
    are of one text, SQL knows the places from sums of lengths, without a search."""
    from ..operators.alignment import aligned

    docs = spread(read(spark, d, "documents").where("text is not null").select("doc_id", "text"))
    boxes = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("box_idx", "text"))
    sent = docs.select("doc_id", F.posexplode(T.sentences("text")).alias("sent_idx", "sentence"))
    j = aligned(sent, boxes).join(boxes.select("doc_id", "box_idx", F.length("text").alias("wide")), ["doc_id", "box_idx"])
    row = F.col("box_idx") % 50
    return j.groupBy("doc_id", "sent_idx", F.floor(F.col("box_idx") / 50).cast("int").alias("page")).agg(
        F.countDistinct("box_idx").alias("n_boxes"), (F.min(row) * 12).alias("y0"), ((F.max(row) + 1) * 12).alias("y1"), (F.max("wide") * 6).cast("long").alias("x1"))
