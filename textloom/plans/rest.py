"""Sources, sinks, perturbations, robustness reports and trained models."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import document as D
from ..operators import robustness as B
from ..operators import scoring as K
from ..session import shared_dir
from ..sources import files as A
from .evaluation import CONF, EVAL, RATES, frame
from .registry import SCORED, SENT, WC, query, read, scored


def _tmp(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


_STD = "SELECT text, (doc_id % 2)::INTEGER AS label, source, source AS topic_id FROM documents"


@query("A01_csv_scan", _STD)
def a01(spark, d):
    p = _tmp(spark, "csv")
    A.write_csv(read(spark, d, "documents").select(F.col("text").alias("essay"), (F.col("doc_id") % 2).alias("generated"), F.col("source").alias("prompt_name")), p)
    return A.read_corpus(spark, p)


@query("A02_jsonl_scan", "SELECT conv_id, text FROM conversations")
def a02(spark, d):
    p = _tmp(spark, "json")
    read(spark, d, "conversations").select("conv_id", "text").write.json(p)
    return A.read_jsonl(spark, p, "conv_id long, text string")


@query("A03_dataset_scan", "SELECT doc_id, lang FROM documents")
def a03(spark, d):
    return read(spark, d, "documents").select("doc_id", "lang")


@query("A04_two_parts_scan", "SELECT doc_id FROM documents UNION ALL SELECT item_id FROM benchmark")
def a04(spark, d):
    return read(spark, d, "documents").select("doc_id").unionByName(read(spark, d, "benchmark").select(F.col("item_id").alias("doc_id")))


_SPL = "CASE WHEN ('0x' || substr(md5(source || lang), 1, 8))::BIGINT % 100 < 80 THEN 'train' WHEN ('0x' || substr(md5(source || lang), 1, 8))::BIGINT % 100 < 90 THEN 'val' ELSE 'test' END"
for _n in ("A05_read_splits", "A06_write_splits"):
    @query(_n, f"SELECT doc_id, {_SPL} AS split FROM documents")
    def a05(spark, d):
        from ..operators.sampling import hash_split

        p = _tmp(spark, "splits")
        A.write_splits(read(spark, d, "documents").select("doc_id", hash_split(F.concat("source", "lang")).alias("split")), p)
        return A.read_splits(spark, p)


@query("A07_csv_sink", "SELECT source, count(*)::VARCHAR AS n FROM documents GROUP BY source")
def a07(spark, d):
    p = _tmp(spark, "metrics")
    read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).coalesce(1).write.csv(p, header=True)  # a small table of metrics
    return A.read_csv(spark, p)


@query("A08_json_sink", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def a08(spark, d):
    p = _tmp(spark, "metrics")
    read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).write.json(p)
    return A.read_jsonl(spark, p, "source string, n long")


_PAIR = "SELECT doc_id, doc_id % 101 AS o, (doc_id * 7) % 101 AS r, 'm' || (doc_id % 3) AS method FROM documents"


def _pairs(spark, d):
    x = read(spark, d, "documents").select("doc_id", (F.col("doc_id") % 101).cast("double").alias("original"), ((F.col("doc_id") * 7) % 101).cast("double").alias("rewritten"), F.concat(F.lit("m"), F.col("doc_id") % 3).alias("method"))
    return B.verdicts(x)


@query("A09_pairs_jsonl", "SELECT doc_id, (doc_id % 101)::DOUBLE AS original, ((doc_id * 7) % 101)::DOUBLE AS rewritten FROM documents")
def a09(spark, d):
    p = _tmp(spark, "pairs")
    _pairs(spark, d).select("doc_id", "original", "rewritten").write.json(p)
    return A.read_jsonl(spark, p, "doc_id long, original double, rewritten double")


@query("A10_mixed_folder", "SELECT text, 0 AS label FROM documents WHERE text IS NOT NULL")
def a10(spark, d):
    """The whole table, as Parquet and CSV by language."""
    p = _tmp(spark, "mixed")
    docs = read(spark, d, "documents").where("text is not null")
    docs.where("lang = 'en'").select("text").write.parquet(f"{p}/a")
    docs.where("lang <> 'en' or lang is null").select("text").write.csv(f"{p}/b", header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="", lineSep="\n")
    return A.read_folder(spark, p).select("text", "label")


@query("A11_whole_texts", r"SELECT text FROM benchmark WHERE len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) * 133 // 100 BETWEEN 20 AND 8000")
def a11(spark, d):
    p = _tmp(spark, "texts")
    read(spark, d, "benchmark").select(F.regexp_replace("text", "\n$", "").alias("text"), "item_id").write.partitionBy("item_id").option("lineSep", "\u0000").text(p)
    t = spark.read.option("recursiveFileLookup", "true").text(p, wholetext=True).select(F.rtrim(F.regexp_replace("value", "\\x00$", "")).alias("text"))
    return t.where(T.n_tokens("text").between(20, 8000))


@query("A12_sniff", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'doc' ELSE 'text' END AS kind FROM documents")
def a12(spark, d):
    k = F.col("doc_id") % 4
    head = F.when(k == 0, F.unhex(F.lit("255044462D312E37"))).when(k == 1, F.concat(F.unhex(F.lit("504B030414000600")), F.encode(F.lit("word/document.xml"), "UTF-8"))).when(k == 2, F.unhex(F.lit("D0CF11E0A1B11AE1"))).otherwise(F.encode(F.lit("plain"), "UTF-8"))
    return read(spark, d, "documents").select("doc_id", A.kind_of(head, F.lit("a.bin")).alias("kind"))


@query("A14_docx")
def a14(spark, d):
    """Documents of two paragraphs and a table, written and read as .docx content."""
    @F.pandas_udf("text string, pages int")
    def run(s: pd.Series) -> pd.DataFrame:
        import io
        import zipfile

        rows = []
        for x in s:
            f = io.BytesIO()
            with zipfile.ZipFile(f, "w") as z:
                z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Document {x}</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
            rows.append(A.docx_text(f.getvalue()))
        return pd.DataFrame(rows, columns=["text", "pages"])

    return read(spark, d, "documents").select("doc_id", run("doc_id").alias("x")).select("doc_id", "x.text", "x.pages")


@query("A16_column_discovery", _STD)
def a16(spark, d):
    x = read(spark, d, "documents").select(F.col("text").alias("input_text"), (F.col("doc_id") % 2).alias("class"), "source", F.col("source").alias("topic_id"))
    return A.discover(x)


@query("A17_ingest_skip_malformed", "SELECT doc_id FROM documents WHERE doc_id % 2 = 0")
def a17(spark, d):
    p = _tmp(spark, "lines")
    good = F.to_json(F.struct("doc_id"))
    read(spark, d, "documents").select(F.when(F.col("doc_id") % 2 == 0, good).otherwise("{broken").alias("value")).write.text(p)
    return A.read_jsonl(spark, p, "doc_id long").where("doc_id is not null")


@query("A20_resume", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def a20(spark, d):
    docs = read(spark, d, "documents").select("doc_id")
    return A.pending(docs, docs.where("doc_id % 3 = 0"), "doc_id")


# --- perturbations, over the documents' own texts ---

def _coin(salt: str, percent: int, key: str = "doc_id") -> str:
    return f"(('0x' || substr(md5('{salt}' || {key}), 1, 8))::BIGINT % 100) < {percent}"


def _sql_each(x: str, table: dict) -> str:
    for a, b in table.items():
        x = rf"regexp_replace({x}, '(?i)\b{a.replace(chr(39), chr(39) * 2)}\b', '{b.replace(chr(39), chr(39) * 2)}', 'g')"
    return x


def _attack(name: str, f, sql: str | None = None) -> None:
    query(name, sql)(lambda spark, d: read(spark, d, "documents").select("doc_id", f("text", "doc_id").alias("out")))


_SPLIT = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '')"


def _voice_sql() -> str:
    x = "x"
    for a, b in B.ACTIVE.items():
        x = f"regexp_replace({x}, '(?i){a}', '{b}', 'g')"
    return x


def _openings_sql() -> str:
    x = "x"
    for a, b in B.OPENINGS.items():
        x = rf"CASE WHEN {_coin('o:' + a + ':', 75, 'doc_id || chr(58) || i')} THEN regexp_replace({x}, '(?i)\b{a}\b', '{b}', 'g') ELSE {x} END"
        x = f"({x})"
    return x


_attack("R01_contractions", B.contractions, f"SELECT doc_id, CASE WHEN {_coin('contract:', 50)} THEN {_sql_each('text', B.CONTRACTIONS)} ELSE {_sql_each('text', B.CONTRACT)} END AS out FROM documents")
_attack("R02_punctuation", B.punctuation, rf"""WITH a AS (SELECT doc_id, replace(text, ';', CASE WHEN {_coin('semicolon:', 50)} THEN '.' ELSE ' —' END) AS t FROM documents),
b AS (SELECT doc_id, CASE WHEN {_coin('colon:', 40)} AND contains(t, ': ') THEN regexp_replace(t, ':\s+', ' — ', 'g') ELSE t END AS t FROM a)
SELECT doc_id, CASE WHEN {_coin('dash:', 50)} THEN replace(t, ' — ', ', ') ELSE t END AS out FROM b""")
_R03 = r"(?i)^(Although|Though|While|Because|Since|Even though)\s+([^,]+),\s+(.+)\n?$"
_attack("R03_clauses", B.clauses, rf"""WITH m AS (SELECT doc_id, text, regexp_matches(text, '{_R03}') AND {_coin('clause:', 70)} AS hit, lower(regexp_extract(text, '{_R03}', 1)) AS word, trim(regexp_extract(text, '{_R03}', 2)) AS sub, trim(regexp_extract(text, '{_R03}', 3)) AS main FROM documents),
p AS (SELECT *, CASE WHEN right(main, 1) IN ('.', '!', '?') THEN right(main, 1) ELSE '.' END AS mark, CASE WHEN right(main, 1) IN ('.', '!', '?') THEN trim(left(main, -1)) ELSE main END AS body FROM m)
SELECT doc_id, CASE WHEN hit THEN upper(left(body, 1)) || substr(body, 2) || ', ' || word || ' ' || sub || mark ELSE text END AS out FROM p""")
_R04 = r"^\s+(and|but|yet|so)\s+([A-Za-z0-9\s]{15,})([.!?])\n?$"
_attack("R04_splits", B.splits, rf"""WITH m AS (SELECT doc_id, text, regexp_extract(text, ',([^,]*)$', 1) AS after FROM documents),
k AS (SELECT *, regexp_extract(left(text, length(text) - length(after) - 1), '([A-Za-z0-9\s]*)$', 1) AS run FROM m),
p AS (SELECT *, contains(text, ',') AND length(run) >= 20 AND regexp_matches(after, '{_R04}') AND {_coin('split:', 60)} AS hit, trim(run) AS first, regexp_extract(after, '{_R04}', 1) AS word, trim(regexp_extract(after, '{_R04}', 2)) AS second, regexp_extract(after, '{_R04}', 3) AS mark FROM k)
SELECT doc_id, CASE WHEN NOT coalesce(hit, false) THEN text WHEN {_coin('join:', 50)} THEN first || '. ' || upper(left(second, 1)) || substr(second, 2) || mark ELSE first || '; ' || word || ' ' || second || mark END AS out FROM p""")
_attack("R05_vocabulary", B.plain_words)
_attack("R06_openings", B.openings, f"WITH s AS (SELECT doc_id, text, {_SPLIT} AS s FROM documents) SELECT doc_id, CASE WHEN len(s) = 0 THEN text ELSE array_to_string(list_transform(s, lambda x, i: {_openings_sql()}), ' ') END AS out FROM s")
_attack("R07_active_voice", lambda c, key: B.active_voice(c, "resume"), f"WITH s AS (SELECT doc_id, text, {_SPLIT} AS s FROM documents) SELECT doc_id, CASE WHEN len(s) = 0 THEN text ELSE array_to_string(list_transform(s, lambda x: regexp_replace({_voice_sql()}, '\\s+', ' ', 'g')), ' ') END AS out FROM s")
_attack("R08_combined", lambda c, key: B.combined(c, key, "resume"))
_attack("R09_rule_based", B.rule_based)


@query("R11_attack_rows")
def r11(spark, d):
    return B.attacks(read(spark, d, "documents"))


@query("F05_held_out_family")
def f05(spark, d):
    return B.attacks(read(spark, d, "documents"), families=B.HELD_OUT).select("doc_id", "attack_family", "attacked_text")


_TEX = "('item one & two' || chr(10) || 'begin{x} ' || doc_id || '%')"
query("T34_repair_tex", r"SELECT doc_id, '\item one \& two' || chr(10) || '\begin{x} ' || doc_id || '\%' AS value FROM documents")(lambda spark, d: read(spark, d, "documents").selectExpr("doc_id", f"{_TEX.replace('chr(10)', 'char(10)')} AS t").select("doc_id", T.repair_tex("t").alias("value")))


@query("E26_latency_summary", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS least, max(value) AS most, round(1000.0::DOUBLE / avg(value), 6) AS per_second FROM events GROUP BY event_type")
def e26(spark, d):
    e = read(spark, d, "events").groupBy("event_type")
    return e.agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(1000.0 / F.avg("value"), 6).alias("per_second"))


@query("D12_rank_auc", f"WITH {EVAL}, r AS (SELECT lang, label, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0::DOUBLE AS k FROM l), s AS (SELECT lang, sum(k) FILTER (WHERE label = 1) AS s, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label <> 1) AS n FROM r GROUP BY 1) SELECT lang, round((s - p * (p + 1) / 2.0::DOUBLE) / nullif(p * n, 0), 9) AS auc FROM s")
def d12(spark, d):
    from ..operators.metrics import auc

    return auc(frame(spark, d), ["lang"])


query("R12_pair_ids", "SELECT doc_id, md5(doc_id || ':m' || (doc_id % 3)) AS pair_id FROM documents")(lambda spark, d: read(spark, d, "documents").select("doc_id", F.md5(F.concat("doc_id", F.lit(":m"), F.col("doc_id") % 3)).alias("pair_id")))

_P = f"WITH p AS (SELECT doc_id, o::DOUBLE AS original, r::DOUBLE AS rewritten, method, greatest(0.0::DOUBLE, o - r)::DOUBLE AS score_drop, o >= 60 AND r < 60 AS evaded FROM ({_PAIR})) "


@query("E23_pair_verdict", _P + "SELECT doc_id, score_drop, evaded FROM p")
def e23(spark, d):
    return _pairs(spark, d).select("doc_id", "score_drop", "evaded")


@query("J14_pair_scores", _P + "SELECT doc_id, original, rewritten FROM p")
def j14(spark, d):
    p = _pairs(spark, d)
    return p.select("doc_id", "original").join(p.select("doc_id", "rewritten"), "doc_id")


_REPORT = _P + """, g AS (SELECT coalesce(method, 'all') AS method, count(*) AS n, round(100 * avg((original >= 60)::INTEGER) + 1e-9, 2) AS acc_original, round(100 * avg((rewritten >= 60)::INTEGER) + 1e-9, 2) AS acc_rewritten, round(100 * avg(evaded::INTEGER) + 1e-9, 2) AS flip_rate, round(avg(score_drop) + 1e-9, 2) AS mean_drop FROM p GROUP BY ROLLUP (method)),
h AS (SELECT *, round(acc_original - acc_rewritten + 1e-9, 2) AS accuracy_drop FROM g), k AS (SELECT *, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1 - accuracy_drop / 100)), 4) AS ari FROM h) """
_SIG = "CASE WHEN ari >= 0.85 THEN 'robust' WHEN ari >= 0.65 THEN 'moderate' WHEN ari >= 0.40 THEN 'weak' ELSE 'fragile' END AS signal"


def _report(spark, d):
    return B.report(_pairs(spark, d), ["method"]).withColumn("method", F.coalesce("method", F.lit("all")))


@query("B23_robustness_report", _REPORT + f"SELECT *, {_SIG} FROM k WHERE method = 'all'")
def b23(spark, d):
    return _report(spark, d).where("method = 'all'")


@query("B24_method_breakdown", _REPORT + f"SELECT *, {_SIG} FROM k WHERE method <> 'all'")
def b24(spark, d):
    return _report(spark, d).where("method <> 'all'")


@query("B25_fooling_patterns", """WITH p AS (SELECT text AS a, replace(text, '. ', CASE doc_id % 3 WHEN 0 THEN ', as empirical evidence suggests. ' WHEN 1 THEN '. Indeed. ' ELSE '. ' END) AS b, doc_id % 101 >= 60 AND (doc_id * 7) % 101 < 60 AS evaded, greatest(0, doc_id % 101 - (doc_id * 7) % 101) AS d FROM (SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN 'Delve ' ELSE '' END || text AS text FROM documents)),
q AS (SELECT a, CASE WHEN starts_with(a, 'Delve ') THEN substr(b, 7) ELSE b END AS b, evaded, d FROM p)
SELECT count(*) FILTER (WHERE evaded AND contains(lower(b), 'as empirical evidence suggests')) AS clause_flips, count(*) FILTER (WHERE evaded AND contains(b, 'Indeed.')) AS split_flips, count(*) FILTER (WHERE evaded AND contains(lower(a), 'delve') AND NOT contains(lower(b), 'delve')) AS vocabulary_flips, round(avg(d), 1) AS mean_drop FROM q""")
def b25(spark, d):
    """Pairs made of the documents' texts: some rewritten with a clause or a sentence more, some with a word less."""
    k = F.col("doc_id") % 3
    t = _pairs(spark, d).join(read(spark, d, "documents").select("doc_id", "text"), "doc_id")
    t = t.select("doc_id", "evaded", "score_drop", F.concat(F.when(k == 2, "Delve ").otherwise(""), "text").alias("original_text"),
                 F.replace(F.col("text"), F.lit(". "), F.when(k == 0, ", as empirical evidence suggests. ").when(k == 1, ". Indeed. ").otherwise(". ")).alias("rewritten_text"))
    return t.agg(*B.fooling_patterns())


@query("B20_family_metrics", _P + "SELECT method, count(*) AS n, round(avg((rewritten >= 60)::INTEGER), 9) AS recall, round(avg((rewritten < 60)::INTEGER), 9) AS evasion, round(avg(rewritten), 9) AS mean FROM p GROUP BY method")
def b20(spark, d):
    hit = (F.col("rewritten") >= 60).cast("int")
    return _pairs(spark, d).groupBy("method").agg(F.count("*").alias("n"), F.round(F.avg(hit), 9).alias("recall"), F.round(F.avg(1 - hit), 9).alias("evasion"), F.round(F.avg("rewritten"), 9).alias("mean"))


@query("E25_resilience_verdict", _P + "SELECT doc_id, CASE WHEN rewritten <= 15 THEN 'verified' WHEN original - rewritten >= 30 THEN 'substantial' ELSE 'moderate' END AS verdict FROM p")
def e25(spark, d):
    return _pairs(spark, d).select("doc_id", F.when(F.col("rewritten") <= 15, "verified").when(F.col("original") - F.col("rewritten") >= 30, "substantial").otherwise("moderate").alias("verdict"))


@query("B30_averages", _P + "SELECT method, round(avg(original), 9) AS initial, round(avg(rewritten), 9) AS final, count(*) AS n FROM p GROUP BY method")
def b30(spark, d):
    return _pairs(spark, d).groupBy("method").agg(F.round(F.avg("original"), 9).alias("initial"), F.round(F.avg("rewritten"), 9).alias("final"), F.count("*").alias("n"))


# --- stored and trained models ---

#: A stored model's parameters, for the query that scores with one.
MODEL = {
    "feature_names": list(K.FUSION_FEATURES), "coefficients": [1.2, 0.8, 0.15, -0.2, 0.1, 0.1, 0.2, 0.2, 0.5, 0.7, -0.3, 0.4, 0.6], "intercept": -0.5,
    "scaler_mean": [0.5, 0.5, 12.0, 2.4] + [0.5] * 6 + [0.33, 0.5, 0.66], "scaler_scale": [0.3, 0.3, 8.0, 0.6] + [0.3] * 6 + [0.2, 0.2, 0.2], "val_threshold": 0.5,
    "calibrator_x": [k / 100 for k in range(101)], "calibrator_y": [round((k / 100) ** 2, 4) for k in range(101)],
}
_FEAT = SCORED + """, o AS (SELECT *, ((('0x' || substr(md5('b' || doc_id || ':' || sent_idx), 1, 8))::BIGINT % 1000) / 1000.0::DOUBLE) AS other FROM scored),
n AS (SELECT doc_id, sent_idx, score AS prob_rob, other AS prob_mb, n_words::DOUBLE AS word_len, ln(1 + n_words::DOUBLE) AS log_len, coalesce(lag(score) OVER w, score) AS prev_prob_rob, coalesce(lead(score) OVER w, score) AS next_prob_rob,
coalesce(lag(other) OVER w, other) AS prev_prob_mb, coalesce(lead(other) OVER w, other) AS next_prob_mb, abs(score - other) AS diff_rob_mb, (score + other) / 2 AS mean_rob_mb, greatest(score, other) AS max_rob_mb FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY sent_idx)),
f AS (SELECT *, (prev_prob_rob + next_prob_rob) / 2 AS neighbor_mean_rob, (prev_prob_mb + next_prob_mb) / 2 AS neighbor_mean_mb FROM n)"""


def _features(spark, d):
    s = scored(spark, d).withColumn("other", T.bucket(F.concat(F.lit("b"), "doc_id", F.lit(":"), "sent_idx"), 1000) / F.lit(1000.0))
    return K.fusion_features(s)


@query("D16_fusion_features", "WITH " + _FEAT + " SELECT doc_id, sent_idx, " + ", ".join(f"round({n}, 9) AS {n}" for n in K.FUSION_FEATURES) + " FROM f")
def d16(spark, d):
    return _features(spark, d).select("doc_id", "sent_idx", *[F.round(n, 9).alias(n) for n in K.FUSION_FEATURES])


_Z = " + ".join([str(MODEL["intercept"]) + "::DOUBLE"] + [f"({c})::DOUBLE * ({n} - {m}::DOUBLE) / {s}::DOUBLE" for n, c, m, s in zip(MODEL["feature_names"], MODEL["coefficients"], MODEL["scaler_mean"], MODEL["scaler_scale"], strict=True)])


@query("D17_stored_model", "WITH " + _FEAT + f", z AS (SELECT doc_id, sent_idx, {_Z} AS z FROM f) SELECT doc_id, sent_idx, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-greatest(least(z, 25), -25))), 6) AS p FROM z")
def d17(spark, d):
    return _features(spark, d).select("doc_id", "sent_idx", F.round(K.logistic_score(MODEL), 6).alias("p"))


@query("D17_calibrated_model", "WITH " + _FEAT + f", z AS (SELECT doc_id, sent_idx, 1.0::DOUBLE / (1.0::DOUBLE + exp(-greatest(least({_Z}, 25), -25))) AS p FROM f), k AS (SELECT *, least(floor(p * 100), 99)::INTEGER AS k FROM z), g AS (SELECT {MODEL['calibrator_y']}::DOUBLE[] AS y) SELECT doc_id, sent_idx, round(y[k + 1] + (p * 100 - k) * (y[k + 2] - y[k + 1]), 6) AS p FROM k, g")
def d17c(spark, d):
    return _features(spark, d).select("doc_id", "sent_idx", F.round(K.logistic_score(MODEL, calibrated=True), 6).alias("p"))


@query("D01_pluggable_scorer", f"SELECT doc_id, (length(text) % 100) / 100.0::DOUBLE AS score FROM documents")
def d01(spark, d):
    return K.score_with(read(spark, d, "documents"), lambda texts: [len(t) % 100 / 100.0 for t in texts], "text").select("doc_id", "score")


def _vector(df, names):
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=names, outputCol="features").transform(df)


def _labelled_features(spark, d):
    """The 13 inputs of every sentence of a labelled document."""
    f = _features(spark, d).select("doc_id", "sent_idx", "source", *K.FUSION_FEATURES)
    return f.join(read(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


@query("D18_fusion_training")
def d18(spark, d):
    """Out-of-fold probabilities of a logistic model of the 13 inputs, five folds by topic of about one size."""
    from ..operators.training import out_of_fold

    return out_of_fold(_labelled_features(spark, d), list(K.FUSION_FEATURES), "source").select("doc_id", "sent_idx", F.round("p", 6).alias("p"))


@query("D18_fusion_model")
def d18m(spark, d):
    """The final model: weights and scaling of each input, threshold and a point of the calibration curve for every hundredth."""
    from ..operators.training import train_fusion

    m = train_fusion(_labelled_features(spark, d), list(K.FUSION_FEATURES), "source")
    rows = [("weight", n, float(c)) for n, c in zip(m["feature_names"], m["coefficients"], strict=True)] + [("mean", n, float(c)) for n, c in zip(m["feature_names"], m["scaler_mean"], strict=True)]
    rows += [("scale", n, float(c)) for n, c in zip(m["feature_names"], m["scaler_scale"], strict=True)] + [("intercept", "", m["intercept"]), ("threshold", "", m["val_threshold"])]
    rows += [("curve", f"{x:.2f}", float(y)) for x, y in zip(m["calibrator_x"], m["calibrator_y"], strict=True)]
    return spark.createDataFrame([(a, b, round(c, 6)) for a, b, c in rows], "part string, name string, value double")


#: A stored gate (weights of a score and of a pooled score, intercept), for the query that SQL can follow.
GATE = (2.0, 1.0, -1.5)
_POOLS = {"max": "greatest(p, score, x)", "mean": "(p + score + x) / 3.0::DOUBLE", "topk": "(p + score + x - least(p, score, x)) / 2.0::DOUBLE"}


def _pooled(spark, d):
    """(label, mb, max, mean, topk) of every sentence of a labelled document: one score, and three poolings of the other's neighbours."""
    s = scored(spark, d).withColumn("mb", T.bucket(F.concat(F.lit("b"), "doc_id", F.lit(":"), "sent_idx"), 1000) / F.lit(1000.0))
    p = D.pooled(s).withColumnsRenamed({"pool_max": "max", "pool_mean": "mean", "pool_top2": "topk"})
    return p.join(read(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id").select("label", "mb", *_POOLS)


def _gated(p, gates):
    return p.withColumns({f"g_{n}": T.sigmoid(F.lit(v1) * F.col("mb") + F.lit(v2) * F.col(n) + F.lit(b)) for n, (v1, v2, b) in gates.items()})


def _simplex_sql() -> str:
    """All weightings over rows of equal scores counted together: the best of each pooling."""
    v1, v2, b = (f"({x})::DOUBLE" for x in GATE)
    pools = " UNION ALL ".join(f"SELECT '{n}' AS triple, (quality = 1)::INTEGER AS label, mb, {e} AS pool FROM n JOIN labels l USING (doc_id)" for n, e in _POOLS.items())
    return f"""WITH {SCORED}, o AS (SELECT *, ((('0x' || substr(md5('b' || doc_id || ':' || sent_idx), 1, 8))::BIGINT % 1000) / 1000.0::DOUBLE) AS mb FROM scored),
n AS (SELECT *, coalesce(lag(score) OVER w, score) AS p, coalesce(lead(score) OVER w, score) AS x FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY sent_idx)), q AS ({pools}),
g AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-greatest(least({v1} * mb + {v2} * pool + {b}, 25), -25))) AS g FROM q),
w AS (SELECT i.range AS w1, j.range AS w2, 20 - i.range - j.range AS w3 FROM range(21) i, range(21) j WHERE i.range + j.range <= 20),
s AS (SELECT triple, w1, w2, w3, label, round(w1 / 20.0::DOUBLE * mb + w2 / 20.0::DOUBLE * pool + w3 / 20.0::DOUBLE * g, 9) AS s FROM g, w),
c AS (SELECT triple, w1, w2, w3, {CONF.format(t='0.5').replace('score', 's')} FROM s GROUP BY ALL), r AS (SELECT triple, w1, w2, w3, {RATES} FROM c)
SELECT triple, w1 / 20.0::DOUBLE AS w1, w2 / 20.0::DOUBLE AS w2, w3 / 20.0::DOUBLE AS w3, macro_f1 FROM r QUALIFY row_number() OVER (PARTITION BY triple ORDER BY macro_f1 DESC, w1, w2) = 1"""


@query("D09_simplex", _simplex_sql())
def d09s(spark, d):
    """The best of 231 weightings of a score, a pooled score and a stored gate over both, for three poolings in one pass."""
    from ..operators.training import best_simplex

    return best_simplex(_gated(_pooled(spark, d), dict.fromkeys(_POOLS, GATE)), {n: ("mb", n, f"g_{n}") for n in _POOLS})


@query("D09_gated_ensemble")
def d09g(spark, d):
    """The same with a gate that is learned for each pooling."""
    from ..operators.training import best_simplex, gate
    from ..tables import table

    p = table(_pooled(spark, d), "pooled")
    learned = {n: (*w, b) for n, (w, b) in ((n, gate(p, ["mb", n])) for n in _POOLS)}
    return best_simplex(_gated(p, learned), {n: ("mb", n, f"g_{n}") for n in _POOLS})


@query("D19_platt")
def d19(spark, d):
    from ..operators.training import platt

    return platt(frame(spark, d)).select("doc_id", F.round("calibrated", 6).alias("calibrated"))


@query("D20_isotonic")
def d20(spark, d):
    from ..operators.training import isotonic

    return isotonic(frame(spark, d)).select("doc_id", F.round("calibrated", 6).alias("calibrated"))


@query("E19_calibration_comparison")
def e19(spark, d):
    from ..operators.metrics import ece
    from ..operators.training import isotonic, platt

    f = frame(spark, d)
    one = lambda g, c: ece(g.select("label", F.col(c).alias("score"))).select(F.col("ece"))
    out = one(f, "score").withColumnRenamed("ece", "uncalibrated")
    for name, g in (("platt", platt(f)), ("isotonic", isotonic(f))):
        out = out.crossJoin(F.broadcast(one(g, "calibrated").withColumnRenamed("ece", name)))  # one row each
    return out.withColumn("reduction_percent", F.round(100 * (F.col("uncalibrated") - F.col("isotonic")) / F.expr("nullif(uncalibrated, 0)"), 6))


_STOPS = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


@query("G12_tfidf", rf"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({_STOPS}, w)) AS w FROM documents),
g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM t),
c AS (SELECT doc_id, term, count(*) AS n FROM g GROUP BY ALL), v AS (SELECT term, sum(n) AS n, count(*) AS df FROM c GROUP BY term ORDER BY n DESC, term LIMIT 50000),
w AS (SELECT doc_id, (1 + ln(c.n)) * (ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + df)) + 1) AS w FROM c JOIN v USING (term))
SELECT d.doc_id, count(w) AS n_terms, round(coalesce(sum(w) / sqrt(sum(w * w)), 0), 6) AS total, round(coalesce(max(w) / sqrt(sum(w * w)), 0), 6) AS most FROM documents d LEFT JOIN w USING (doc_id) GROUP BY d.doc_id""")
def g12(spark, d):
    """How many terms each text has, the sum of its weights and the largest."""
    from ..operators.training import tfidf

    v, _ = tfidf(read(spark, d, "documents").select("doc_id", "text"))
    total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    return v.select("doc_id", F.size("weights").cast("long").alias("n_terms"), F.round(total, 6).alias("total"), F.round(F.coalesce(F.array_max("weights"), F.lit(0.0)), 6).alias("most"))


@query("D21_tfidf_baseline")
def d21(spark, d):
    from ..operators.training import tfidf_baseline

    j = read(spark, d, "documents").select("doc_id", "text").join(read(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return tfidf_baseline(j).select("doc_id", F.round("p", 4).alias("p"))


@query("D01_batched_scorer", "SELECT doc_id, (length(text) % 100) / 100.0::DOUBLE AS score FROM documents")
def d01b(spark, d):
    """A scorer that each task loads once and that takes batches of texts of about one length."""
    return K.score_in_batches(read(spark, d, "documents").select("doc_id", "text"), lambda: lambda texts: [len(t) % 100 / 100.0 for t in texts], "text").select("doc_id", "score")


@query("ST2_result_cache", "WITH " + SENT + rf", k AS (SELECT DISTINCT sha256(text) AS content, text FROM documents) SELECT content, len(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))::BIGINT AS n_sentences, {WC.format('text')}::BIGINT AS n_words FROM k")
def st2(spark, d):
    """A stream of documents into a cache of results by content: each text is analysed once, however often it comes."""
    from ..streaming.documents import cache_stream

    return cache_stream(spark, f"{d}/documents.parquet", _tmp(spark, "cache")).select("content", "n_sentences", "n_words")


@query("ST1_stream_documents", "WITH " + SCORED + " SELECT doc_id, count(*) AS n_sentences, round(avg(score), 9) AS mean FROM scored GROUP BY doc_id")
def st1(spark, d):
    from ..streaming.documents import score_stream

    return score_stream(spark, f"{d}/documents.parquet", _tmp(spark, "stream"))
