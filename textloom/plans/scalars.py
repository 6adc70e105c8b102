"""Scalar text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .registry import SENT, WC, query, read, scalar, sentences

_CTRL = r"regexp_replace({0}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]', '', 'g')"
_Q = "translate({0}, '" + "".join(T.QUOTES).replace("'", "''") + "', '" + "".join(T.QUOTES.values()).replace("'", "''") + "')"
_TAG = "regexp_replace({0}, '<[^>]+>', ' ', 'g')"


def _md(x: str) -> str:
    for p, r in ((r"(?m)^#{1,6}\s+", ""), (r"\*\*|__|\*|_", ""), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), ("(?s)```.*?```", ""), ("`([^`]+)`", r"\1")):
        x = f"regexp_replace({x}, '{p}', '{r}', 'g')"
    return x


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _space(x: str) -> str:
    x = f"replace({x}, chr(13) || chr(10), chr(10))"
    x = rf"regexp_replace({x}, '[ \t\x{{A0}}\x{{2000}}-\x{{200A}}]+', ' ', 'g')"
    return _strip(rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')")


_CLEAN = _space(_md(_TAG.format(_Q.format(_CTRL.format("coalesce({0}, '')")))))

scalar("T01_nfkc", lambda: T.nfkc("text"), None)
scalar("T02_strip_controls", lambda: T.strip_controls("text"), _CTRL.format("text"))
scalar("T03_strip_tags", lambda: T.strip_tags("html"), _TAG.format("html"), "pages", "page_id")
scalar("A21_html_source", lambda: T.tidy_space(T.strip_tags("html")), _space(_TAG.format("html")), "pages", "page_id")
scalar("T04_plain_quotes", lambda: T.plain_quotes("text"), _Q.format("text"))
scalar("T05_strip_markdown", lambda: T.strip_markdown("text"), _md("text"))
scalar("T06_tidy_space", lambda: T.tidy_space("text"), _space("text"))
scalar("T07_clean_text", lambda: T.clean("html"), _CLEAN.replace("{0}", "html").replace("{1,6}", "{1,6}"), "pages", "page_id")
scalar("T08_normalize_topic", lambda: T.topic("text"), r"CASE WHEN {x} = '' THEN 'unknown_topic' ELSE substr({x}, 1, 64) END".replace("{x}", r"regexp_replace(" + _strip(r"regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\s]', '', 'g')") + r", '\s+', '_', 'g')"))
_TEN = r"array_to_string(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')[1:10], ' ')"
scalar("T09_hash_topic", lambda: T.hash_topic("text"), f"CASE WHEN {_TEN} = '' THEN 'empty_text_hash' ELSE 'hash_' || substr(sha256({_TEN}), 1, 16) END")
scalar("T10_short_id", lambda: T.short_id("text"), "substr(md5(text), 1, 16)")
scalar("T11_word_count", lambda: T.n_words("text"), WC.format("text") + "::BIGINT")
scalar("T12_token_estimate", lambda: T.n_tokens("text"), f"({WC.format('text')} * 133 // 100)::BIGINT")
_SOURCES = (*T.ACADEMIC, *T.QUESTIONS, "persuade_corpus", "chat_gpt_moth", "mistral7b", "llama2_chat", "other")
_SRC = "[" + ", ".join(f"'{x}'" for x in _SOURCES) + f"][doc_id % {len(_SOURCES)} + 1]"
_src = lambda: F.element_at(F.array(*map(F.lit, _SOURCES)), (F.col("doc_id") % len(_SOURCES) + 1).cast("int"))
_IN = lambda x: "(" + ", ".join(f"'{y}'" for y in x) + ")"
scalar("T13_domain", lambda: T.domain(_src()), f"CASE WHEN {_SRC} IN {_IN(T.ACADEMIC)} THEN 'academic' WHEN {_SRC} IN {_IN(T.QUESTIONS)} THEN 'qa' ELSE 'essay' END")
scalar("T14_generator", lambda: T.generator(_src()), "CASE " + " ".join(f"WHEN contains(lower({_SRC}), '{k}') THEN '{v}'" for k, v in T.GENERATORS) + " ELSE 'Other_AI' END")
_CASES = lambda names: " ".join(f"WHEN contains(lower({_SRC}), '{k}') THEN '{v}'" for k, v in names)
scalar("T14_generator_left_out", lambda: T.generator_by_label(_src(), F.col("doc_id") % 3), f"CASE WHEN doc_id % 3 = 0 THEN 'human' {_CASES(T.GENERATORS_LEFT_OUT)} ELSE 'Other_AI' END")
scalar("T14_generator_retrained", lambda: T.generator(_src(), T.GENERATORS_RETRAINED, "other"), f"CASE {_CASES(T.GENERATORS_RETRAINED)} ELSE 'other' END")
scalar("T14_generators_recalled", lambda: F.array_join(T.generators_recalled(_src()), "|"), "concat_ws('|', " + ", ".join(f"CASE WHEN " + " OR ".join(f"contains(lower({_SRC}), '{k}')" for k, v in T.GENERATORS_RECALLED if v == n) + f" THEN '{n}' END" for n in dict.fromkeys(v for _, v in T.GENERATORS_RECALLED)) + ")")
scalar("T15_transition_flag", lambda: T.has_transition("text"), r"regexp_matches(lower(text), '\b(" + "|".join(T.TRANSITION_PHRASES) + r")\b')")
scalar("T17_marker_flag", lambda: T.has_marker("text"), "(" + " OR ".join(f"contains(lower(text), '{m}')" for m in T.MARKERS) + ")")
_ALIGN = T.ALIGN_DROPPED.replace("'", "''")
scalar("T26_align_key", lambda: T.align_key("text"), f"lower(regexp_replace(text, '{_ALIGN}', '', 'g'))")
scalar("T36_safe_name", lambda: T.safe_name("url"), "regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g')", "pages", "page_id")
scalar("T32_token_lock", lambda: T.locked("text")["text"], None)
scalar("T33_tex_lock", lambda: T.locked("text", T.TEX_LOCKS, nested=True)["text"], None)
scalar("T35_mask_math", lambda: T.locked("text", (r"\$\$[\s\S]*?\$\$", r"\\\[[\s\S]*?\\\]", r"\\\([\s\S]*?\\\)", r"\$[^$]+\$"))["text"], None)


@query("T16_metadata_flag", "WITH " + SENT + r""" SELECT doc_id, sent_idx, regexp_matches(lower(sentence), '""" + T.METADATA_LINE + r"""') AS value FROM sent""")
def metadata_flag(spark, d):
    return sentences(spark, d).select("doc_id", "sent_idx", T.is_metadata("sentence").alias("value"))


_SIGN = f"v AS (SELECT unnest({list(T.SIGNATURES)}) AS word, unnest({list(T.SIGNATURES.values())}) AS model), h AS (SELECT doc_id, word, model, len(regexp_extract_all(lower(text), '\\b' || word || '\\b')) AS n FROM documents, v)"


@query("T18_signature_counts", f"WITH {_SIGN} SELECT doc_id, word, model, n FROM h WHERE n > 0")
def signature_counts(spark, d):
    from ..operators.document import signature_counts as run

    return run(read(spark, d, "documents"), T.SIGNATURES)


@query("B29_signature_density", rf"""WITH {_SIGN}, c AS (SELECT doc_id, coalesce(sum(n) FILTER (WHERE model = 'Claude'), 0) AS cl, coalesce(sum(n) FILTER (WHERE model = 'GPT'), 0) AS g FROM h GROUP BY 1),
w AS (SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]+'))) AS k FROM documents),
x AS (SELECT doc_id, cl, g, CASE WHEN coalesce(k, 0) > 0 THEN (cl + g) / k::DOUBLE * 1000.0::DOUBLE ELSE 0.0::DOUBLE END AS per FROM w JOIN c USING (doc_id))
SELECT doc_id, round(per, 2) AS density, CASE WHEN per > 4.5 AND cl > g THEN 'Claude Writing Fingerprint' WHEN per > 4.5 THEN 'GPT Writing Fingerprint' WHEN per > 1.5 THEN 'Mixed/Hybrid AI Signature' ELSE 'Standard Academic Prose (Human-like)' END AS fingerprint FROM x""")
def signature_density(spark, d):
    from ..operators.document import signature_density as run

    return run(read(spark, d, "documents"), T.SIGNATURES)


_CUT = "substr(text, 1, (length(text) // 2)::BIGINT)"


@query("T27_similarity", rf"""WITH p AS (SELECT doc_id, text AS a, {_CUT} AS b, list_distinct(regexp_extract_all(lower(text), '([A-Za-z0-9_]+)', 1)) AS x, list_distinct(regexp_extract_all(lower({_CUT}), '([A-Za-z0-9_]+)', 1)) AS y FROM documents)
SELECT doc_id, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 1.0::DOUBLE ELSE round(0.7::DOUBLE * len(list_intersect(x, y)) / greatest(len(list_distinct(list_concat(x, y))), 1) + 0.3::DOUBLE * least(length(a), length(b)) / greatest(length(a), length(b), 1), 4) END AS value FROM p""")
def similarity(spark, d):
    return read(spark, d, "documents").select("doc_id", T.similarity("text", F.expr("substr(text, 1, length(text) div 2)")).alias("value"))


@query("T31_protected", r"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(\b[A-Z]{2,}\b|\b[A-Z][a-z]+ \d{4}\b|\d+(?:\.\d+)?%)', 1))), '|') AS value FROM documents""")
def protected(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(T.protected("text")), "|").alias("value"))


@query("T37_sigmoid_logit", """WITH s AS (SELECT event_id, value, 1.0::DOUBLE / (1.0::DOUBLE + exp(-greatest(least(value / 10.0::DOUBLE, 25), -25))) AS p FROM events)
SELECT event_id, round(p, 9) AS sigmoid, round(ln(greatest(least(p, 1 - 1e-6), 1e-6) / (1 - greatest(least(p, 1 - 1e-6), 1e-6))), 6) AS logit FROM s""")
def sigmoid_logit(spark, d):
    e = read(spark, d, "events").withColumn("p", T.sigmoid(F.col("value") / 10.0))
    return e.select("event_id", F.round("p", 9).alias("sigmoid"), F.round(T.logit("p"), 6).alias("logit"))


@query("T38_interpolate", """WITH e AS (SELECT event_id, (event_id % 997) / 996.0::DOUBLE AS p FROM events), k AS (SELECT *, p * 100 AS x, least(floor(p * 100), 99)::INT AS k FROM e)
SELECT event_id, round((k / 100.0::DOUBLE) * (k / 100.0::DOUBLE) + (x - k) * (((k + 1) / 100.0::DOUBLE) * ((k + 1) / 100.0::DOUBLE) - (k / 100.0::DOUBLE) * (k / 100.0::DOUBLE)), 9) AS value FROM k""")
def interpolate(spark, d):
    grid = F.array(*[F.lit(k / 100.0 * (k / 100.0)) for k in range(101)])
    return read(spark, d, "events").select("event_id", F.round(T.interpolate((F.col("event_id") % 997) / F.lit(996.0), grid), 9).alias("value"))


@query("T20_tier", """SELECT event_id, CASE WHEN (event_id % 101) / 100.0::DOUBLE >= 0.75 THEN 'HIGH' WHEN (event_id % 101) / 100.0::DOUBLE >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM events""")
def tier(spark, d):
    return read(spark, d, "events").select("event_id", T.tier((F.col("event_id") % 101) / F.lit(100.0)).alias("tier"))
