"""Queries by name with the SQL that gives the same rows, and the frames that many of them start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL if there is one."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def scalar(name: str, expr: Callable[[], Column], sql: str | None, table: str = "documents", key: str = "doc_id") -> None:
    """A query of one expression over every row of a table."""
    query(name, sql and f"SELECT {key}, {sql} AS value FROM {table}")(lambda spark, d: read(spark, d, table).select(key, expr().alias("value")))


# --- sentences and their stand-in scores ---

SENT = r"""s0 AS (SELECT doc_id, lang, source, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents),
sent AS (SELECT doc_id, lang, source, unnest(s) AS sentence, (generate_subscripts(s, 1) - 1)::INTEGER AS sent_idx FROM s0)"""
WC = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> ''))"
SCORED = SENT + rf""",
scored AS (SELECT *, (('0x' || substr(md5(doc_id || ':' || sent_idx), 1, 8))::BIGINT % 1000) / 1000.0::DOUBLE AS score,
  {WC.format('sentence')}::BIGINT AS n_words FROM sent)"""
SMOOTH = SCORED + """,
nb AS (SELECT *, lag(score) OVER w AS p, lead(score) OVER w AS x, count(*) OVER (PARTITION BY doc_id) AS n FROM scored WINDOW w AS (PARTITION BY doc_id ORDER BY sent_idx)),
smooth AS (SELECT *, CASE WHEN n < 3 THEN score WHEN p IS NULL THEN 0.7::DOUBLE * score + 0.3::DOUBLE * x WHEN x IS NULL THEN 0.7::DOUBLE * score + 0.3::DOUBLE * p
  ELSE 0.25::DOUBLE * p + 0.5::DOUBLE * score + 0.25::DOUBLE * x END AS smoothed FROM nb)"""


def sentences(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, lang, source, sent_idx, sentence)."""
    return read(spark, d, "documents").select("doc_id", "lang", "source", F.posexplode(T.sentences("text")).alias("sent_idx", "sentence"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Sentences with a stand-in score, a hash of their place, and their number of words. It detects nothing;
    a real scorer takes its place through ``operators.scoring.score_with``."""
    s = sentences(spark, d)
    return s.withColumn("score", T.bucket(F.concat_ws(":", "doc_id", "sent_idx"), 1000) / F.lit(1000.0)).withColumn("n_words", T.n_words("sentence"))
