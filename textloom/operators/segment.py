"""Generators: windows of tokens, context strings, paragraphs, bibliography-aware sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def token_windows(docs: DataFrame, size: int, stride: int, least: int) -> DataFrame:
    """(doc_id, start, chunk): windows of words; a rest of fewer than ``least`` makes none but the first."""
    d = docs.select("doc_id", T.words("text").alias("w"))
    d = d.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(stride))).alias("start"))
    return d.where((F.col("start") == 0) | (F.size("w") - F.col("start") >= least)).select("doc_id", "start", F.array_join(F.slice("w", F.col("start") + 1, size), " ").alias("chunk"))


def context(sents: DataFrame) -> DataFrame:
    """``sents`` with ``context``: a sentence between its neighbours."""
    w = Window.partitionBy("doc_id").orderBy("sent_idx")
    return sents.withColumn("context", T.strip(F.concat_ws(" ", F.lag("sentence").over(w), "sentence", F.lead("sentence").over(w))))


def trim_to_tokens(docs: DataFrame, least: int, most: int) -> DataFrame:
    """(doc_id, n_tokens, text): whole paragraphs up to ``most`` tokens; shorter texts than ``least`` go."""
    p = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x")).withColumn("n", T.n_tokens("x"))
    p = p.withColumn("upto", F.sum("n").over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") <= most)
    g = p.groupBy("doc_id").agg(F.max("upto").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s")).where(F.col("n_tokens") >= least)
    return g.select("doc_id", "n_tokens", F.array_join(F.transform("s", lambda e: e["x"]), "\n").alias("text"))


def bibliography_split(docs: DataFrame) -> DataFrame:
    """(doc_id, part, idx, piece): sentences of the body; after the last word references, bibliography or works
    cited, the entries that start with [n]."""
    head = F.regexp_extract("text", r"(?is)^(.*)\b(references|bibliography|works cited)\b(.*)$", 1)
    tail = F.regexp_extract("text", r"(?is)^(.*)\b(references|bibliography|works cited)\b(.*)$", 3)
    found = F.col("text").rlike(r"(?i)\b(references|bibliography|works cited)\b")
    d = docs.select("doc_id", F.when(found, head).otherwise(F.col("text")).alias("body"), F.when(found, tail).otherwise("").alias("tail"))
    body = d.select("doc_id", F.lit("body").alias("part"), F.posexplode(F.filter(F.transform(T.sentences("body"), T.strip), lambda s: s != "")).alias("idx", "piece"))
    refs = d.select("doc_id", F.lit("reference").alias("part"), F.posexplode(F.filter(F.transform(F.split("tail", r"(?=\[\d+\])"), T.strip), lambda s: s != "")).alias("idx", "piece"))
    return body.unionByName(refs)


#: Words that begin a section inside a line, and how lines begin that open a paragraph: headings and
#: metadata (case does not matter), entries of references, bullets.
SECTIONS = r"Abstract|Index Terms|1\s+Introduction|Introduction|Background|Related Work|Methodology|Experiments|Results|Discussion|Conclusion|References|Bibliography"
OPENS = r"^(?:[0-9]+\.|\d+\s+[A-Z]|\b(?:abstract|introduction|background|related work|methodology|experiments|results|discussion|conclusion|references|works cited|bibliography|department|school|university|e-mail|email|keywords|author|authors|independent research|july \d{4}|june \d{4}|august \d{4}|january \d{4}|february \d{4}|march \d{4}|april \d{4}|may \d{4}|september \d{4}|october \d{4}|november \d{4}|december \d{4})\b)"
ENTRY = r"^\[\d+\]|^[A-Z][a-z]+,?\s+[A-Z]\.?(?:\s+&\s+[A-Z][a-z]+,?\s+[A-Z]\.?)?\s+\(\d{4}\)|^(?:[\*\-•]|\d+\.)\s+"


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph_idx, paragraph): blocks between empty lines, also before a section's word inside a line; in
    a block lines are joined until a heading, an entry of references, a bullet or a short line without a full stop
    opens the next paragraph."""
    text = F.replace(F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    text = F.regexp_replace(text, rf"(?i)(?<=\S)\s*(\b(?:{SECTIONS})\b[\s—\-.:]+)", "\n\n$1")
    lines = lambda b: F.filter(F.transform(F.split(b, "\n"), T.strip), lambda x: x != "")
    p = docs.select("doc_id", F.posexplode(F.split(text, "\n\n")).alias("b", "block")).select("doc_id", "b", F.posexplode(lines("block")).alias("i", "x"))
    opens = (F.col("i") == 0) | F.col("x").rlike(f"(?i){OPENS}") | F.col("x").rlike(ENTRY) | ((F.length("x") < 70) & ~F.col("x").endswith("."))
    p = p.withColumn("k", F.sum(opens.cast("int")).over(Window.partitionBy("doc_id").orderBy("b", "i").rowsBetween(Window.unboundedPreceding, 0)))
    g = p.groupBy("doc_id", "k").agg(F.sort_array(F.collect_list(F.struct("b", "i", "x"))).alias("s"))
    return g.select("doc_id", (F.col("k") - 1).cast("int").alias("paragraph_idx"), F.array_join(F.transform("s", lambda e: e["x"]), " ").alias("paragraph"))
