"""The corpus pipeline: documents through quality rules, line dedup, near-dedup, substring dedup and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import chunks, lines, near_dup, packing, quality
from textloom.llm._tables import table
from textloom.session import ship


def _shipped(stage):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    run.__doc__ = stage.__doc__
    return run


STAGES = [
    ("quality_rules", _shipped(quality.stage)),
    ("line_dedup", _shipped(lines.stage)),
    ("near_dedup", _shipped(near_dup.stage)),
    ("substring_dedup", _shipped(chunks.stage)),
    ("packing", _shipped(packing.stage)),
]
#: Hashes of their own decide the middle stages, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on what its predecessor wrote, from the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
