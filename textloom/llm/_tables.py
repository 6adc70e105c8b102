"""Shared tables, bounded broadcasts and connected components for the llm operators.

Everything that cuts lineage is a Parquet table under ``spark.checkpoint.dir``, the folder that driver and
executors share, so a lost executor costs only the tasks that it ran.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: Rows up to which a small side is broadcast; beyond it joins are shuffled with a salt.
BROADCAST_ROWS = 50_000
SALTS = 16


_made: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for path, spark in list(_made.items()):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended already
            return


def table(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again; it stays until the application ends or ``drop``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    _made[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._textloom_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``table`` that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_textloom_path", None)
        if path and path in _made:
            _delete(_made.pop(path), path)


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", salt: str = "doc_id") -> DataFrame:
    """Join with a side of one row per key: broadcast if it has at most BROADCAST_ROWS rows, which is counted
    first; otherwise shuffled on the key and a salt, so that a hot key of ``left`` is dealt over SALTS tasks."""
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on, how)
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(salted, [*on, "_salt"], how).drop("_salt")


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); component: its smallest node.

    Each round contracts every node into its smallest neighbour. An edge (u, v) becomes (m(u), m(v)), which
    keeps what hangs together together; the number of rounds grows with the logarithm of the paths' lengths.
    """
    edges = table(edges.select("a", "b").where("a <> b").distinct(), f"{label}-edges")
    nodes = table(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("component", F.col("node")), f"{label}-nodes")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = table(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")), f"{label}-least")
        new_nodes = table(
            nodes.join(least.select(F.col("a").alias("component"), "to"), "component", "left")
            .select("node", F.coalesce("to", "component").alias("component")), f"{label}-nodes")
        new_edges = table(
            edges.join(least.select("a", F.col("to").alias("ta")), "a").join(least.select(F.col("a").alias("b"), F.col("to").alias("tb")), "b")
            .where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), f"{label}-edges")
        drop(nodes, edges, least)
        nodes, edges = new_nodes, new_edges
    drop(edges)
    return nodes
