"""Tables that cut lineage, and connected components on top of them.

A table is Parquet under ``spark.checkpoint.dir``, the folder that driver and executors share, so a lost executor costs
only the tasks that it ran.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import shared_dir

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


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out anew if it comes in fewer partitions than there are cores, as a file of one row group does."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def components(edges: DataFrame, label: str = "cc", rounds: list[int] | None = None) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); component: its smallest node. ``rounds`` gets each round's edges.

    Each round contracts a node into the one of itself and its neighbours that a hash of node and round puts first, and
    that one into its own. An edge (u, v) becomes (m(u), m(v)), which keeps together what hangs together. As the order is drawn
    anew each time, a constant share of nodes goes in a round, chains in ascending order included, so
    rounds grow with the logarithm of the nodes.
    """
    edges = table(edges.select("a", "b").where("a <> b").distinct(), f"{label}-edges")
    nodes = table(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("component", F.col("node")), f"{label}-nodes")
    step = 0
    while n := edges.count():
        if rounds is not None:
            rounds.append(n)
        step += 1
        mark = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(step)).alias("h"), F.col(c).alias("id"))  # noqa: E731, B023
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = table(both.groupBy("a").agg(F.least(mark("a"), F.min(mark("b"))).getField("id").alias("to")), f"{label}-first")
        two = table(first.join(first.select(F.col("a").alias("to"), F.col("to").alias("next")), "to").select("a", F.col("next").alias("to")), f"{label}-two")
        new_nodes = table(
            nodes.join(two.select(F.col("a").alias("component"), "to"), "component", "left")
            .select("node", F.coalesce("to", "component").alias("component")), f"{label}-nodes")
        new_edges = table(
            edges.join(two.select("a", F.col("to").alias("ta")), "a").join(two.select(F.col("a").alias("b"), F.col("to").alias("tb")), "b")
            .where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), f"{label}-edges")
        drop(nodes, edges, first, two)
        nodes, edges = new_nodes, new_edges
    drop(edges)
    if not step:
        return nodes
    least = nodes.groupBy("component").agg(F.min("node").alias("least"))
    out = table(nodes.join(least, "component").select("node", F.col("least").alias("component")), f"{label}-least")
    drop(nodes)
    return out
