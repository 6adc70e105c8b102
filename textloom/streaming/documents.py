"""Structured Streaming over a folder of documents."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def scored_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, mean): a document is a row, so its sentences never cross micro-batches."""
    s = T.sentences("text")
    score = F.transform(s, lambda x, i: T.bucket(F.concat_ws(":", "doc_id", i), 1000) / F.lit(1000.0))
    d = docs.select("doc_id", score.alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / F.size("s"), 9).alias("mean"))


def _stream(spark: SparkSession, source: str, files: int | None = None) -> DataFrame:
    """The Parquet files of a folder, or one file, as a stream; ``files`` to a micro-batch at most."""
    schema = spark.read.parquet(source).schema
    # a stream reads folders: a single file is picked out of its folder by name
    single = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(source).select("path").limit(2).collect()
    alone = len(single) == 1 and single[0].path.rstrip("/").endswith(source.rstrip("/").rsplit("/", 1)[1])
    folder, name = source.rstrip("/").rsplit("/", 1) if alone else (source, "*.parquet")
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def score_stream(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Scores every file of ``source`` that is there, exactly once, into Parquet at ``target``; the table."""
    q = scored_documents(_stream(spark, source)).writeStream.format("parquet").option("path", target).option("checkpointLocation", f"{target}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(target)


def analysed(docs: DataFrame) -> DataFrame:
    """(content, n_sentences, n_words): what follows from a text alone, by the hash of it."""
    return docs.select("content", F.size(T.sentences("text")).cast("long").alias("n_sentences"), T.n_words("text").cast("long").alias("n_words"))


#: How long the stream remembers a text; older ones are found in the cache itself.
REMEMBERED = "1 hour"


def cache_stream(spark: SparkSession, source: str, target: str, files: int | None = None) -> DataFrame:
    """A cache of results by content hash at ``target``, fed by the files of ``source`` that are there; the table.

    Texts that come again within REMEMBERED are dropped by the stream's state, older ones by a join of the micro-batch with
    the partitions of the cache that its hashes fall into. A micro-batch that runs twice adds nothing, and so does a replay of
    all files under another checkpoint. Null texts are left out.
    """
    docs = _stream(spark, source, files).where("text is not null").select(F.sha2("text", 256).alias("content"), "text", F.current_timestamp().alias("seen"))
    fresh = docs.withWatermark("seen", REMEMBERED).dropDuplicatesWithinWatermark(["content"])
    schema = "content string, n_sentences long, n_words long, prefix string"

    def add(batch: DataFrame, _: int) -> None:
        here = batch.dropDuplicates(["content"]).withColumn("prefix", F.substring("content", 1, 2))
        try:
            known = batch.sparkSession.read.schema(schema).parquet(target).select("content", "prefix")
        except AnalysisException:  # nothing was cached yet
            known = None
        new = here if known is None else here.join(known, ["prefix", "content"], "left_anti")
        # a file for each prefix and batch
        analysed(new).withColumn("prefix", F.substring("content", 1, 2)).repartition("prefix").write.mode("append").partitionBy("prefix").parquet(target)

    state = f"{target}-state-{uuid.uuid4().hex[:12]}"
    fresh.writeStream.foreachBatch(add).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(target).drop("prefix")


def counted_events(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per type and window, with a watermark; works on a stream and on a table."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
