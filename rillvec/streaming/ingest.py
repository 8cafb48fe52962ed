"""Structured Streaming into an index: each micro-batch is encoded and published under its batch id.

A batch that is replayed after a failure overwrites its own folder, so every
row is published exactly once.  Readers see whole batches: a folder counts
only when the manifest table names it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ivf import IvfModel, encode, postings_of
from ..plans.durable import durable_dir


def publish_batch(batch: DataFrame, batch_id: int, model: IvfModel, path: str, shard: str) -> None:
    """Postings of one micro-batch, in a folder of its own, and its line of the manifest."""
    postings_of(encode(batch, model), shard).write.mode("overwrite").parquet(f"{path}/postings/batch_id={batch_id}")
    line = batch.sparkSession.createDataFrame([(batch_id,)], "batch_id int")
    line.coalesce(1).write.mode("overwrite").json(f"{path}/manifest/{batch_id:09d}")


def start(stream: DataFrame, model: IvfModel, path: str, shard: str = "active", available_now: bool = True) -> StreamingQuery:
    """Ingest a stream of (doc_id, x)."""
    writer = stream.select("doc_id", "x").writeStream.option("checkpointLocation", f"{path}/checkpoint")
    writer = writer.foreachBatch(lambda batch, batch_id: publish_batch(batch, batch_id, model, path, shard))
    return writer.trigger(availableNow=True).start() if available_now else writer.start()


def published(spark: SparkSession, path: str) -> DataFrame:
    """shard, list_id, doc_id, code, batch_id of all batches that the manifest names.

    Batches are partitions of one table; the manifest prunes them in a
    semi-join; the driver collects no manifest and names no paths one by one.
    """
    named = spark.read.schema("batch_id int").json(f"{path}/manifest/*")
    rows = spark.read.schema("shard string, list_id int, doc_id long, code array<short>, batch_id int").parquet(f"{path}/postings")
    return rows.join(named, "batch_id", "left_semi").select("shard", "list_id", "doc_id", "code", "batch_id")


def latency_stream(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Windowed latencies of a stream of (ts, value): late rows within the watermark still count."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("max"))


def ingest_demo(spark: SparkSession, source: str, model: IvfModel) -> DataFrame:
    """Stream a Parquet table of (vec_id, embedding) through ``start`` and read what was published."""
    schema = spark.read.parquet(source).schema
    # As a pattern, the path may name a file as well as a folder.
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{source[:-1]}[{source[-1]}]")
    path = f"{durable_dir(spark)}/ingest-{uuid.uuid4().hex}"
    start(stream.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("x")), model, path).awaitTermination()
    return published(spark, path)
