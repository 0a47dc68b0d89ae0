"""Streams over the event log and over arriving chunks: an extension, the batch forms are in operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import IndexStore

EVENTS = "timestamp timestamp, commit string, comment_count bigint"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Review events of a folder of JSON lines, as they are appended."""
    return spark.readStream.schema(EVENTS).json(path)


def reviews_per_window(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Reviews and comments by window of event time; a window is final once the watermark has passed it."""
    return (
        events.withWatermark("timestamp", late).groupBy(F.window("timestamp", width))
        .agg(F.count("*").alias("reviews"), F.sum("comment_count").alias("comments"))
        .select(F.col("window.start").alias("window_start"), "reviews", "comments")
    )


def running_iterations(events: DataFrame) -> DataFrame:
    """Iterations by commit, for the update or complete output mode."""
    return events.groupBy("commit").agg(F.count("*").alias("iteration_count"), F.max("timestamp").alias("last_reviewed"))


def index_chunks(chunks: DataFrame, root: str, checkpoint: str):
    """Upserts arriving chunks into an index, one version a batch; a batch that is run again changes nothing."""

    def upsert(batch: DataFrame, batch_id: int) -> None:
        IndexStore(batch.sparkSession, root).create().upsert("chunks", batch, ["content_hash"], "chunk_id")

    return chunks.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
