"""Incremental indexing: a stream of documents whose chunks are added to a Parquet index once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..operators.chunks import split_chunks


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # nothing has been written yet
        return None


def index_stream(docs: DataFrame, path: str, checkpoint: str, size: int = 256) -> StreamingQuery:
    """Start a query that appends the chunks of new documents to ``path``.

    A document that the index has already, or that the batch repeats, adds nothing. A batch overwrites a folder of
    its own, so a batch that runs again after a failure leaves one copy.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
        index = _read(spark, path)
        if index is not None:
            earlier = index.where(F.col("batch") != number).select("doc_id").distinct()
            new = new.join(earlier, "doc_id", "left_anti")
        split_chunks(new, size).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Events by window and type; rows later than ``late`` are dropped, closed windows leave the state."""
    return _timed(events, late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of users: events no further apart than ``gap``."""
    return _timed(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
