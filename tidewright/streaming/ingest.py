"""Streaming ingest of documents into the store (an extension: the batch operators need no stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewright.operators.extraction import SPECS, extract


def extractions_of(stream: DataFrame, categories: tuple[str, ...] = tuple(SPECS)) -> DataFrame:
    """Extracted facts of a batch of documents, with a hash that names each fact of a document."""
    return extract(stream, categories).withColumn("fact", F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "category", "record_hash"), 256))


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, categories: tuple[str, ...] = tuple(SPECS)) -> StreamingQuery:
    """All files of ``source`` that were not seen before, once: facts are appended as parquet, at most once per document.

    A repeated micro-batch overwrites its own folder, so a restart leaves no duplicates.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        extractions_of(batch, categories).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per type and tumbling window; with a stream, rows later than the watermark are dropped by design."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))
