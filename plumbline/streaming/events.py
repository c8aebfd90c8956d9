"""The measures that make sense on an unending table of events, as Structured Streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def source(spark: SparkSession, path: str, schema, files_at_once: int = 1) -> DataFrame:
    """Files as they come, with a time that watermarks can use."""
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)
    return read.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 day", late: str = "7 days", by: str = "event_type") -> DataFrame:
    """Counts and sums of each window and level; a window closes when nothing that late is waited for."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", F.round("total", 6).alias("total"))


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "7 days", by: str = "user_id") -> DataFrame:
    """Each user's runs of events with no gap between them."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), by).agg(F.count("*").alias("n")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(events: DataFrame, late: str = "7 days") -> DataFrame:
    """Events without repeats of their id within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def drain(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything that is there now, written once, and recoverable from the checkpoint."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)
    query.awaitTermination()
    return query
