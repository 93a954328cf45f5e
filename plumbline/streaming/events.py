"""Structured Streaming over events: an extension; static analysis itself has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def activity(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events by window and type.  On a stream, state is dropped once the watermark has passed its window."""
    if events.isStreaming:  # watermarks ask for timestamps with a zone
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")
