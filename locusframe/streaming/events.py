"""Streaming counterparts (an extension): the same predicates over a stream, and depth by event-time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_depth(events: DataFrame, window: str = "1 hour", late: str = "2 hours", keep: Column | None = None) -> DataFrame:
    """(start, event_type, n, value_sum): rows by window of event time, open for rows that come at most `late` late; works on tables too."""
    rows = events if keep is None else events.where(keep)
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value_sum")).select(F.col("w.start").alias("start"), "event_type", "n", "value_sum")
