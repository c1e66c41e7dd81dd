"""Structured Streaming forms: sliding attempt counts, session windows, and idempotent scoring against a frozen snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The event table's folder as a stream; `ts` becomes a timestamp, which watermarks need."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def attempts_by_window(events: DataFrame, length: str = "24 hours", step: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """user_id, window start, attempts: sliding windows; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy("user_id", F.window("ts", length, step).alias("w")).agg(F.count("*").alias("attempts")).select("user_id", F.col("w.start").alias("start"), "attempts")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, session start and end, events, value."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")


def scored(orders: DataFrame, snapshot: DataFrame, late: str = "1 day") -> DataFrame:
    """Orders of a stream with their account's features from a frozen snapshot; a repeated order id is scored once."""
    once = orders.withWatermark("ts", late).dropDuplicatesWithinWatermark(["order_id"])
    return once.join(snapshot, "account_id", "left")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there now, through the stream, as a table in memory (for tests and small results)."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)
