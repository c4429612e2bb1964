"""Facts and events as streams: an extension, since indexes are rebuilt in batches elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fact_stream(spark: SparkSession, folder: str, schema, delay: str = "1 day") -> DataFrame:
    """Facts from Parquet files as they arrive; a fact delivered again within the delay is dropped."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.withWatermark("ingested_at", delay).dropDuplicatesWithinWatermark(["scan_id", "fact_id"])


def counts_by_window(facts: DataFrame, width: str = "1 day") -> DataFrame:
    """Facts a type and window; a window closes when the watermark passes it."""
    return facts.groupBy(F.window("ingested_at", width), "fact_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("from_at"), "fact_type", "n")


def sessions(events: DataFrame, at: str = "ts", user: str = "user_id", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of a user's events, parted by gaps."""
    return events.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("s"), user).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("s.start").alias("from_at"), F.col("s.end").alias("to_at"), "n")
