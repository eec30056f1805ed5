"""Streaming bars of events: windowed aggregates with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, folder: str, schema: StructType, files: int = 1) -> DataFrame:
    got = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    return got.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need a zoned type


def bars(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Per user and window: rows, sum and mean of value; rows later than ``late`` are left out."""
    return (
        events.withWatermark("ts", late)
        .groupBy("user_id", F.window("ts", width))
        .agg(F.count("value").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("vwap"))
        .select("user_id", F.col("window.start").alias("start"), "n", "total", "vwap")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Per user: sessions that end after a gap."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
