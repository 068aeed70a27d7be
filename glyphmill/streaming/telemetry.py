"""Usage records as a stream: beyond the batch report, with the same expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.telemetry import SCHEMA


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """Records of JSON-lines files that arrive in a folder."""
    rows = spark.readStream.schema(SCHEMA).json(folder)
    return rows.filter(F.col("ts").isNotNull() & ~F.isnan("ts"))


def daily(records: DataFrame, late: str = "1 day") -> DataFrame:
    """``(day, call, calls, saved_chars)`` by UTC day; records later than ``late`` are dropped."""
    saved = F.greatest(F.col("file_chars") - F.col("snippet_chars"), F.lit(0))
    rows = records.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    days = rows.groupBy(F.window("at", "1 day"), "call").agg(F.count("*").alias("calls"), F.sum(saved).alias("saved_chars"))
    return days.select(F.col("window.start").alias("day"), "call", "calls", "saved_chars")
