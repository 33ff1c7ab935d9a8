"""Structured Streaming over the ledger, an extension: operations counted as they are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.ledger import SCHEMA


def operations_per_window(spark: SparkSession, path: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """A streaming frame of (start, operation, status, n); rows later than the watermark are left out."""
    rows = spark.readStream.schema(SCHEMA).parquet(path).withWatermark("at", late)
    return rows.groupBy(F.window("at", width), "operation", "status").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "operation", "status", "n")
