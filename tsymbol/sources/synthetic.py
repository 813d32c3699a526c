"""Synthetic series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sine(spark: SparkSession, length: int = 1000, freq: float = 20.0) -> DataFrame:
    """(t, value): sin(t / freq)"""
    return spark.range(length).select(F.col("id").cast("int").alias("t"), F.sin(F.col("id") / freq).alias("value"))


def random_walks(spark: SparkSession, n: int, length: int, seed: int = 0) -> DataFrame:
    """(series_id, t, value): sums of seeded normal steps."""
    from pyspark.sql import Window

    rows = spark.range(n * length).select(F.floor(F.col("id") / length).alias("series_id"), (F.col("id") % length).cast("int").alias("t"), F.randn(seed).alias("step"))
    return rows.select("series_id", "t", F.sum("step").over(Window.partitionBy("series_id").orderBy("t")).alias("value"))
