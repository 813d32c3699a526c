"""Image files, decoded by Spark's own image source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, shape [height, width, channels], values): row-major bytes from 0 to 255, channels as stored (BGR)."""
    rows = spark.read.format("image").load(path).select("image.*")
    bits = F.regexp_extract_all(F.hex("data"), F.lit("(..)"), F.lit(1))
    return rows.select(F.col("origin").alias("image_id"), F.array("height", "width", "nChannels").alias("shape"), F.transform(bits, lambda x: F.conv(x, 16, 10).cast("int")).alias("values"))
