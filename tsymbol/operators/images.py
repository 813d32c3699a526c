"""Images as series: (image_id, shape, values), row-major."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsymbol.operators.normalize import to_bytes


def standardise(images: DataFrame) -> DataFrame:
    """values to mean 0 and population deviation 1 (0 counts as 1); mean and dev are kept for the way back."""
    v, n = F.col("values").cast("array<double>"), F.size("values")
    rows = images.withColumn("mean", F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n)
    rows = rows.withColumn("dev", F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean"))) / n))
    rows = rows.withColumn("dev", F.when(F.col("dev") == 0, 1.0).otherwise(F.col("dev")))
    return rows.withColumn("values", F.transform(v, lambda x: (x - F.col("mean")) / F.col("dev")))


def restore(images: DataFrame, *, clip: bool = False) -> DataFrame:
    """values back to whole numbers from 0 to 255, wrapped around or clipped."""
    back = lambda x: x * F.col("dev") + F.col("mean")
    fit = (lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.rint(x))).cast("int")) if clip else to_bytes
    return images.withColumn("values", F.transform("values", lambda x: fit(back(x))))


def rows_of(images: DataFrame) -> DataFrame:
    """(series_id, channel, t, value): each last-axis line of an image is a series of its own."""
    width = F.try_element_at("shape", F.lit(-1))
    return images.select("image_id", "shape", F.posexplode("values").alias("p", "value")).select(F.col("image_id").alias("series_id"), F.floor(F.col("p") / width).cast("int").alias("channel"), (F.col("p") % width).alias("t"), F.col("value").cast("double"))


def mean_squared_error(a: DataFrame, b: DataFrame) -> DataFrame:
    """(image_id, mse)"""
    both = a.select("image_id", F.col("values").alias("x")).join(b.select("image_id", F.col("values").alias("y")), "image_id")
    total = F.aggregate(F.zip_with("x", "y", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return both.select("image_id", (total / F.size("x")).alias("mse"))
