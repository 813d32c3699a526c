"""Tab-separated series, a row a series with its class first; and 2-D point sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tsv(spark: SparkSession, path: str, *, least: int = 100, standardise: bool = True) -> DataFrame:
    """(series_id, label, values): NaN and empty cells dropped, sample deviation 1 and mean 0, rows of under `least` values left out.
    Whole rows are read as text, so rows may differ in length."""
    lines = spark.read.text(path).filter(F.trim("value") != "").select(F.monotonically_increasing_id().alias("series_id"), F.split(F.trim("value"), r"[\t ]+").alias("f"))
    numbers = F.filter(F.transform(F.slice("f", 2, F.greatest(F.size("f") - 1, F.lit(0))), lambda x: x.try_cast("double")), lambda x: x.isNotNull() & ~F.isnan(x))
    rows = lines.select("series_id", F.get("f", F.lit(0)).alias("label"), numbers.alias("values")).filter(F.size("values") >= least)
    if not standardise:
        return rows
    n = F.size("values")
    rows = rows.withColumn("m", F.aggregate("values", F.lit(0.0), lambda s, x: s + x) / n)
    rows = rows.withColumn("d", F.sqrt(F.aggregate("values", F.lit(0.0), lambda s, x: s + (x - F.col("m")) * (x - F.col("m"))) / (n - 1)))
    rows = rows.withColumn("d", F.when((F.col("d") == 0) | F.col("d").isNull(), 1.0).otherwise(F.col("d")))
    return rows.select("series_id", "label", F.transform("values", lambda x: (x - F.col("m")) / F.col("d")).alias("values"))


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, label) of a tab-separated point set without a header."""
    return spark.read.csv(path, sep="\t", schema="x double, y double, label int")
