"""Normalisation of points(series_id, channel, t, value) and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What each mode's statistics are taken over.
SCOPES = {"channel": ["channel"], "series": ["series_id", "channel"], "dataset": []}
MODES = [f"{kind}_{scope}" for kind in ("z", "minmax") for scope in ("per_channel", "per_series", "dataset")]


def statistics(points: DataFrame, mode: str, eps: float = 1e-12) -> DataFrame:
    """(scope.., shift, scale): value -> (value - shift) / scale. Map-side aggregation; one row a scope."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    kind, _, scope = mode.partition("_")
    keys = SCOPES[scope.removeprefix("per_")]
    if kind == "z":
        made = (F.avg("value"), F.stddev_pop("value") + F.lit(eps))
    else:
        made = (F.min("value"), F.max("value") - F.min("value") + F.lit(eps))
    return points.groupBy(*keys).agg(made[0].alias("shift"), made[1].alias("scale"))


def _joined(points: DataFrame, stats: DataFrame) -> DataFrame:
    keys = [c for c in stats.columns if c not in ("shift", "scale")]
    return points.join(stats, keys) if keys else points.crossJoin(F.broadcast(stats))  # one row


def normalise(points: DataFrame, stats: DataFrame) -> DataFrame:
    return _joined(points, stats).withColumn("value", (F.col("value") - F.col("shift")) / F.col("scale")).select(*points.columns)


def denormalise(points: DataFrame, stats: DataFrame) -> DataFrame:
    return _joined(points, stats).withColumn("value", F.col("value") * F.col("scale") + F.col("shift")).select(*points.columns)


def z_over_series(points: DataFrame) -> DataFrame:
    """(t, shift, scale) over all series at each place, population deviation, 0 counting as 1: as general compression uses."""
    return points.groupBy("t").agg(F.avg("value").alias("shift"), F.when(F.stddev_pop("value") == 0, 1.0).otherwise(F.stddev_pop("value")).alias("scale"))


def z_each(points: DataFrame, key: str, value: str = "value", *, sample: bool = False) -> DataFrame:
    """Every series to mean 0 and deviation 1 (population, or sample); a deviation of 0 or null counts as 1."""
    w = Window.partitionBy(key)
    dev = (F.stddev_samp if sample else F.stddev_pop)(value).over(w)
    return points.withColumn(value, (F.col(value) - F.avg(value).over(w)) / F.when((dev == 0) | dev.isNull(), 1.0).otherwise(dev))


def to_bytes(value):
    """Rounded half to even and wrapped into 0..255."""
    return F.pmod(F.rint(value).cast("long"), F.lit(256)).cast("int")
