"""Between points (a row a value), series (a row an array) and channels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cols(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def to_series(points: DataFrame, key: str | Sequence[str], order: str | Sequence[str], value: str | Column) -> DataFrame:
    """(key.., values array<double>, start, n). One shuffle by key; `order` must decide between equal values."""
    value = F.col(value) if isinstance(value, str) else value
    packed = F.struct(*(F.col(o).alias(f"o{k}") for k, o in enumerate(_cols(order))), value.cast("double").alias("v"))
    rows = points.groupBy(*_cols(key)).agg(F.transform(F.array_sort(F.collect_list(packed)), lambda s: s["v"]).alias("values"))
    return with_ends(rows)


def with_ends(series: DataFrame) -> DataFrame:
    return series.withColumns({"start": F.get("values", F.lit(0)), "n": F.size("values")})


def to_points(series: DataFrame, key: str | Sequence[str], values: str = "values") -> DataFrame:
    """(key.., t, value), t from 0."""
    return series.select(*_cols(key), F.posexplode(values).alias("t", "value"))


def chunks(series: DataFrame, parts: int, *, keep_tail: bool = False) -> DataFrame:
    """Every series cut into `parts` chunks of equal length (chunk from 0); the rest that doesn't fill one is dropped unless keep_tail."""
    size = F.floor(F.size("values") / parts).cast("int")
    last = F.when(F.col("chunk") == parts - 1, F.size("values")).otherwise(size) if keep_tail else size
    rows = series.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return with_ends(rows.withColumn("values", F.slice("values", F.col("chunk") * size + 1, last)).filter(F.size("values") > 0))


def chunk_number(rate: float, jobs: int) -> int:
    """Chunks for a partition rate: round(exp(1 / rate)) for each job."""
    import math

    return round(math.exp(1 / rate)) * jobs


def stack_channels(points: DataFrame, n_times: int, *, last_dim: bool = True) -> DataFrame:
    """points(series_id, channel, t, value) with the key that 2-D algorithms see: (series_id, channel), or all channels of a series one after the other."""
    if last_dim:
        return points.select("series_id", "channel", "t", "value")
    return points.select("series_id", F.lit(0).alias("channel"), (F.col("channel") * n_times + F.col("t")).alias("t"), "value")


def unstack_channels(points: DataFrame, n_times: int) -> DataFrame:
    """The inverse of stack_channels(last_dim=False)."""
    return points.select("series_id", F.floor(F.col("t") / n_times).cast("int").alias("channel"), (F.col("t") % n_times).alias("t"), "value")


def array_channels(rows: DataFrame, key: str, cube: str) -> DataFrame:
    """(series_id, channel, t, value float) from a column of arrays [time][feature]: every feature becomes a channel."""
    long = rows.select(F.col(key).alias("series_id"), F.posexplode(cube).alias("t", "at")).select("series_id", "t", F.posexplode("at").alias("channel", "value"))
    return long.select("series_id", "channel", "t", F.col("value").cast("float").alias("value"))


def channel_arrays(points: DataFrame) -> DataFrame:
    """(series_id, cube [time][feature]): the inverse of array_channels()."""
    at = points.groupBy("series_id", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "value"))), lambda s: s["value"]).alias("at"))
    return at.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "at"))), lambda s: s["at"]).alias("cube"))
