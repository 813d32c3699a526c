"""Missing values (null and NaN) of points, by window, and of arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsymbol.functions.columns import missing


def fill_points(points: DataFrame, key: str | Sequence[str], order: str | Sequence[str], value: str = "value", method: str = "ffill") -> DataFrame:
    """mean, median, ffill, bfill (any letter case), or else 0. What ffill and bfill cannot reach becomes 0."""
    key, order = ([x] if isinstance(x, str) else list(x) for x in (key, order))
    v = F.when(~missing(F.col(value)), F.col(value))
    by = Window.partitionBy(*key)
    run = by.orderBy(*order)
    found = {
        "mean": F.avg(v).over(by),
        "median": F.percentile(v, F.lit(0.5)).over(by),
        "ffill": F.last(v, ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, 0)),
        "bfill": F.first(v, ignorenulls=True).over(run.rowsBetween(0, Window.unboundedFollowing)),
    }.get(method.lower(), F.lit(0.0))
    return points.withColumn(value, F.coalesce(v, found, F.lit(0.0)))


def filled(values: Column, method: str = "ffill") -> Column:
    """The same for an array column, by a fold inside the JVM."""
    kept = F.filter(values, lambda x: ~missing(x))
    if method.lower() == "mean":
        rest = F.aggregate(kept, F.lit(0.0), lambda s, x: s + x) / F.size(kept)
    elif method.lower() == "median":
        ordered, n = F.sort_array(kept), F.size(kept)
        rest = (F.element_at(ordered, F.floor((n + 1) / 2).cast("int")) + F.element_at(ordered, F.floor(n / 2 + 1).cast("int"))) / 2
    elif method.lower() in ("ffill", "bfill"):
        fold = lambda a: F.aggregate(a, F.array().cast("array<double>"), lambda s, x: F.concat(s, F.array(F.when(missing(x), F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0.0))).otherwise(x))))
        chained = fold(values) if method.lower() == "ffill" else F.reverse(fold(F.reverse(values)))
        return F.when(F.exists(values, missing), chained).otherwise(values)
    else:
        rest = F.lit(0.0)
    rest = F.when(F.size(kept) > 0, rest).otherwise(F.lit(0.0)) if method.lower() in ("mean", "median") else rest
    return F.transform(values, lambda x: F.when(missing(x), rest).otherwise(x))
