"""SAX and 1d-SAX over points(series_id, t, value), inside the JVM; and the incremental 1-D digitizer of increments."""

from __future__ import annotations

from math import sqrt
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def breakpoints(k: int, scale: float = 1.0) -> list[float]:
    """Quantiles 1/k .. (k-1)/k of a normal distribution."""
    return [NormalDist(0, scale).inv_cdf(i / k) for i in range(1, k)]


def midpoints(k: int, scale: float = 1.0) -> list[float]:
    """Quantiles 1/2k, 3/2k .."""
    return [NormalDist(0, scale).inv_cdf(i / (2 * k)) for i in range(1, 2 * k, 2)]


def _bin(x, cuts: list[float]):
    return sum((F.when(x >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))


def _windows(points: DataFrame, width: int) -> DataFrame:
    """points with window number w; the rest that doesn't fill a window is dropped. Lengths come from one aggregation."""
    whole = points.groupBy("series_id").agg(F.floor(F.count(F.lit(1)) / width).alias("n_w"))
    return points.withColumn("w", F.floor(F.col("t") / width).cast("int")).join(whole, "series_id").filter("w < n_w")


def paa(points: DataFrame, width: int) -> DataFrame:
    """(series_id, w, mean)"""
    return _windows(points, width).groupBy("series_id", "w").agg(F.avg("value").alias("mean"))


def sax(points: DataFrame, width: int, k: int = 5) -> DataFrame:
    """(series_id, w, label, symbol)"""
    label = _bin(F.col("mean"), breakpoints(k))
    return paa(points, width).select("series_id", "w", label.alias("label"), F.char(label + 97).alias("symbol"))


def inverse_sax(made: DataFrame, width: int, k: int = 5) -> DataFrame:
    """(series_id, t, value)"""
    value = F.element_at(F.array(*map(F.lit, midpoints(k))), F.col("label") + 1)
    return made.select("series_id", "w", value.alias("value"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("i")).select("series_id", (F.col("w") * width + F.col("i")).alias("t"), "value")


def one_d_sax(points: DataFrame, width: int, slopes: int, means: int) -> DataFrame:
    """(series_id, w, slope, mean, label, symbol): least-squares slope and value in the middle of each window."""
    rows = _windows(points, width).groupBy("series_id", "w").agg((F.covar_pop("t", "value") / F.var_pop("t")).alias("slope"), F.avg("value").alias("mean"))
    label = _bin(F.col("slope"), breakpoints(slopes, sqrt(0.03 / width))) * means + _bin(F.col("mean"), breakpoints(means))
    return rows.withColumn("label", label).withColumn("symbol", F.char(F.col("label") + 97))


def inverse_one_d_sax(made: DataFrame, width: int, slopes: int, means: int) -> DataFrame:
    """(series_id, t, value)"""
    at = lambda values, k: F.element_at(F.array(*map(F.lit, values)), k + 1)
    slope, mean = at(midpoints(slopes, sqrt(0.03 / width)), F.floor(F.col("label") / means).cast("int")), at(midpoints(means), F.col("label") % means)
    rows = made.select("series_id", "w", slope.alias("s"), mean.alias("m"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("i"))
    return rows.select("series_id", (F.col("w") * width + F.col("i")).alias("t"), ((F.col("i") - (width - 1) / 2) * F.col("s") + F.col("m")).alias("value"))


# --- incremental digitization of increments


def weighted_median(values: np.ndarray, weights: np.ndarray) -> float:
    """The least value up to which the weights pass half of their sum; where they just reach it, the mean with the next."""
    order = np.argsort(values, kind="stable")
    ranked, upto = values[order], np.cumsum(weights[order])
    at = int(np.searchsorted(2 * upto, upto[-1]))
    exact = 2 * upto[at] == upto[-1] and at + 1 < len(ranked)
    return float((ranked[at] + ranked[at + 1]) / 2 if exact else ranked[at])


def fit_value(values: np.ndarray, weighted: bool, norm: int) -> tuple[float, float]:
    """The value that stands for increments in order of time, and its error; weighted: errors add up along the run."""
    n = len(values)
    steps, sums = np.arange(1, n + 1), np.cumsum(values)
    if weighted and norm == 1:
        value = weighted_median(sums / steps, steps.astype(float))
        return value, float(np.abs(sums - steps * value).sum())
    if weighted:
        value = float((steps * sums).sum() / (steps * steps).sum())
        return value, float(((sums - steps * value) ** 2).sum())
    value = float(np.median(values) if norm == 1 else values.mean())
    rest = values - value
    return value, float(np.abs(rest).sum() if norm == 1 else (rest**2).sum())


def incremental(lengths: np.ndarray, incs: np.ndarray, tol: float, *, weighted: bool = True, symmetric: bool = False, norm: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Labels and centres (len, inc) of one series' pieces, by increments in sorted order: a cluster takes the next
    increment as long as its error stays below its size times tol. With symmetric, increments go by magnitude until the first
    cluster has met a change of sign, and by sign from there on."""
    order = np.argsort(np.abs(incs) if symmetric else incs, kind="stable")
    label, centres = np.empty(len(incs), np.int64), []
    begin, turned, met = 0, False, False
    sign = np.sign(incs[order[0]]) if len(order) else 0
    while begin < len(order):
        stop, value = begin + 1, float(incs[order[begin]])
        while stop < len(order):
            met |= bool(np.sign(incs[order[stop]]) != sign)
            trial, error = fit_value(incs[np.sort(order[begin : stop + 1])], weighted, norm)
            if not error < (stop + 1 - begin) * tol:
                break
            stop, value = stop + 1, trial
        group = order[begin:stop]
        label[group] = len(centres)
        centres.append((lengths[group].mean(), value))
        if symmetric and met and not turned:
            rest = order[stop:]
            order[stop:] = rest[np.lexsort((np.abs(incs[rest]), np.sign(incs[rest])))]
            turned = True
        begin = stop
    return label, np.array(centres).reshape(-1, 2)
