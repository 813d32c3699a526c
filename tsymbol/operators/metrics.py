"""Errors, distances, profiles and clustering quality."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsymbol.functions import kernels
from tsymbol.operators.cluster import features


def relative_error(a: DataFrame, b: DataFrame, key: str = "series_id") -> DataFrame:
    """One row: the sum over series of |X - Y| (2-norm) by the sum of |X|, for points(key, t, value)."""
    both = a.join(b.select(key, "t", F.col("value").alias("other")), [key, "t"])
    d = F.col("value") - F.col("other")
    each = both.groupBy(key).agg(F.sqrt(F.sum(d * d)).alias("d"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("x"))
    return each.agg((F.sum("d") / F.sum("x")).alias("rel_error"))


def smape(both: DataFrame, actual: str = "value", forecast: str = "other") -> DataFrame:
    """One row: the mean of 200 |F - A| / (|A| + |F|) percent."""
    return both.agg((F.avg(200 * F.abs(F.col(forecast) - F.col(actual)) / (F.abs(actual) + F.abs(forecast)))).alias("smape"))


def l2_errors(both: DataFrame, key: str = "series_id", actual: str = "value", forecast: str = "other") -> DataFrame:
    """(key, l2, l2_diff): 2-norms of the difference, and of the difference of first differences."""
    w = Window.partitionBy(key).orderBy("t")
    d = F.col(actual) - F.col(forecast)
    rows = both.withColumn("d", d).withColumn("dd", F.col("d") - F.lag("d").over(w))
    return rows.groupBy(key).agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("l2"), F.coalesce(F.sqrt(F.sum(F.col("dd") * F.col("dd"))), F.lit(0.0)).alias("l2_diff"))


def dtw(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """pairs with the dynamic time warping distance of two array columns."""
    schema = T.StructType([*pairs.schema.fields, T.StructField("dtw", T.DoubleType())])
    at, bt = pairs.columns.index(a), pairs.columns.index(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [kernels.dtw(np.array(x or [], float), np.array(y or [], float)) for x, y in zip(batch.column(at).to_pylist(), batch.column(bt).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.float64())], names=[f.name for f in schema])

    return pairs.mapInArrow(run, schema)


def dtw_paths(pairs: DataFrame, a: str = "a", b: str = "b", *, dist: Callable[[float, float], float] | None = None, drop_straight: bool = False) -> DataFrame:
    """pairs with `dtw` and `path`, the warping path as places (i, j) in both arrays, with any pointwise cost (squared difference
    where none is given). drop_straight: points on straight stretches are removed first, and places count what is left."""
    schema = T.StructType([*pairs.schema.fields, T.StructField("dtw", T.DoubleType()), T.StructField("path", T._parse_datatype_string("array<struct<i:int,j:int>>"))])
    at, bt = pairs.columns.index(a), pairs.columns.index(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [kernels.dtw_path(np.array(x or [], float), np.array(y or [], float), dist, drop_straight) for x, y in zip(batch.column(at).to_pylist(), batch.column(bt).to_pylist(), strict=True)]
            paths = pa.array([[{"i": i, "j": j} for i, j in path] for _, path in made], pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([d for d, _ in made], pa.float64()), paths], names=[f.name for f in schema])

    return pairs.mapInArrow(run, schema)


def performance_profile(scores: DataFrame, thetas: list[float], problem: str = "problem", solver: str = "solver", score: str = "score") -> DataFrame:
    """(solver, theta, share): the share of problems where a solver's score is at most theta times the best. Null scores never are."""
    n = scores.select(problem).distinct().count()
    # a window, as a join would work scores out twice: averages added up in another order then miss themselves at theta 1
    best = scores.filter(F.col(problem).isNotNull()).withColumn("best", F.min(score).over(Window.partitionBy(problem)))
    rows = best.withColumn("theta", F.explode(F.array(*map(F.lit, thetas))))
    fits = F.when(F.col(score) <= F.col("theta") * F.col("best"), 1.0).otherwise(0.0)
    return rows.groupBy(solver, "theta").agg((F.sum(fits) / n).alias("share"))


def first_tolerance(counts: DataFrame, key: str = "series_id", share: float = 0.2) -> DataFrame:
    """(key, tol): of counts(key, tol, n_pieces, n), the least tolerance with at most share * n pieces; null where none is."""
    return counts.groupBy(key).agg(F.min(F.when(F.col("n_pieces") <= share * F.col("n"), F.col("tol"))).alias("tol"))


def expected_wcss(alpha: float, n: int, k: int) -> float:
    return 0.5 * alpha**2 * (n - k)


def mean_by(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*(F.avg(v).alias(v) for v in values))


def silhouette(labelled: DataFrame) -> float:
    """Mean silhouette with squared Euclidean distances, by pyspark.ml."""
    return ClusteringEvaluator(predictionCol="label", featuresCol="features").evaluate(features(labelled))


def separation(labelled: DataFrame) -> DataFrame:
    """One row: calinski_harabasz and davies_bouldin of points(x, y, label). Centres meet each other, so labels should be few."""
    c = labelled.groupBy("label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count(F.lit(1)).alias("n"))
    rows = labelled.join(c, "label").withColumn("d2", (F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2)
    inside = rows.groupBy("label").agg(F.avg(F.sqrt("d2")).alias("s"), F.sum("d2").alias("w"))
    c = c.join(inside, "label")
    a, b = c.alias("a"), c.alias("b")
    far = F.sqrt((F.col("a.cx") - F.col("b.cx")) ** 2 + (F.col("a.cy") - F.col("b.cy")) ** 2)
    worst = a.join(b, F.col("a.label") != F.col("b.label")).groupBy(F.col("a.label")).agg(F.max((F.col("a.s") + F.col("b.s")) / far).alias("r"))
    mean = labelled.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    between = c.crossJoin(F.broadcast(mean)).agg(F.sum(F.col("n") * ((F.col("cx") - F.col("mx")) ** 2 + (F.col("cy") - F.col("my")) ** 2)).alias("between"), F.sum("w").alias("within"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    score = (F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))
    return between.crossJoin(F.broadcast(worst.agg(F.avg("r").alias("davies_bouldin")))).select(score.alias("calinski_harabasz"), "davies_bouldin")


def adjusted_rand(df: DataFrame, a: str = "label", b: str = "truth") -> DataFrame:
    """One row: the adjusted Rand index, from the contingency table."""
    two = lambda c: c * (c - 1) / 2
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("c"))
    both = cells.agg(F.sum(two(F.col("c"))).alias("both"), F.sum("c").alias("n"))
    of = lambda x, name: cells.groupBy(x).agg(F.sum("c").alias("c")).agg(F.sum(two(F.col("c"))).alias(name))
    rows = both.crossJoin(F.broadcast(of(a, "ra"))).crossJoin(F.broadcast(of(b, "rb")))  # one row each
    chance = F.col("ra") * F.col("rb") / two(F.col("n"))
    return rows.select(((F.col("both") - chance) / ((F.col("ra") + F.col("rb")) / 2 - chance)).alias("ari"))
