"""k-means and other pluggable clusterings of pieces. Estimators of pyspark.ml do the work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsymbol.operators.digitize import PLACE, by_frequency


def features(points: DataFrame, columns: Sequence[str] = ("x", "y")) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(points)


def cluster(points: DataFrame, estimator, columns: Sequence[str] = ("x", "y")) -> DataFrame:
    """points with the label that any pyspark.ml clustering estimator predicts."""
    rows = features(points, columns)
    model = estimator.fit(rows)
    return model.transform(rows).withColumn("label", F.col(model.getPredictionCol())).select(*points.columns, "label")


def k_means(points: DataFrame, k: int, *, seed: int = 0, max_iter: int = 300, tol: float = 1e-4, place: Sequence[str] = PLACE) -> DataFrame:
    """points(place.., x, y) with labels by falling frequency; k is at most the number of distinct points."""
    k = min(k, points.select("x", "y").distinct().count())
    if k <= 1:
        return points.withColumn("label", F.lit(0))
    return by_frequency(cluster(points, KMeans(k=k, seed=seed, maxIter=max_iter, tol=tol)), place)


def sampled_k_means(points: DataFrame, k: int, r: float = 0.5, *, seed: int = 42, max_iter: int = 300, tol: float = 1e-4, place: Sequence[str] = PLACE) -> DataFrame:
    """k-means fitted on a seeded sample of the share r, at least k points, that predicts all. The seed hashes the place, so reruns agree."""
    n = points.count()
    k = min(k, points.select("x", "y").distinct().count())
    if k <= 1:
        return points.withColumn("label", F.lit(0))
    share = max(r, min(1.0, 2.0 * k / n))
    picked = points.filter((F.pmod(F.xxhash64(F.lit(seed), *place), F.lit(1 << 30)) / float(1 << 30)) < share)
    if picked.select("x", "y").distinct().limit(k).count() < k:
        picked = points
    model = KMeans(k=k, seed=seed, maxIter=max_iter, tol=tol).fit(features(picked))
    return by_frequency(model.transform(features(points)).withColumn("label", F.col("prediction")).select(*points.columns, "label"), place)


def largest_variance(labelled: DataFrame, columns: Sequence[str]) -> float:
    """The largest population variance of a cluster in any of the columns."""
    per = labelled.groupBy("label").agg(F.greatest(*(F.var_pop(c) for c in columns), F.lit(0.0)).alias("v"))
    return per.agg(F.max("v")).first()[0] or 0.0


def fewest_clusters(points: DataFrame, tol: float, n_points: int, *, min_k: int = 3, max_k: int = 100, columns: Sequence[str] = ("x", "y"), seed: int = 0, place: Sequence[str] = PLACE) -> tuple[DataFrame, int]:
    """The fewest clusters whose variances stay within 6 (N - n) / (N n) (tol / 0.2)^2, or max_k; ValueError below min_k pieces."""
    n = points.count()
    if n < min_k:
        raise ValueError(f"{n} pieces are fewer than min_k = {min_k}")
    bound = 6 * (n_points - n) / (n_points * n) * (tol / 0.2) ** 2
    labelled, k = None, min_k
    most = min(max_k, points.select(*columns).distinct().count())
    for k in range(min(min_k, most), most + 1):  # noqa: B007
        labelled = cluster(points, KMeans(k=k, seed=seed), columns) if k > 1 else points.withColumn("label", F.lit(0))
        if largest_variance(labelled, columns) <= bound:
            break
    return by_frequency(labelled, place), k
