import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from tsymbol.operators.series import to_points
from tsymbol.plans import estimators as E


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(7)
    rows = [(s, c, np.cumsum(rng.normal(size=n)).tolist()) for s in range(6) for c, n in ((0, 40), (1, 33))]
    return spark.createDataFrame(rows, "series_id long, channel int, values array<double>").cache()


@pytest.mark.parametrize("make", [E.joint, E.quantized, E.fixed_point, E.fast, E.fast_quantized, E.fast_fixed_point])
def test_joint_symbolizers_go_there_and_back(spark, series, make, tmp_path):
    model, symbols = make(tol=0.1, k=6).fit_transform(series)
    assert symbols.count() == series.count()
    got = {(r.series_id, r.channel): r for r in symbols.collect()}
    assert all(len(r.labels) == len(r.symbols) for r in got.values())
    back = model.inverse(symbols, 40)
    assert {len(r["values"]) for r in back.collect()} == {40}
    again = model.transform(series)
    assert again.count() == series.count()
    path = f"file://{tmp_path}/m"
    model.save(path)
    loaded = E.Model.load(spark, path)
    assert [r.labels for r in loaded.transform(series).orderBy("series_id", "channel").collect()] == [r.labels for r in again.orderBy("series_id", "channel").collect()]
    with pytest.raises(E.NotFittedError):
        loaded.fitted_symbols()
    assert model.storage_bits(symbols).first()["bits"] > 0


def test_a_fine_codebook_restores_the_chain(series):
    model, symbols = E.joint(tol=1e-9, alpha=1e-6).fit_transform(series)
    back = {(r.series_id, r.channel, r.t): r.value for r in model.inverse(symbols).collect()}
    want = {(r.series_id, r.channel, r.t): r.value for r in to_points(series, ["series_id", "channel"]).collect()}
    assert back.keys() == want.keys() and all(abs(back[k] - v) < 1e-3 for k, v in want.items())


def test_means_keep_the_length(series):
    s = E.EachSymbolizer(tol=0.3, alpha=0.5)
    made = s.rates(s.transform(series.filter("channel = 0")))
    n = {r.series_id: r["count"] for r in s.inverse(made).groupBy("series_id").count().collect()}
    assert set(n.values()) == {40}
    assert all(0 < r.compression_rate <= 1 and 0 < r.digitization_rate <= 1 for r in made.collect())


def test_partitions_keep_their_starts(series):
    made = E.EachSymbolizer(tol=0.1, alpha=0.5, partition=4).transform(series.filter("channel = 0"))
    assert made.count() == 24 and made.filter(F.size("values") == 10).count() == 24


def test_any_estimator(series):
    model = E.joint(tol=0.2).fit_with(series, KMeans(k=4, seed=1))
    counts = model.labelled.groupBy("label").count().orderBy("label").collect()
    assert [r["count"] for r in counts] == sorted((r["count"] for r in counts), reverse=True)


@pytest.mark.parametrize("bad, error", [({"tol": 0}, ValueError), ({"tol": "x"}, TypeError), ({"alpha": -1}, ValueError), ({"k": 1.5}, TypeError), ({"k": 0}, ValueError), ({"sorting": "x"}, ValueError), ({"scl": -1}, ValueError), ({"partition": 0}, ValueError), ({"partition_rate": 2}, ValueError), ({"init": "x"}, ValueError), ({"eta": 0}, ValueError)])
def test_parameters_are_checked(bad, error):
    with pytest.raises(error):
        E.joint(**bad)


def test_whole_images_through_general_compression(spark):
    rows = spark.createDataFrame([(s, 0, t, float((s * 7 + t * 3) % 50)) for s in range(8) for t in range(20)], "series_id long, channel int, t int, value double")
    model, symbols, stats = E.general_compress(E.joint(tol=0.01, alpha=0.01), rows)
    back = E.general_decompress(model, symbols, stats, 20, whole=True)
    assert back.count() == 160 and back.agg(F.min("value") >= 0, F.max("value") <= 255).first() == (True, True)
