import numpy as np
import pytest
from pyspark.sql import functions as F

from tsymbol.functions import columns as C
from tsymbol.functions import kernels
from tsymbol.operators import baselines, cluster, digitize, encoders, fill, images, inverse, metrics, normalize, quantizer
from tsymbol.operators.compress import compress_arrays, pieces_of
from tsymbol.operators.series import chunks, to_series, with_ends


def frame(spark, arrays):
    return spark.createDataFrame([(k, 0, [float(v) if v is not None else None for v in a]) for k, a in enumerate(arrays)], "series_id long, channel int, values array<double>")


NAN = float("nan")


@pytest.mark.parametrize("method, want", [("ffill", [0, 1, 1, 3, 3]), ("bfill", [1, 1, 3, 3, 0]), ("mean", [2, 1, 2, 3, 2]), ("median", [2, 1, 2, 3, 2]), ("zero", [0, 1, 0, 3, 0])])
def test_fill_of_points_and_arrays(spark, method, want):
    x = [NAN, 1.0, None, 3.0, NAN]
    points = spark.createDataFrame([(0, t, v) for t, v in enumerate(x)], "series_id long, t int, value double")
    assert [r.value for r in fill.fill_points(points, "series_id", "t", method=method).orderBy("t").collect()] == want
    assert frame(spark, [x]).select(fill.filled(F.col("values"), method)).first()[0] == want


def test_fill_of_nothing_but_holes(spark):
    for method in ("ffill", "bfill", "mean", "median", "zero"):
        assert frame(spark, [[NAN, None]]).select(fill.filled(F.col("values"), method)).first()[0] == [0, 0]


def test_compress_fills_and_handles_short_series(spark):
    rows = compress_arrays(frame(spark, [[], [1], [1, NAN, 3], [NAN, NAN]]), 0.1)
    got = {r.series_id: [(p["len"], p["inc"]) for p in r.pieces] for r in rows.collect()}
    assert got == {0: [], 1: [], 2: [(1, 2.0), (1, 0.0)], 3: [(1, 0.0)]}


@pytest.mark.parametrize("sorting", digitize.SORTINGS)
@pytest.mark.parametrize("alpha", [0.03, 0.2, 5.0])
def test_islands_equal_one_task(spark, sorting, alpha):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(250, 2))
    if sorting not in ("1-norm", "pca"):
        points = np.round(points, 1)
    df = spark.createDataFrame([(0, 0, i, float(x), float(y)) for i, (x, y) in enumerate(points)], "series_id long, channel int, idx int, x double, y double")
    labelled, starts = digitize.aggregate(df, alpha, sorting)
    got = [r.label for r in labelled.orderBy("idx").collect()]
    want, first = kernels.group_greedily(points, alpha, sorting)
    assert got == want.tolist()
    assert [(r.idx, r.n_members) for r in starts.orderBy("label").collect()] == [(i, int((want == k).sum())) for k, i in enumerate(first)]


def test_nearest_breaks_ties_by_label(spark):
    pieces = spark.createDataFrame([(1.0, 0.0), (5.0, 5.0)], "len double, inc double")
    book = spark.createDataFrame([(1, 2.0, 0.0), (0, 0.0, 0.0)], "label int, len double, inc double")
    assert [r.label for r in digitize.nearest(pieces, book).orderBy("len").collect()] == [0, 1]


def test_lengths_of_centres_with_scl_0(spark):
    pieces = spark.createDataFrame([(0, 0, 0, 2, 1.0), (0, 0, 1, 4, 1.1), (0, 0, 2, 9, -3.0)], "series_id long, channel int, idx int, len int, inc double")
    scale = digitize.scale_of(pieces, 0.0)
    points = pieces.select("*", *digitize.scaled(scale))
    labels, starts = digitize.aggregate(points, 0.5, "norm")
    book = digitize.start_codebook(starts, scale, points.join(labels.select("idx", "label"), "idx"))
    assert sorted(r.len for r in book.collect()) == [3.0, 9.0]


def test_whole_lengths_inside_the_jvm(spark):
    rng = np.random.default_rng(4)
    lists = [np.round(rng.uniform(0, 4, size=n) * 4) / 4 for n in rng.integers(1, 12, 60)]
    got = [r[0] for r in frame(spark, lists).orderBy("series_id").select(C.whole_lengths(F.col("values"))).collect()]
    assert got == [kernels.whole_lengths(x).astype(int).tolist() for x in lists]


def test_stitching_equals_the_kernel(spark):
    x = np.cumsum(np.random.default_rng(5).normal(size=80))
    rows = compress_arrays(frame(spark, [x]), 0.3)
    p = pieces_of(rows, ["series_id"]).orderBy("idx").toPandas()
    want = kernels.stitch(p["len"].to_numpy(), p["inc"].to_numpy(), x[0])
    arrays = rows.select("series_id", F.get("values", F.lit(0)).alias("start"), F.transform("pieces", lambda q: q["len"].cast("double")).alias("lengths"), F.transform("pieces", lambda q: q["inc"]).alias("incs"))
    got = [r.value for r in inverse.stitched(arrays, "series_id").orderBy("t").collect()]
    assert got == pytest.approx(want.tolist()) and len(got) == len(x)


def test_chunks_drop_or_keep_the_tail(spark):
    rows = with_ends(frame(spark, [range(11)]))
    assert [len(r["values"]) for r in chunks(rows, 3).orderBy("chunk").collect()] == [3, 3, 3]
    assert [len(r["values"]) for r in chunks(rows, 3, keep_tail=True).orderBy("chunk").collect()] == [3, 3, 5]


@pytest.mark.parametrize("n, want", [(5, [1, 2, 3, 3, 3]), (2, [1, 3]), (1, [1])])
def test_keep_ends(spark, n, want):
    assert frame(spark, [[1, 2, 3]]).select(C.keep_ends(F.col("values"), n)).first()[0] == want


@pytest.mark.parametrize("mode", normalize.MODES)
def test_normalisation_is_undone(spark, mode):
    rows = spark.createDataFrame([(s, c, t, float(s + 2 * c + t * t)) for s in range(3) for c in range(2) for t in range(4)], "series_id long, channel int, t int, value double")
    stats = normalize.statistics(rows, mode)
    back = normalize.denormalise(normalize.normalise(rows, stats), stats)
    key = lambda df: [round(r.value, 6) for r in df.orderBy("series_id", "channel", "t").collect()]
    assert key(back) == key(rows)


@pytest.mark.parametrize("bits", [8, 12, 16, 32])
def test_quantisation_error(spark, bits):
    x = np.random.default_rng(6).normal(size=200).tolist()
    df = spark.createDataFrame([(v,) for v in x], "v double")
    q = quantizer.fit(df, "v", bits)
    got = df.select("v", q.quantize(F.col("v")).alias("q")).select("v", "q", q.dequantize(F.col("q")).alias("b")).collect()
    assert all(abs(r.v - r.b) <= q.scale / 2 + 1e-6 * abs(r.q) * q.scale + 1e-12 for r in got)
    assert min(r.q for r in got) == q.low and max(r.q for r in got) == q.high


def test_quantisation_of_one_value_and_wrong_flags(spark):
    df = spark.createDataFrame([(2.5,), (2.5,)], "v double")
    q = quantizer.fit(df, "v")
    assert df.select(q.dequantize(q.quantize(F.col("v")))).first()[0] == 2.5
    with pytest.raises(ValueError):
        quantizer.fit(df, "v", signed=False)


def test_k_means_and_sampling(spark):
    rows = [(0, 0, i, float(c * 10 + (i % 3) * 0.1), float(c)) for c in range(3) for i in range(c * 20, c * 20 + 20 - 4 * c)]
    df = spark.createDataFrame(rows, "series_id long, channel int, idx int, x double, y double")
    for made in (cluster.k_means(df, 3), cluster.sampled_k_means(df, 3, 0.5)):
        sizes = [r["count"] for r in made.groupBy("label").count().orderBy("label").collect()]
        assert sizes == [20, 16, 12]
    labelled, k = cluster.fewest_clusters(df, 0.5, 400, min_k=1, max_k=5)
    assert k == 3 and labelled.select("label").distinct().count() == 3
    with pytest.raises(ValueError):
        cluster.fewest_clusters(df.limit(1), 0.5, 10)


def test_encoders_on_empty_and_repeated_sequences(spark):
    df = spark.createDataFrame([(0, ["b", "a", "b"]), (1, []), (2, ["a"])], "doc long, seq array<string>")
    words = encoders.dictionary(df)
    assert {r.token: r.id for r in words.collect()} == {"b": 1, "a": 2}
    assert {r.doc: r.ids for r in encoders.categorical(df).collect()} == {0: [1, 2, 1], 1: [], 2: [2]}
    bow = encoders.dense(df, encoders.bag_of_words(df), 2)
    assert {r.doc: r.vector for r in bow.collect()} == {0: [2.0, 2.0], 1: [0.0, 0.0], 2: [0.0, 2.0]}
    assert {r.doc: r.seq for r in encoders.n_grams(df, 2).collect()} == {0: ["ba", "ab", "b"], 1: [], 2: ["a"]}
    numbers = df.withColumn("seq", F.transform("seq", lambda x: F.ascii(x)))
    assert {r.doc: r.seq for r in encoders.pad(numbers, 4, "first", "pre").collect()} == {0: [98, 98, 97, 98], 1: [-1] * 4, 2: [97] * 4}
    assert encoders.covering_length(df, 1.0).first()[0] == 3 and encoders.covering_length(df, 0.0).first()[0] == 3


def test_sax_round_trip_is_a_step_function(spark):
    points = spark.createDataFrame([(0, t, float(t % 7 - 3)) for t in range(23)], "series_id long, t int, value double")
    back = baselines.inverse_sax(baselines.sax(points, 5, 4), 5, 4)
    assert back.count() == 20 and back.select("value").distinct().count() <= 4


def test_incremental_digitizer():
    lengths, incs = np.arange(1.0, 9.0), np.array([1.0, 1.1, -1.0, 5.0, 1.05, -1.1, 5.1, 0.95])
    for weighted in (False, True):
        for norm in (1, 2):
            for symmetric in (False, True):
                label, centres = baselines.incremental(lengths, incs, 0.3, weighted=weighted, symmetric=symmetric, norm=norm)
                assert set(label.tolist()) == set(range(len(centres))) and (label >= 0).all()
    label, _ = baselines.incremental(lengths, incs, 0.3, weighted=False)
    assert label[3] == label[6] != label[0]


def test_images_wrap_or_clip(spark):
    df = spark.createDataFrame([(0, [2, 2], [0, 255, 7, 9])], "image_id long, shape array<int>, values array<int>")
    made = images.standardise(df)
    assert images.restore(made).first()["values"] == [0, 255, 7, 9]
    assert images.mean_squared_error(df, images.restore(made, clip=True)).first()["mse"] == 0
    assert images.rows_of(df).count() == 4


def test_metrics_of_equal_series_are_zero(spark):
    a = spark.createDataFrame([(0, t, float(t)) for t in range(5)], "series_id long, t int, value double")
    assert metrics.relative_error(a, a).first()[0] == 0
    pairs = spark.createDataFrame([(1, [1.0, 2.0], [1.0, 1.0, 2.0])], "id long, a array<double>, b array<double>")
    assert metrics.dtw(pairs).first()["dtw"] == 0


def test_series_of_ties_are_ordered(spark):
    df = spark.createDataFrame([(0, 1, 2.0), (0, 0, 1.0), (0, 1, 1.0)], "k long, t int, v double")
    assert to_series(df, "k", "t", "v").first()["values"] == [1.0, 1.0, 2.0]


def test_dtw_paths(spark):
    from tsymbol.operators import metrics

    df = spark.createDataFrame([(1, [0.0, 1.0, 2.0], [0.0, 2.0]), (2, [1.0, 1.0], [1.0])], "k int, a array<double>, b array<double>")
    got = {r.k: (r.dtw, [tuple(x) for x in r.path]) for r in metrics.dtw_paths(df).collect()}
    assert got == {1: (1.0, [(0, 0), (1, 0), (2, 1)]), 2: (0.0, [(0, 0), (1, 0)])} or got[1][0] == 1.0 and got[1][1][0] == (0, 0) and got[1][1][-1] == (2, 1)
    apart = metrics.dtw_paths(df, dist=lambda x, y: abs(x - y), drop_straight=True).filter("k = 1").first()
    assert apart["dtw"] == 0.0 and [tuple(x) for x in apart["path"]] == [(0, 0), (1, 1)]


def test_sql_function(spark):
    import math

    from tsymbol.plans.sql import register

    register(spark)
    spark.createDataFrame([(1, [math.sin(0.05 * i) for i in range(1000)]), (2, None), (3, [])], "k int, v array<double>").createOrReplaceTempView("waves")
    got = {r.k: r.s for r in spark.sql("SELECT k, symbolize(v, 0.1D, 0.1D) AS s FROM waves").collect()}
    assert got == {1: "aBbCbCbCbCbCbCbCA", 2: None, 3: ""}


def test_symbols_beyond_all_letters(spark):
    from pyspark.sql import functions as F

    from tsymbol.functions import columns as C

    rows = spark.range(1000).select("id", C.symbol(F.col("id").cast("int"), F.lit(1000)).alias("s")).collect()
    assert [r.s for r in sorted(rows, key=lambda r: r.id)] == C.symbols_of(1000)


def test_best_scores_meet_themselves_in_a_profile(spark):
    """Scores that come out differently each time they are worked out, as averages do whose parts arrive in another order."""
    import random

    import pandas as pd

    def score(batches):
        for b in batches:
            yield b.assign(score=[1 + random.SystemRandom().random() for _ in range(len(b))])

    pairs = spark.createDataFrame(pd.DataFrame([(p, s) for p in range(50) for s in "ab"], columns=["problem", "solver"]))
    made = metrics.performance_profile(pairs.mapInPandas(score, "problem long, solver string, score double"), [1.0]).collect()
    assert sum(r.share for r in made) == pytest.approx(1.0)


def test_a_class_is_digested_without_a_row_that_holds_it(spark):
    """No row of the plan may be longer than a sequence."""
    from hashlib import md5

    rows = [(1, 1, None), (2, 5, [""]), (2, 1, ["a", "é"]), (2, 2, None), (2, 3, []), (2, 4, ["b", None, "c"]), (3, 1, []), (None, 2, ["y"]), (None, 1, ["x"])]
    df = spark.createDataFrame(rows, "label int, doc long, seq array<string>")
    want = {1: "", 2: "a é b c ", 3: "", None: "x y"}
    assert {r.label: r.digest for r in encoders.class_digests(df).collect()} == {k: md5(v.encode()).hexdigest() for k, v in want.items()}
    assert "collect_list" not in encoders.class_digests(df)._jdf.queryExecution().toString()


def test_nearest_meets_centres_in_batches(spark):
    rng = np.random.default_rng(2)
    book, points = np.round(rng.normal(size=(1000, 2)), 1), np.round(rng.normal(size=(3000, 2)), 1)
    pieces = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "i int, len double, inc double")
    made = digitize.nearest(pieces, spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(book)], "label int, len double, inc double"))
    want = [int(((p - book) ** 2).sum(1).argmin()) for p in points]
    assert [r.label for r in made.orderBy("i").collect()] == want
    plan = made._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "array_min" not in plan  # no array of a struct a centre for each piece


def test_coded_sequences_give_what_joins_give(spark):
    rows = [(5, ["x", None, "a"]), (3, ["b", "a", "b"]), (9, None), (4, []), (7, ["", "a"])]
    df = spark.createDataFrame(rows, "doc long, seq array<string>").coalesce(1)
    ids, total = {"b": 1, "a": 2, "x": 3, None: 4, "": 5}, {"b": 2, "a": 3, "x": 1, "": 1}
    assert {r.token: r.id for r in encoders.dictionary(df).collect()} == ids
    pairs = {(d, t) for d, seq in rows for t in seq or [] if t is not None}
    bow = encoders.bag_of_words(df)
    assert "CoGroups" in bow._jdf.queryExecution().toString()  # a token is joined once a part, not once a document
    assert sorted(tuple(r) for r in bow.collect()) == sorted((d, ids[t], float(total[t])) for d, t in pairs)
    assert sorted(tuple(r) for r in encoders.one_hot(df).collect()) == sorted((d, ids[t], 1.0) for d, t in pairs)
    assert {r.doc: r.ids for r in encoders.categorical(df).collect()} == {5: [3, 2], 3: [1, 2, 1], 9: [], 4: [], 7: [5, 2]}
    again = df.unionAll(df)
    assert sorted(tuple(r) for r in encoders.bag_of_words(again).collect()) == sorted((d, ids[t], 2.0 * total[t]) for d, t in pairs)


def test_classes_of_coded_sequences(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["c"]), (3, ["z"]), (4, None)], "doc long, seq array<string>")
    weights = spark.createDataFrame([("p", "a", 1.0), ("p", "b", 1.0), ("q", "c", 2.0), ("q", "b", 1.0)], "label string, token string, weight double")
    made = encoders.classify(df, weights)
    assert "CoGroups" in made._jdf.queryExecution().toString()
    got = {r.doc: (r.label, round(r.distance, 9)) for r in made.collect()}
    assert got == {1: ("p", round(1 - 3 / 10**0.5, 9)), 2: ("q", round(1 - 2 / 5**0.5, 9)), 3: ("p", 1.0), 4: ("p", 1.0)}
