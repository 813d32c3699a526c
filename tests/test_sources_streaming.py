import numpy as np

from tsymbol.operators.compress import compress_arrays, pieces_of
from tsymbol.sources import arff, synthetic, ucr
from tsymbol.streaming.compress import _advance, drain, stream_pieces

ARFF = """@relation r
@attribute bag relational
@attribute class {x,y}
@data
'1.0,2.0\\n3.0,?',x
"5,NaN\\n7,8",y
"""


def test_arff_by_both_readers(spark, tmp_path):
    path = tmp_path / "a.arff"
    path.write_text(ARFF)
    arff.register(spark)
    want = [("x", [[1.0, 2.0], [3.0, 0.0]]), ("y", [[5.0, 0.0], [7.0, 8.0]])]
    assert [(r.label, r.channels) for r in spark.read.format("arff").load(str(path)).orderBy("series_id").collect()] == want
    rows = arff.read(spark, f"file://{path}")
    assert [(r.label, r.channels) for r in rows.orderBy("line").collect()] == want
    assert arff.to_points(rows.withColumnRenamed("line", "series_id")).count() == 8


def test_tsv(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("1\t1\t2\t3\tNaN\n2\t5\t5\n")
    rows = ucr.read_tsv(spark, f"file://{tmp_path}/a.tsv", least=3).collect()
    assert [r.label for r in rows] == ["1"] and np.allclose(rows[0]["values"], [-1, 0, 1])
    (tmp_path / "p.txt").write_text("1.5\t2\t1\n")
    assert tuple(ucr.read_shapes(spark, f"file://{tmp_path}/p.txt").first()) == (1.5, 2.0, 1)


def test_sine_and_walks(spark):
    assert synthetic.sine(spark, 10, 20).orderBy("t").collect()[1].value == np.sin(1 / 20)
    assert synthetic.random_walks(spark, 3, 5).count() == 15


def test_stream_equals_batch(spark):
    rng = np.random.default_rng(8)
    walks = {k: np.cumsum(rng.normal(size=40)).tolist() for k in range(4)}
    df = spark.createDataFrame([(k, 0, v) for k, v in walks.items()], "series_id long, channel int, values array<double>")
    want = sorted((r.series_id, r.idx, r.len, round(r.inc, 9)) for r in pieces_of(compress_arrays(df, 0.2, keep=["series_id"]), ["series_id"]).collect())
    rows = [(k, t, x) for k, v in walks.items() for t, x in enumerate(v)] + [(k, 1000, None) for k in walks]
    got = drain(spark.createDataFrame(rows, "series_id long, t long, value double"), lambda s: stream_pieces(s, 0.2))
    assert sorted((r.series_id, r.idx, r.len, round(r.inc, 9)) for r in got.collect()) == want


def test_state_carries_over_batches_and_drops_late_rows():
    x = np.cumsum(np.random.default_rng(9).normal(size=60))
    rows = list(enumerate(x.tolist()))
    _, whole = _advance(None, iter([*rows, (99, None)]), 0.2, float("inf"))
    state, parts = None, []
    for k in range(0, 60, 7):
        state, out = _advance(state, iter(rows[k : k + 7] + rows[max(0, k - 2) : k]), 0.2, float("inf"))
        parts += out
    _, out = _advance(state, iter([(99, None)]), 0.2, float("inf"))
    assert parts + out == whole
