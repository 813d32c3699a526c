import numpy as np
import pytest

from tsymbol.llm import neighbours as nn

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in good:
        if q % 100:
            continue
        best = out.setdefault(q, {})
        for c, b in good:
            if c != q and len(a) == len(b):
                best[c] = min(best.get(c, np.inf), float(np.sqrt(((a - b) ** 2).sum())))
    return {q: sorted((s, c) for c, s in best.items())[:k] for q, best in out.items() if best}


@pytest.mark.parametrize("block", [3, 4096])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nn, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(nn, "QUERY_BLOCK", block)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(0, 420, 7)]
    rows += [(100, [1.0] * 8), (100, [2.0] * 8), (3, [1.0] * 8), (2, [1.0] * 8), (5, [1.0] * 8), (5, [1.5] * 8)]  # repeated ids, ties
    rows += [(200, None), (300, []), (9, [0.0] * 8), (11, [float("nan")] * 8), (12, [float("inf")] + [1.0] * 7), (13, [None] + [1.0] * 7), (None, [1.0] * 8), (400, [1.0, 2.0]), (401, [1.0, 2.5])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)
    got = {}
    for r in nn.search(df, df.filter("vec_id % 100 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(rows, 5)
    assert got.keys() == want.keys()
    for q, found in got.items():
        assert [(k, i) for k, i, _ in sorted(found)] == [(k + 1, c) for k, (_, c) in enumerate(want[q])]
        assert [s for *_, s in sorted(found)] == pytest.approx([s for s, _ in want[q]], rel=1e-14)


def test_doubles_and_overflow(spark, monkeypatch):
    """Doubles whose squares overflow have infinite distances, ties to smaller ids; fine differences of doubles aren't lost."""
    monkeypatch.setattr(nn, "AT_ONCE", 2)
    rows = [(0, [1e200, 1.0]), (1, [-1e200, 1.0]), (2, [1e200, 1.0 + 1e-9]), (3, [5.0, 5.0]), (100, [5.0, 5.0 + 1e-12]), (4, [5.0, 5.0 + 1.5e-12]), (200, [1.0, 1.0]), (300, [1e200, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(nn.search(df, df.filter("vec_id % 100 = 0"), 3).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: [2, 300, 1], 100: [4, 3, 200], 200: [3, 100, 4], 300: [2, 0, 1]}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert nn.search(df, df).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(50, 16)) * rng.uniform(0.01, 100, size=(50, 1))
    codes, scale, error = nn.quantise(v)
    assert np.linalg.norm(v - codes * scale[:, None], axis=1) == pytest.approx(error)
    assert (error <= scale / 2 * np.sqrt(16) + 1e-12).all()
