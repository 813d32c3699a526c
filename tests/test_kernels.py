import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tsymbol.functions import kernels
from tsymbol.functions.columns import symbols_of
from tsymbol.operators import each

walks = st.lists(st.floats(-5, 5), min_size=0, max_size=60).map(np.cumsum)


def one(x, tol, max_len=np.inf):
    p = kernels.segment(np.asarray(x, float), [len(x)], tol, max_len)
    return p


def test_golden_sine():
    x = np.sin(0.05 * np.arange(1000))
    p = one(x, 0.1)
    assert p.length.tolist()[:5] == [41, 61, 63, 63, 62] and p.length[-1] == 17 and len(p.length) == 17
    assert p.inc[:3] == pytest.approx([0.88736237, -1.81317705, 1.84841889])
    label, book = each.digitize(p.length, p.inc, 0.1, "2-norm", 1.0)
    letters = symbols_of(len(book))
    assert "".join(letters[k] for k in label) == "aBbCbCbCbCbCbCbCA"
    assert [b[1] for b in book] == pytest.approx([17, 41, 61, 62.714286, 63])
    assert [b[2] for b in book] == pytest.approx([0.608704, 0.887362, -1.813177, 1.853339, -1.852363], abs=1e-6)


@settings(max_examples=60, deadline=None)
@given(walks, st.sampled_from([0.01, 0.1, 1.0]), st.sampled_from([1, 3, np.inf]))
def test_segments_equal_the_direct_form(x, tol, max_len):
    p = one(x, tol, max_len)
    want = kernels.segment_directly(np.asarray(x, float), tol, max_len)
    near_threshold = any(abs(e - tol * (m - 1)) < 1e-9 for m, _, e in want)
    if not near_threshold:
        assert p.length.tolist() == [w[0] for w in want]
        assert p.inc == pytest.approx([w[1] for w in want], abs=1e-9)
    assert p.length.sum() == max(len(x) - 1, 0)
    assert all(e <= tol * (m - 1) + 1e-9 for m, e in zip(p.length, p.err, strict=True) if m > 1)


def test_many_series_at_once_equal_each_alone():
    rng = np.random.default_rng(1)
    series = [np.cumsum(rng.normal(size=n)) for n in (0, 1, 2, 50, 7, 200, 1)]
    p = kernels.segment(np.concatenate(series), [len(s) for s in series], 0.2)
    alone = [one(s, 0.2) for s in series]
    assert p.count.tolist() == [len(a.length) for a in alone]
    assert p.length.tolist() == [m for a in alone for m in a.length]
    assert p.end_value == pytest.approx([v for a in alone for v in a.end_value])


@pytest.mark.parametrize("x", [[], [1.0], [1.0, 2.0], [3.0] * 20, list(range(30)), [1e9 + (-1) ** k for k in range(30)]])
def test_degenerate_series_end(x):
    p = one(x, 0.1)
    assert p.length.sum() == max(len(x) - 1, 0)
    assert one(x, 0.1, 0).length.tolist() == [1] * max(len(x) - 1, 0)


def sequential(points, alpha, sorting):
    """Point by point, as the greedy rule says it."""
    key, order = kernels.sort_keys(points, sorting)
    label, k = [-1] * len(points), 0
    for at, i in enumerate(order):
        if label[i] >= 0:
            continue
        label[i] = k
        for j in order[at + 1 :]:
            if label[j] >= 0:
                continue
            if ((points[i] - points[j]) ** 2).sum() <= alpha**2:
                label[j] = k
            elif sorting != "lexi" and key[j] - key[i] > alpha:
                break
        k += 1
    return label


@pytest.mark.parametrize("sorting", ["2-norm", "1-norm", "lexi", "norm", "pca"])
def test_groups_equal_the_sequential_rule(sorting):
    rng = np.random.default_rng(2)
    for _ in range(30):
        points = rng.normal(size=(150, 2))
        if sorting != "1-norm":
            points = np.round(points, 1)
        got, starts = kernels.group_greedily(points, 0.2, sorting)
        assert got.tolist() == sequential(points, 0.2, sorting)
        assert all(((points[i] - points[starts[g]]) ** 2).sum() <= 0.2**2 + 1e-12 for i, g in enumerate(got))


def test_values_in_one_dimension():
    label, centres = kernels.group_values(np.array([0.0, 0.1, 0.5, 0.55, 2.0]), 0.2)
    assert label.tolist() == [0, 0, 1, 1, 2] and centres == pytest.approx([0.2, 0.7, 2.0])


def test_whole_lengths_carry_and_halve_to_even():
    assert kernels.whole_lengths([1.5, 1, 1, 1.5]).tolist() == [2, 1, 1, 1]
    assert kernels.whole_lengths([2.5]).tolist() == [2]
    assert kernels.whole_lengths([0.2, 3.0]).tolist() == [1, 2]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-3, 3), min_size=1, max_size=12), st.lists(st.floats(-3, 3), min_size=1, max_size=12))
def test_dtw_equals_its_table(x, y):
    got = kernels.dtw(np.array(x), np.array(y))
    want, path = kernels.dtw_path(np.array(x), np.array(y))
    assert got == pytest.approx(want, abs=1e-9)
    assert path[0] == (0, 0) and path[-1] == (len(x) - 1, len(y) - 1)


def test_symbols():
    assert symbols_of(4) == ["A", "a", "B", "b"] and symbols_of(3, 1) == ["A", "B", "C"] and symbols_of(2, 2) == ["a", "b"]
    assert symbols_of(52)[0] == "!" and symbols_of(51)[50] == "Z"
    assert symbols_of(2, ["x", "y"]) == ["x", "y"]
    with pytest.raises(ValueError):
        symbols_of(3, ["x", "y"])


@pytest.mark.parametrize("sorting", ["norm", "lexi", "pca"])
def test_points_in_parts_are_grouped_as_all_at_once(sorting):
    points = np.round(np.random.default_rng(5).normal(size=(5000, 2)), 1 if sorting != "pca" else 6)
    key, order = kernels.sort_keys(points, sorting)
    want, starts = kernels.group_greedily(points, 0.2, sorting)
    groups = kernels.Groups(0.2, part=64)
    label, first = groups.take(key[order], points[order])
    assert label.tolist() == want[order].tolist() and order[first].tolist() == starts.tolist()
    assert len(groups.label) < len(starts) / 2  # starts out of reach are let go
