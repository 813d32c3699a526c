"""numpy kernels that run inside Arrow batches. Segmentation advances all series of a batch together, a point a step."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Slack of the segmentation test.
EPSILON = float(np.finfo(float).eps)


@dataclass
class Pieces:
    """Pieces of all series one after the other; `count` says how many each has."""

    count: np.ndarray
    length: np.ndarray
    inc: np.ndarray
    err: np.ndarray
    end_value: np.ndarray

    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.count)])


def segment(flat: np.ndarray, sizes: np.ndarray, tol: float, max_len: float = np.inf) -> Pieces:
    """Greedy polygonal chains of many series at once.

    A piece from x[s] grows while its squared distance from the line is at most tol * (m - 1) + eps and m - 1 < max_len for
    its length m; a piece of length 1 is always fine, so that no input can stall. The distance follows from running sums of
    y = x - x[s]: A = sum y^2 and B = sum i*y give err = A - 2 (y_m / m) B + (y_m / m)^2 m (m + 1) (2 m + 1) / 6.
    Series of fewer than two points have no pieces. Values must be finite.
    """
    sizes = np.asarray(sizes, np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else np.empty(0, np.int64)
    order = np.argsort(-sizes, kind="stable")  # the long ones first: those still running are a prefix
    at, size = begin[order], sizes[order]
    n = len(sizes)
    anchor = flat[np.minimum(at, len(flat) - 1)] if n and len(flat) else np.zeros(n)
    anchor = np.where(size > 0, anchor, 0.0)
    a, b, m = np.zeros(n), np.zeros(n), np.zeros(n)
    inc, err = np.zeros(n), np.zeros(n)
    out: list[tuple] = []

    def emit(who: np.ndarray, step: int) -> None:
        out.append((order[who], np.full(len(who), step), m[who].copy(), inc[who].copy(), err[who].copy(), anchor[who] + inc[who]))

    longest = int(size[0]) if n else 0
    live = n
    for step in range(1, longest):
        while live and size[live - 1] <= step:
            live -= 1
        s = slice(0, live)
        x = flat[at[s] + step]
        y = x - anchor[s]
        m1 = m[s] + 1
        a1, b1 = a[s] + y * y, b[s] + m1 * y
        slope = y / m1
        e = np.maximum(a1 - 2 * slope * b1 + slope * slope * m1 * (m1 + 1) * (2 * m1 + 1) / 6, 0.0)
        fits = (m1 == 1) | ((e <= tol * (m1 - 1) + EPSILON) & (m1 - 1 < max_len))
        new = np.flatnonzero(~fits)
        if len(new):
            emit(new, step)
            anchor[new] = flat[at[new] + step - 1]
            y_new = x[new] - anchor[new]
            a1[new], b1[new], m1[new], y[new], e[new] = y_new * y_new, y_new, 1.0, y_new, 0.0
        a[s], b[s], m[s], inc[s], err[s] = a1, b1, m1, y, np.where(m1 == 1, 0.0, e)
        ended = np.flatnonzero(size[s] == step + 1)
        if len(ended):
            emit(ended, step + 1)
    if not out:
        none = np.empty(0)
        return Pieces(np.zeros(n, np.int64), none.astype(np.int64), none, none, none)
    who, when, length, rise, error, end = (np.concatenate(x) for x in zip(*out, strict=True))
    by = np.lexsort((when, who))
    return Pieces(np.bincount(who, minlength=n), length[by].astype(np.int64), rise[by], error[by], end[by])


def segment_directly(x: np.ndarray, tol: float, max_len: float = np.inf, norm: int = 2) -> list[tuple[int, float, float]]:
    """The same for one series, with every distance summed point by point; a check of segment(). norm 1 sums absolute distances.
    A bound of tol^2 a point is segment() with tol squared."""
    out, s, e = [], 0, 1
    last = None
    while e < len(x):
        m = e - s
        line = x[s] + (x[e] - x[s]) / m * np.arange(m + 1)
        d = float((np.abs(line - x[s : e + 1]) ** norm).sum())
        if m == 1 or (d <= tol * (m - 1) + EPSILON and m - 1 < max_len):
            last, e = (m, float(x[e] - x[s]), d), e + 1
        else:
            out.append(last)
            s = e - 1
    return out + ([last] if last else [])


# --- greedy sorted aggregation


def sort_keys(points: np.ndarray, sorting: str) -> tuple[np.ndarray, np.ndarray]:
    """Key of each point and the order of the points; ties go by place."""
    if sorting in ("2-norm", "norm"):
        key = np.sqrt((points * points).sum(1))
    elif sorting == "1-norm":
        key = np.abs(points).sum(1)
    elif sorting == "pca":
        key = principal(points)
    elif sorting == "lexi":
        return points[:, 0], np.lexsort((points[:, 1], points[:, 0]))
    else:
        raise ValueError(f"unknown sorting {sorting!r}")
    return key, np.argsort(key, kind="stable")


def principal(points: np.ndarray) -> np.ndarray:
    """Projection on the first principal axis of the centred points, turned so that the first point is not above 0."""
    centred = points - points.mean(0)
    values, axes = np.linalg.eigh(centred.T @ centred)
    key = centred @ axes[:, np.argmax(values)]
    return key * (-1.0 if len(key) and key[0] > 0 else 1.0)


def group_greedily(points: np.ndarray, alpha: float, sorting: str, *, sound: bool = False, key: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Label of each point, and the starting point of each label.

    In key order, the first point without a label starts a group and takes all later free points within alpha of it. No
    point whose key lies further off than alpha can be so near, except for the 1-norm: there the scan ends at the first
    free point beyond both, as long as `sound` doesn't widen it to the bound that holds, alpha * sqrt(2)."""
    own, order = sort_keys(points, sorting)
    if key is not None:
        own, order = key, np.argsort(key, kind="stable")
    ordered, keys = points[order], own[order]
    label, starts = np.full(len(points), -1), []
    narrow = sorting == "1-norm" and not sound
    reach = alpha * (np.sqrt(2) if sorting == "1-norm" else 1.0)
    for i in range(len(ordered)):
        if label[i] >= 0:
            continue
        stop = np.searchsorted(keys, keys[i] + reach * (1 + 1e-12) + 1e-300, side="right")
        free = i + np.flatnonzero(label[i:stop] < 0)
        near = ((ordered[free] - ordered[i]) ** 2).sum(1) <= alpha**2
        if narrow:
            barred = np.flatnonzero(~near & (keys[free] - keys[i] > alpha))
            if len(barred):
                near[barred[0] :] = False
        label[free[near]] = len(starts)
        label[i] = len(starts)
        starts.append(order[i])
    out = np.empty(len(points), np.int64)
    out[order] = label
    return out, np.array(starts, np.int64)


class Groups:
    """group_greedily() of points that come in order of key, a part at a time, for all sortings but the 1-norm.

    A point belongs to the first start within alpha of it, and starts a group where there is none. Starts whose key lies more
    than alpha below the part's are out of reach of all that follow and are let go, so only those within reach are held."""

    def __init__(self, alpha: float, part: int = 4096):
        self.alpha, self.part, self.count = alpha, part, 0
        self.key, self.points, self.label = np.empty(0), np.empty((0, 2)), np.empty(0, np.int64)

    def take(self, key: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label of each point, and whether it starts a group."""
        label, first = np.empty(len(key), np.int64), np.zeros(len(key), bool)
        for a in range(0, len(key), self.part):
            s = slice(a, a + self.part)
            label[s], first[s] = self._take(key[s], points[s])
        return label, first

    def _take(self, key: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held = self.key + self.alpha * (1 + 1e-12) + 1e-300 >= key[0]
        self.key, self.points, self.label = self.key[held], self.points[held], self.label[held]
        label, first = np.full(len(key), -1), np.zeros(len(key), bool)
        free, alpha2 = np.arange(len(key)), self.alpha**2
        for p, k in zip(self.points, self.label, strict=True):
            near = ((points[free] - p) ** 2).sum(1) <= alpha2
            label[free[near]] = k
            free = free[~near]
            if not len(free):
                break
        new = []
        while len(free):
            i = free[0]
            near = ((points[free] - points[i]) ** 2).sum(1) <= alpha2
            near[0] = True
            label[free[near]] = self.count
            first[i] = True
            new.append(i)
            self.count += 1
            free = free[~near]
        if new:
            self.key, self.points = np.concatenate([self.key, key[new]]), np.concatenate([self.points, points[new]])
            self.label = np.concatenate([self.label, label[new]])
        return label, first


def group_values(values: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """1-D groups of half-width alpha around centres one alpha above their least member (the last ones around it)."""
    order = np.argsort(values, kind="stable")
    label, centres = np.full(len(values), -1), []
    for at, i in enumerate(order):
        if label[i] >= 0:
            continue
        centre = values[i] + alpha if values[i] < values[order[-1]] - alpha else values[i]
        later = order[at:]
        inside = later[(np.abs(values[later] - centre) <= alpha * (1 + 1e-12)) & (label[later] < 0)]
        label[inside] = len(centres)
        label[i] = len(centres)
        centres.append(centre)
    return label, np.array(centres)


# --- reconstruction and distances


def whole_lengths(lengths: np.ndarray) -> np.ndarray:
    """Integer lengths of at least 1 that carry the rounding error on; halves go to the even number, the last is only rounded."""
    out, carry = [], 0.0
    for k, x in enumerate(lengths):
        want = x + carry
        got = float(np.rint(want))
        if k < len(lengths) - 1 and got == 0:
            got = 1.0
        carry = want - got
        out.append(got)
    return np.array(out)


def stitch(lengths: np.ndarray, incs: np.ndarray, start: float) -> np.ndarray:
    """Points of a polygonal chain; a piece of no length adds none but shifts what follows."""
    parts, now = [np.array([start])], start
    for n, inc in zip(lengths.astype(int), incs, strict=True):
        if n > 0:
            parts.append(now + np.arange(1, n + 1) / n * inc)
        now += inc
    return np.concatenate(parts)


def dtw(x: np.ndarray, y: np.ndarray) -> float:
    """Dynamic time warping with squared differences, full window. Rows of the cost matrix by a running minimum."""
    if not len(x) or not len(y):
        return float("nan")
    last = np.cumsum((x[0] - y) ** 2)
    for v in x[1:]:
        cost = (v - y) ** 2
        best = np.minimum(last, np.concatenate([[np.inf], last[:-1]]))
        total = np.cumsum(cost)
        # d[j] = cost[j] + min(best[j], d[j-1])  =>  d = total + running min of (best - total before j)
        last = total + np.minimum.accumulate(best - (total - cost))
    return float(last[-1])


def dtw_path(x: np.ndarray, y: np.ndarray, dist=None, drop_straight: bool = False) -> tuple[float, list[tuple[int, int]]]:
    """The distance with any pointwise cost, and the warping path; drop_straight first removes points on straight stretches."""
    if drop_straight:
        bent = lambda v: v[np.concatenate([[True], np.abs(np.diff(v, 2)) > 1e-14, [True]])] if len(v) > 2 else v
        x, y = bent(np.asarray(x, float)), bent(np.asarray(y, float))
    cost = np.array([[dist(a, b) for b in y] for a in x]) if dist else (np.asarray(x, float)[:, None] - np.asarray(y, float)[None, :]) ** 2
    total = np.full((len(x) + 1, len(y) + 1), np.inf)
    total[0, 0] = 0
    for i in range(len(x)):
        for j in range(len(y)):
            total[i + 1, j + 1] = cost[i, j] + min(total[i, j], total[i, j + 1], total[i + 1, j])
    i, j, path = len(x), len(y), []
    while i and j:
        path.append((i - 1, j - 1))
        i, j = min(((i - 1, j - 1), (i - 1, j), (i, j - 1)), key=lambda p: total[p])
    return float(total[-1, -1]), path[::-1]
