import random
import re
from math import comb

import numpy as np
import pytest

from tsymbol.llm import minhash as mh
from tsymbol.llm.components import components

SCHEMA = "doc_id long, text string, n long, comp string, least int"


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def brute(rows, near):
    sets = [shingle_set(t, near.shingle) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= near.percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    least = {r: min((i for i in g if i is not None), default=None) for r, g in groups.items()}
    return sorted(str((i, len(sets[k]), least[find(k)], i == least[find(k)])) for k, (i, _) in enumerate(rows))


def corpus(n_families=12, size=8):
    random.seed(6)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(4))
    rows, i = [], 0
    for _ in range(n_families):
        base = [word() for _ in range(random.randint(20, 120))]
        for _ in range(size):
            text = list(base)
            for _ in range(random.randint(0, 3)):
                text[random.randrange(len(text))] = word()
            rows.append((i, " ".join(text)))
            i += 1
    rows += [(900, None), (901, ""), (902, " \n"), (903, "Two words"), (904, "two WORDS"), (905, "two"), (906, "ÉA b c"), (907, "éa b c"), (908, rows[0][1].upper()), (3, rows[len(rows) // 2][1]), (3, "quite another text with that id here"), (None, rows[0][1]), (None, "no id at all here"), (910, "two"), (910, "two")]
    return rows


@pytest.mark.parametrize("settings", [{"percent": 85, "shingle": 3}, {"percent": 80, "shingle": 5, "tile": 3}])
def test_components_equal_brute_force(spark, settings):
    near = mh.Near(**settings)
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "x", 0) for i, t in rows], SCHEMA)
    got = sorted(str((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in mh.link(df, near).collect())
    assert got == brute(rows, near)


@pytest.mark.parametrize("tiles", [{"tile": 16}, {"tile_items": 200}])
def test_family_around_the_threshold(spark, tiles):
    """Many texts whose pairs lie on both sides of the threshold: buckets that a star can't settle."""
    random.seed(7)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(60):
        text = list(base)
        for k in random.sample(range(60), random.randint(1, 5)):
            text[k] = f"x{i}.{k}"
        rows.append((i, " ".join(text)))
    near = mh.Near(percent=85, shingle=3, **tiles)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in mh.link(df, near).collect()) == brute(rows, near)


def test_dedup_keeps_columns_and_one_of_each(spark):
    rows = corpus(4, 4)
    df = spark.createDataFrame([(i, t, 1, "x", 0) for i, t in rows], SCHEMA)
    made = mh.dedup(df, mh.Near())
    assert made.schema == df.schema
    kept = [r.doc_id for r in mh.link(df, mh.Near()).filter("kept").collect()]
    assert set(kept) == {r.doc_id for r in made.collect()}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mh.link(df).count() == 0 and mh.dedup(df).count() == 0


@pytest.mark.parametrize("near", [mh.Near(85, 3), mh.Near(80, 5)])
def test_losses_at_the_threshold(near):
    """The exact chances, for a pair of just the least similarity, to share no band and to be dropped by any of the looks."""
    t, lost, still = near.percent / 100, 0.0, np.ones(1)
    batch = np.array([comb(near.batch, m) * t**m * (1 - t) ** (near.batch - m) for m in range(near.batch + 1)])
    for least in mh.least_equal(near.percent, near.batch, near.permutations, near.miss):
        still = np.convolve(still, batch)
        lost += still[:least].sum()
        still[:least] = 0
    assert lost < 2e-5 and (1 - t**near.rows) ** (near.permutations // near.rows) < 1e-5


def test_sequential_bounds():
    least = mh.least_equal(80, 32, 256, 1e-4)
    assert len(least) == 8 and list(least) == sorted(least) and least[-1] < 0.8 * 256
    rng = np.random.default_rng(8)
    a = rng.integers(0, 60000, (200, 256)).astype(np.uint16)
    b = np.where(rng.random((200, 256)) < 0.85, a, a + np.uint16(1))
    assert mh.survives(a, b, mh.Near()).all() and not mh.survives(a, np.roll(a, 1, axis=0), mh.Near()).any()


def test_signatures_estimate_similarity():
    texts = [" ".join(f"w{k}" for k in range(300)).encode(), " ".join(f"w{k}" for k in range(60, 360)).encode()]
    near = mh.Near(shingle=1)
    flat, size = mh.shingles(texts, 1, near.seed)
    sig = mh.signatures(flat, size, near)
    assert abs((sig[0] == sig[1]).mean() - 240 / 360) < 0.12


def test_components_of_random_graphs(spark):
    random.seed(9)
    edges = [(a, a + 1) for a in range(0, 60)] + [(1000, b) for b in range(1001, 1100)] + [(random.randrange(2000, 2300), random.randrange(2000, 2300)) for _ in range(150)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
