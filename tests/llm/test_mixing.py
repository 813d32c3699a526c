import re

import pytest
from pyspark.sql import functions as F

from tsymbol.llm import mixing as m

SCHEMA = "doc_id long, text string, source string, size int, repeats string"


def rows():
    out = [(i, "w " * (1 + i % 37), f"s{i % 5}", 0, "x") for i in range(400)]
    out += [(1000, None, None, 0, "x"), (1001, "a\x85b c", None, 0, "x"), (1002, "", "s1", 0, "x"), (1003, "x", "", 0, "x"), (1004, None, "empty", 0, "x"), (None, "p q", "Z", 0, "x"), (7, "twice twice", "s2", 0, "x"), (7, "twice twice", "s2", 0, "x")]
    return out


def levels(sizes, mix):
    """Share, cap, and share again what the caps leave over."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mix.weights[k % len(mix.weights)] for k, s in enumerate(names)}
    left, open_, out = sum(sizes.values()) * mix.budget_percent / 100, set(names), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > mix.max_epochs * sizes[s]}
        for s in over or open_:
            out[s] = mix.max_epochs * sizes[s] if over else share * weight[s]
        left -= sum(out[s] for s in over)
        open_ -= over or open_
    return out


def test_targets_and_takes(spark):
    mix = m.Mix()
    df = spark.createDataFrame(rows(), SCHEMA)
    size, source_size, target, repeats, *_ = m.planned(df)
    made = m.plan(df, mix).select("doc_id", "source", F.col(size).alias("n"), F.col(source_size).alias("of"), F.col(target).alias("aim"), F.col(repeats).alias("times")).collect()
    assert len(made) == len(rows())
    sizes = {}
    for _, t, s, *_ in rows():
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken = levels(sizes, mix), {}
    for r in made:
        assert r.of == sizes[r.source] and r.aim == pytest.approx(want[r.source]) and 0 <= r.times <= 2
        taken[r.source] = taken.get(r.source, 0) + r.times * r.n
    assert all(abs(taken[s] - want[s]) <= 40 for s in sizes)  # half of the largest bucket
    again = m.plan(df.repartition(3), mix).select("doc_id", "text", F.col(repeats).alias("times")).collect()
    assert sorted(map(str, again)) == sorted(map(str, m.plan(df, mix).select("doc_id", "text", F.col(repeats).alias("times")).collect()))
    copies = m.sample(df, mix)
    assert copies.schema == df.schema and copies.count() == sum(r.times for r in made)


def test_all_sources_capped(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, "c", "y")], "doc_id long, text string, source string")
    mix = m.Mix(budget_percent=300)
    assert {r.source: r.target for r in m.plan(df, mix).collect()} == {"x": 4.0, "y": 2.0}


def test_empty_and_wordless(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert m.plan(df).count() == 0 and m.sample(df).count() == 0
    blank = spark.createDataFrame([(1, " ", "x"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.repeats) for r in m.plan(blank).collect()] == [(0, 0.0, 0)] * 2


def test_source_of_null_or_equal_ids_is_split(spark):
    rows = [(None, f"w{i} " * 10, "a") for i in range(300)] + [(7, f"w{i} " * 10, "b") for i in range(300)] + [(i, "x " * 10, "c") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r.source: (r.taken, r.target) for r in m.plan(df).groupBy("source").agg(F.sum(F.col("size") * F.col("repeats")).alias("taken"), F.first("target").alias("target")).collect()}
    assert all(abs(a - b) <= 60 for a, b in taken.values())
