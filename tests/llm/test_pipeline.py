"""run() against plain Python over a small table with planted copies, and the registered queries over the smallest tables."""

import os
import random

import pytest

import __spark_entry__
import corpus_pipeline
import public_tokenizers
import tiktoken
from tests.llm.test_linededup import brute as without_copies
from tests.llm.test_minhash import brute as near_groups
from tests.llm.test_mixing import levels
from tests.llm.test_quality import brute as measured
from tsymbol.llm import bpe, linededup, minhash, mixing, quality
from tsymbol.llm import queries as q

SF = "/root/testdata/sf0.001"


def corpus():
    random.seed(11)
    word = lambda: "".join(random.choice("abcdefghijklm") for _ in range(random.randint(2, 8)))
    line = lambda: " ".join(word() for _ in range(12))
    shared = line()
    docs = []
    for i in range(60):
        lines = [" ".join(line() for _ in range(6 if i < 10 else 1)) for _ in range(random.randint(2, 8))]
        if i % 5 == 0:
            lines.insert(1, shared)
        docs.append([i, "\n".join(lines), "en", f"s{i % 3}"])
    for i in range(60, 70):  # near copies: a word more in every line, so that no line repeats
        docs.append([i, "\n".join(f"{x} {word()}" for x in docs[i - 60][1].split("\n")), "en", "s1"])
    docs += [[70, docs[3][1], "en", "s0"], [71, None, "en", "s0"], [72, "too short", "de", None], [73, "a " * 100, "de", None], [74, line() + "\n" + line(), "de", None]]
    return [(*d, len(d[1] or "")) for d in docs]


def test_run_equals_plain_python(spark, tmp_path):
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, list(r.ids)) for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect())
    docs = [(i, t, s) for i, t, _, s, _ in corpus() if measured(t, quality.Rules())[6]]
    cut = without_copies([(i, t) for i, t, _ in docs], linededup.MIN_CHARS)
    docs = [(i, cut[i, t][0], s) for i, t, s in docs if cut[i, t][2] < cut[i, t][1]]
    kept = set(near_groups([(i, t) for i, t, _ in docs], minhash.Near()))
    docs = [(i, t, s) for i, t, s in docs if any(k.startswith(f"({i},") and k.endswith("True)") for k in kept)]
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={}).encode_ordinary
    sizes, taken = {}, {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    by_id = {i: (t, s) for i, t, s in docs}
    for i, ids in got:
        assert ids == encode(by_id[i][0])
        taken[by_id[i][1]] = taken.get(by_id[i][1], 0) + len(by_id[i][0].split())
    want = levels(sizes, mixing.Mix())
    # a source's words come as near as half of the document at its limit, each of which has a bucket of its own here
    largest = {s: max(len(t.split()) for _, t, x in docs if x == s) for s in sizes}
    assert 0 < len(docs) < 66 and all(abs(taken.get(s, 0) - want[s]) <= largest[s] / 2 for s in sizes)


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame(corpus()[:8], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns


@pytest.mark.skipif(not os.path.exists(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_registered_query_runs(spark, name):
    assert q.QUERIES[name](spark, SF).count() > 0


def test_entry_lists_them():
    names = __spark_entry__.queries()
    assert set(q.QUERIES) <= set(names) and "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)
