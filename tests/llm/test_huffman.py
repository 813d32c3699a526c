import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import public_tokenizers
from tsymbol.llm import huffman as hf
from tsymbol.llm import split

DOCUMENTS = "/root/testdata/sf0.1/documents.parquet"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 5000), st.integers(1, 10**9), min_size=1, max_size=60), st.integers(6, 20))
def test_lengths_are_a_full_limited_code(counts, limit):
    lengths = hf.code_lengths(counts, limit)
    assert lengths.keys() == counts.keys() and max(lengths.values()) <= limit
    assert sum(2.0**-n for n in lengths.values()) == (1.0 if len(counts) > 1 else 0.5)


def test_lengths_are_optimal_without_a_limit():
    import heapq

    rng = np.random.default_rng(1)
    counts = {i: int(n) for i, n in enumerate(rng.integers(1, 1000, 200))}
    heap, total = list(counts.values()), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    assert sum(counts[i] * n for i, n in hf.code_lengths(counts, 20).items()) == total


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 129, 5000])
def test_bits_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.zipf(1.2, n) % 3000
    values, counts = np.unique(np.append(ids, 7), return_counts=True)
    code = hf.Code(hf.code_lengths(dict(zip(values.tolist(), counts.tolist(), strict=True))))
    bits, marks = code.encode(ids)
    assert (code.decode(bits, marks, n) == ids).all() and len(marks) == -(-n // hf.STRIDE)


def texts():
    return [(5, "Hello <|endoftext|> world"), (1, None), (9, ""), (1, "dup id"), (3, "a" * 4000), (None, "no id"), (2, "é世界 \n\n  x"), (7, "same"), (8, "same")]


@pytest.mark.parametrize("block", [4, 1 << 17])
def test_files_equal_the_library(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(hf, "BLOCK", block)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in texts()], "doc_id long, text string, n int, bucket string").repartition(3)
    folder = f"file://{tmp_path}/h"
    hf.write(df, folder, PATH, buckets=3)
    tk = Tokenizer.from_file(PATH)
    want = [(i, tk.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in texts()]
    got = sorted(hf.read(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in want), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), len(x), crc(x)) for i, x in want)


def ids_of(texts):
    library = hf.Library(open(PATH, encoding="utf-8").read(), public_tokenizers.PATTERN)
    ids, size = library.ids(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])]


def test_ids_of_texts_equal_the_library():
    rng = random.Random(4)
    tk = Tokenizer.from_file(PATH)
    made = [t for _, t in texts()] + ["\x00\x7f\xad ÿ", "'s 12 --", " a", "a ", " ", "a  b", "a \n b", "x\xa0 y\x85 z", "a\x1c b", "\u2003 x y", "it's don't 'll", "a <|endoftext|> b  c", "<|endoftext|>"]
    made += ["".join(rng.choice(["a", "B", " ", " ", "\n", "\t", "é", "世", "'s", "1", ".", ",", "\xa0", "\r\n", "<|endoftext|>"]) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    assert ids_of(made) == [tk.encode(t or "", add_special_tokens=False).ids for t in made]


@pytest.mark.skipif(not os.path.exists(DOCUMENTS), reason="the driver's tables are not here")
def test_all_documents_equal_the_library():
    tk, library = Tokenizer.from_file(PATH), hf.Library(open(PATH, encoding="utf-8").read(), public_tokenizers.PATTERN)
    for batch in pq.ParquetFile(DOCUMENTS).iter_batches(1000, columns=["text"]):
        ids, size = library.ids(batch.column(0))
        want = [x.ids for x in tk.encode_batch_fast([t or "" for t in batch.column(0).to_pylist()], add_special_tokens=False)]
        assert [len(x) for x in want] == size.tolist() and sum(want, []) == ids.tolist()


def test_memory_that_is_full_changes_nothing(monkeypatch):
    want = ids_of([t for _, t in texts()])
    for most in (0, 1, 5):
        monkeypatch.setattr(split.TextIds.__init__, "__defaults__", ((), None, most))
        assert ids_of([t for _, t in texts()]) == want


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    hf.write(df, f"file://{tmp_path}/e", PATH, buckets=2)
    assert hf.read(spark, f"file://{tmp_path}/e").count() == 0
