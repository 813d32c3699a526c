import hashlib
import random

import pytest
from pyspark.sql import functions as F

import public_tokenizers
import tiktoken
from tsymbol.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, ids string, n_tokens int"


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def texts():
    random.seed(1)
    return [
        None, "", " ", "a", "a" * 3000, "ab" * 400 + "c", "x" * 49, "y" * 48, "don't 12345 it's", " \n\n  é世界 \x00\t x", "ÿ" * 100, "\x1c a \x85b\xa0c",
        "".join(random.choice("abcdefgh") for _ in range(1500)), "two  spaces", "line \n end ", "<|endoftext|>", "Same", "Same", "🙂👍🏽 z" * 20, "tail ",
    ]


def rows(spark):
    return spark.createDataFrame([(i, t, "clash", 7) for i, t in enumerate(texts())], SCHEMA)


def test_ids_and_bytes_equal_the_library(spark, reference):
    df = rows(spark)
    made = bpe.encode(df, PATH, decoded="back")
    got = {r.doc_id: (list(r.ids), bytes(r.back)) for r in made.collect()}
    assert got == {i: (reference.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate(texts())}
    again = bpe.decode(made.drop("back"), PATH)
    assert {r.doc_id: bytes(r.decoded) for r in again.collect()} == {k: v for k, (_, v) in got.items()}


def test_digests(spark, reference):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in bpe.digests(rows(spark), PATH).collect():
        t = texts()[r.doc_id] or ""
        ids = reference.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(t.encode()))


def test_empty_tables_and_unknown_ids(spark):
    assert bpe.digests(spark.createDataFrame([], SCHEMA), PATH).count() == 0
    df = spark.createDataFrame([(1, None), (2, []), (3, [64, None, 999999])], "doc_id long, ids array<int>")
    assert {r.doc_id: bytes(r.decoded) for r in bpe.decode(df, PATH).collect()} == {1: b"", 2: b"", 3: b"a"}


def test_memory_that_is_full_changes_nothing(reference, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "DECODED", 100)
    codec = bpe.Codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    codec.open()
    codec.texts.most = 3
    for _ in range(2):
        ids, size = codec.ids(pa.array(texts()))
        assert size.tolist() == [len(reference.encode_ordinary(t or "")) for t in texts()]
        assert ids.tolist() == [i for t in texts() for i in reference.encode_ordinary(t or "")]
        assert codec.decode(ids, size) == [(t or "").encode() for t in texts()]


def test_repeated_rows_stay(spark):
    df = spark.createDataFrame([(5, "x y")] * 3, "doc_id long, text string")
    assert bpe.encode(df, PATH).agg(F.count("ids")).first()[0] == 3


def test_checked_encoding(spark, monkeypatch):
    df = rows(spark)
    want = {r.doc_id: list(r.ids) for r in bpe.encode(df, PATH).collect()}
    assert {r.doc_id: list(r.ids) for r in bpe.encode(df, PATH, checked=True).collect()} == want
    import pyarrow as pa

    codec = bpe.Codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    codec.open()
    ids, size = codec.ids(pa.array(["abc def"]))
    assert codec.decode(ids[::-1], size) != [b"abc def"]


def letters(n, alphabet="abcdefghijklmnopqrstuvwxyz"):
    return "".join(random.choices(alphabet, k=n))


def test_long_words_equal_the_library(reference):
    """Random and periodic words of all lengths around the windows', with windows that share no token."""
    random.seed(2)
    words = [letters(random.randint(40, 400), "abcdefghijklmnopqrstuvwxyzé"[: random.randint(1, 27)]) for _ in range(300)]
    words += [letters(random.randint(1, 13)) * random.randint(20, 200) for _ in range(60)]
    words += [letters(300) + "a" * 2000 + letters(300), letters(7) * 3000, "é" * 3000, "=-" * 2000, "x" * 97]
    codec = bpe.Codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    codec.open()
    ids, size = codec.learn(words)
    want = [reference._core_bpe.encode_single_piece(w.encode()) for w in words]
    assert size.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_a_word_of_a_million_letters(spark, reference):
    random.seed(4)
    word = letters(1_000_000)
    got = bpe.encode(spark.createDataFrame([(1, word)], "doc_id long, text string"), PATH, checked=True).first()
    assert list(got.ids) == reference.encode_ordinary(word)
