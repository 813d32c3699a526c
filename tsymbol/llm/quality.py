"""Quality rules: base counts, and repetition measured with suffix arrays over the words and the characters of each document.

All documents of an Arrow batch share one prefix doubling in numpy: ranks start from (document, word), so that suffixes of
different documents never meet, and each round sorts only the suffixes that still tie. The ranks of every round give the
longest common prefix (LCP) of neighbours in the array by descending powers of two. The deepest LCP interval that holds a
suffix reaches max(lcp before, lcp after); where it has `min_words` words or more, that prefix is a maximal repeated
substring's occurrence. The union of these spans gives the covered words, the largest LCP the longest repeat.

The method's covered fraction takes in shorter repeats than the base rule, which sees five words and more: texts that stutter
or turn in small circles. Its longest repeat says more than the base rule only of runs that overlap themselves. Documents that pass both are
measured again over code points, white space included, so inside words too, with repeats of `min_chars` or more and limits of
their own. A document can hold such a repeat only where two of its windows of `min_chars` hash alike; the others need no array.

Defined results: a null or blank text has no words and fails the base rules. Repeated rows each give a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsymbol.llm.common import give_back
from tsymbol.llm.split import parts

#: Bytes of text that are measured together.
SLICE = 3_000_000
#: Words of the base rule's repeats.
BASE_WORDS = 5


@dataclass(frozen=True)
class Rules:
    """Limits. A document is kept if it passes the base rules and the limits of the method, over words and over characters."""

    min_doc_words: int = 10
    base_percent: int = 20  # base rule: words inside repeats of BASE_WORDS or more
    min_words: int = 4  # the method: a repeat has so many words at least
    max_repeat_percent: int = 25  # words inside such repeats; above the base rule's share, so that only shorter repeats decide
    max_longest_percent: int = 10  # longest repeat, in words of the document; the base rule bounds it unless it overlaps itself
    longest_floor: int = 50  # shorter longest repeats pass always
    min_chars: int = 200  # a repeat over characters; twice what lines of clean documents that repeat by chance or by habit reach
    max_char_percent: int = 10  # characters inside such repeats
    max_longest_char_percent: int = 4  # longest such repeat; under half of the above, as two copies cover twice their length


def suffix_ranks(doc: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Final ranks (places in the suffix array) and the ranks of each round k, where equal ranks share 2**k words."""
    n = len(word)
    key = doc.astype(np.int64) << 32 | word
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.append(True, sorted_key[1:] != sorted_key[:-1])
    first = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    rounds, step = [rank.copy()], 1
    end = np.searchsorted(doc, doc, side="right") if n else np.empty(0, np.int64)  # one past the document's last word
    sizes = np.diff(np.append(first, n))
    tied = order[np.repeat(sizes > 1, sizes)]
    while len(tied):
        after = tied + step
        inside = after < end[tied]
        second = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        pair = rank[tied] * (n + 1) + second
        by = np.argsort(pair, kind="stable")
        tied, pair = tied[by], pair[by]
        base = rank[tied]
        new = np.append(True, pair[1:] != pair[:-1])
        group = np.append(True, base[1:] != base[:-1])
        at = np.arange(len(tied))
        begin = np.maximum.accumulate(np.where(group, at, 0))
        start = np.maximum.accumulate(np.where(new, at, 0))
        rank[tied] = base + start - begin
        rounds.append(rank.copy())
        sizes = np.diff(np.append(np.flatnonzero(new), len(tied)))
        tied = tied[np.repeat(sizes > 1, sizes)]
        step *= 2
    return rank, rounds


def neighbour_lcp(doc: np.ndarray, rank: np.ndarray, rounds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and the LCP in words of each entry with the one before (0 for the first)."""
    n = len(rank)
    array = np.empty(n, np.int64)
    array[rank] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return array, lcp
    live = np.flatnonzero(rounds[0][array[1:]] == rounds[0][array[:-1]]) + 1
    a, b, got = array[live - 1], array[live], np.zeros(len(live), np.int64)
    end = np.searchsorted(doc, doc[a], side="right") if len(live) else a
    for k in range(len(rounds) - 1, -1, -1):
        x, y = a + got, b + got
        fits = (x < end) & (y < end)
        same = np.zeros(len(live), bool)
        same[fits] = rounds[k][x[fits]] == rounds[k][y[fits]]
        # equal ranks of round k mean 2**k equal words, unless the suffix was alone already
        same &= x != y
        got[same] += 1 << k
    lcp[live] = got
    return array, lcp


def deepest_repeats(doc: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The length of the longest repeat that begins at each word: the depth of the deepest LCP interval that holds its suffix."""
    deepest = np.zeros(len(word), np.int64)
    if len(word):
        array, lcp = neighbour_lcp(doc, *suffix_ranks(doc, word))
        deepest[array] = np.maximum(lcp, np.append(lcp[1:], 0))
    return deepest


def covered(doc: np.ndarray, deepest: np.ndarray, n_docs: int, least: int) -> np.ndarray:
    """For each document: words inside the union of its repeats of `least` words or more."""
    at = np.arange(len(deepest))
    reach = np.maximum.accumulate(np.where(deepest >= least, at + deepest, 0))
    return np.bincount(doc[reach > at], minlength=n_docs)


def longest(doc: np.ndarray, deepest: np.ndarray, n_docs: int) -> np.ndarray:
    """For each document: words of its longest repeat."""
    out = np.zeros(n_docs, np.int64)
    np.maximum.at(out, doc, deepest)
    return out


def suspects(doc: np.ndarray, code: np.ndarray, size: int) -> np.ndarray:
    """The documents in which two windows of `size` characters hash alike: all that repeat so many, and few others."""
    if len(code) < size:
        return np.empty(0, np.int64)
    mixed = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    base = 0xD1342543DE82EF95
    powers = lambda b: np.cumprod(np.full(len(code), b, np.uint64))
    sums = np.append(np.uint64(0), np.cumsum(mixed * powers(base)))
    whole = doc[: len(doc) - size + 1] == doc[size - 1 :]
    at = doc[: len(whole)][whole]
    window = ((sums[size:] - sums[:-size]) * powers(pow(base, -1, 1 << 64))[: len(whole)])[whole] ^ (at.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
    ordered = np.sort(window)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    return np.unique(at[np.isin(window, twice)]) if len(twice) else np.empty(0, np.int64)


def char_repeats(texts: list[bytes], min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: its code points, those inside repeats of min_chars or more, and those of the longest repeat (0 if below)."""
    coded = [np.frombuffer(x.decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for x in texts]
    size = np.fromiter(map(len, coded), np.int64, len(coded))
    inside, most = np.zeros(len(coded), np.int64), np.zeros(len(coded), np.int64)
    if size.sum():
        held = suspects(np.repeat(np.arange(len(coded)), size), np.concatenate(coded), min_chars)
        if len(held):
            doc = np.repeat(np.arange(len(held)), size[held])
            deepest = deepest_repeats(doc, np.concatenate([coded[k] for k in held]).astype(np.int64))
            deepest[deepest < min_chars] = 0
            inside[held], most[held] = covered(doc, deepest, len(held), min_chars), longest(doc, deepest, len(held))
    return size, inside, most


def _measure(texts: list[bytes], rules: Rules) -> dict[str, np.ndarray]:
    split = [x.split() for x in texts]
    n_words = np.fromiter(map(len, split), np.int64, len(split))
    doc = np.repeat(np.arange(len(split)), n_words)
    flat = [w for x in split for w in x]
    word = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64) if flat else np.empty(0, np.int64)
    deepest = deepest_repeats(doc, word)
    repeated, own, most = covered(doc, deepest, len(split), BASE_WORDS), covered(doc, deepest, len(split), rules.min_words), longest(doc, deepest, len(split))
    chars = [len(x.decode("utf-8", "replace")) - sum(map(x.count, (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"))) for x in texts]
    symbols = [sum(map(x.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))) for x in texts]
    dup = []
    for x in texts:
        lines = [y for y in x.split(b"\n") if y and not y.isspace()]
        dup.append(len(lines) - len(set(lines)))
    failed = (n_words < rules.min_doc_words) | (100 * repeated > rules.base_percent * n_words)
    method = (100 * own <= rules.max_repeat_percent * n_words) & ((most < rules.longest_floor) | (100 * most <= rules.max_longest_percent * n_words))
    kept = ~failed & method
    size, in_chars, longest_chars = char_repeats([x for x, k in zip(texts, kept, strict=True) if k], rules.min_chars)
    kept[kept] = (100 * in_chars <= rules.max_char_percent * size) & (100 * longest_chars <= rules.max_longest_char_percent * size)
    return {"n_words": n_words, "word_chars": np.array(chars, np.int64), "n_symbols": np.array(symbols, np.int64), "n_dup_lines": np.array(dup, np.int64), "n_repeat_words": repeated, "base_failed": failed, "kept": kept, "longest_repeat": most}


MEASURES = T.StructType([T.StructField(n, T.BooleanType() if n in ("base_failed", "kept") else T.LongType(), False) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "longest_repeat")])


def measure(df: DataFrame, rules: Rules | None = None, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, the counts, base_failed, kept (the verdict) and longest_repeat of each row. No shuffle."""
    rules = rules or Rules()
    source = df.select(*keep, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("\0text"))
    schema = T.StructType([*source.schema.fields[:-1], *MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in parts(whole, SLICE):
                got = _measure(part.column(part.num_columns - 1).to_pylist(), rules)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(got[f.name]) for f in MEASURES)], names=[f.name for f in schema])
        give_back()

    return source.mapInArrow(run, schema)


def keep_good(df: DataFrame, rules: Rules | None = None, *, text: str = "text") -> DataFrame:
    """The rows of df that are kept, with all their columns and no others."""
    rules = rules or Rules()
    columns = df.columns
    source = df.select("*", F.coalesce(F.col(text), F.lit("")).cast("binary").alias("\0text"))
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in parts(whole, SLICE):
                kept = _measure(part.column(part.num_columns - 1).to_pylist(), rules)["kept"]
                yield pa.RecordBatch.from_arrays(part.columns[:-1], names=columns).filter(pa.array(kept))
        give_back()

    return source.mapInArrow(run, schema)
