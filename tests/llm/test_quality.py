import random
import re
from collections import Counter

import numpy as np

from tsymbol.llm import quality as q

SCHEMA = "doc_id long, text string, kept boolean, n_words string"


def brute(text, rules):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)

    def inside(size):
        windows = Counter(tuple(words[i : i + size]) for i in range(n - size + 1))
        return {k for i in range(n - size + 1) if windows[tuple(words[i : i + size])] > 1 for k in range(i, i + size)}

    covered = inside(5)
    longest = max((m for m in range(1, n) if len({tuple(words[i : i + m]) for i in range(n - m + 1)}) < n - m + 1), default=0)
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = n < 10 or 100 * len(covered) > 20 * n
    fine = 100 * len(inside(rules.min_words)) <= rules.max_repeat_percent * n and (longest < rules.longest_floor or 100 * longest <= rules.max_longest_percent * n)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed, not failed and fine, longest)


def texts():
    random.seed(2)
    out = [None, "", " \n\t ", "a", "é#ß $$ <b>\x85\xa0 x\n\nx\nx", "a " * 60, "one two three four five six " * 4]
    out += [" ".join(random.choice("abcd") for _ in range(random.randint(0, 60))) for _ in range(60)]
    out += ["\n".join(" ".join(random.choice(["w%d" % k for k in range(300)]) for _ in range(12)) for _ in range(20)) for _ in range(10)]
    return out


def test_counts_equal_brute_force(spark):
    rules = q.Rules(longest_floor=4, max_longest_percent=10)
    df = spark.createDataFrame([(i, t, None, "x") for i, t in enumerate(texts())], SCHEMA)
    got = {r.doc_id: tuple(r)[1:] for r in q.measure(df, rules).collect()}
    assert got == {i: brute(t, rules) for i, t in enumerate(texts())}


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(3)
    doc = np.sort(rng.integers(0, 5, 200))
    word = rng.integers(0, 3, 200)
    rank, rounds = q.suffix_ranks(doc, word)
    array, lcp = q.neighbour_lcp(doc, rank, rounds)
    suffix = lambda i: (doc[i], word[i : np.searchsorted(doc, doc[i], side="right")].tolist())
    assert [suffix(i) for i in array] == sorted(suffix(i) for i in range(200))
    for k in range(1, 200):
        a, b = suffix(array[k - 1]), suffix(array[k])
        same = 0
        while a[0] == b[0] and same < min(len(a[1]), len(b[1])) and a[1][same] == b[1][same]:
            same += 1
        assert lcp[k] == same


def test_keeping_leaves_the_columns_alone(spark):
    df = spark.createDataFrame([(i, t, None, "x") for i, t in enumerate(texts())], SCHEMA)
    kept = q.keep_good(df)
    assert kept.schema == df.schema
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, t in enumerate(texts()) if brute(t, q.Rules())[6]]
    assert q.keep_good(df.filter("false")).count() == 0 and q.measure(df.filter("false")).count() == 0


def unlike(rng, n):
    """n words that repeat nothing of length."""
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n)]


def test_limits_over_characters_reject_what_the_base_rule_keeps():
    rng = random.Random(5)
    passage, short, rest = unlike(rng, 270), unlike(rng, 105), unlike(rng, 3000)
    glued = "".join(unlike(rng, 100))
    cases = {
        "passage twice": rest[:1230] + passage + rest[1230:2460] + passage,
        "longest only": rest[:1400] + passage[:135] + rest[1400:2730] + passage[:135],
        "covered only": rest[:900] + short + rest[900:1800] + short + rest[1800:2685] + short,
        "inside words": [*rest[:400], glued + "x", *rest[400:800], "y" + glued],
        "once": rest[:2730] + passage,
        "a line twice": rest[:200] + passage[:16] + rest[200:400] + passage[:16],
        "a passage in a long text": rest[:2850] + passage[:60] + passage[100:110] + passage[:60],
    }
    got = q._measure([" ".join(x).encode() for x in cases.values()], q.Rules())
    assert not got["base_failed"].any()
    assert dict(zip(cases, got["kept"].tolist(), strict=True)) == {k: k in ("once", "a line twice", "a passage in a long text") for k in cases}
    size, covered, longest = q.char_repeats([" ".join(cases[k]).encode() for k in ("longest only", "covered only")], 200)
    assert 100 * covered[0] < 10 * size[0] and 100 * longest[0] > 4 * size[0] and 100 * covered[1] > 10 * size[1] and 100 * longest[1] < 4 * size[1]


def test_repeats_over_characters_equal_brute_force():
    rng = random.Random(6)
    made = ["", "é", "aé" * 30, *("".join(rng.choice("ab é") for _ in range(rng.randint(0, 90))) for _ in range(60))]
    size, covered, longest = q.char_repeats([x.encode() for x in made], 7)
    for k, x in enumerate(made):
        n = len(x)
        windows = Counter(x[i : i + 7] for i in range(n - 6))
        inside = {j for i in range(n - 6) if windows[x[i : i + 7]] > 1 for j in range(i, i + 7)}
        most = max((m for m in range(7, n) if len({x[i : i + m] for i in range(n - m + 1)}) < n - m + 1), default=0)
        assert (size[k], covered[k], longest[k]) == (n, len(inside), most)


def test_stuttering_passes_the_base_rule_and_not_the_method():
    rng = random.Random(8)
    some = unlike(rng, 40)
    cases = {
        "each word five times": [w for w in some for _ in range(5)],
        "each word once": some,
        "small circles": [w for i in range(0, 40, 4) for w in some[i : i + 4] + [some[i]] + some[i : i + 4]],
        "four words twice": some[:20] + some[:4] + some[20:],
    }
    got = q._measure([" ".join(x).encode() for x in cases.values()], q.Rules())
    assert dict(zip(cases, zip(got["base_failed"].tolist(), got["kept"].tolist()), strict=True)) == {k: (False, k in ("each word once", "four words twice")) for k in cases}


def test_very_long_text():
    rng = random.Random(9)
    words = unlike(rng, 150_000)
    got = q._measure([" ".join(words + words[:20_000]).encode(), ("a " * 200_000).encode(), b"x" * 2_000_000], q.Rules())
    assert got["n_words"].tolist() == [170_000, 200_000, 1] and got["base_failed"].tolist() == [True, True, True]
    assert got["longest_repeat"].tolist() == [20_000, 199_999, 0]
