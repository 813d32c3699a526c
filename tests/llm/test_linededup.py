import random

from tsymbol.llm import linededup as ld

SCHEMA = "doc_id long, text string, n_lines string, h int, runs int"


BLANK = " \t\r\x0b\x0c"


def brute(docs, least):
    """Of every run of lines, of any number, that has enough characters, all copies but the first go, with the blank lines inside."""
    order = sorted({d for d in docs}, key=lambda d: (d[0] is not None, d[0] or 0))
    first, gone = {}, set()
    seqs = {d: [x.strip(BLANK) for x in (d[1] or "").split("\n") if x.strip(BLANK)] for d in order}
    for d in order:
        lines = seqs[d]
        for a in range(len(lines)):
            for m in range(1, len(lines) - a + 1):
                run = tuple(lines[a : a + m])
                if first.setdefault(run, (d, a)) != (d, a) and sum(map(len, run)) >= least:
                    gone |= {(d, k) for k in range(a, a + m)}
    out = {}
    for d in order:
        k, kept, blanks = -1, [], []
        for x in (d[1] or "").split("\n"):
            if not x.strip(BLANK):
                blanks.append((k, x))
                kept.append(("blank", k, x))
                continue
            k += 1
            kept.append(("gone" if (d, k) in gone else "line", k, x))
        text = [x for what, k, x in kept if what == "line" or what == "blank" and not ((d, k) in gone and (d, k + 1) in gone)]
        out[d] = ("\n".join(text), len(seqs[d]), sum((d, k) in gone for k in range(len(seqs[d]))))
    return out


def corpus():
    random.seed(10)
    some = ["aa", "bbb", "cccc cccc", "", "  ", "d" * 25, " e e ", "f" * 9]
    docs = [(i, "\n".join(random.choice(some) for _ in range(random.randint(0, 14)))) for i in range(40)]
    long = "\n".join(f"line number {k} of a long text" for k in range(70))
    return docs + [(100, None), (101, ""), (102, "\n\n"), (103, long), (104, "own first line here\n" + long + "\nown last line here"), (105, long), (106, "line number 5 of a long text")]


def test_equals_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "x", 1, 1) for i, t in docs], SCHEMA)
    n_lines, n_deleted, *_ = ld.counted(df)
    got = {r.doc_id: (r.text, r[n_lines], r[n_deleted]) for r in ld.dedup(df, min_chars=10).collect()}
    assert got == {d[0]: v for d, v in brute(docs, 10).items()}


def test_runs_of_any_number_of_short_lines(spark):
    a, b, c, d = "alpha 01", "beta 002", "gamma 03", "delta 04"
    docs = [(1, f"{a}\n{b}\n{c}\nown"), (2, f"x\n{a}\n{b}\n{c}"), (3, f"{b}\n{c}\n{d}"), (4, f"{b}\t\n\n {c}\r\n{d}\nown"), (5, f"{a}\n{b}")]
    got = {r.doc_id: r.text for r in ld.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: docs[0][1], 2: "x", 3: docs[2][1], 4: "own", 5: docs[4][1]}


def test_few_lines_in_many_orders(spark):
    random.seed(12)
    for pool, least in ((["a", "b"], 3), (["ab", "c", "ddd", "", "a"], 6)):
        docs = [(i, "\n".join(random.choice(pool) for _ in range(random.randint(0, 30)))) for i in range(40)] + [(50, "a\n" * 200), (51, "b\n" + "a\n" * 150)]
        got = {r.doc_id: r.text for r in ld.dedup(spark.createDataFrame(docs, "doc_id long, text string"), min_chars=least).collect()}
        assert got == {d[0]: v[0] for d, v in brute(docs, least).items()}


def sequences():
    random.seed(13)
    out = [[random.choice("abc") for _ in range(random.randint(1, 25))] for _ in range(25)] + [list("a" * 40), list("a" * 33), list("abcabcabc"), list("z")]
    return out + [out[3], out[4][2:]]


def test_suffix_array_and_its_intervals(spark, monkeypatch):
    from tsymbol.llm import suffixes as sx

    seqs = sequences()
    monkeypatch.setattr(sx, "CHUNK", 7)
    rows, place = [], 0
    for k, x in enumerate(seqs):
        rows += [(place + i, k, len(x) - i, ord(c), 0) for i, c in enumerate(x)]
        place += len(x)
    lines = spark.createDataFrame(rows, "gid long, seq long, left long, h1 long, h2 long").repartition(5)
    array, rounds = sx.suffix_array(lines)
    order = sx.neighbours(array, rounds)
    suffix = {g: seqs[k][len(seqs[k]) - left :] for g, k, left, _, _ in rows}
    many = {c for c in "abcz" if sum(x.count(c) for x in seqs) > 1}
    want = sorted((g for g in suffix if suffix[g][0] in many), key=lambda g: (suffix[g], g))
    got = sorted(order.collect(), key=lambda r: r["at"])
    assert [r["gid"] for r in got] == want
    common = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert [r["lcp"] for r in got] == [0] + [common(suffix[a], suffix[b]) for a, b in zip(want, want[1:])]
    longest = {g: max((common(suffix[g], suffix[q]) for q in range(g)), default=0) for g in suffix}
    found = {r["gid"]: r["length"] for r in sx.longest_earlier(order).collect()}
    assert found == {g: n for g, n in longest.items() if n}


def test_repeated_rows_share_a_result(spark):
    rows = [(1, "a line of some length")] * 3 + [(2, "a line of some length\nanother"), (None, "a line of some length")]
    made = ld.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((str(r.doc_id), r.text) for r in made.collect()) == [("1", ""), ("1", ""), ("1", ""), ("2", "another"), ("None", "a line of some length")]


def test_thin_drops_what_lost_all(spark):
    rows = [(1, "a line of some length", 1), (2, "a line of some length", 2), (3, None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int")
    made = ld.thin(df)
    assert made.columns == df.columns and sorted(r.doc_id for r in made.collect()) == [1, 3]


def test_empty_and_nothing_repeated(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ld.dedup(df).count() == 0
    one = spark.createDataFrame([(1, "only\nlines")], "doc_id long, text string")
    assert ld.dedup(one).first()["text"] == "only\nlines"
