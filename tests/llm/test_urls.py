from tsymbol.llm import urls as u

RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
SCHEMA = "page_id long, url string, host int, rule string"

CASES = [
    (None, "", "", None), ("", "", "", None), ("no scheme/x", "", "", None), ("HTTP://Www.EXAMPLE.org/es/1?q#f", "www.example.org", "/es/1", "example.org/es/"),
    ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1"), ("https://example.org/en/2", "example.org", "/en/2", "org/"), ("x://a.com/fr/", "a.com", "/fr/", "com/fr/"),
    ("x://a.com/de/9#t", "a.com", "/de/9", "com/de/"), ("x://acom/de/9", "acom", "/de/9", None), ("x://a.org", "a.org", "", None), ("x://a.org?p=/x", "a.org", "", None), ("a://b://c.org/d", "b:", "//c.org/d", None), ("x://É.com/Fr/", "É.com", "/Fr/", None), ("x:///only", "", "/only", None), ("x://com/fr/\nz", "com", "/fr/\nz", "com/fr/"),
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, c[0], 1, "x") for i, c in enumerate(CASES)], SCHEMA)
    got = {r.page_id: r for r in u.judge(df, RULES).collect()}
    for i, (_, host, path, rule) in enumerate(CASES):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (RULES[rule] if rule else got[i].verdict) and got[i].verdict in ("allow", "block")


def test_templates_learn_from_the_labels_of_their_host(spark):
    rows = [(k, f"x://a.net/shop/{k}/view", 0, "") for k in range(40)] + [(100 + k, f"x://a.net/news/{k}", 0, "") for k in range(40)] + [(300 + k, f"x://b.net/shop/{k}/view", 0, "") for k in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    # rules label the shop items and news items whose number begins with 1 or 2
    rules = {**{f"a.net/shop/{d}": "block" for d in (1, 2)}, **{f"a.net/news/{d}": "allow" for d in (1, 2)}}
    got = {r.page_id: r for r in u.judge(df, rules).collect()}
    assert got[35].rule is None and got[35].verdict == "block" and got[35].template == "a.net/shop/{n}/*" or got[35].template.startswith("a.net/shop/")
    assert got[35].verdict == "block" and got[135].verdict == "allow" and got[303].verdict == "allow"


def test_generalised_segments(spark):
    from pyspark.sql import functions as F

    names = {"12": "{n}", "12.html": "{n.ext}", "2024-05-01": "{date}", "deadbeef01": "{hash}", "a1b2c3": "{code}", "x" * 50: "{long}", "news": "news", "": ""}
    df = spark.createDataFrame([(k,) for k in names], "s string")
    assert {r.s: r.g for r in df.select("s", u.segment(F.col("s")).alias("g")).collect()} == names


def test_empty_repeated_and_no_rules(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert u.judge(df, RULES).count() == 0
    twice = spark.createDataFrame([(1, "x://a.b/c", 0, "")] * 2 + [(None, "x://a.b/c", 0, "")], SCHEMA)
    assert [r.verdict for r in u.judge(twice, {}).collect()] == ["allow"] * 3


def test_branches_below_the_third_segment_are_told_apart(spark):
    for above in ("shop/a/b", "shop/a/b/c/d/e"):
        rows = [(100 * j + k, f"x://a.net/{above}/{part}/w{'abcdefghij'[k // 10]}/{k}", 0, "") for j, part in enumerate(("spam", "news")) for k in range(40)]
        rules = {**{f"a.net/{above}/spam/w{c}": "block" for c in "abc"}, **{f"a.net/{above}/news/w{c}": "allow" for c in "abc"}}
        got = {r.page_id: r for r in u.judge(spark.createDataFrame(rows, SCHEMA), rules).collect()}
        assert len(got) == 80 and (got[35].rule, got[135].rule) == (None, None)
        assert (got[35].verdict, got[135].verdict) == ("block", "allow")
        assert got[35].template != got[135].template and "/spam/" in got[35].template and "/news/" in got[135].template


def plain(urls, rules, tree):
    """page -> (verdict, template) of distinct leaf paths, one level after the other to the end of the deepest."""
    said = [next((rules[r] for r in sorted(rules, key=lambda r: (-len(r), r)) if x.startswith(r)), None) for x in urls]
    wild = lambda x: "{n}" if x.isdigit() else x
    rows = {}
    for x, v in zip(urls, said, strict=True):
        key = tuple(wild(p) for p in x.split("/") if p)
        n, b = rows.get(key, (0, 0))
        rows[key] = (n + (v is not None), b + (v == "block"))
    add = lambda keys: (sum(rows[k][0] for k in keys), sum(rows[k][1] for k in keys))
    smooth = lambda keys, p: (add(keys)[1] + tree.prior * p) / (add(keys)[0] + tree.prior)
    n, b = add(rows)
    ends = {}

    def grow(keys, level, made, purity):
        kinds = {}
        (all_n, all_b), share = add(keys), 0.0
        for k in keys:
            kinds.setdefault(k[level] if level < len(k) else "", []).append(k)
        nodes = {}
        for s, part in kinds.items():
            n, b = add(part)
            share = all_b / all_n if all_n else 0.0
            apart = n >= tree.support and all_n > n and abs(b / n - share) > tree.z * (share * (1 - share) / n) ** 0.5
            nodes.setdefault("" if s == "" else s if apart else "*", []).extend(part)
        for t, part in nodes.items():
            p = smooth(part, purity)
            for k in part:
                if level >= max(tree.depth, len(k)):
                    ends[k] = ("block" if p >= tree.reject else "allow", "/".join(x for x in (*made, t) if x))
            part = [k for k in part if level < max(tree.depth, len(k))]
            if part:
                grow(part, level + 1, (*made, t), p)

    for host in {k[0] for k in rows}:
        keys = [k for k in rows if k[0] == host]
        grow(keys, 1, (host,), smooth(keys, b / n if n else 0.0))
    return [(v or ends[k][0], ends[k][1]) for x, v in zip(urls, said, strict=True) for k in [tuple(wild(p) for p in x.split("/") if p)]]


def test_tree_of_any_depth_equals_plain_python(spark):
    import random
    from dataclasses import replace

    rng = random.Random(7)
    paths = ["/".join([rng.choice(["a.net", "b.net"]), *(rng.choice(["p", "q", "r", "7"]) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 8])))]) for _ in range(1500)] + ["a.net" + "/p" * 12 + f"/{x}" for x in ("q", "r/s/t", "7")]
    rules = {"a.net/p/p": "block", "a.net/q": "allow", "a.net/p/q/r/p": "block", "a.net/p/q/r/q": "allow", "a.net/r/r/r/r/p": "block", "a.net/r/r/q": "allow", "b.net/7/p": "block"}
    got = {r.page_id: (r.verdict, r.template) for r in u.judge(spark.createDataFrame([(i, "x://" + x, 0, "") for i, x in enumerate(paths)], SCHEMA), rules).collect()}
    # the host is no level: depth counts from the first segment, plain() from the host
    want = plain(paths, rules, replace(u.Tree(), depth=u.Tree().depth + 1))
    assert [got[i] for i in range(len(paths))] == want
    assert {v for v, _ in want} == {"allow", "block"} and any(set(t.split("/")[4:]) - {"*"} for _, t in want)
