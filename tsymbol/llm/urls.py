"""URL filter: host and path rules, and beyond them a tree of path templates for each host. DataFrame functions only.

Paths are cut into their segments, and segments that look like a number, a date, a hash or a mixed code become wildcards. One
aggregation leaves a row for each host and generalised path; the tree is built on these rows, level by level down to the end
of every path: a branch whose labelled share differs significantly from that of all branches beside it stays, all others
merge into `*`. A node with one row or without labels can't branch any more, and is taken to its end at once. Labels are the verdicts of the rules. A node's purity is its share of blocked labels,
smoothed towards its parent's, and the template of a url is rejected where the purity at its leaf reaches a threshold.

Defined results: a null url, or one without `://`, has an empty host and an empty path, no rule, and a verdict like any other.
Of several rules that fit, the longest wins; of equally long ones, the first by code point. Repeated rows each give a row.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsymbol.llm.common import materialise

#: Patterns of variable segments and the wildcards that stand for them, tried in this order.
WILDCARDS = (
    (r"^\d{4}-\d{1,2}(-\d{1,2})?$", "{date}"),
    (r"^\d+$", "{n}"),
    (r"^\d+\.[A-Za-z]{1,5}$", "{n.ext}"),
    (r"^[0-9A-Fa-f]{8,}(-[0-9A-Fa-f]{4,})*$", "{hash}"),
    (r"^[^.]*\d[^.]*\d[^.]*\d.*$", "{code}"),
    (r"^.{40,}$", "{long}"),
)


@dataclass(frozen=True)
class Tree:
    """depth: segments whose levels every path passes, shorter ones by repeating their end, longer ones go on; z: how far a branch's share has to lie from its siblings', in standard errors; support:
    labelled urls that a branch needs to stay; prior: labels that a parent's purity counts for; reject: purity that blocks."""

    depth: int = 3
    z: float = 2.0
    support: int = 5
    prior: float = 4.0
    reject: float = 0.75


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(part(1), string.ascii_uppercase, string.ascii_lowercase), part(2)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null. rules: host with path -> verdict, a parameter of bounded size."""
    fits = None
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        rule_host, slash, rest = rule.partition("/")
        hit = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        fits = F.when(hit, F.lit(rule)) if fits is None else fits.when(hit, F.lit(rule))
    return F.lit(None).cast("string") if fits is None else fits.otherwise(F.lit(None).cast("string"))


def segment(x: Column) -> Column:
    out = F.when(x == "", F.lit(""))
    for pattern, name in WILDCARDS:
        out = out.when(x.rlike(pattern), F.lit(name))
    return out.otherwise(x)


def segments(path: Column) -> Column:
    """All generalised segments of a path."""
    return F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), segment)


def templates(leaves: DataFrame, tree: Tree) -> DataFrame:
    """From (host, segments, labelled, blocked) rows: the same with the template's segments and the purity of the leaf."""
    total = leaves.agg(F.sum("labelled"), F.sum("blocked")).first()
    base = (total[1] or 0) / total[0] if total[0] else 0.0
    sums = lambda df, *by: df.groupBy(*by).agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b"), F.sum("paths").alias("rows"))
    smooth = lambda b, n, p: (b + F.lit(tree.prior) * p) / (n + F.lit(tree.prior))
    leaves = leaves.withColumn("paths", F.lit(1))
    root = sums(leaves, "host").select("host", smooth(F.col("b"), F.col("n"), F.lit(base)).alias("purity"))
    now = materialise(leaves.join(root, "host").withColumn("template", F.array().cast("array<string>")), "url-tree")
    ended, above, level = [], ["host", "template"], 0
    while True:
        now = now.withColumn("s", F.coalesce(F.get("segments", F.lit(level)), F.lit("")))
        one, all_ = sums(now, *above, "s"), sums(now, *above).select(*above, F.col("n").alias("all_n"), F.col("b").alias("all_b"))
        share = F.col("all_b") / F.col("all_n")
        error = F.sqrt(share * (1 - share) / F.col("n"))
        apart = (F.col("n") >= tree.support) & (F.col("all_n") > F.col("n")) & (F.abs(F.col("b") / F.col("n") - share) > F.lit(tree.z) * error)
        named = one.join(all_, above).select(*above, "s", F.when(F.col("s") == "", F.lit("")).when(F.coalesce(apart, F.lit(False)), F.col("s")).otherwise(F.lit("*")).alias("t"))
        now = now.join(named, [*above, "s"]).withColumn("template", F.concat("template", F.array("t"))).drop("s", "t")
        now = now.join(sums(now, *above), above).withColumn("purity", smooth(F.col("b"), F.col("n"), F.col("purity")))
        now = materialise(now.withColumn("alone", (F.col("rows") == 1) | (F.col("n") == 0)).drop("n", "b", "rows"), "url-tree")
        if level >= tree.depth:
            left = F.size("segments") - level  # levels to come, the last of them the end
            stars = F.concat("template", F.array_repeat(F.lit("*"), F.greatest(left - 1, F.lit(0))))
            purity = F.aggregate(F.array_repeat(F.lit(0), F.greatest(left, F.lit(0))), F.col("purity"), lambda p, _: smooth(F.col("blocked"), F.col("labelled"), p))
            ended.append(now.filter((left <= 0) | F.col("alone")).select("host", "segments", stars.alias("template"), purity.alias("purity")))
            now = now.filter((left > 0) & ~F.col("alone"))
            if now.isEmpty():
                return reduce(DataFrame.unionByName, ended)
        now = now.drop("alone")
        level += 1


def judge(pages: DataFrame, rules: dict[str, str], tree: Tree | None = None, *, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keep, host, path, rule, verdict, template of each row."""
    tree = tree or Tree()
    host, path = host_and_path(F.col(url))
    rows = pages.select(*(F.col(c).alias(f"\0{c}") for c in keep), host.alias("host"), path.alias("path"))
    rows = rows.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("rule"), segments(F.col("path")).alias("segments"))
    said = F.coalesce(reduce(lambda c, r: c.when(F.col("rule") == r, F.lit(rules[r])), list(rules)[1:], F.when(F.col("rule") == next(iter(rules)), F.lit(rules[next(iter(rules))]))), F.lit(None).cast("string")) if rules else F.lit(None).cast("string")
    rows = rows.withColumn("said", said)
    leaves = rows.groupBy("host", "segments").agg(F.count("said").alias("labelled"), F.count(F.when(F.col("said") == "block", 1)).alias("blocked"))
    known = templates(materialise(leaves, "url-leaves"), tree)
    template = F.concat_ws("/", "host", F.filter("template", lambda t: t != ""))
    known = known.select("host", "segments", "purity", template.alias("template"))
    method = F.when(F.col("purity") >= tree.reject, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(known, ["host", "segments"], "left").select(*(F.col(f"\0{c}").alias(c) for c in keep), "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "template")
