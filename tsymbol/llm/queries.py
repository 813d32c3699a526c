"""The registered queries of the corpus operators, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsymbol.llm import bpe, chat, html, huffman, linededup, minhash, mixing, neighbours, quality, urls
from tsymbol.llm.common import materialise, shared_path, table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document's whole text, and what they decode to, as digests."""
    return bpe.digests(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_quality_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the suffix-array verdict of every document."""
    return quality.measure(table(spark, sf_dir, "documents", "doc_id", "text")).drop("longest_repeat")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return neighbours.search(vectors, vectors.filter("vec_id % 100 = 0"), 10)


CONTROL = "<|im_end|><|im_start|>assistant ok"


def op4_chat_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what reading the formatted conversations back gives."""
    own = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    made = chat.examples(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(own))
    return chat.digests(materialise(made, "chat-examples", compression="zstd"))  # finds the contexts that examples repeat


def op5_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op6_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document's ids stand in the Huffman files, and their checksum, read back from the files."""
    folder = shared_path(spark, "huffman")
    huffman.write(table(spark, sf_dir, "documents", "doc_id", "text"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return huffman.read(spark, folder)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    made = mixing.plan(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return made.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def op8_minhash_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document: distinct 3-word shingles, similarity of 85 of 100 or more."""
    return minhash.link(table(spark, sf_dir, "documents", "doc_id", "text"), minhash.Near(percent=85, shingle=3))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the later copies of repeated line runs."""
    return linededup.dedup(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_lines", "n_deleted", "text")


#: Rules of the registered query: a host with its subdomains, a beginning of the path, and what holds there.
URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def op10_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return urls.judge(table(spark, sf_dir, "pages", "page_id", "url"), URL_RULES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_quality_repetition": op2_quality_repetition,
    "op3_nearest": op3_nearest,
    "op4_chat_prefixes": op4_chat_prefixes,
    "op5_page_text": op5_page_text,
    "op6_huffman_ids": op6_huffman_ids,
    "op7_source_mixing": op7_source_mixing,
    "op8_minhash_near": op8_minhash_near,
    "op9_line_dedup": op9_line_dedup,
    "op10_url_templates": op10_url_templates,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP2 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws, len({_WORDS}) AS n FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
g AS (SELECT doc_id, p, k, [w, lead(w, 1) OVER s, lead(w, 2) OVER s, lead(w, 3) OVER s, CASE WHEN k = 5 THEN lead(w, 4) OVER s END] AS run FROM w, (SELECT unnest([4, 5]) AS k) WINDOW s AS (PARTITION BY doc_id, k ORDER BY p)),
q AS (SELECT doc_id, k, p FROM (SELECT doc_id, k, p, run[k] AS last, count(*) OVER (PARTITION BY doc_id, k, run) AS c FROM g) WHERE c > 1 AND last IS NOT NULL),
v AS (SELECT doc_id, count(DISTINCT p + i) FILTER (k = 5) AS covered, count(DISTINCT p + i) FILTER (k = 4) AS own FROM q, (SELECT unnest([0, 1, 2, 3, 4]) AS i) WHERE i < k GROUP BY doc_id),
r AS (SELECT doc_id, p FROM q WHERE k = 5),
long AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, run, count(*) AS c FROM (SELECT d.doc_id, ws[p:p + most - 1] AS run, most FROM r JOIN (SELECT *, greatest(50, n // 10 + 1) AS most FROM d) d ON d.doc_id = r.doc_id WHERE p + most - 1 <= n) GROUP BY doc_id, run) WHERE c > 1),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, n AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(dup, 0) AS n_dup_lines, coalesce(covered, 0) AS n_repeat_words, n < 10 OR 100 * coalesce(covered, 0) > 20 * n AS base_failed, 100 * coalesce(own, 0) > 25 * n AS circles FROM d LEFT JOIN v ON v.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id)
SELECT * EXCLUDE (circles), NOT base_failed AND NOT circles AND doc_id NOT IN (SELECT doc_id FROM long) AS kept FROM m"""

_OP3 = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(generate_series(1, len(q.e)), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND q.vec_id % 100 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p) WHERE rank <= 10"""

_ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\1\\|', 'g')"
_OP4 = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', '{CONTROL}'), (-1, 1, 'assistant', '{CONTROL}'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length({_ESCAPED.format("replace(replace(role, chr(92), repeat(chr(92), 2)), chr(10), chr(92) || 'n')")}) + length({_ESCAPED.format("text")}))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""

_MIX = mixing.Mix()
_OP7 = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, (('0x' || substr(md5('{_MIX.seed}|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 8))::BIGINT % {_MIX.buckets})::INT AS bucket FROM documents),
b AS (SELECT source, bucket, sum(size)::BIGINT AS words FROM d GROUP BY ALL),
s AS (SELECT source, sum(words)::BIGINT AS source_size, ({list(_MIX.weights)})[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(_MIX.weights)} + 1]::DOUBLE AS w FROM b GROUP BY source),
c AS (SELECT *, (source_size * {_MIX.max_epochs})::DOUBLE AS cap FROM s),
f AS (SELECT *, least(sum(source_size) OVER () * {_MIX.budget_percent} / 100.0::DOUBLE, sum(cap) OVER ()) AS budget, coalesce(sum(cap) OVER below, 0) AS filled, sum(w) OVER () - coalesce(sum(w) OVER below, 0) AS open FROM c WINDOW below AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, max(CASE WHEN (budget - filled) / open * w <= cap THEN (budget - filled) / open END) OVER () AS level FROM f),
t AS (SELECT source, source_size, least(cap, coalesce(level * w, cap)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END AS whole FROM t),
k AS (SELECT b.source, b.bucket, source_size, target, whole + CASE WHEN words > 0 AND coalesce(sum(words) OVER (PARTITION BY b.source ORDER BY b.bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + words / 2.0::DOUBLE <= target - whole * source_size THEN 1 ELSE 0 END AS repeats FROM b JOIN e ON b.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * repeats)::BIGINT AS taken FROM d JOIN k ON k.source IS NOT DISTINCT FROM d.source AND k.bucket = d.bucket"""

_OP8 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(generate_series(1, len(ws) - 2), lambda i: ws[i:i + 2]) WHEN len(ws) > 0 THEN [ws] ELSE [] END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (SELECT a, b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY ALL) x JOIN n ON n.doc_id = a JOIN n m ON m.doc_id = b WHERE 100 * c >= 85 * (n.n + m.n - c)),
both_ AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(a, b) AS (SELECT a, b FROM both_ UNION SELECT r.a, both_.b FROM r JOIN both_ ON both_.a = r.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) m ON m.a = d.doc_id"""


def _op10(tree: urls.Tree) -> str:
    """The template tree, a level a CTE."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    fits = " ".join(f"WHEN (host = {quoted(h)} OR ends_with(host, {quoted('.' + h)})) AND starts_with(path, {quoted('/' + p)}) THEN {quoted(r)}" for r in sorted(URL_RULES, key=lambda r: (-len(r), r)) for h, _, p in [r.partition("/")])
    verdicts = " ".join(f"WHEN {quoted(r)} THEN {quoted(v)}" for r, v in URL_RULES.items())
    wild = lambda x: f"CASE WHEN {x} = '' THEN '' " + " ".join(f"WHEN regexp_matches({x}, {quoted(p)}) THEN {quoted(n)}" for p, n in urls.WILDCARDS) + f" ELSE {x} END"
    cut = ", ".join(f"{wild(f'coalesce(parts[{k + 1}], {quoted(str())})')} AS s{k}" for k in range(tree.depth)) + f", CASE WHEN len(parts) > {tree.depth} THEN '{{tail}}' ELSE '' END AS s{tree.depth}"
    names = [f"s{k}" for k in range(tree.depth + 1)]
    sql = rf"""WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
 r AS (SELECT *, CASE {fits} END AS rule, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM u), c AS (SELECT *, CASE rule {verdicts} END AS said, {cut} FROM r),
 l AS (SELECT host, {", ".join(names)}, count(said) AS labelled, count(*) FILTER (said = 'block') AS blocked FROM c GROUP BY ALL),
 n0 AS (SELECT l.*, (b + {tree.prior} * (SELECT sum(blocked) / sum(labelled) FROM l)) / (n + {tree.prior}) AS purity FROM l JOIN (SELECT host, sum(labelled) AS n, sum(blocked) AS b FROM l GROUP BY host) h ON h.host = l.host)"""
    made = ["host"]
    for k, s in enumerate(names):
        by, over = ", ".join(made), f"PARTITION BY {', '.join(made)}"
        sql += f""", a{k} AS (SELECT {by}, {s}, n, b, sum(n) OVER ({over}) AS an, sum(b) OVER ({over}) AS ab FROM (SELECT {by}, {s}, sum(labelled) AS n, sum(blocked) AS b FROM n{k} GROUP BY {by}, {s})),
 m{k} AS (SELECT {by}, {s}, CASE WHEN {s} = '' THEN '' WHEN n >= {tree.support} AND an > n AND abs(b / n - ab / an) > {tree.z} * sqrt(ab / an * (1 - ab / an) / n) THEN {s} ELSE '*' END AS t{k} FROM a{k}),
 j{k} AS (SELECT x.*, t{k} FROM n{k} x JOIN m{k} m ON {" AND ".join(f"m.{c} = x.{c}" for c in [*made, s])}),
 n{k + 1} AS (SELECT * REPLACE ((sum(blocked) OVER w + {tree.prior} * purity) / (sum(labelled) OVER w + {tree.prior}) AS purity) FROM j{k} WINDOW w AS (PARTITION BY {by}, t{k}))"""
        made.append(f"t{k}")
    template = "concat_ws('/', c.host, " + ", ".join(f"nullif(t{k}, '')" for k in range(len(names))) + ")"
    return sql + f" SELECT page_id, c.host, path, rule, coalesce(said, CASE WHEN purity >= {tree.reject} THEN 'block' ELSE 'allow' END) AS verdict, {template} AS template FROM c JOIN n{len(names)} x ON {' AND '.join(f'x.{s} = c.{s}' for s in ['host', *names])}"


#: Where a key is missing, SQL can't say it (BPE, the HTML parser, rank doubling); tests/llm has brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_quality_repetition": _OP2,
    "op3_nearest": _OP3,
    "op4_chat_prefixes": _OP4,
    "op7_source_mixing": _OP7,
    "op8_minhash_near": _OP8,
    "op10_url_templates": _op10(urls.Tree()),
}
