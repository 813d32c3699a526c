"""One registered query for each operator, and the same in SQL for DuckDB where SQL can say it.

Series come from `events` (values of a user in order of time), `lineitem` and `embeddings`; sequences from `documents` (words of
whole texts). Floating results are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from math import sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsymbol.functions import columns as C
from tsymbol.operators import baselines, cluster, digitize, encoders, fill, images, inverse, metrics, normalize, patches, quantizer
from tsymbol.operators.compress import compress_arrays, compress_column, pieces_of
from tsymbol.operators.series import array_channels, channel_arrays, chunks, stack_channels, to_points, to_series, unstack_channels, with_ends
from tsymbol.plans import estimators
from tsymbol.sources import synthetic

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(x: Column | str) -> Column:
    """Six places, without a negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)


def q6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


# --- inputs


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("series_id"), "event_type", "ts", "event_id", "value")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, t, value)"""
    w = Window.partitionBy("series_id").orderBy("ts", "event_id")
    return events(spark, sf_dir).select("series_id", (F.row_number().over(w) - 1).alias("t"), "value")


def holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """points with every seventh value of a series missing, the first ones too."""
    return points(spark, sf_dir).withColumn("value", F.when((F.col("t") + F.col("series_id")) % 7 > 1, F.col("value")))


def walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, t, value): running totals of the differences from a series' mean, to mean 0 and deviation 1."""
    rows = points(spark, sf_dir).withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy("series_id")))
    total = F.sum("value").over(Window.partitionBy("series_id").orderBy("t"))
    return normalize.z_each(rows.withColumn("value", total), "series_id")


def walk_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, channel, values)"""
    return to_series(walks(spark, sf_dir), "series_id", "t", "value").withColumn("channel", F.lit(0))


def pieces(spark: SparkSession, sf_dir: str, tol: float = 0.1) -> DataFrame:
    return pieces_of(compress_arrays(walk_series(spark, sf_dir).select("series_id", "channel", "values"), tol), ["series_id", "channel"])


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, channel, t, value): event types are channels."""
    w = Window.partitionBy("series_id", "event_type").orderBy("ts", "event_id")
    return events(spark, sf_dir).select("series_id", F.col("event_type").alias("channel"), (F.row_number().over(w) - 1).alias("t"), "value")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, seq): words of whole texts."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("doc"), F.split("text", " ").alias("seq"))


def labelled_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("doc"), F.col("quality").alias("label"))
    return sequences(spark, sf_dir).join(labels, "doc")


POINTS = "SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value FROM events"
HOLES = f"SELECT series_id, t, CASE WHEN (t + series_id) % 7 > 1 THEN value END AS value FROM ({POINTS})"
TOTALS = f"SELECT series_id, t, sum(d) OVER (PARTITION BY series_id ORDER BY t) AS c FROM (SELECT series_id, t, value - avg(value) OVER (PARTITION BY series_id) AS d FROM ({POINTS}))"
DEV = "stddev_pop(c) OVER (PARTITION BY series_id)"
WALKS = f"SELECT series_id, t, (c - avg(c) OVER (PARTITION BY series_id)) / CASE WHEN {DEV} = 0 THEN 1 ELSE {DEV} END AS value FROM ({TOTALS})"
TYPED = "SELECT user_id AS series_id, event_type AS channel, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS t, value FROM events"
SEQ = "SELECT doc_id AS doc, string_split(text, ' ') AS seq FROM documents"
TOK = f"SELECT doc, unnest(seq) AS token, generate_subscripts(seq, 1) - 1 AS pos FROM ({SEQ})"
DICT = f"SELECT token, row_number() OVER (ORDER BY d, pos) AS id FROM (SELECT token, min((doc, pos)) AS m, m[1] AS d, m[2] AS pos FROM ({TOK}) GROUP BY token)"
LABELLED = f"SELECT s.doc, s.seq, l.quality AS label FROM ({SEQ}) s JOIN labels l ON l.doc_id = s.doc"


def pieces_sql(source: str, tol: float, max_len: float = 1e18) -> str:
    """CTEs ending in pieces(series_id, idx, len, inc, err): the segmentation as a recursion, a point a step."""
    err = "greatest(a1 - 2 * (y / m1) * b1 + (y / m1) * (y / m1) * m1 * (m1 + 1) * (2 * m1 + 1) / 6, 0)"
    return f"""
WITH RECURSIVE pts AS MATERIALIZED (SELECT series_id, t, value::DOUBLE AS value FROM ({source})),
s(series_id, t, x0, prev, a, b, m, inc, err, idx, dl, di, de) AS (
  SELECT series_id, 0::BIGINT, value, value, 0::DOUBLE, 0::DOUBLE, 0::BIGINT, 0::DOUBLE, 0::DOUBLE, 0::BIGINT, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE FROM pts WHERE t = 0
  UNION ALL
  SELECT series_id, t, CASE WHEN fits THEN x0 ELSE prev END, x, CASE WHEN fits THEN a1 ELSE (x - prev) * (x - prev) END, CASE WHEN fits THEN b1 ELSE x - prev END,
    CASE WHEN fits THEN m1 ELSE 1 END, CASE WHEN fits THEN y ELSE x - prev END, CASE WHEN fits AND m1 > 1 THEN e ELSE 0 END, CASE WHEN fits THEN idx ELSE idx + 1 END,
    CASE WHEN NOT fits THEN m END, CASE WHEN NOT fits THEN inc END, CASE WHEN NOT fits THEN err END
  FROM (SELECT *, m1 = 1 OR (e <= {tol} * (m1 - 1) + 2.220446049250313e-16 AND m1 - 1 < {max_len}) AS fits FROM (SELECT *, {err} AS e FROM (
    SELECT s.*, s.t AS t_, p.value AS x, p.value - s.x0 AS y, s.m + 1 AS m1, s.a + (p.value - s.x0) * (p.value - s.x0) AS a1, s.b + (s.m + 1) * (p.value - s.x0) AS b1
    FROM (SELECT series_id, t + 1 AS t, x0, prev, a, b, m, inc, err, idx FROM s) s JOIN pts p ON p.series_id = s.series_id AND p.t = s.t)))
),
ends AS (SELECT series_id, max(t) AS n FROM pts GROUP BY series_id),
pieces AS (
  SELECT series_id, idx - 1 AS idx, dl AS len, di AS inc, de AS err FROM s WHERE dl IS NOT NULL
  UNION ALL
  SELECT s.series_id, idx, m, inc, err FROM s JOIN ends ON ends.series_id = s.series_id AND ends.n = s.t WHERE m > 0
)
"""


# --- missing values and normalisation


def _fill(method: str, expression: str):
    @query(f"SELECT series_id, t, {q6(expression)} AS value FROM ({HOLES})")
    def f(spark, sf_dir):
        return fill.fill_points(holes(spark, sf_dir), "series_id", "t", method=method).select("series_id", F.col("t").cast("long").alias("t"), r6("value").alias("value"))

    QUERIES[f"fill_{method}"] = QUERIES.pop("f")
    ORACLE_SQL[f"fill_{method}"] = ORACLE_SQL.pop("f")


_RUN = "OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN"
_fill("ffill", f"coalesce(last_value(value IGNORE NULLS) {_RUN} UNBOUNDED PRECEDING AND CURRENT ROW), 0)")
_fill("bfill", f"coalesce(first_value(value IGNORE NULLS) {_RUN} CURRENT ROW AND UNBOUNDED FOLLOWING), 0)")
_fill("mean", "coalesce(value, avg(value) OVER (PARTITION BY series_id), 0)")
_fill("median", "coalesce(value, median(value) OVER (PARTITION BY series_id), 0)")
_fill("zero", "coalesce(value, 0)")


def _norm(mode: str, over: str):
    kind = mode.split("_")[0]
    shift, scale = (f"avg(value) {over}", f"stddev_pop(value) {over} + 1e-12") if kind == "z" else (f"min(value) {over}", f"max(value) {over} - min(value) {over} + 1e-12")

    def f(spark, sf_dir):
        rows = typed(spark, sf_dir)
        stats = normalize.statistics(rows, mode)
        made = normalize.normalise(rows, stats)
        back = normalize.denormalise(made, stats).withColumnRenamed("value", "back")
        return made.join(back, ["series_id", "channel", "t"]).select("series_id", "channel", F.col("t").cast("long").alias("t"), r6("value").alias("value"), r6("back").alias("back"))

    QUERIES[f"normalise_{mode}"] = f
    ORACLE_SQL[f"normalise_{mode}"] = f"SELECT series_id, channel, t, {q6(f'(value - {shift}) / ({scale})')} AS value, {q6('value')} AS back FROM ({TYPED})"


for _m, _o in (("per_channel", "OVER (PARTITION BY channel)"), ("per_series", "OVER (PARTITION BY series_id, channel)"), ("dataset", "OVER ()")):
    _norm(f"z_{_m}", _o)
    _norm(f"minmax_{_m}", _o)


@query(f"SELECT series_id, t, {q6('(value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w = 0 THEN 1 ELSE stddev_pop(value) OVER w END')} AS value FROM ({POINTS}) WINDOW w AS (PARTITION BY t)")
def normalise_over_series(spark, sf_dir):
    rows = points(spark, sf_dir)
    return normalize.normalise(rows, normalize.z_over_series(rows)).select("series_id", F.col("t").cast("long").alias("t"), r6("value").alias("value"))


# --- compression

_PIECES = f"SELECT series_id, idx, len, {q6('inc')} AS inc, {q6('err')} AS err FROM pieces"


def _pieces(rows: DataFrame) -> DataFrame:
    return rows.select("series_id", F.col("idx").cast("long").alias("idx"), F.col("len").cast("long").alias("len"), r6("inc").alias("inc"), r6("err").alias("err"))


@query(pieces_sql(WALKS, 0.1) + _PIECES)
def compress(spark, sf_dir):
    return _pieces(pieces(spark, sf_dir))


@query(pieces_sql(WALKS, 0.5, 4) + _PIECES)
def compress_max_len(spark, sf_dir):
    return _pieces(pieces_of(compress_arrays(walk_series(spark, sf_dir), 0.5, 4, keep=["series_id"]), ["series_id"]))


@query(pieces_sql(WALKS, 0.1) + f", e AS (SELECT p.series_id, idx, len, inc, sum(len) OVER (PARTITION BY p.series_id ORDER BY idx) AS at FROM pieces p) SELECT e.series_id, idx, len, {q6('w.value')} AS end_value FROM e JOIN pts w ON w.series_id = e.series_id AND w.t = e.at")
def compress_fixed_point(spark, sf_dir):
    return pieces(spark, sf_dir).select("series_id", F.col("idx").cast("long").alias("idx"), F.col("len").cast("long").alias("len"), r6("end_value").alias("end_value"))


@query(pieces_sql(HOLES.replace("END AS value", "END AS raw").join(["SELECT series_id, t, coalesce(first_value(raw IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS value FROM (", ")"]), 20.0) + _PIECES)
def compress_filled(spark, sf_dir):
    rows = to_series(holes(spark, sf_dir), "series_id", "t", "value")
    return _pieces(pieces_of(compress_arrays(rows, 20.0, fill="bfill", keep=["series_id"]), ["series_id"]))


@query(pieces_sql(f"SELECT series_id * 3 + t // (n // 3) AS series_id, t % (n // 3) AS t, value FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM ({WALKS})) WHERE t < 3 * (n // 3)", 0.1) + _PIECES)
def compress_chunks(spark, sf_dir):
    """Three chunks a series, the rest dropped."""
    cut = chunks(with_ends(walk_series(spark, sf_dir)), 3).withColumn("series_id", F.col("series_id") * 3 + F.col("chunk"))
    return _pieces(pieces_of(compress_arrays(cut.select("series_id", "values"), 0.1), ["series_id"]))


@query(pieces_sql(WALKS, 0.1) + f"SELECT series_id, idx, len, {q6('inc')} AS inc FROM pieces")
def compress_inside_jvm(spark, sf_dir):
    """The fold that needs no Python."""
    rows = walk_series(spark, sf_dir).select("series_id", F.posexplode(compress_column(F.col("values"), 0.1)).alias("idx", "p"))
    return rows.select("series_id", F.col("idx").cast("long").alias("idx"), F.col("p.len").cast("long").alias("len"), r6("p.inc").alias("inc"))


@query(f"SELECT series_id, t AS idx, {q6('value - before')} AS inc FROM (SELECT series_id, t - 1 AS t, value, lag(value) OVER (PARTITION BY series_id ORDER BY t) AS before FROM ({WALKS})) WHERE before IS NOT NULL")
def compress_single_steps(spark, sf_dir):
    rows = pieces_of(compress_arrays(walk_series(spark, sf_dir), 0.1, 1, keep=["series_id"]), ["series_id"])
    return rows.select("series_id", F.col("idx").cast("long").alias("idx"), r6("inc").alias("inc"))


@query(pieces_sql(WALKS, 0.1) + f", c AS (SELECT series_id, count(*) AS n_pieces FROM pieces GROUP BY series_id), n AS (SELECT series_id, count(*) AS n FROM pts GROUP BY series_id) SELECT n.series_id, n_pieces, n, {q6('n_pieces / n')} AS rate FROM n JOIN c ON c.series_id = n.series_id")
def compression_rate(spark, sf_dir):
    rows = compress_arrays(walk_series(spark, sf_dir), 0.1).select("series_id", F.size("pieces").cast("long").alias("n_pieces"), F.size("values").cast("long").alias("n"))
    return rows.withColumn("rate", r6(F.col("n_pieces") / F.col("n")))


# --- digitization

_SCALED = "SELECT p.*, len / CASE WHEN sl = 0 THEN 1 ELSE sl END AS x, inc / CASE WHEN si = 0 THEN 1 ELSE si END AS y FROM pieces p, (SELECT stddev_pop(len) AS sl, stddev_pop(inc) AS si FROM pieces)"
_CODES = [(0, 1.0, -1.0), (1, 1.0, 0.0), (2, 2.0, 0.25), (3, 4.0, 0.5), (4, 12.0, 1.0)]
_CODES_SQL = "(VALUES " + ", ".join(f"({a}, {b}::DOUBLE, {c}::DOUBLE)" for a, b, c in _CODES) + ") AS c(label, clen, cinc)"
_ASSIGNED = f", a AS (SELECT series_id, idx, any_value(len) AS len, any_value(inc) AS inc, min((d, label))[2] AS label FROM (SELECT p.*, label, (len - clen) * (len - clen) + (inc - cinc) * (inc - cinc) AS d FROM pieces p, {_CODES_SQL}) GROUP BY series_id, idx) "


def codes(spark) -> DataFrame:
    return spark.createDataFrame(_CODES, "label int, len double, inc double")


def assigned(spark, sf_dir) -> DataFrame:
    return digitize.nearest(pieces(spark, sf_dir), codes(spark))


@query(pieces_sql(WALKS, 0.1) + f"SELECT series_id, idx, {q6('x')} AS x, {q6('y')} AS y FROM ({_SCALED})")
def scale_pieces(spark, sf_dir):
    rows = pieces(spark, sf_dir)
    return rows.select("*", *digitize.scaled(digitize.scale_of(rows))).select("series_id", F.col("idx").cast("long").alias("idx"), r6("x").alias("x"), r6("y").alias("y"))


@query(pieces_sql(WALKS, 0.1) + _ASSIGNED + "SELECT series_id, idx, label::BIGINT AS label FROM a")
def nearest_centre(spark, sf_dir):
    return assigned(spark, sf_dir).select("series_id", F.col("idx").cast("long").alias("idx"), F.col("label").cast("long").alias("label"))


@query(pieces_sql(WALKS, 0.1) + _ASSIGNED + f"SELECT label::BIGINT AS label, {q6('avg(len)')} AS len, {q6('avg(inc)')} AS inc, count(*) AS n_members FROM a GROUP BY label")
def group_centres(spark, sf_dir):
    return digitize.mean_codebook(assigned(spark, sf_dir)).select(F.col("label").cast("long").alias("label"), r6("len").alias("len"), r6("inc").alias("inc"), "n_members")


@query(pieces_sql(WALKS, 0.1) + _ASSIGNED + ", m AS (SELECT label, avg(len) AS ml, avg(inc) AS mi FROM a GROUP BY label) SELECT round(sum((len - ml) * (len - ml) + (inc - mi) * (inc - mi)), 4) AS wcss FROM a JOIN m ON m.label = a.label")
def within_cluster_squares(spark, sf_dir):
    rows = assigned(spark, sf_dir)
    return digitize.wcss(rows, digitize.mean_codebook(rows)).select(F.round("wcss", 4).alias("wcss"))


@query(pieces_sql(WALKS, 0.1) + _ASSIGNED + ", f AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, min((series_id, idx))) - 1 AS new FROM a GROUP BY label) SELECT series_id, idx, new AS label FROM a JOIN f ON f.label = a.label")
def labels_by_frequency(spark, sf_dir):
    return digitize.by_frequency(assigned(spark, sf_dir), ("series_id", "idx")).select("series_id", F.col("idx").cast("long").alias("idx"), F.col("label").cast("long").alias("label"))


@query(pieces_sql(WALKS, 0.1) + _ASSIGNED + "SELECT series_id, string_agg(substr('AaBbC', label + 1, 1), '' ORDER BY idx) AS symbols FROM a GROUP BY series_id")
def assign_symbols(spark, sf_dir):
    rows = assigned(spark, sf_dir).withColumn("symbol", C.symbol(F.col("label"), F.lit(5)))
    return rows.groupBy("series_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "symbol"))), lambda s: s["symbol"]), "").alias("symbols"))


#: Sort keys in SQL; pca: the axis of a symmetric matrix by its angle, turned so that the first point isn't above 0.
_KEYS = {"2-norm": "sqrt(x * x + y * y)", "norm": "sqrt(x * x + y * y)", "1-norm": "abs(x) + abs(y)", "lexi": "x", "pca": "CASE WHEN first_value(pc) OVER (ORDER BY series_id, idx) > 0 THEN -pc ELSE pc END"}
_PCA = "SELECT s.*, (x - avg(x) OVER ()) * cos(turn) + (y - avg(y) OVER ()) * sin(turn) AS pc FROM scaled s, (SELECT 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS turn FROM scaled)"


def greedy_sql(points: str, alpha: str, sorting: str = "2-norm", own: str = "") -> str:
    """CTEs ending in g(series_id, idx, label): greedy sorted aggregation of points(series_id, idx, x, y) as a recursion, a group
    a step: the first free point takes all free points within alpha. own: the column in each of whose values grouping begins anew.
    By 1-norm, a group ends before the first free point that is further off in both key and distance."""
    by = f"PARTITION BY {own}" if own else ""
    order = "x, y, series_id, idx" if sorting == "lexi" else "key, series_id, idx"
    source = _PCA if sorting == "pca" else "SELECT * FROM scaled"
    bar = f"AND ord < coalesce(min(ord) FILTER (NOT near AND key - hkey > {alpha}) OVER ({by}), 9223372036854775807)" if sorting == "1-norm" else ""
    return f""",
scaled AS MATERIALIZED ({points}),
keyed AS (SELECT *, {_KEYS[sorting]} AS key FROM ({source})),
r(step, series_id, idx, ord, x, y, key, label) AS (
  SELECT 0::BIGINT, series_id, idx, row_number() OVER ({by} ORDER BY {order}), x, y, key, NULL::BIGINT FROM keyed
  UNION ALL
  SELECT step + 1, series_id, idx, ord, x, y, key, CASE WHEN near {bar} OR ord = head THEN step END FROM (
    SELECT *, (x - hx) * (x - hx) + (y - hy) * (y - hy) <= ({alpha}) * ({alpha}) AS near FROM (
      SELECT *, min(ord) OVER w AS head, arg_min(x, ord) OVER w AS hx, arg_min(y, ord) OVER w AS hy, arg_min(key, ord) OVER w AS hkey FROM r WHERE label IS NULL WINDOW w AS ({by})))),
g AS (SELECT series_id, idx, label FROM r WHERE label IS NOT NULL)
"""


_JOINT_POINTS = "SELECT series_id, idx, x, y FROM (" + _SCALED + ")"


def _aggregate(sorting: str, alpha: float):
    ORACLE_SQL[f"aggregate_{sorting.replace('-', '')}"] = pieces_sql(WALKS, 0.1) + greedy_sql(_JOINT_POINTS, f"{alpha}::DOUBLE", sorting) + "SELECT series_id, idx, label FROM g"

    def f(spark, sf_dir):
        rows = pieces(spark, sf_dir)
        labelled, _ = digitize.aggregate(rows.select("series_id", "channel", "idx", *digitize.scaled(digitize.scale_of(rows))), alpha, sorting)
        return labelled.select("series_id", F.col("idx").cast("long").alias("idx"), F.col("label").cast("long").alias("label"))

    QUERIES[f"aggregate_{sorting.replace('-', '')}"] = f


for _s in digitize.SORTINGS:
    _aggregate(_s, 0.1)


@query()
def cluster_k_means(spark, sf_dir):
    rows = pieces(spark, sf_dir)
    return cluster.k_means(rows.select("series_id", "channel", "idx", *digitize.scaled(digitize.scale_of(rows))), 5).select("series_id", "idx", "label")


@query()
def cluster_sampled_k_means(spark, sf_dir):
    rows = pieces(spark, sf_dir)
    return cluster.sampled_k_means(rows.select("series_id", "channel", "idx", *digitize.scaled(digitize.scale_of(rows))), 5, 0.3).select("series_id", "idx", "label")


@query()
def cluster_fewest(spark, sf_dir):
    rows = pieces(spark, sf_dir)
    n = walks(spark, sf_dir).count()
    labelled, _ = cluster.fewest_clusters(rows.select("series_id", "channel", "idx", *digitize.scaled(digitize.scale_of(rows))), 4.0, n, max_k=6)
    return labelled.select("series_id", "idx", "label")


# --- symbolizers


_EACH = pieces_sql(WALKS, 0.1) + greedy_sql("SELECT p.series_id, idx, len / CASE WHEN sl = 0 THEN 1 ELSE sl END AS x, inc / CASE WHEN si = 0 THEN 1 ELSE si END AS y FROM pieces p JOIN (SELECT series_id, stddev_pop(len) AS sl, stddev_pop(inc) AS si FROM pieces GROUP BY series_id) d ON d.series_id = p.series_id", "0.1::DOUBLE", own="series_id")
_LETTER = "CASE WHEN k < 52 THEN substr('" + "".join(C.alphabet()) + "', (label + 1)::INT, 1) ELSE chr((label + 33)::INT) END"


@query(_EACH + f""", b AS (SELECT series_id, max(label) + 1 AS k, count(*) AS c FROM g GROUP BY series_id), n AS (SELECT series_id, count(*) AS n FROM pts GROUP BY series_id), t AS (SELECT g.series_id, string_agg({_LETTER}, '' ORDER BY idx) AS s FROM g JOIN b ON b.series_id = g.series_id GROUP BY g.series_id)
SELECT n.series_id, n::INT AS n, coalesce(c, 0)::INT AS n_pieces, coalesce(k, 0)::INT AS n_symbols, coalesce(s, '') AS string FROM n LEFT JOIN b ON b.series_id = n.series_id LEFT JOIN t ON t.series_id = n.series_id""")
def symbolize_each(spark, sf_dir):
    """The flagship: every user's running total in symbols."""
    made = estimators.EachSymbolizer(tol=0.1, alpha=0.1).transform(walk_series(spark, sf_dir))
    return made.select("series_id", "n", F.size("pieces").alias("n_pieces"), F.size("codebook").alias("n_symbols"), "string")


@query(_EACH + f""", m AS (SELECT p.series_id, label, avg(len) AS len, avg(inc) AS inc FROM pieces p JOIN g ON g.series_id = p.series_id AND g.idx = p.idx GROUP BY ALL),
a AS MATERIALIZED (SELECT g.series_id, idx, len, inc, max(idx) OVER (PARTITION BY g.series_id) AS last FROM g JOIN m ON m.series_id = g.series_id AND m.label = g.label),
w(series_id, idx, carry, whole) AS (
  SELECT DISTINCT series_id, -1::BIGINT, 0::DOUBLE, 0::DOUBLE FROM pts
  UNION ALL
  SELECT series_id, idx, want - got, got FROM (SELECT series_id, idx, want, CASE WHEN round_even(want, 0) = 0 AND idx < last THEN 1 ELSE round_even(want, 0) END AS got FROM (
    SELECT w.series_id, a.idx, last, len + w.carry AS want FROM w JOIN a ON a.series_id = w.series_id AND a.idx = w.idx + 1))),
o AS (SELECT a.series_id, a.idx, whole, inc, st.value + coalesce(sum(inc) OVER before_, 0) AS x, coalesce(sum(whole) OVER before_, 0) AS place FROM a JOIN w ON w.series_id = a.series_id AND w.idx = a.idx JOIN pts st ON st.series_id = a.series_id AND st.t = 0 WINDOW before_ AS (PARTITION BY a.series_id ORDER BY a.idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT series_id, (place + i)::INT AS t, {q6('x + i / whole * inc')} AS value FROM (SELECT *, unnest(generate_series(1, whole::BIGINT)) AS i FROM o) UNION ALL SELECT series_id, 0, {q6('value')} FROM pts WHERE t = 0""")
def reconstruct_each(spark, sf_dir):
    s = estimators.EachSymbolizer(tol=0.1, alpha=0.1)
    return s.inverse(s.transform(walk_series(spark, sf_dir))).select("series_id", "t", r6("value").alias("value"))


#: alpha from the number of points and pieces, for a tolerance.
_AUTO = "(SELECT (30 * (s - n) * {tol}::DOUBLE * {tol} / (81 * s)) ^ 0.25 FROM (SELECT (SELECT count(*) FROM pts) AS s, (SELECT count(*) FROM pieces) AS n))"


def joint_sql(alpha: float | None, sorting: str = "norm", *, tol: float = 0.1, fixed_point: bool = False) -> str:
    """Symbols of all series over one codebook of greedy groups. fixed_point: increments are the end values of pieces."""
    ends = ", ends_ AS (SELECT p.series_id, idx, len, sum(len) OVER (PARTITION BY p.series_id ORDER BY idx) AS at FROM pieces p)"
    pieces_ = "(SELECT e.series_id, idx, len, value AS inc FROM ends_ e JOIN pts ON pts.series_id = e.series_id AND pts.t = e.at)" if fixed_point else "pieces"
    points = f"SELECT series_id, idx, len / CASE WHEN sl = 0 THEN 1 ELSE sl END AS x, inc / CASE WHEN si = 0 THEN 1 ELSE si END AS y FROM {pieces_} p, (SELECT stddev_pop(len) AS sl, stddev_pop(inc) AS si FROM {pieces_})"
    near = f"{alpha}::DOUBLE" if alpha else _AUTO.format(tol=tol)
    return pieces_sql(WALKS, tol) + (ends if fixed_point else "") + f", al AS MATERIALIZED (SELECT {near} AS alpha)" + greedy_sql(points, "(SELECT alpha FROM al)", sorting) + f""", k AS (SELECT max(label) + 1 AS k FROM g),
t AS (SELECT series_id, string_agg({_LETTER}, '' ORDER BY idx) AS symbols FROM g, k GROUP BY series_id) SELECT n.series_id, n::INT AS n, coalesce(symbols, '') AS symbols FROM (SELECT series_id, count(*) AS n FROM pts GROUP BY series_id) n LEFT JOIN t ON t.series_id = n.series_id"""


def _joint(name: str, make, sql: str | None = None):
    if sql:
        ORACLE_SQL[name] = sql

    def f(spark, sf_dir):
        _, symbols = make().fit_transform(walk_series(spark, sf_dir))
        return symbols.select("series_id", "n", F.array_join("symbols", "").alias("symbols"))

    QUERIES[name] = f


_joint("symbolize_joint", lambda: estimators.joint(tol=0.1), joint_sql(None))
_joint("symbolize_joint_pca", lambda: estimators.joint(tol=0.1, alpha=0.2, sorting="pca"), joint_sql(0.2, "pca"))
_joint("symbolize_joint_k_means", lambda: estimators.joint(tol=0.1, init="k-means", k=8))
_joint("symbolize_quantized", lambda: estimators.quantized(tol=0.1), joint_sql(None))
_joint("symbolize_fixed_point", lambda: estimators.fixed_point(tol=0.1), joint_sql(0.1, fixed_point=True))
_joint("symbolize_fast", lambda: estimators.fast(tol=0.1, k=8))
_joint("symbolize_fast_quantized", lambda: estimators.fast_quantized(tol=0.1), joint_sql(0.5))
_joint("symbolize_fast_fixed_point", lambda: estimators.fast_fixed_point(tol=0.1), joint_sql(0.5, fixed_point=True))


@query()
def symbolize_unseen(spark, sf_dir):
    """Symbols of all series as if they were unseen, by the nearest centres of a fitted codebook, and their reconstruction error."""
    rows = walk_series(spark, sf_dir)
    model = estimators.joint(tol=0.1).fit(rows)
    back = model.inverse(model.transform(rows))
    return metrics.relative_error(to_points(rows, ["series_id"]), back)


# no SQL: places that two series reach give 1 and -1 but for rounding, and such ties fall differently in each engine
@query()
def symbolize_standardised(spark, sf_dir):
    model, symbols, _ = estimators.general_compress(estimators.joint(tol=0.3), points(spark, sf_dir).select("series_id", F.lit(0).alias("channel"), "t", "value"))
    return symbols.select("series_id", F.array_join("symbols", "").alias("symbols"))


# --- reconstruction

_FRACTIONS = "CASE WHEN label < 3 THEN len + 0.5 ELSE len + 0.25 END"


@query(pieces_sql(WALKS, 0.1) + _ASSIGNED + f""", n AS (SELECT series_id, max(idx) AS last FROM a GROUP BY series_id),
w(series_id, idx, carry, whole) AS (
  SELECT series_id, -1::BIGINT, 0::DOUBLE, NULL::DOUBLE FROM n
  UNION ALL
  SELECT series_id, idx, want - got, got FROM (SELECT series_id, idx, want, CASE WHEN round_even(want, 0) = 0 AND idx < last THEN 1 ELSE round_even(want, 0) END AS got FROM (
    SELECT w.series_id, a.idx, n.last, {_FRACTIONS} + w.carry AS want FROM w JOIN a ON a.series_id = w.series_id AND a.idx = w.idx + 1 JOIN n ON n.series_id = w.series_id)))
SELECT series_id, idx, whole::BIGINT AS len FROM w WHERE idx >= 0""")
def quantize_lengths(spark, sf_dir):
    lengths = F.when(F.col("label") < 3, F.col("len") + 0.5).otherwise(F.col("len") + 0.25)
    rows = assigned(spark, sf_dir).withColumn("f", lengths).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("idx", "f"))).alias("x"))
    rows = rows.select("series_id", F.posexplode(C.whole_lengths(F.transform("x", lambda s: s["f"]))).alias("idx", "len"))
    return rows.select("series_id", F.col("idx").cast("long").alias("idx"), F.col("len").cast("long").alias("len"))


_STARTS = ", st AS (SELECT series_id, value AS start FROM pts WHERE t = 0)"
_STITCH = pieces_sql(WALKS, 0.1) + _STARTS + f""", b AS (SELECT p.*, start + coalesce(sum(inc) OVER (PARTITION BY p.series_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x,
 coalesce(sum(len) OVER (PARTITION BY p.series_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM pieces p JOIN st ON st.series_id = p.series_id)
SELECT series_id, (before_ + i)::BIGINT AS t, {q6('x + i / len * inc')} AS value FROM (SELECT *, unnest(generate_series(1, len)) AS i FROM b) UNION ALL SELECT series_id, 0, {q6('start')} FROM st"""


def _arrays(spark, sf_dir, inc: str = "inc") -> DataFrame:
    rows = compress_arrays(walk_series(spark, sf_dir), 0.1)
    return rows.select("series_id", F.get("values", F.lit(0)).alias("start"), F.transform("pieces", lambda p: p["len"].cast("double")).alias("lengths"), F.transform("pieces", lambda p: p[inc]).alias("incs"))


def _points(rows: DataFrame) -> DataFrame:
    return rows.select("series_id", F.col("t").cast("long").alias("t"), r6("value").alias("value"))


@query(_STITCH)
def stitch(spark, sf_dir):
    return _points(inverse.stitched(_arrays(spark, sf_dir), "series_id"))


@query(_STITCH)
def stitch_fixed_point(spark, sf_dir):
    return _points(inverse.stitched(_arrays(spark, sf_dir, "end_value"), "series_id", fixed_point=True))


@query(_STITCH)
def stitch_by_windows(spark, sf_dir):
    rows = compress_arrays(walk_series(spark, sf_dir), 0.1).select("series_id", F.get("values", F.lit(0)).alias("start"), F.inline("pieces"))
    return _points(inverse.stitched_by_windows(rows, ["series_id"]))


@query(f"SELECT series_id, CASE WHEN len(v) > 60 THEN v[1:59] || [v[-1]] ELSE v || list_resize([]::DOUBLE[], 60 - len(v), v[-1]) END AS values FROM (SELECT series_id, list(round(value, 2) ORDER BY t) AS v FROM ({POINTS}) GROUP BY series_id)")
def trim_keeping_ends(spark, sf_dir):
    return to_series(points(spark, sf_dir), "series_id", "t", F.round("value", 2)).select("series_id", C.keep_ends(F.col("values"), 60).alias("values"))


@query(f"SELECT series_id, CASE WHEN len(v) >= 70 THEN v[1:70] ELSE v || list_resize([]::DOUBLE[], 70 - len(v), v[-1]) END AS values FROM (SELECT series_id, list(round(value, 2) ORDER BY t) AS v FROM ({POINTS}) GROUP BY series_id)")
def pad_or_truncate(spark, sf_dir):
    rows = points(spark, sf_dir).withColumn("value", F.round("value", 2))
    return inverse.to_length(rows, ["series_id"], 70, "pad").select("series_id", "values")


@query(f"SELECT series_id, t, value FROM ({POINTS})")
def series_round_trip(spark, sf_dir):
    return to_points(to_series(points(spark, sf_dir), "series_id", "t", "value"), "series_id").select("series_id", F.col("t").cast("long").alias("t"), "value")


@query("SELECT vec_id AS series_id, i // 16 AS channel, i % 16 AS t, round(v::DOUBLE, 6) + 0.0 AS value FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)")
def channels_round_trip(spark, sf_dir):
    """64 numbers as 4 channels of 16 steps, through both stackings and back."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("series_id"), F.posexplode("embedding").alias("i", "value"))
    long = rows.select("series_id", F.floor(F.col("i") / 16).cast("int").alias("channel"), (F.col("i") % 16).alias("t"), F.col("value").cast("double"))
    back = unstack_channels(stack_channels(long, 16, last_dim=False), 16)
    cube = channel_arrays(back)
    flat = array_channels(cube, "series_id", "cube")
    return flat.select("series_id", F.col("channel").cast("long").alias("channel"), F.col("t").cast("long").alias("t"), r6(F.col("value").cast("double")).alias("value"))


@query()
def mean_patches(spark, sf_dir):
    made = estimators.EachSymbolizer(tol=0.1, alpha=0.5).transform(walk_series(spark, sf_dir))
    return patches.mean_patches(patches.patches(made)).select("series_id", "label", F.transform("patch", lambda x: F.round(x, 6)).alias("patch"))


@query()
def reconstruct_from_patches(spark, sf_dir):
    made = estimators.EachSymbolizer(tol=0.1, alpha=0.5).transform(walk_series(spark, sf_dir))
    return patches.from_patches(patches.patches(made), made.select("series_id", "start")).select("series_id", F.transform("values", lambda x: F.round(x, 6)).alias("values"))


# --- quantisation and storage


def _quantized(bits: int) -> str:
    low, high = quantizer.bounds(bits)
    return f"SELECT series_id, t, greatest({low}, least({high}, round_even((value - z) / s, 0)))::BIGINT AS q, round(s * greatest({low}, least({high}, round_even((value - z) / s, 0)))::FLOAT::DOUBLE + z, 4) + 0.0 AS back FROM ({POINTS}), (SELECT (max(value) - min(value)) / {high - low} AS s, (min(value) * {high} - max(value) * {low}) / {high - low} AS z FROM events)"


@query(_quantized(8))
def quantize_8_bits(spark, sf_dir):
    rows = points(spark, sf_dir)
    q = quantizer.fit(events(spark, sf_dir), "value", 8)
    return rows.withColumn("q", q.quantize(F.col("value"))).select("series_id", F.col("t").cast("long").alias("t"), F.col("q").cast("long").alias("q"), (F.round(q.dequantize(F.col("q")), 4) + F.lit(0.0)).alias("back"))


@query(_quantized(12))
def quantize_12_bits(spark, sf_dir):
    rows = points(spark, sf_dir)
    q = quantizer.fit(events(spark, sf_dir), "value", 12)
    return rows.withColumn("q", q.quantize(F.col("value"))).select("series_id", F.col("t").cast("long").alias("t"), F.col("q").cast("long").alias("q"), (F.round(q.dequantize(F.col("q")), 4) + F.lit(0.0)).alias("back"))


@query(pieces_sql(WALKS, 0.1) + _ASSIGNED + f"SELECT {len(_CODES)}::BIGINT AS k, count(*) AS n_symbols, count(DISTINCT series_id) AS n_series, ({len(_CODES)} * 24 + 8 * count(*) + 64 * count(DISTINCT series_id) + 128)::BIGINT AS bits FROM a")
def storage(spark, sf_dir):
    rows = assigned(spark, sf_dir).groupBy("series_id").agg(F.collect_list("label").alias("symbols"))
    return quantizer.storage_bits(rows, codes(spark), 8, 16, quantized=True)


# --- sequences


@query(f"SELECT doc, seq[1:10] AS seq FROM ({SEQ})")
def truncate_sequences(spark, sf_dir):
    return encoders.truncate(sequences(spark, sf_dir), 10, "post")


_LENS = f"SELECT doc, list(length(token) ORDER BY pos) AS seq FROM ({TOK}) GROUP BY doc"


@query(f"SELECT doc, CASE WHEN len(seq) > 50 THEN seq[-50:] ELSE seq || list_resize([]::BIGINT[], 50 - len(seq), seq[-1]) END AS seq FROM ({_LENS})")
def pad_sequences(spark, sf_dir):
    rows = sequences(spark, sf_dir).withColumn("seq", F.transform("seq", lambda x: F.length(x)))
    return encoders.pad(rows, 50).select("doc", F.col("seq").cast("array<bigint>").alias("seq"))


@query(DICT)
def token_dictionary(spark, sf_dir):
    return encoders.dictionary(sequences(spark, sf_dir)).select("token", F.col("id").cast("long").alias("id"))


@query(f"SELECT count(DISTINCT token) + 1 AS corpus_size FROM ({TOK})")
def corpus_size(spark, sf_dir):
    return encoders.corpus_size(sequences(spark, sf_dir))


@query(f"SELECT token, count(*) AS n FROM ({TOK}) GROUP BY token")
def symbol_counts(spark, sf_dir):
    return encoders.symbol_counts(sequences(spark, sf_dir))


@query(f"WITH d AS ({DICT}) SELECT doc, list(id ORDER BY pos) AS ids FROM ({TOK}) t JOIN d ON d.token = t.token GROUP BY doc")
def encode_categories(spark, sf_dir):
    return encoders.categorical(sequences(spark, sf_dir)).select("doc", F.col("ids").cast("array<bigint>").alias("ids"))


@query(f"WITH t AS ({TOK}), c AS (SELECT token, count(*) AS n FROM t GROUP BY token), d AS ({DICT}) SELECT doc, id, n::DOUBLE AS value FROM (SELECT DISTINCT doc, token FROM t) x JOIN c ON c.token = x.token JOIN d ON d.token = x.token")
def bag_of_words(spark, sf_dir):
    return encoders.bag_of_words(sequences(spark, sf_dir)).select("doc", F.col("id").cast("long").alias("id"), "value")


@query(f"WITH d AS ({DICT}) SELECT doc, id, 1::DOUBLE AS value FROM (SELECT DISTINCT doc, token FROM ({TOK})) x JOIN d ON d.token = x.token")
def one_hot(spark, sf_dir):
    return encoders.one_hot(sequences(spark, sf_dir)).select("doc", F.col("id").cast("long").alias("id"), "value")


@query(f"""WITH c AS (SELECT doc, unnest(string_split(lower(array_to_string(seq, ' ')), '')) AS term FROM ({SEQ})), tf AS (SELECT doc, term, count(*) AS tf FROM c WHERE term <> '' GROUP BY doc, term),
 f AS (SELECT term, count(*) AS df FROM tf GROUP BY term), w AS (SELECT doc, tf.term, tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1) AS w FROM tf JOIN f ON f.term = tf.term)
 SELECT doc, term, {q6('w / sqrt(sum(w * w) OVER (PARTITION BY doc))')} AS weight FROM w""")
def char_tf_idf(spark, sf_dir):
    return encoders.char_tf_idf(sequences(spark, sf_dir)).select("doc", "term", r6("weight").alias("weight"))


@query(f"SELECT doc, list_transform(generate_series(1, greatest(len(seq) - 3, 0)), lambda i: array_to_string(seq[i:i + 4], '')) AS seq FROM ({SEQ})")
def n_grams(spark, sf_dir):
    return encoders.n_grams(sequences(spark, sf_dir), 5)


@query(f"SELECT doc, array_to_string(seq, ' ') AS text FROM ({SEQ})")
def join_sequences(spark, sf_dir):
    return encoders.joined(sequences(spark, sf_dir))


@query(f"WITH l AS (SELECT len(seq) AS n, row_number() OVER (ORDER BY len(seq)) AS k, count(*) OVER () AS c FROM ({SEQ})) SELECT n::BIGINT AS length FROM l WHERE k = round_even(0.9 * c, 0)")
def covering_length(spark, sf_dir):
    return encoders.covering_length(sequences(spark, sf_dir), 0.9).select(F.col("length").cast("long").alias("length"))


@query(f"WITH x AS ({LABELLED}), c AS (SELECT label, token, count(*) AS n FROM (SELECT label, unnest(seq) AS token FROM x) GROUP BY label, token) SELECT label, token, n FROM c")
def class_counts(spark, sf_dir):
    return encoders.class_counts(labelled_sequences(spark, sf_dir))


_TFIDF = f"""WITH x AS ({LABELLED}), c AS (SELECT label, token, count(*) AS n FROM (SELECT label, unnest(seq) AS token FROM x) GROUP BY label, token),
 f AS (SELECT token, count(*) AS df FROM c GROUP BY token), t AS (SELECT label, sum(n) AS total FROM c GROUP BY label),
 w AS (SELECT c.label, c.token, n / total AS tf, n / total * ln(1 + (SELECT count(*) FROM t) / df) AS tf_idf FROM c JOIN f ON f.token = c.token JOIN t ON t.label = c.label)"""


@query(_TFIDF + " SELECT label, token, round(tf, 9) AS tf, round(tf_idf, 9) AS tf_idf FROM w")
def tf_idf(spark, sf_dir):
    return encoders.tf_idf(encoders.class_counts(labelled_sequences(spark, sf_dir))).select("label", "token", F.round("tf", 9).alias("tf"), F.round("tf_idf", 9).alias("tf_idf"))


@query(_TFIDF + " SELECT label, token, round(tf_idf, 9) AS weight FROM w WHERE tf_idf >= 1e-5")
def class_matrix(spark, sf_dir):
    w = encoders.tf_idf(encoders.class_counts(labelled_sequences(spark, sf_dir)))
    return encoders.class_matrix(w, threshold=1e-5).select("label", "token", F.round("weight", 9).alias("weight"))


@query(_TFIDF + f""", k AS (SELECT doc, token, count(*) AS n FROM ({TOK}) WHERE token IN (SELECT token FROM w) GROUP BY doc, token), dn AS (SELECT doc, sqrt(sum(n * n)) AS dn FROM k GROUP BY doc), cn AS (SELECT label, sqrt(sum(tf_idf * tf_idf)) AS cn FROM w GROUP BY label),
 s AS (SELECT k.doc, w.label, 1 - sum(n * tf_idf) / any_value(dn) / any_value(cn) AS distance FROM k JOIN w ON w.token = k.token JOIN dn ON dn.doc = k.doc JOIN cn ON cn.label = w.label GROUP BY k.doc, w.label),
 b AS (SELECT doc, min((distance, label)) AS b FROM s GROUP BY doc) SELECT d.doc_id AS doc, coalesce(b.b[2], (SELECT min(label) FROM w)) AS label, {q6('coalesce(b.b[1], 1)')} AS distance FROM documents d LEFT JOIN b ON b.doc = d.doc_id""")
def classify(spark, sf_dir):
    w = encoders.class_matrix(encoders.tf_idf(encoders.class_counts(labelled_sequences(spark, sf_dir))))
    return encoders.classify(sequences(spark, sf_dir), w).select("doc", "label", r6("distance").alias("distance"))


@query(f"SELECT label, md5(array_to_string(flatten(list(seq ORDER BY doc)), ' ')) AS digest FROM ({LABELLED}) GROUP BY label")
def class_corpus(spark, sf_dir):
    return encoders.class_digests(labelled_sequences(spark, sf_dir))


_BOOK = "SELECT label, (clen - (SELECT avg(clen) FROM c0)) / (SELECT stddev_pop(clen) FROM c0) AS x, (cinc - (SELECT avg(cinc) FROM c0)) / (SELECT stddev_pop(cinc) FROM c0) AS y FROM c0"


@query(pieces_sql(WALKS, 0.1) + _ASSIGNED + f", c0 AS (SELECT * FROM {_CODES_SQL}), e AS ({_BOOK}) SELECT a.series_id AS doc, list([{q6('x')}, {q6('y')}] ORDER BY idx) AS vectors FROM a JOIN e ON e.label = a.label GROUP BY a.series_id")
def embed_symbols(spark, sf_dir):
    rows = assigned(spark, sf_dir).groupBy(F.col("series_id").alias("doc")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "label"))), lambda s: s["label"].cast("string")).alias("seq"))
    return encoders.embed(rows, codes(spark)).select("doc", F.transform("vectors", lambda v: F.transform(v, lambda x: F.round(x, 6) + F.lit(0.0))).alias("vectors"))


# --- baselines, metrics


def _bins(x: str, cuts: list[float]) -> str:
    return " + ".join(f"CASE WHEN {x} >= {c!r} THEN 1 ELSE 0 END" for c in cuts)


_WINDOWS = f"SELECT * FROM (SELECT series_id, t, value, t // 5 AS w, count(*) OVER (PARTITION BY series_id) // 5 AS nw FROM ({WALKS})) WHERE w < nw"


@query(f"SELECT series_id, w, label::BIGINT AS label, chr((label + 97)::INT) AS symbol FROM (SELECT series_id, w, {_bins('avg(value)', baselines.breakpoints(6))} AS label FROM ({_WINDOWS}) GROUP BY series_id, w)")
def sax(spark, sf_dir):
    return baselines.sax(walks(spark, sf_dir), 5, 6).select("series_id", F.col("w").cast("long").alias("w"), F.col("label").cast("long").alias("label"), "symbol")


_MIDS = ", ".join(repr(x) for x in baselines.midpoints(6))


@query(f"WITH s AS (SELECT series_id, w, {_bins('avg(value)', baselines.breakpoints(6))} AS label FROM ({_WINDOWS}) GROUP BY series_id, w) SELECT series_id, w * 5 + i AS t, {q6(f'([{_MIDS}]::DOUBLE[])[label + 1]')} AS value FROM s, (SELECT unnest(generate_series(0, 4)) AS i)")
def inverse_sax(spark, sf_dir):
    return _points(baselines.inverse_sax(baselines.sax(walks(spark, sf_dir), 5, 6), 5, 6))


_ONE_D = f"SELECT series_id, w, ({_bins('covar_pop(value, t) / var_pop(t)', baselines.breakpoints(4, sqrt(0.03 / 5)))}) * 4 + {_bins('avg(value)', baselines.breakpoints(4))} AS label FROM ({_WINDOWS}) GROUP BY series_id, w"


@query(f"SELECT series_id, w, label::BIGINT AS label FROM ({_ONE_D})")
def one_d_sax(spark, sf_dir):
    return baselines.one_d_sax(walks(spark, sf_dir), 5, 4, 4).select("series_id", F.col("w").cast("long").alias("w"), F.col("label").cast("long").alias("label"))


@query(f"SELECT series_id, w * 5 + i AS t, {q6(f'(i - 2.0) * ({[*baselines.midpoints(4, sqrt(0.03 / 5))]}::DOUBLE[])[label // 4 + 1] + ({[*baselines.midpoints(4)]}::DOUBLE[])[label % 4 + 1]')} AS value FROM ({_ONE_D}), (SELECT unnest(generate_series(0, 4)) AS i)")
def inverse_one_d_sax(spark, sf_dir):
    return _points(baselines.inverse_one_d_sax(baselines.one_d_sax(walks(spark, sf_dir), 5, 4, 4), 5, 4, 4))


def _with_sax(spark, sf_dir) -> DataFrame:
    back = baselines.inverse_sax(baselines.sax(walks(spark, sf_dir), 5, 6), 5, 6).withColumnRenamed("value", "other")
    return walks(spark, sf_dir).join(back, ["series_id", "t"])


_BOTH = f"WITH s AS (SELECT series_id, w, {_bins('avg(value)', baselines.breakpoints(6))} AS label FROM ({_WINDOWS}) GROUP BY series_id, w), both_ AS (SELECT x.series_id, x.t, x.value, ([{_MIDS}]::DOUBLE[])[label + 1] AS other FROM ({_WINDOWS}) x JOIN s ON s.series_id = x.series_id AND s.w = x.w)"


@query(_BOTH + f" SELECT {q6('sum(d) / sum(x)')} AS rel_error FROM (SELECT sqrt(sum((value - other) ** 2)) AS d, sqrt(sum(value * value)) AS x FROM both_ GROUP BY series_id)")
def relative_error(spark, sf_dir):
    both = _with_sax(spark, sf_dir)
    return metrics.relative_error(both.select("series_id", "t", "value"), both.select("series_id", "t", F.col("other").alias("value"))).select(r6("rel_error").alias("rel_error"))


@query(_BOTH + f" SELECT {q6('avg(200 * abs(other - value) / (abs(value) + abs(other)))')} AS smape FROM both_")
def smape(spark, sf_dir):
    return metrics.smape(_with_sax(spark, sf_dir)).select(r6("smape").alias("smape"))


@query(_BOTH + f" SELECT series_id, {q6('sqrt(sum(d * d))')} AS l2, {q6('coalesce(sqrt(sum(dd * dd)), 0)')} AS l2_diff FROM (SELECT series_id, d, d - lag(d) OVER (PARTITION BY series_id ORDER BY t) AS dd FROM (SELECT series_id, t, value - other AS d FROM both_)) GROUP BY series_id")
def l2_errors(spark, sf_dir):
    return metrics.l2_errors(_with_sax(spark, sf_dir)).select("series_id", r6("l2").alias("l2"), r6("l2_diff").alias("l2_diff"))


@query(f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT series_id, t, value::DOUBLE AS value FROM ({WALKS})),
d(series_id, i, j, total) AS (
  SELECT a.series_id, 0::BIGINT, b.t, sum((a.value - b.value) * (a.value - b.value)) OVER (PARTITION BY a.series_id ORDER BY b.t) FROM v a JOIN v b ON b.series_id = a.series_id + 1 WHERE a.t = 0
  UNION ALL
  SELECT series_id, i, j, upto + min(best - (upto - cost)) OVER (PARTITION BY series_id ORDER BY j) FROM (
    SELECT *, sum(cost) OVER (PARTITION BY series_id ORDER BY j) AS upto FROM (
      SELECT d.series_id, d.i + 1 AS i, j, (a.value - b.value) * (a.value - b.value) AS cost, least(total, coalesce(lag(total) OVER (PARTITION BY d.series_id ORDER BY j), 'infinity'::DOUBLE)) AS best
      FROM d JOIN v a ON a.series_id = d.series_id AND a.t = d.i + 1 JOIN v b ON b.series_id = d.series_id + 1 AND b.t = d.j)))
SELECT series_id, {q6("arg_max(total, (i, j))")} AS dtw FROM d GROUP BY series_id""")
def dtw_distance(spark, sf_dir):
    """Each user's walk against the walk of the next user by id."""
    rows = walk_series(spark, sf_dir).select("series_id", F.col("values").alias("a"))
    other = rows.select((F.col("series_id") - 1).alias("series_id"), F.col("a").alias("b"))
    return metrics.dtw(rows.join(other, "series_id")).select("series_id", r6("dtw").alias("dtw"))


_SCORES = "SELECT user_id AS problem, event_type AS solver, avg(value) AS score FROM events GROUP BY ALL"


@query(f"WITH s AS ({_SCORES}), b AS (SELECT problem, min(score) AS best FROM s GROUP BY problem) SELECT solver, theta, {q6('sum(CASE WHEN score <= theta * best THEN 1.0 ELSE 0 END) / (SELECT count(*) FROM b)')} AS share FROM s JOIN b ON b.problem = s.problem, (SELECT unnest([1.0::DOUBLE, 1.5, 2.0, 4.0]) AS theta) GROUP BY solver, theta")
def performance_profile(spark, sf_dir):
    rows = to_series(events(spark, sf_dir), ["series_id", "event_type"], "event_id", "value").withColumn("values", F.filter("values", lambda x: x.isNotNull()))
    total = F.aggregate("values", F.lit(0.0), lambda s, x: s + x)  # in order of event, so that reruns agree to the last bit
    score = F.when(F.size("values") > 0, total / F.size("values")).alias("score")
    scores = rows.select(F.col("series_id").alias("problem"), F.col("event_type").alias("solver"), score)
    return metrics.performance_profile(scores, [1.0, 1.5, 2.0, 4.0]).select("solver", "theta", r6("share").alias("share"))


_TOLS = (0.05, 0.2, 0.5, 2.0)


@query("SELECT series_id, min(tol) AS tol FROM (" + " UNION ALL ".join(f"SELECT n.series_id, CASE WHEN c <= 0.2 * n THEN {tol}::DOUBLE END AS tol FROM ({pieces_sql(WALKS, tol)} SELECT series_id, count(*) AS c FROM pieces GROUP BY series_id) p JOIN (SELECT user_id AS series_id, count(*) AS n FROM events GROUP BY user_id) n ON n.series_id = p.series_id" for tol in _TOLS) + ") GROUP BY series_id")
def first_tolerance(spark, sf_dir):
    rows = walk_series(spark, sf_dir)
    parts = [compress_arrays(rows, tol).select("series_id", F.lit(tol).alias("tol"), F.size("pieces").alias("n_pieces"), F.size("values").alias("n")) for tol in _TOLS]
    made = parts[0]
    for p in parts[1:]:
        made = made.unionAll(p)
    return metrics.first_tolerance(made)


@query(f"SELECT event_type, {q6('avg(value)')} AS value FROM events GROUP BY event_type")
def mean_by_group(spark, sf_dir):
    return metrics.mean_by(events(spark, sf_dir), ["event_type"], ["value"]).select("event_type", r6("value").alias("value"))


@query("""WITH c AS (SELECT label, vec_id % 7 AS truth, count(*) AS c FROM embeddings GROUP BY ALL), s AS (SELECT sum(c * (c - 1) / 2) AS b, sum(c) AS n FROM c),
 a AS (SELECT sum(c * (c - 1) / 2) AS a FROM (SELECT sum(c) AS c FROM c GROUP BY label)), t AS (SELECT sum(c * (c - 1) / 2) AS t FROM (SELECT sum(c) AS c FROM c GROUP BY truth))
 SELECT round((b - a * t / (n * (n - 1) / 2)) / ((a + t) / 2 - a * t / (n * (n - 1) / 2)), 6) + 0.0 AS ari FROM s, a, t""")
def adjusted_rand(spark, sf_dir):
    return metrics.adjusted_rand(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", (F.col("vec_id") % 7).alias("truth"))).select(r6("ari").alias("ari"))


@query("""WITH p AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label FROM embeddings), c AS (SELECT label, avg(x) AS cx, avg(y) AS cy, count(*) AS n FROM p GROUP BY label),
 w AS (SELECT p.label, avg(sqrt((x - cx) ** 2 + (y - cy) ** 2)) AS s, sum((x - cx) ** 2 + (y - cy) ** 2) AS w FROM p JOIN c ON c.label = p.label GROUP BY p.label),
 d AS (SELECT a.label, max((wa.s + wb.s) / sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2)) AS r FROM c a JOIN c b ON a.label <> b.label JOIN w wa ON wa.label = a.label JOIN w wb ON wb.label = b.label GROUP BY a.label),
 m AS (SELECT avg(x) AS mx, avg(y) AS my, count(*) AS n FROM p), b AS (SELECT sum(c.n * ((cx - mx) ** 2 + (cy - my) ** 2)) AS b, count(*) AS k FROM c, m)
 SELECT round((b / (k - 1)) / ((SELECT sum(w) FROM w) / (n - k)), 6) AS calinski_harabasz, round((SELECT avg(r) FROM d), 4) AS davies_bouldin FROM b, m""")
def cluster_separation(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), "label")
    return metrics.separation(rows).select(r6("calinski_harabasz").alias("calinski_harabasz"), F.round("davies_bouldin", 4).alias("davies_bouldin"))


_PIXELS = "SELECT vec_id AS image_id, list_transform(embedding, lambda x: (abs(floor(x::DOUBLE * 1000)) % 256)::BIGINT) AS values FROM embeddings"


@query(_PIXELS)
def image_round_trip(spark, sf_dir):
    """Vectors as 8 x 8 images: standardised and restored."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), F.array(F.lit(8), F.lit(8)).alias("shape"), F.transform("embedding", lambda x: (F.abs(F.floor(x.cast("double") * 1000)) % 256).cast("int")).alias("values"))
    return images.restore(images.standardise(rows)).select("image_id", F.col("values").cast("array<bigint>").alias("values"))


@query()
def image_symbols(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("series_id"), F.array(F.lit(8), F.lit(8)).alias("shape"), F.transform("embedding", lambda x: (F.abs(F.floor(x.cast("double") * 1000)) % 256).cast("int")).alias("values"))
    made = estimators.EachSymbolizer(tol=0.5, alpha=0.5).transform(images.standardise(rows).select("series_id", "values"))
    return made.select("series_id", "string")


@query("SELECT i AS t, round(sin(i / 20.0), 6) + 0.0 AS value FROM (SELECT unnest(generate_series(0, 999)) AS i)")
def synthetic_sine(spark, sf_dir):
    return synthetic.sine(spark, 1000, 20).select(F.col("t").cast("long").alias("t"), r6("value").alias("value"))


@query()
def incremental_digits(spark, sf_dir):
    """The incremental 1-D digitizer over each user's pieces."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        label, _ = baselines.incremental(pdf["len"].to_numpy(float), pdf["inc"].to_numpy(float), 0.2)
        return pd.DataFrame({"series_id": pdf["series_id"], "idx": pdf["idx"], "label": np.asarray(label, np.int32)})

    return pieces(spark, sf_dir).groupBy("series_id").applyInPandas(run, "series_id long, idx int, label int")


@query(pieces_sql(WALKS, 0.1) + f"SELECT series_id, idx, len, {q6('inc')} AS inc FROM pieces")
def compress_as_stream(spark, sf_dir):
    """The streaming operator, run as a stream over the points until they end: its pieces equal the batch's."""
    from tsymbol.streaming.compress import drain, stream_pieces

    rows = walks(spark, sf_dir).select("series_id", F.col("t").cast("long").alias("t"), "value")
    ends = rows.select("series_id").distinct().select("series_id", F.lit(1 << 62).cast("long").alias("t"), F.lit(None).cast("double").alias("value"))
    made = drain(rows.unionAll(ends), lambda stream: stream_pieces(stream, 0.1))
    return made.select("series_id", "idx", "len", r6("inc").alias("inc"))
