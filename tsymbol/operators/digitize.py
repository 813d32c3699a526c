"""Digitization: scaling of pieces, greedy sorted aggregation spread over islands, codebooks, assignment to centres.

Pieces are rows (series_id, channel, idx, len, inc, ..) whose place in the order of ties is (series_id, channel, idx).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsymbol.functions import kernels

SORTINGS = ("2-norm", "1-norm", "lexi", "norm", "pca")
PLACE = ("series_id", "channel", "idx")


@dataclass(frozen=True)
class Scale:
    """What divides lengths and increments before clustering; a deviation of 0 counts as 1."""

    length: float
    inc: float
    scl: float = 1.0
    pieces: int = 0
    points: int = 0


def scale_of(pieces: DataFrame, scl: float = 1.0) -> Scale:
    """Population deviations of all pieces (one aggregated row reaches the driver)."""
    r = pieces.agg(F.stddev_pop("len").alias("a"), F.stddev_pop("inc").alias("b"), F.count(F.lit(1)).alias("n"), F.sum("len").alias("s")).first()
    return Scale(r.a or 1.0, r.b or 1.0, scl, r.n, int(r.s or 0))


def scaled(scale: Scale) -> tuple[Column, Column]:
    return (F.col("len") * scale.scl / scale.length).alias("x"), (F.col("inc") / scale.inc).alias("y")


def auto_alpha(scale: Scale, tol: float, n_points: int, eta: float = 3.0) -> float:
    """alpha = (30 (S - N) tol^2 / (eta^4 S))^(1/4) for S points in N pieces."""
    return (30 * (n_points - scale.pieces) * tol**2 / (eta**4 * n_points)) ** 0.25


def sort_key(points: DataFrame, sorting: str, place: Sequence[str]) -> Column:
    x, y = F.col("x"), F.col("y")
    if sorting in ("2-norm", "norm"):
        return F.sqrt(x * x + y * y)
    if sorting == "1-norm":
        return F.abs(x) + F.abs(y)
    if sorting == "lexi":
        return x
    if sorting != "pca":
        raise ValueError(f"sorting must be one of {SORTINGS}")
    m = points.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"), F.min_by(F.struct("x", "y"), F.struct(*place)).alias("first")).first()
    values, axes = np.linalg.eigh(np.array([[m.xx, m.xy], [m.xy, m.yy]]))
    a, b = axes[:, np.argmax(values)]
    if (m.first.x - m.mx) * a + (m.first.y - m.my) * b > 0:
        a, b = -a, -b
    return (x - m.mx) * float(a) + (y - m.my) * float(b)


def aggregate(points: DataFrame, alpha: float, sorting: str = "2-norm", *, sound: bool = False, place: Sequence[str] = PLACE) -> tuple[DataFrame, DataFrame]:
    """Greedy sorted aggregation of points(place.., x, y): points with label, and starts(label, place.., x, y, n_members).

    No group reaches over a stretch of keys wider than alpha without a point (wider than alpha * sqrt(2) for the 1-norm). So
    keys fall into cells of that width, runs of occupied neighbouring cells are islands, and each island is grouped on its own; labels
    count on from the islands before. The windows see a row a cell or an island; equal points are grouped as one, but for the
    1-norm, whose early stop can part them. A wide alpha leaves one island: then the distinct points of it stream through one
    task in order of key, which holds a batch and the groups within reach (the 1-norm's early stop needs the whole island)."""
    if alpha <= 0:
        raise ValueError("alpha must be above 0")
    width = alpha * (sqrt(2) if sorting == "1-norm" else 1.0) * (1 + 1e-9)
    keyed = points.select(*place, "x", "y").withColumn("key", sort_key(points, sorting, place))
    at = F.struct(*place)
    if sorting == "1-norm":
        distinct = keyed.select("x", "y", "key", at.alias("at"), F.lit(1).cast("long").alias("members"))
    else:
        distinct = keyed.groupBy("x", "y").agg(F.min("key").alias("key"), F.min(at).alias("at"), F.count(F.lit(1)).alias("members"))
    distinct = distinct.withColumn("cell", F.floor(F.col("key") / width)).cache()
    cells = distinct.select("cell").distinct()
    before = F.lag("cell").over(Window.orderBy("cell"))
    islands = cells.withColumn("island", F.sum(F.when(F.col("cell") - before == 1, 0).otherwise(1)).over(Window.orderBy("cell")))

    seated = distinct.join(F.broadcast(islands), "cell").select("island", "key", "x", "y", "at", "members")  # a row a cell
    schema = T.StructType([*(seated.schema[c] for c in seated.columns), T.StructField("local", T.LongType()), T.StructField("first", T.BooleanType())])

    def with_labels(table: pa.RecordBatch, local: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*table.columns, pa.array(local, pa.int64()), pa.array(first, pa.bool_())], names=[f.name for f in schema])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, now = None, None
        for batch in batches:
            number, key, x, y = (batch.column(k).to_numpy() for k in range(4))
            points, local, first = np.column_stack([x, y]), np.empty(len(x), np.int64), np.zeros(len(x), bool)
            ends = np.flatnonzero(np.diff(number)) + 1
            for a, b in zip([0, *ends], [*ends, len(number)], strict=True):
                if number[a] != now:
                    groups, now = kernels.Groups(alpha), number[a]
                local[a:b], first[a:b] = groups.take(key[a:b], points[a:b])
            yield with_labels(batch, local, first)

    def whole(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        label, starts = kernels.group_greedily(np.column_stack([batch.column("x").to_numpy(), batch.column("y").to_numpy()]), alpha, sorting, sound=sound, key=batch.column("key").to_numpy())
        first = np.zeros(len(label), bool)
        first[starts] = True
        return pa.Table.from_batches([with_labels(batch, label, first)])

    if sorting == "1-norm":
        rows = seated.repartition("island").sortWithinPartitions("island", "at").groupBy("island").applyInArrow(whole, schema)
    else:
        order = ("x", "y", "at") if sorting == "lexi" else ("key", "at")
        rows = seated.repartition("island").sortWithinPartitions("island", *order).mapInArrow(stream, schema)
    grouped = rows.cache()
    sizes = grouped.groupBy("island").agg((F.max("local") + 1).alias("k"))
    base = sizes.select("island", (F.coalesce(F.sum("k").over(Window.orderBy("island").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("base"))
    labelled = grouped.join(F.broadcast(base), "island").withColumn("label", (F.col("base") + F.col("local")).cast("int"))  # a row an island
    on = ["x", "y"]
    if sorting == "1-norm":
        out = labelled.select(*(F.col(f"at.{p}").alias(p) for p in place), "x", "y", "label")
    else:
        out = keyed.drop("key").join(labelled.select(*on, "label"), on)
    members = labelled.groupBy("label").agg(F.sum("members").alias("n_members"))
    starts = labelled.filter("first").select("label", *(F.col(f"at.{p}").alias(p) for p in place), "x", "y").join(members, "label")
    return out, starts


def mean_codebook(labelled: DataFrame) -> DataFrame:
    """(label, len, inc, n_members): group means of raw pieces(label, len, inc)."""
    return labelled.groupBy("label").agg(F.avg("len").alias("len"), F.avg("inc").alias("inc"), F.count(F.lit(1)).alias("n_members"))


def start_codebook(starts: DataFrame, scale: Scale, labelled: DataFrame | None = None) -> DataFrame:
    """(label, len, inc, n_members): starting points taken back to raw units; with scl 0, lengths are means of `labelled`."""
    if scale.scl == 0:
        return starts.select("label", (F.col("y") * scale.inc).alias("inc"), "n_members").join(mean_lengths(labelled), "label").select("label", "len", "inc", "n_members")
    return starts.select("label", (F.col("x") * scale.length / scale.scl).alias("len"), (F.col("y") * scale.inc).alias("inc"), "n_members")


def mean_lengths(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("label").agg(F.avg("len").alias("len"))


def by_frequency(labelled: DataFrame, place: Sequence[str] = PLACE) -> DataFrame:
    """Labels renumbered by falling count, ties by first place. The window sees a row a label."""
    counts = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(*place)).alias("f"))
    new = counts.select("label", (F.row_number().over(Window.orderBy(F.desc("c"), "f")) - 1).alias("new"))
    return labelled.join(new, "label").drop("label").withColumnRenamed("new", "label")


def nearest(pieces: DataFrame, codebook: DataFrame, length: str = "len", inc: str = "inc") -> DataFrame:
    """pieces with the label of the nearest centre in raw space, ties to the smaller label.

    The centres go to the workers; their number is checked. Arrow batches meet all of them in numpy, a part at a time."""
    centres = codebook.select("label", F.col("len").cast("double"), F.col("inc").cast("double")).limit(LARGEST_CODEBOOK + 1).collect()
    if len(centres) > LARGEST_CODEBOOK:
        raise ValueError(f"a codebook has at most {LARGEST_CODEBOOK} labels here")
    if not centres:
        return pieces.withColumn("label", F.lit(None).cast(codebook.schema["label"].dataType))
    book = np.array([tuple(c) for c in sorted(centres, key=lambda c: c[0])], float)
    rows = pieces.withColumns({"_x": F.col(length).cast("double"), "_y": F.col(inc).cast("double")})
    kept = [c for c in pieces.columns if c != "label"]
    rows = rows.select(*kept, "_x", "_y")
    schema = T.StructType([*(pieces.schema[c] for c in kept), T.StructField("label", codebook.schema["label"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind, step = to_arrow_type(schema["label"].dataType), max(1, CELLS // len(book))
        for batch in batches:
            x, y = (batch.column(len(kept) + k).to_numpy(zero_copy_only=False) for k in range(2))
            best = np.empty(len(x), np.int64)
            for a in range(0, len(x), step):
                dx, dy = x[a : a + step, None] - book[:, 1], y[a : a + step, None] - book[:, 2]
                best[a : a + step] = (dx * dx + dy * dy).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(book[best, 0].astype(np.int64)).cast(kind)], names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)


#: Distances that nearest() holds at once.
CELLS = 1 << 18

#: Labels that nearest() takes; a symbol alphabet of more is no use.
LARGEST_CODEBOOK = 20_000


def wcss(labelled: DataFrame, codebook: DataFrame) -> DataFrame:
    """One row: the sum of squared distances of pieces to their centres."""
    c = codebook.select("label", F.col("len").alias("c_len"), F.col("inc").alias("c_inc"))
    return labelled.join(c, "label").agg(F.sum((F.col("len") - F.col("c_len")) ** 2 + (F.col("inc") - F.col("c_inc")) ** 2).alias("wcss"))
