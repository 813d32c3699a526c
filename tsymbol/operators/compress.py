"""Compression of series into pieces (len, inc, err, end_value)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsymbol.functions import kernels
from tsymbol.operators.fill import filled

PIECE = "array<struct<idx:int,len:int,inc:double,err:double,end_value:double>>"


def _arrow(values: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists one after the other, and the number of each; null lists are empty."""
    sizes = values.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    return np.asarray(values.flatten().to_numpy(zero_copy_only=False), float), sizes


def _piece_array(p: kernels.Pieces) -> pa.ListArray:
    off = p.offsets()
    idx = np.arange(len(p.length)) - np.repeat(off[:-1], p.count)
    items = pa.StructArray.from_arrays([pa.array(idx, pa.int32()), pa.array(p.length, pa.int32()), pa.array(p.inc), pa.array(p.err), pa.array(p.end_value)], names=["idx", "len", "inc", "err", "end_value"])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), items)


def compress_arrays(series: DataFrame, tol: float, max_len: float = np.inf, *, fill: str | None = "bfill", keep: Sequence[str] | None = None) -> DataFrame:
    """series with a column `pieces`, one array a series. No shuffle: Arrow batches of arrays go through one kernel call each.
    Missing values are filled first; a series of one point has no pieces."""
    max_len = np.inf if max_len == -1 else max_len
    keep = list(keep) if keep is not None else [c for c in series.columns if c != "values"]
    source = series.select(*keep, "values")
    if fill is not None:
        source = source.withColumn("values", filled(F.col("values"), fill))
    schema = T.StructType([*source.schema.fields, T.StructField("pieces", T._parse_datatype_string(PIECE), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = _arrow(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, _piece_array(kernels.segment(flat, sizes, tol, max_len))], names=[f.name for f in schema])

    return source.mapInArrow(run, schema)


def pieces_of(compressed: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key.., idx, len, inc, err, end_value), a row a piece."""
    return compressed.select(*key, F.inline("pieces"))


def compress_column(values, tol: float):
    """Pieces of an array column by a fold inside the JVM, without Python; each step copies the pieces so far, so it suits short series."""
    state = "struct<done:array<struct<len:int,inc:double>>,x0:double,prev:double,a:double,b:double,m:int,inc:double>"
    first = F.try_element_at(values, F.lit(1))
    zero = F.struct(F.array().cast("array<struct<len:int,inc:double>>").alias("done"), first.alias("x0"), first.alias("prev"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0).alias("m"), F.lit(0.0).alias("inc")).cast(state)

    def step(s, x):
        y, m = x - s["x0"], s["m"] + 1
        a, b, slope = s["a"] + y * y, s["b"] + m * y, y / m
        err = F.greatest(a - 2 * slope * b + slope * slope * m * (m + 1) * (2 * m + 1) / 6, F.lit(0.0))
        fits = (m == 1) | (err <= tol * (m - 1) + F.lit(kernels.EPSILON))
        again = x - s["prev"]
        grown = F.struct(s["done"].alias("done"), s["x0"].alias("x0"), x.alias("prev"), a.alias("a"), b.alias("b"), m.alias("m"), y.alias("inc"))
        closed = F.struct(F.concat(s["done"], F.array(F.struct(s["m"].alias("len"), s["inc"].alias("inc")))).alias("done"), s["prev"].alias("x0"), x.alias("prev"), (again * again).alias("a"), again.alias("b"), F.lit(1).alias("m"), again.alias("inc"))
        return F.when(fits, grown.cast(state)).otherwise(closed.cast(state))

    done = lambda s: F.when(s["m"] > 0, F.concat(s["done"], F.array(F.struct(s["m"].alias("len"), s["inc"].alias("inc"))))).otherwise(s["done"])
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), zero, step, done)
