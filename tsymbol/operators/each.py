"""Symbolic approximation of every series on its own, with a codebook of its own: one Arrow pass, no shuffle besides making the arrays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsymbol.functions import kernels
from tsymbol.functions.columns import symbols_of
from tsymbol.operators.compress import PIECE, _arrow, _piece_array
from tsymbol.operators.fill import filled

BOOK = "array<struct<label:int,symbol:string,len:double,inc:double,n_members:int,sp_piece:int>>"


def digitize(length: np.ndarray, inc: np.ndarray, alpha: float, sorting: str, scl: float) -> tuple[np.ndarray, list[tuple]]:
    """Labels of one series' pieces and (label, len, inc, members, starting piece); centres are means of raw pieces."""
    std_len, std_inc = (float(np.std(v)) or 1.0 for v in (length, inc)) if len(length) else (1.0, 1.0)
    label, starts = kernels.group_greedily(np.column_stack([length * scl / std_len, inc / std_inc]), alpha, sorting)
    n = np.bincount(label, minlength=len(starts))
    means = (np.bincount(label, v, minlength=len(starts)) / n for v in (length.astype(float), inc))
    return label, list(zip(range(len(starts)), *(m.tolist() for m in means), n.tolist(), starts.tolist(), strict=True))


def symbolize_each(series: DataFrame, tol: float = 0.1, alpha: float = 0.5, sorting: str = "2-norm", scl: float = 1.0, max_len: float = np.inf, *, fill: str = "bfill", alphabet: int | Sequence[str] = 0) -> DataFrame:
    """series with pieces, labels, symbols (joined) and codebook."""
    max_len = np.inf if max_len == -1 else max_len
    source = series.withColumn("values", filled(F.col("values"), fill))
    names = [c for c in source.columns if c != "values"]
    source = source.select(*names, "values")
    added = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in (("pieces", PIECE), ("labels", "array<int>"), ("symbols", "array<string>"), ("codebook", BOOK))])
    schema = T.StructType([*source.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(added)
        for batch in batches:
            flat, sizes = _arrow(batch.column(batch.num_columns - 1))
            p = kernels.segment(flat, sizes, tol, max_len)
            off, labels, symbols, books = p.offsets(), [], [], []
            for a, b in zip(off[:-1], off[1:], strict=True):
                label, book = digitize(p.length[a:b], p.inc[a:b], alpha, sorting, scl) if b > a else (np.empty(0, int), [])
                letters = symbols_of(len(book), alphabet)
                labels.append(label.tolist())
                symbols.append([letters[x] for x in label])
                books.append([{"label": k, "symbol": letters[k], "len": x, "inc": y, "n_members": n, "sp_piece": s} for k, x, y, n, s in book])
            more = [_piece_array(p), *(pa.array(v, types.field(n).type) for n, v in (("labels", labels), ("symbols", symbols), ("codebook", books)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[f.name for f in schema])

    return source.mapInArrow(run, schema)


def reconstruct_each(made: DataFrame, key: str) -> DataFrame:
    """(key, t, value): from the labels, codebook and start of symbolize_each(), inside the JVM."""
    from tsymbol.operators.inverse import stitched

    at = lambda field: F.transform("labels", lambda k: F.get(F.col("codebook"), k)[field])
    rows = made.select(key, "start", at("len").alias("lengths"), at("inc").alias("incs"))
    return stitched(rows, key)
