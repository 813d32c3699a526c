"""Patches: the raw stretches behind each symbol, and reconstruction from their means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def patches(series: DataFrame, key: str = "series_id") -> DataFrame:
    """(key, idx, label, patch) from rows (key, values, pieces, labels, codebook): the stretch of each piece, moved so that it lies
    around its centre's increment, at round(centre length) + 1 places."""
    rows = series.select(key, "values", F.transform("pieces", lambda p: p["len"]).alias("lens"), "labels", F.transform("codebook", lambda c: c["len"]).alias("cl"), F.transform("codebook", lambda c: c["inc"]).alias("ci"))
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, idx int, label int, patch array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, values, lens, labels, cl, ci in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, at = np.array(values), 0
                for i, (n, label) in enumerate(zip(lens, labels, strict=True)):
                    raw = x[at : at + n + 1]
                    raw = raw - raw[0] - (raw[-1] - raw[0] - ci[label]) / 2
                    out.append((k, i, label, np.interp(np.linspace(0, 1, round(cl[label]) + 1), np.linspace(0, 1, len(raw)), raw).tolist()))
                    at += n
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(0).type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.list_(pa.float64()))], names=[key, "idx", "label", "patch"])

    return rows.mapInArrow(run, schema)


def mean_patches(made: DataFrame, key: str = "series_id") -> DataFrame:
    """(key, label, patch): place by place means."""
    at = made.select(key, "label", F.posexplode("patch").alias("pos", "v")).groupBy(key, "label", "pos").agg(F.avg("v").alias("v"))
    return at.groupBy(key, "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("patch"))


def from_patches(made: DataFrame, starts: DataFrame, key: str = "series_id") -> DataFrame:
    """(key, values): mean patches in order of the pieces, each beginning where the last ended. starts: (key, start)."""
    rows = made.select(key, "idx", "label").join(mean_patches(made, key), [key, "label"]).join(starts, key)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [float(pdf["start"].iloc[0])]
        for patch in pdf.sort_values("idx")["patch"]:
            p = np.asarray(patch, float)
            out.extend((p[1:] - p[0] + out[-1]).tolist())
        return pd.DataFrame({key: [pdf[key].iloc[0]], "values": [out]})

    return rows.groupBy(key).applyInPandas(build, f"{key} {rows.schema[key].dataType.simpleString()}, values array<double>")
