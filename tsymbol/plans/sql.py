"""Functions for Spark SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tsymbol.functions import kernels
from tsymbol.functions.columns import symbols_of
from tsymbol.operators.each import digitize


def register(spark: SparkSession) -> None:
    """symbolize(values, tol, alpha): the symbols of a series of numbers over a codebook of its own; a null series gives null.
    Missing values count as 0."""

    def symbolize(values: pd.Series, tol: pd.Series, alpha: pd.Series) -> pd.Series:
        out = []
        for v, t, a in zip(values, tol, alpha, strict=True):
            if v is None:
                out.append(None)
                continue
            x = np.nan_to_num(np.array([np.nan if y is None else y for y in v], float))
            p = kernels.segment(x, np.array([len(x)]), float(t), np.inf)
            label, book = digitize(p.length, p.inc, float(a), "2-norm", 1.0) if len(p.length) else ([], [])
            letters = symbols_of(len(book))
            out.append("".join(letters[k] for k in label))
        return pd.Series(out, dtype=object)

    spark.udf.register("symbolize", F.pandas_udf(symbolize, "string"))
