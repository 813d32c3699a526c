"""Codebooks as tables: Parquet files and a row of parameters beside them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from tsymbol.operators.digitize import LARGEST_CODEBOOK


def save(codebook: DataFrame, meta: dict, path: str) -> None:
    codebook.write.mode("overwrite").parquet(f"{path}/codebook")
    codebook.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/codebook"), json.loads(spark.read.parquet(f"{path}/meta").first()[0])


def show(codebook: DataFrame) -> str:
    """The codebook, a line a label. A codebook of more labels than digitize.nearest() takes is an error."""
    rows = codebook.select("label", "symbol", "len", "inc").orderBy("label").limit(LARGEST_CODEBOOK + 1).collect()
    if len(rows) > LARGEST_CODEBOOK:
        raise ValueError(f"a codebook has at most {LARGEST_CODEBOOK} labels here")
    return "\n".join(f"{r.symbol}: length {r.len:g}, increment {r.inc:g}" for r in rows)
