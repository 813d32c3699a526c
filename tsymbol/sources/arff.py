"""ARFF files as a Spark data source: spark.read.format("arff").load(path).

A row is (file, series_id, label, channels array<array<double>>); relational attributes give several channels, flat ones one.
Missing values (`?`) become 0, as NaN does. Files are the partitions. register(spark) makes the format known; read() goes
through Spark's text reader instead and so reaches any store.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from glob import glob

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, series_id long, label string, channels array<array<double>>"


def number(text: str) -> float:
    text = text.strip()
    value = 0.0 if text in ("", "?") else float(text)
    return 0.0 if value != value else value


def parse_line(line: str) -> tuple[list[list[float]], str]:
    """Channels and class of a data line: either 'a,b\\nc,d',class or a,b,c,class."""
    line = line.strip()
    if line[:1] in "'\"":
        quote = line[0]
        body, _, label = line[1:].rpartition(quote)
        return [[number(x) for x in part.split(",")] for part in body.replace("\\n", "\n").split("\n") if part], label.strip().lstrip(",").strip()
    *values, label = next(csv.reader([line]))
    return [[number(x) for x in values]], label.strip()


class Arff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArffReader(self.options["path"])


class ArffReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in sorted(glob(self.path))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, encoding="utf-8", errors="replace") as f:
            inside, n = False, 0
            for line in f:
                if inside and line.strip() and line[0] != "%":
                    channels, label = parse_line(line)
                    yield partition.value, n, label, channels
                    n += 1
                inside |= line.strip().lower() == "@data"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Arff)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, label, channels) of relational ARFF files in any store that Spark reads; lines before @data are told by their look."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), "value").filter(F.col("value").rlike("^['\"]"))
    body = F.regexp_extract("value", r"^(['\"])(.*)\1,\s*(.*?)\s*$", 2)
    cells = F.transform(F.split(body, r"\\n"), lambda part: F.transform(F.split(part, ","), lambda x: F.coalesce(F.nanvl(F.trim(x).try_cast("double"), F.lit(0.0)), F.lit(0.0))))
    return text.select("file", "line", F.regexp_extract("value", r"^(['\"])(.*)\1,\s*(.*?)\s*$", 3).alias("label"), cells.alias("channels"))


def to_points(rows: DataFrame, key: str = "series_id") -> DataFrame:
    """(series_id, label, channel, t, value)"""
    return rows.select(F.col(key).alias("series_id"), "label", F.posexplode("channels").alias("channel", "v")).select("series_id", "label", "channel", F.posexplode("v").alias("t", "value"))
