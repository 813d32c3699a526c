"""What the corpus operators share: reading tables, intermediate tables, id types."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: ASCII white space; words are the runs of everything else.
WORD = r"[^\x20\x09-\x0D]+"

_made: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a temporary one where it is unset and Spark runs
    in one process. A cluster without the setting is an error, as its executors couldn't read each other's files."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='tsymbol-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def own(df: DataFrame, path: str) -> DataFrame:
    """df, which reads the table at path, as one that discard() and clean() delete."""
    _made.add(path)
    df._tsymbol_path = path
    return df


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return own(df.sparkSession.read.schema(df.schema).parquet(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete a materialised table that nothing reads any more."""
    path = getattr(df, "_tsymbol_path", None)
    if path:
        _delete(df.sparkSession, path)
        _made.discard(path)


def clean(spark: SparkSession) -> None:
    """Delete all tables that this process has materialised and not discarded; call it once results have been written."""
    for path in list(_made):
        _delete(spark, path)
    _made.clear()


def give_back() -> None:
    """Return the memory that a worker has freed to the system, so that it isn't held while other stages run."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def spare(df: DataFrame, *names: str) -> list[str]:
    """Column names for working columns that clash with none of df's, whatever the letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
