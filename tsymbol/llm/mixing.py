"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

Targets: every source gets a share of the budget in proportion to its weight, but at most `max_epochs` times its size; what
a cap leaves over goes to the others by weight until none is above its cap. As the level rises, sources reach their caps in
order of size over weight, so that the level follows from running sums over the sources.

Taking: a source's target over its size gives whole repetitions of every document and a fraction. For the fraction, the
documents fall into buckets by a seeded hash of id and text, the buckets' sizes are summed (map-side first), and whole buckets are taken in
order until the remaining target is met as nearly as a bucket allows. A hot source so costs as many rows as it has buckets.

Defined results: a null text has size 0. A null source is a source of its own, the last. Rows that repeat both id and
text each give a row and fall into one bucket, so that all or none of them are in the fraction. An empty table gives no rows; sources without any word have target 0 and their documents are not taken.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tsymbol.llm.common import WORD, spare


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (5, 2, 1)  # by source in order of code points, repeating
    budget_percent: int = 150
    max_epochs: int = 2
    buckets: int = 8192
    seed: int = 20


def words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """From (source, source_size), one row a source: with target. A source's rank orders its weight; the window sees sources only."""
    in_order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, mix.weights)), (F.row_number().over(in_order) - 1) % len(mix.weights) + 1).cast("double")
    rows = sizes.withColumn("w", weight).withColumn("cap", (F.col("source_size") * mix.max_epochs).cast("double"))
    whole = Window.partitionBy()
    rows = rows.withColumn("budget", F.least(F.sum("source_size").over(whole) * F.lit(mix.budget_percent) / 100.0, F.sum("cap").over(whole)))
    below = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").cast("binary").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("filled", F.coalesce(F.sum("cap").over(below), F.lit(0.0))).withColumn("open", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(below), F.lit(0.0)))
    # the level if all before this source are capped and this one and the rest are not; the first that fits is the level
    level = (F.col("budget") - F.col("filled")) / F.col("open")
    rows = rows.withColumn("level", F.max(F.when(level * F.col("w") <= F.col("cap"), level)).over(whole))
    return rows.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def plan(df: DataFrame, mix: Mix | None = None, *, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """df with size, source_size, target and repeats (how many times a document is taken) under names that don't clash; see `planned`."""
    mix = mix or Mix()
    size, source_size, target, repeats, bucket, own = planned(df)
    # a hash that SQL elsewhere has too; the text is in it for ids that are null or not unique
    digest = F.md5(F.concat(F.lit(f"{mix.seed}|"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text), F.lit(""))))
    hashed = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % mix.buckets).cast("int")
    rows = df.withColumns({size: words(F.col(text)), bucket: hashed, own: F.struct(F.col(source).alias("source"))})
    by_bucket = rows.groupBy(F.col(own).alias("own"), F.col(bucket).alias("bucket")).agg(F.sum(size).alias("words"))
    sizes = by_bucket.groupBy("own").agg(F.sum("words").alias("source_size")).select(F.col("own.source").alias("source"), "source_size")
    aims = targets(sizes, mix).select(F.struct("source").alias("own"), "source_size", "target")
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(epochs + 1e-12)
    before = F.coalesce(F.sum("words").over(Window.partitionBy("own").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    extra = before + F.col("words") / 2.0 <= F.col("target") - whole * F.col("source_size")
    taken = by_bucket.join(aims, "own").select(F.col("own").alias(own), F.col("bucket").alias(bucket), F.col("source_size").alias(source_size), F.col("target").alias(target), (whole + F.when(extra & (F.col("words") > 0), 1).otherwise(0)).cast("long").alias(repeats))
    return rows.join(taken, [own, bucket], "left").drop(own, bucket)


def planned(df: DataFrame) -> list[str]:
    """The names of the columns that plan() adds: size, source_size, target, repeats, and two that it uses itself."""
    return spare(df, "size", "source_size", "target", "repeats", "bucket", "own")


def sample(df: DataFrame, mix: Mix | None = None, *, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """df's rows, each as many times as it is taken, with df's columns."""
    repeats = planned(df)[3]
    made = plan(df, mix, text=text, source=source, key=key)
    copies = F.when(F.col(repeats) > 0, F.sequence(F.lit(1).cast("long"), F.col(repeats))).otherwise(F.array().cast(T.ArrayType(T.LongType())))
    return made.withColumn(repeats, F.explode(copies)).select(*df.columns)
