"""Connected components of an undirected graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsymbol.llm.common import discard, materialise


def _mark(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of edges(u, v): comp is the least node that it is connected with. Hot nodes are only
    aggregated map-side and joined, so that skewed ones can be split; every round is written to the shared folder."""
    now = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "cc")
    mark = _mark(now)
    while True:
        # large star: every larger neighbour of a node moves to the node's least neighbour
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours move to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        # a node whose other neighbours moved keeps its own edge
        after = materialise(small.unionAll(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "cc")
        discard(now)
        now, last, mark = after, mark, _mark(after)
        if mark == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
