"""Reconstruction: labels to centres, lengths to the integer grid, pieces to points. All inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsymbol.functions.columns import whole_lengths


def centres_of(symbols: DataFrame, codebook: DataFrame, key: Sequence[str], label: str = "label") -> DataFrame:
    """(key.., idx, len, inc): the codebook's row of each symbol, by an equi-join that Spark may broadcast by its size."""
    return symbols.join(codebook.select(label, "len", "inc"), label).select(*key, "idx", "len", "inc")


def as_arrays(pieces: DataFrame, key: Sequence[str], start: Column | str = "start", length: str = "len", inc: str = "inc") -> DataFrame:
    """(key.., start, lengths, incs) from pieces with their series' start."""
    start = F.col(start) if isinstance(start, str) else start
    rows = pieces.groupBy(*key).agg(F.first(start).alias("start"), F.array_sort(F.collect_list(F.struct("idx", F.col(length).cast("double").alias("l"), F.col(inc).cast("double").alias("i")))).alias("p"))
    return rows.select(*key, "start", F.transform("p", lambda s: s["l"]).alias("lengths"), F.transform("p", lambda s: s["i"]).alias("incs"))


def stitched(rows: DataFrame, key: str | Sequence[str], *, fixed_point: bool = False, quantize: bool = True) -> DataFrame:
    """(key.., t, value) from (key.., start, lengths, incs): lengths are put on the integer grid, pieces follow each other.
    With fixed_point, incs are end values: a piece runs from the one before to its own."""
    key = [key] if isinstance(key, str) else list(key)
    rows = rows.withColumn("whole", whole_lengths(F.col("lengths")) if quantize else F.transform("lengths", lambda x: x.cast("int")))
    sums = lambda a, zero: F.aggregate(a, F.array(zero), lambda s, x: F.concat(s, F.array(F.try_element_at(s, F.lit(-1)) + x)))
    if fixed_point:
        begins = F.concat(F.array("start"), F.slice("incs", 1, F.greatest(F.size("incs") - 1, F.lit(0))))
    else:
        begins = sums(F.col("incs"), F.col("start"))
    rows = rows.withColumn("begins", begins).withColumn("places", sums(F.col("whole"), F.lit(0)))
    piece = rows.select(*key, F.posexplode("whole").alias("k", "m"), "begins", "places", "incs").filter("m > 0").select(*key, "m", F.get("begins", F.col("k")).alias("a"), F.get("places", F.col("k")).alias("at"), F.get("incs", F.col("k")).alias("inc"))
    i = F.col("i")
    rise = (F.col("inc") - F.col("a")) if fixed_point else F.col("inc")
    points = piece.select(*key, "m", "a", "at", "inc", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("i")).select(*key, (F.col("at") + i).alias("t"), (F.col("a") + i / F.col("m") * rise).alias("value"))
    return points.unionByName(rows.select(*key, F.lit(0).alias("t"), F.col("start").alias("value")))


def stitched_by_windows(pieces: DataFrame, key: Sequence[str], start: str = "start") -> DataFrame:
    """The same from rows (key.., start, idx, len int, inc) with whole lengths, for series of any number of pieces: running sums over windows."""
    before = Window.partitionBy(*key).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = pieces.withColumn("a", F.col(start) + F.coalesce(F.sum("inc").over(before), F.lit(0.0))).withColumn("at", F.coalesce(F.sum("len").over(before), F.lit(0)))
    i = F.col("i")
    points = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("len")))).select(*key, (F.col("at") + i).cast("int").alias("t"), (F.col("a") + i / F.col("len") * F.col("inc")).alias("value"))
    return points.unionByName(rows.filter("idx = 0").select(*key, F.lit(0).alias("t"), F.col(start).alias("value")))


def to_length(points: DataFrame, key: Sequence[str], n: int, method: str = "keep_ends") -> DataFrame:
    """(key.., values): reconstructed points as arrays of exactly n; `pad` cuts or repeats the last, `keep_ends` keeps the last,
    `mean` fills with the mean of the series."""
    from tsymbol.functions.columns import keep_ends, padded
    from tsymbol.operators.series import to_series

    rows, v = to_series(points, key, "t", "value"), F.col("values")
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    made = {"keep_ends": lambda: keep_ends(v, n), "pad": lambda: padded(F.slice(v, 1, n), n, F.try_element_at(v, F.lit(-1))), "mean": lambda: padded(F.slice(v, 1, n), n, mean)}
    if method not in made:
        raise ValueError(f"method must be one of {sorted(made)}")
    return rows.select(*key, made[method]().alias("values"))
