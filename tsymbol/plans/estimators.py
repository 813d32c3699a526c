"""Symbolizers: fit a codebook, turn series into symbols, and back.

EachSymbolizer gives every series a codebook of its own, JointSymbolizer all series one. Series come as
(series_id, channel, values); symbols go as (series_id, channel, start, n, labels, symbols).
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace
from numbers import Integral, Real

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsymbol.functions.columns import alphabet as letters_of
from tsymbol.functions.columns import symbol
from tsymbol.operators import cluster, digitize, each, inverse, quantizer
from tsymbol.operators.compress import compress_arrays, pieces_of
from tsymbol.operators.fill import filled
from tsymbol.operators.series import chunk_number, chunks, to_series, with_ends
from tsymbol.sources import models

KEY = ["series_id", "channel"]


class NotFittedError(ValueError, AttributeError):
    """Raised where a codebook is needed and none has been fitted."""


@dataclass(frozen=True)
class Params:
    """init: agg, k-means, f-kmeans (fitted on a sample of share r) or gpu-kmeans (the same as k-means here).
    centres: mean or start (of groups). assign: raw or scaled, the space of out-of-sample distances. alpha None: by the formula.
    bits_*: integer widths of the codebook, None for none. fixed_point: pieces hold end values in place of increments."""

    tol: float = 0.2
    init: str = "agg"
    sorting: str = "norm"
    alpha: float | None = None
    k: int = 2
    r: float = 0.5
    scl: float = 1.0
    max_len: float = np.inf
    max_iter: int = 300
    fill: str = "ffill"
    seed: int = 2022
    eta: float = 3.0
    alphabet: int | tuple[str, ...] = 0
    partition: int | None = None
    partition_rate: float | None = None
    jobs: int = 1
    keep_tail: bool = False
    centres: str = "start"
    assign: str = "raw"
    fixed_point: bool = False
    bits_len: int | None = None
    bits_inc: int | None = None
    trim: str = "keep_ends"

    def validate(self) -> Params:
        def number(name: str, low: float, *, strict: bool = True, high: float = np.inf) -> None:
            x = getattr(self, name)
            if isinstance(x, bool) or not isinstance(x, Real):
                raise TypeError(f"{name} must be a number")
            if x < low or (strict and x == low) or x > high:
                raise ValueError(f"{name} = {x} is out of range")

        number("tol", 0)
        if self.alpha is not None:
            number("alpha", 0)
        number("scl", 0, strict=False)
        number("r", 0, high=1)
        if self.max_len != -1:
            number("max_len", 0, strict=False)
        for name in ("k", "max_iter", "jobs", *(["partition"] if self.partition is not None else [])):
            if isinstance(getattr(self, name), bool) or not isinstance(getattr(self, name), Integral):
                raise TypeError(f"{name} must be an integer")
            number(name, 0)
        if self.partition_rate is not None:
            number("partition_rate", 0, high=1)
        number("eta", 0)
        for name, allowed in (("init", ("agg", "k-means", "f-kmeans", "gpu-kmeans")), ("centres", ("mean", "start")), ("assign", ("raw", "scaled")), ("trim", ("keep_ends", "pad", "mean"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}")
        if self.sorting not in digitize.SORTINGS:
            raise ValueError(f"sorting must be one of {digitize.SORTINGS}")
        return self


class EachSymbolizer:
    """A codebook for every series; centres are group means. Series of several partitions are cut into chunks, each a series with
    its own start, so that no jump between them is lost."""

    def __init__(self, **params):
        self.params = replace(Params(tol=0.1, alpha=0.5, sorting="2-norm", centres="mean", fill="bfill"), **params).validate()

    def transform(self, series: DataFrame) -> DataFrame:
        p = self.params
        rows = with_ends(series)
        parts = p.partition or (chunk_number(p.partition_rate, p.jobs) if p.partition_rate else None)
        if parts:
            rows = chunks(rows, parts, keep_tail=p.keep_tail)
        made = each.symbolize_each(rows, p.tol, p.alpha, p.sorting, p.scl, p.max_len, fill=p.fill, alphabet=p.alphabet)
        return with_ends(made).withColumn("string", F.array_join("symbols", ""))

    def rates(self, made: DataFrame) -> DataFrame:
        """compression_rate (pieces by points) and digitization_rate (labels by pieces)."""
        n = F.size("pieces")
        return made.select("*", (n / F.col("n")).alias("compression_rate"), (F.size("codebook") / n).alias("digitization_rate"))

    def inverse(self, made: DataFrame, key: str = "series_id") -> DataFrame:
        return each.reconstruct_each(made, key)


@dataclass
class Model:
    params: Params
    codebook: DataFrame
    scale: digitize.Scale
    labelled: DataFrame | None = None
    quantizers: dict = field(default_factory=dict)

    @property
    def _inc(self) -> str:
        return "end_value" if self.params.fixed_point else "inc"

    def _symbols(self, compressed: DataFrame, labelled: DataFrame) -> DataFrame:
        book = self.codebook.select("label", "symbol")
        rows = labelled.join(book, "label").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("idx", "label", "symbol"))).alias("x"))
        ends = compressed.select(*KEY, F.get("values", F.lit(0)).alias("start"), F.size("values").alias("n"))
        none = lambda kind: F.array().cast(f"array<{kind}>")
        pick = lambda name, kind: F.coalesce(F.transform("x", lambda s: s[name]), none(kind)).alias(f"{name}s")
        return ends.join(rows, KEY, "left").select(*KEY, "start", "n", pick("label", "int"), pick("symbol", "string"))

    def fitted_symbols(self) -> DataFrame:
        """Symbols of the series that the codebook was fitted on."""
        if self.labelled is None:
            raise NotFittedError("the model was loaded; use transform()")
        return self._symbols(self._compressed, self.labelled)

    def transform(self, series: DataFrame) -> DataFrame:
        """Symbols of any series: pieces afresh, each with the label of the nearest centre."""
        p = self.params
        compressed = compress_arrays(series.select(*KEY, "values"), p.tol, p.max_len, fill=p.fill, keep=KEY)
        pieces = pieces_of(compressed, KEY)
        if p.assign == "scaled":
            a, b = p.scl / self.scale.length, 1 / self.scale.inc
            book = self.codebook.select("label", (F.col("len") * a).alias("len"), (F.col("inc") * b).alias("inc"))
            pieces = digitize.nearest(pieces.withColumn("_l", F.col("len") * a).withColumn("_i", F.col(self._inc) * b), book, "_l", "_i")
        else:
            pieces = digitize.nearest(pieces, self.codebook, "len", self._inc)
        return self._symbols(compressed, pieces)

    def inverse(self, symbols: DataFrame, length: int | None = None) -> DataFrame:
        """(series_id, channel, t, value), or with `length` (series_id, channel, values) of that length."""
        book = self.codebook.select("label", "len", "inc")
        rows = symbols.select(*KEY, "start", F.posexplode_outer("labels").alias("idx", "label")).join(book, "label", "left")
        arrays = rows.groupBy(*KEY).agg(F.first("start").alias("start"), F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("idx", "len", "inc")))).alias("x"))
        arrays = arrays.select(*KEY, "start", F.transform("x", lambda s: s["len"]).alias("lengths"), F.transform("x", lambda s: s["inc"]).alias("incs"))
        points = inverse.stitched(arrays, KEY, fixed_point=self.params.fixed_point)
        return points if length is None else inverse.to_length(points, KEY, length, self.params.trim)

    def storage_bits(self, symbols: DataFrame) -> DataFrame:
        p = self.params
        return quantizer.storage_bits(symbols, self.codebook, p.bits_len or 64, p.bits_inc or 64, quantized=bool(self.quantizers))

    def save(self, path: str) -> None:
        meta = {k: v for k, v in asdict(self.params).items()}
        models.save(self.codebook, {"params": meta, "scale": asdict(self.scale)}, path)

    @classmethod
    def load(cls, spark, path: str) -> Model:
        codebook, meta = models.load(spark, path)
        p = meta["params"]
        p["alphabet"] = tuple(p["alphabet"]) if isinstance(p["alphabet"], list) else p["alphabet"]
        return cls(Params(**p), codebook, digitize.Scale(**meta["scale"]))


class JointSymbolizer:
    """One codebook for all series."""

    def __init__(self, params: Params | None = None, **changes):
        self.params = replace(params or Params(), **changes).validate()
        if self.params.init == "agg" and self.params.sorting not in digitize.SORTINGS:
            raise ValueError("unknown sorting")

    def fit(self, series: DataFrame) -> Model:
        p = self.params
        rows = series.select(*KEY, "values")
        parts = p.partition or (chunk_number(p.partition_rate, p.jobs) if p.partition_rate else None)
        if parts:
            cut = chunks(with_ends(rows), parts, keep_tail=p.keep_tail)
            rows = cut.select("series_id", (F.col("channel") * parts + F.col("chunk")).alias("channel"), "values")
        compressed = compress_arrays(rows, p.tol, p.max_len, fill=p.fill, keep=KEY).cache()
        inc = "end_value" if p.fixed_point else "inc"
        pieces = pieces_of(compressed, KEY).withColumn("inc", F.col(inc)).select(*KEY, "idx", "len", "inc")
        scale = digitize.scale_of(pieces, p.scl)
        points = pieces.select(*KEY, "idx", "len", "inc", *digitize.scaled(scale))
        if p.init == "agg":
            alpha = p.alpha
            if alpha is None:
                n_points = compressed.agg(F.sum(F.size("values"))).first()[0]
                alpha = digitize.auto_alpha(scale, p.tol, n_points, p.eta)
            labels, starts = digitize.aggregate(points, alpha, p.sorting)
            labelled = points.join(labels.select(*KEY, "idx", "label"), [*KEY, "idx"])
            codebook = digitize.start_codebook(starts, scale, labelled) if p.centres == "start" else digitize.mean_codebook(labelled)
        else:
            make = cluster.sampled_k_means(points, p.k, p.r, seed=p.seed, max_iter=p.max_iter) if p.init == "f-kmeans" else cluster.k_means(points, p.k, seed=p.seed, max_iter=p.max_iter)
            labelled = make
            codebook = digitize.mean_codebook(labelled)
        return _model(p, compressed, labelled, codebook, scale)

    def fit_with(self, series: DataFrame, estimator) -> Model:
        """With any clustering estimator of pyspark.ml; labels by frequency, centres are means."""
        p = self.params
        compressed = compress_arrays(series.select(*KEY, "values"), p.tol, p.max_len, fill=p.fill, keep=KEY).cache()
        pieces = pieces_of(compressed, KEY).select(*KEY, "idx", "len", "inc")
        scale = digitize.scale_of(pieces, p.scl)
        labelled = digitize.by_frequency(cluster.cluster(pieces.select("*", *digitize.scaled(scale)), estimator))
        return _model(p, compressed, labelled, digitize.mean_codebook(labelled), scale)

    def fit_transform(self, series: DataFrame) -> tuple[Model, DataFrame]:
        model = self.fit(series)
        return model, model.fitted_symbols()


def _model(p: Params, compressed: DataFrame, labelled: DataFrame, codebook: DataFrame, scale: digitize.Scale) -> Model:
    labelled, codebook = labelled.cache(), codebook.cache()
    k = codebook.count()
    if not isinstance(p.alphabet, int) and k > len(letters_of(p.alphabet)):
        raise ValueError(f"{k} labels need as many symbols")
    codebook = codebook.select("label", symbol(F.col("label"), F.lit(k), p.alphabet).alias("symbol"), "len", "inc", "n_members")
    made = {}
    if p.bits_len is not None or p.bits_inc is not None:
        codebook, made = quantizer.quantize_codebook(codebook, p.bits_len, p.bits_inc)
    model = Model(p, codebook, scale, labelled, made)
    model._compressed = compressed
    return model


#: Presets by purpose.
def joint(**changes) -> JointSymbolizer:
    return JointSymbolizer(Params(), **changes)


def quantized(**changes) -> JointSymbolizer:
    return JointSymbolizer(Params(bits_len=8, bits_inc=16, seed=42), **changes)


def fixed_point(**changes) -> JointSymbolizer:
    return JointSymbolizer(Params(alpha=0.1, fixed_point=True, bits_len=8, bits_inc=16, seed=42, trim="pad"), **changes)


def fast(**changes) -> JointSymbolizer:
    return JointSymbolizer(Params(init="f-kmeans", centres="mean", assign="scaled", max_iter=2), **changes)


def fast_quantized(**changes) -> JointSymbolizer:
    return JointSymbolizer(Params(alpha=0.5, bits_len=8, bits_inc=16, r=1.0), **changes)


def fast_fixed_point(**changes) -> JointSymbolizer:
    return JointSymbolizer(Params(alpha=0.5, bits_len=8, bits_inc=16, r=1.0, fixed_point=True), **changes)


def general_compress(symbolizer: JointSymbolizer, points: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """Model, symbols and statistics of points(series_id, channel, t, value), standardised over all series at each place."""
    from tsymbol.operators.normalize import normalise, z_over_series

    stats = z_over_series(points)
    model, symbols = symbolizer.fit_transform(to_series(normalise(points, stats), KEY, "t", "value"))
    return model, symbols, stats


def general_decompress(model: Model, symbols: DataFrame, stats: DataFrame, length: int, *, whole: bool = False) -> DataFrame:
    """(series_id, channel, t, value); whole: rounded and wrapped into 0..255."""
    from tsymbol.operators.normalize import denormalise, to_bytes
    from tsymbol.operators.series import to_points

    points = denormalise(to_points(model.inverse(symbols, length), KEY), stats)
    return points.withColumn("value", to_bytes(F.col("value"))) if whole else points


def encode(symbolizer: JointSymbolizer, series: DataFrame) -> tuple[Model, DataFrame]:
    """fit_transform() by another name."""
    return symbolizer.fit_transform(series)


def decode(model: Model, symbols: DataFrame, length: int | None = None) -> DataFrame:
    """inverse() by another name."""
    return model.inverse(symbols, length)


def fill_series(series: DataFrame, method: str) -> DataFrame:
    return series.withColumn("values", filled(F.col("values"), method))
