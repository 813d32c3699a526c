"""Affine integer quantisation of columns, and storage accounting."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spark's integer types by width.
WIDTHS = {8: "tinyint", 16: "smallint", 32: "int", 64: "bigint"}


@dataclass(frozen=True)
class Quantizer:
    """x -> clip(rint((x - zero) / scale), low, high); back: scale * (float32 of q) + zero. A single value (scale 0) comes back as zero."""

    bits: int
    low: int
    high: int
    scale: float
    zero: float

    @property
    def type(self) -> str:
        return next(t for w, t in WIDTHS.items() if w >= self.bits)

    def quantize(self, x: Column) -> Column:
        if self.scale == 0:
            return F.lit(0).cast(self.type)
        q = F.rint((x - F.lit(self.zero)) / F.lit(self.scale))
        return F.greatest(F.lit(float(self.low)), F.least(F.lit(float(self.high)), q)).cast(self.type)

    def dequantize(self, q: Column) -> Column:
        return F.lit(self.scale) * q.cast("float").cast("double") + F.lit(self.zero)


def bounds(bits: int, signed: bool = True, zero_point: bool = True) -> tuple[int, int]:
    """Least and greatest code. Without a zero point, and for values taken as symmetric around 0, the codes are symmetric."""
    if not signed and zero_point:
        raise ValueError("symmetric values don't go with a zero point")
    high = 2 ** (bits - 1) - 1
    return (-high - 1 if signed and zero_point else -high), high


def fit(df: DataFrame, column: str, bits: int = 8, *, signed: bool = True, zero_point: bool = True, clip: tuple[float, float] | None = None) -> Quantizer:
    """Scale and zero of a column, from its least and greatest value (one aggregated row), or from clip; signed=False takes
    the range as symmetric around 0."""
    if bits not in WIDTHS:
        warnings.warn(f"{bits} bits are kept in a wider integer", stacklevel=2)
    low, high = bounds(bits, signed, zero_point)
    least, most = clip or df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    if not signed:
        least, most = -max(abs(least), abs(most)), max(abs(least), abs(most))
    return Quantizer(bits, low, high, (most - least) / (high - low), (least * high - most * low) / (high - low))


def quantize_codebook(codebook: DataFrame, bits_len: int | None = 8, bits_inc: int | None = 16) -> tuple[DataFrame, dict[str, Quantizer]]:
    """codebook with q_len and q_inc, and len and inc as they come back; None leaves a column as it is."""
    made = {}
    for name, bits in (("len", bits_len), ("inc", bits_inc)):
        if bits is not None:
            made[name] = fit(codebook, name, bits)
            codebook = codebook.withColumn(f"q_{name}", made[name].quantize(F.col(name)))
            codebook = codebook.withColumn(name, made[name].dequantize(F.col(f"q_{name}")))
    return codebook, made


def storage_bits(symbols: DataFrame, codebook: DataFrame, bits_len: int = 64, bits_inc: int = 64, *, starts: int | None = None, bits_start: int = 64, quantized: bool = False) -> DataFrame:
    """One row: bits of centres, symbols (8 each) and start values; 128 more for the scales of a quantised codebook."""
    k = codebook.agg(F.count(F.lit(1)).alias("k"))
    s = symbols.agg(F.sum(F.size("symbols")).alias("n_symbols"), F.count(F.lit(1)).alias("n_series"))
    n_starts = F.lit(starts) if starts is not None else F.col("n_series")
    bits = F.col("k") * (bits_len + bits_inc) + 8 * F.coalesce("n_symbols", F.lit(0)) + bits_start * n_starts + (128 if quantized else 0)
    return k.crossJoin(F.broadcast(s)).select("k", "n_symbols", "n_series", bits.cast("long").alias("bits"))  # one row each
