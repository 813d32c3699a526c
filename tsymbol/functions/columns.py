"""Column expressions that stay inside the JVM."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def missing(x: Column) -> Column:
    """Null or NaN."""
    return x.isNull() | F.isnan(x)


def alphabet(choice: int | Sequence[str] = 0) -> list[str]:
    """0: each capital before its small letter; 1: capitals, then small ones; another number: small ones first; or own symbols."""
    if isinstance(choice, int):
        return {0: [c for pair in zip(UPPER, LOWER, strict=True) for c in pair], 1: [*UPPER, *LOWER]}.get(choice, [*LOWER, *UPPER])
    return list(choice)


def symbols_of(k: int, choice: int | Sequence[str] = 0) -> list[str]:
    """Symbols of k labels. Letters serve fewer than 52 labels, printable characters from `!` on any more; own symbols serve as many as there are."""
    letters = alphabet(choice)
    if not isinstance(choice, int):
        if k > len(letters):
            raise ValueError(f"{k} labels need as many symbols; the alphabet has {len(letters)}")
        return letters[:k]
    return letters[:k] if k < len(letters) else [chr(33 + i) for i in range(k)]


def symbol(label: Column, k: Column, choice: int | Sequence[str] = 0) -> Column:
    """Symbol of a label where there are k labels."""
    letters = alphabet(choice)
    own = F.try_element_at(F.array(*map(F.lit, letters)), label + 1)
    # char() knows 256 characters only
    other = F.decode(F.unhex(F.lpad(F.hex((label + 33).cast("long")), 8, "0")), "UTF-32")
    return own if not isinstance(choice, int) else F.when(k < len(letters), own).otherwise(other)


def whole_lengths(lengths: Column) -> Column:
    """array<int> of lengths on the integer grid: the rounding error goes on to the next, halves to even, 0 becomes 1 but for the last."""
    n = F.size(lengths)
    zero = F.struct(F.array().cast("array<int>").alias("done"), F.lit(0.0).alias("carry"))

    def step(s: Column, x: Column) -> Column:
        want = x + s["carry"]
        got = F.rint(want)
        got = F.when((got == 0) & (F.size(s["done"]) < n - 1), 1.0).otherwise(got)
        return F.struct(F.concat(s["done"], F.array(got.cast("int"))).alias("done"), (want - got).alias("carry"))

    return F.aggregate(lengths.cast("array<double>"), zero, step, lambda s: s["done"])


def first_or_last(a: Column, n: int, side: str) -> Column:
    """At most n elements: side `post` cuts the end off, `pre` the beginning."""
    return F.slice(a, 1, n) if side == "post" else F.when(F.size(a) > n, F.slice(a, -n, n)).otherwise(a)


def padded(a: Column, n: int, fill: Column, side: str = "post") -> Column:
    """Exactly n elements: `fill` makes a short array longer at its end (post) or beginning (pre)."""
    more = F.array_repeat(fill, F.greatest(F.lit(0), n - F.size(a)))
    return F.concat(a, more) if side == "post" else F.concat(more, a)


def keep_ends(a: Column, n: int) -> Column:
    """n elements with the first and the last kept: what is too long loses its middle end, what is short repeats its last."""
    long = F.slice(a, 1, 1) if n == 1 else F.concat(F.slice(a, 1, n - 1), F.slice(a, -1, 1))
    return F.when(F.size(a) > n, long).otherwise(padded(a, n, F.try_element_at(a, F.lit(-1))))


def grams(a: Column, w: int) -> Column:
    """Joined runs of w symbols from every place but the last w - 2; the last one is a symbol short."""
    count = F.greatest(F.lit(0), F.size(a) - w + 2)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(a, i, w), ""))).otherwise(F.array().cast("array<string>"))
