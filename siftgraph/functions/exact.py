"""Arithmetic on the exact binary values of doubles, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .addresses import bound

#: Splits a double of 53 bits into two of 26.
_SPLIT = 134217729.0


def halves(t: float) -> tuple[float, float]:
    """A double as the sum of two of 26 bits."""
    hi = t * _SPLIT - (t * _SPLIT - t)
    return hi, t - hi


def product(x: Column, t: float | Column, t_hi: Column | None = None, t_lo: Column | None = None) -> Column:
    """x times t without an error: a struct of the rounded product ``p`` and the rest ``e`` (both doubles). x is a variable, as it occurs often; t is a number, or a variable with its halves. Beyond about 1e290 the halves overflow."""
    if not isinstance(t, Column):
        t, t_hi, t_lo = map(F.lit, (t, *halves(t)))
    p, c = x * t, x * F.lit(_SPLIT)
    x_hi = c - (c - x)
    x_lo = x - x_hi
    e = ((x_hi * t_hi - p) + x_hi * t_lo + x_lo * t_hi) + x_lo * t_lo
    return F.struct(p.alias("p"), e.alias("e"))


def half_even(value: Column, places: int) -> Column:
    """A double rounded to decimal places by its exact binary value, ties to the even digit; null, NaN and infinities stay. The nearest double to the rounded decimal comes out."""
    t = float(10**places)

    def rounded(m: Column) -> Column:
        n = F.floor(m["p"]).cast("double")
        rest = m["p"] - n  # exact
        up = (rest > 0.5) | ((rest == 0.5) & ((m["e"] > 0) | ((m["e"] == 0) & (n % 2 == 1))))
        return F.when(up, n + 1).otherwise(n) / F.lit(t)

    def signed(x: Column) -> Column:
        whole = F.isnan(x) | (F.abs(x) >= 2.0**52 / t)  # no digits beyond the places, or none at all
        size = bound(F.abs(x), lambda a: bound(product(a, t), rounded))
        return F.when(whole, x).when((x < 0) | (x.cast("string") == "-0.0"), -size).otherwise(size)

    return bound(value.cast("double"), signed)
