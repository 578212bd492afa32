"""Number helpers shared by the other expression modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dbl(value) -> Column:
    return F.lit(float(value)) if isinstance(value, (int, float)) else value.cast("double")


def half_up(x: Column) -> Column:
    """Round half toward positive infinity, the rule every stored figure uses."""
    return F.floor(x + F.lit(0.5))


def half_up_to(x: Column, places: int) -> Column:
    scale = F.lit(float(10 ** places))
    return F.floor(x * scale + F.lit(0.5)) / scale


def wrap360(x: Column) -> Column:
    return F.pmod(x, F.lit(360.0))


def finite(x: Column) -> Column:
    """True for a real number; null and NaN are unknown."""
    return x.isNotNull() & ~F.isnan(x)


def ratio(num: Column, den: Column) -> Column:
    """num / den, null when the denominator is zero or unknown."""
    return F.when(den != 0, num.cast("double") / den.cast("double"))


def at_least(x: Column, low) -> Column:
    """max(x, low) that keeps unknown unknown (`greatest` would skip the null)."""
    return F.when(x < low, F.lit(low)).otherwise(x)


def at_most(x: Column, high) -> Column:
    return F.when(x > high, F.lit(high)).otherwise(x)


def clamp(x: Column, low, high) -> Column:
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def round6(x) -> Column:
    """Six decimals, halves away from zero, in plain double arithmetic.

    `round` goes through decimal text and can land on the other side of a tie.
    """
    c = F.col(x) if isinstance(x, str) else x
    return F.signum(c) * F.floor(F.abs(c) * 1e6 + 0.5) / 1e6
