"""Wind and heading vocabulary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldlens.constants import COMPASS, OCTANTS
from fieldlens.functions.num import finite, wrap360


def _pick(names: list[str], deg: Column) -> Column:
    step = 360.0 / len(names)
    d = deg.cast("double")
    idx = F.pmod(F.floor(wrap360(d) / step + 0.5), F.lit(len(names)))
    return F.when(finite(d), F.get(F.array(*[F.lit(n) for n in names]), idx.cast("int")))


def compass_point(deg: Column) -> Column:
    """Nearest of the sixteen points; unknown direction stays null."""
    return _pick(COMPASS, deg)


def octant(deg: Column) -> Column:
    """Nearest of the eight octants, rounded from degrees rather than from points."""
    return _pick(OCTANTS, deg)


def point_index(point: Column) -> Column:
    """0..15, null for a word that is not a compass point."""
    pos = F.array_position(F.array(*[F.lit(n) for n in COMPASS]), point)
    return F.when(pos > 0, pos - 1)


def points_apart(a: Column, b: Column) -> Column:
    """Steps between two points around the circle, null when either is unknown."""
    d = F.pmod(point_index(a) - point_index(b), F.lit(16))
    return F.least(d, 16 - d)


def normal_winds(text: Column) -> Column:
    """Comma list to distinct known points in first-seen order; empty is null."""
    known = F.array(*[F.lit(n) for n in COMPASS])
    words = F.transform(F.split(text, ","), lambda w: F.upper(F.trim(w)))
    kept = F.array_distinct(F.filter(words, lambda w: F.array_contains(known, w)))
    return F.when(F.size(kept) > 0, kept)


def huntable_on(winds: Column, wind_from_deg: Column) -> Column:
    """True / false, or null when neither side is known."""
    return F.when(winds.isNotNull() & (F.size(winds) > 0) & finite(wind_from_deg.cast("double")),
                  F.array_contains(winds, compass_point(wind_from_deg)))
