"""Sun, moon, season and clock expressions.

Instants are BIGINT or DOUBLE milliseconds since the epoch inside these builders;
`millis` turns a timestamp into that form.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.constants import (CLOSE_AFTER_SUNSET_MIN, MONTHLY_NORMAL_F, MOON_NAMES,
                                 NEW_MOON_EPOCH_S, OPEN_BEFORE_SUNRISE_MIN, SEASON_CALENDAR,
                                 SETTLE_MIN, SYNODIC_DAYS, TWILIGHT_HOURS, WALK_MPS)
from fieldlens.functions.num import finite, half_up

HOUR_MS = 3600000.0
DAY_MS = 86400000.0


def millis(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1000.0)


def from_millis(ms: Column) -> Column:
    return F.timestamp_micros(half_up(ms * 1000.0).cast("bigint"))


def solar_offset_ms(lng: Column) -> Column:
    """Fifteen degrees of longitude to the hour; unknown longitude shifts nothing."""
    return F.when(finite(lng), lng / 15.0 * HOUR_MS).otherwise(F.lit(0.0))


def solar_day(ms: Column, lng: Column) -> Column:
    days = F.floor((ms + solar_offset_ms(lng)) / DAY_MS)
    return F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int"))


def solar_hour(ms: Column, lng: Column) -> Column:
    return F.pmod(F.floor((ms + solar_offset_ms(lng)) / HOUR_MS), F.lit(24))


def day_start_ms(day: Column) -> Column:
    return F.unix_date(day) * F.lit(DAY_MS)


def with_sun(df: DataFrame, ms: Column, lat: Column, lng: Column) -> DataFrame:
    """Add sunrise, sunset and noon (ms) near an instant; no sunrise leaves nulls.

    The low-precision sunrise equation, one projection per step: each step is used
    several times by the next, so nesting them in one expression would multiply work.
    """
    n = half_up(ms / DAY_MS + (2440588 - 2451545 - 0.5) + 0.0008)
    out = df.withColumn("_noon", n - lng / 360.0)
    out = out.withColumn("_anomaly", (F.lit(357.5291) + 0.98560028 * F.col("_noon")) % 360.0)
    m = F.radians("_anomaly")
    centre = 1.9148 * F.sin(m) + 0.02 * F.sin(2 * m) + 0.0003 * F.sin(3 * m)
    out = out.withColumn("_ecliptic", (F.col("_anomaly") + centre + 180.0 + 102.9372) % 360.0)
    e = F.radians("_ecliptic")
    out = (out.withColumn("_transit", F.col("_noon") + 0.0053 * F.sin(m) - 0.0069 * F.sin(2 * e))
           .withColumn("_decl", F.asin(F.sin(e) * math.sin(math.radians(23.44)))))
    d, phi = F.col("_decl"), F.radians(lat)
    out = out.withColumn("_cos", (math.sin(math.radians(-0.833)) - F.sin(phi) * F.sin(d))
                         / (F.cos(phi) * F.cos(d)))
    half = F.when(F.col("_cos").between(-1, 1), F.degrees(F.acos("_cos")) / 360.0)
    back = 2451545 + 0.5 - 2440588
    t = F.col("_transit")
    return (out.withColumn("_half", half)
            .withColumns({"sunrise": (t - F.col("_half") + back) * DAY_MS,
                          "sunset": (t + F.col("_half") + back) * DAY_MS,
                          "noon": (t + back) * DAY_MS})
            .drop("_noon", "_anomaly", "_ecliptic", "_transit", "_decl", "_cos", "_half"))


def band_from_sun(ms: Column, sunrise: Column, sunset: Column) -> Column:
    """dawn / dusk / day / night against known sun times; no sun means unknown."""
    w = TWILIGHT_HOURS * HOUR_MS
    return (F.when(sunrise.isNull() | sunset.isNull(), "unknown")
            .when(ms.between(sunrise - w, sunrise + w), "dawn")
            .when(ms.between(sunset - w, sunset + w), "dusk")
            .when((ms > sunrise + w) & (ms < sunset - w), "day")
            .otherwise("night"))


def with_light_band(df: DataFrame, ms: Column, lat: Column, lng: Column) -> DataFrame:
    """Add `band` from the sun of the instant's own UTC day."""
    out = with_sun(df, ms, lat, lng)
    return (out.withColumn("band", band_from_sun(ms, F.col("sunrise"), F.col("sunset")))
            .drop("sunrise", "sunset", "noon"))


def solar_noon_ms(ms: Column, lng: Column) -> Column:
    off = solar_offset_ms(lng)
    return F.floor((ms + off) / DAY_MS) * DAY_MS + DAY_MS / 2 - off


def with_solar_band(df: DataFrame, ms: Column, lat: Column, lng: Column) -> DataFrame:
    """Add `band` from the sun of the camera's solar day."""
    out = with_sun(df, solar_noon_ms(ms, lng), lat, lng)
    return (out.withColumn("band", F.when(ms.isNull(), "unknown").otherwise(
        band_from_sun(ms, F.col("sunrise"), F.col("sunset")))).drop("sunrise", "sunset", "noon"))


def is_daylight(band: Column) -> Column:
    return band.isin("dawn", "day", "dusk")


def band_for_window(window: Column) -> Column:
    return F.when(window == "AM", "dawn").otherwise("dusk")


# ---- moon and season ----------------------------------------------------------------

def moon_phase(ms: Column) -> Column:
    """{frac, illum, name} of the synodic month."""
    frac = F.pmod((ms / 1000.0 - float(NEW_MOON_EPOCH_S)) / 86400.0 / SYNODIC_DAYS, F.lit(1.0))
    name = F.lit(None).cast("string")
    for below, label in reversed(MOON_NAMES):
        name = F.when(frac < below, F.lit(label)).otherwise(name)
    return F.struct(frac.alias("frac"), ((1.0 - F.cos(2 * math.pi * frac)) / 2).alias("illum"),
                    name.alias("name"))


def season_phase(day: Column) -> Column:
    """{phase, score, tier} of the season calendar; ranges may wrap the year end."""
    md = F.date_format(day, "MM-dd")
    out = F.lit(None)
    for start, end, score, phase, tier in reversed(SEASON_CALENDAR):
        inside = ((md >= start) | (md <= end)) if start > end else md.between(start, end)
        row = F.struct(F.lit(phase).alias("phase"), F.lit(score).alias("score"),
                       F.lit(tier).alias("tier"))
        out = F.when(inside, row).otherwise(out)
    return out


def seasonal_normal_f(day: Column) -> Column:
    """Monthly normals interpolated around mid-month."""
    normals = F.array(*[F.lit(float(v)) for v in MONTHLY_NORMAL_F])
    m = F.month(day) - 1
    t = (F.dayofmonth(day) - 15) / F.dayofmonth(F.last_day(day))
    other = F.when(t >= 0, F.pmod(m + 1, F.lit(12))).otherwise(F.pmod(m + 11, F.lit(12)))
    w = F.least(F.lit(1.0), F.abs(t))
    return F.get(normals, m) * (1.0 - w) + F.get(normals, other) * w


# ---- clocks -------------------------------------------------------------------------

def hour_key(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def local_instant_ms(naive: Column, offset_s: Column) -> Column:
    """A zone-free local time plus its UTC offset to an instant."""
    return F.unix_micros(naive.cast("timestamp")) / 1000.0 - offset_s * 1000.0


def shooting_hours(sunrise_ms: Column, sunset_ms: Column) -> Column:
    opened = sunrise_ms - OPEN_BEFORE_SUNRISE_MIN * 60000.0
    closed = sunset_ms + CLOSE_AFTER_SUNSET_MIN * 60000.0
    return F.struct(opened.alias("open"), closed.alias("close"),
                    half_up((closed - opened) / 60000.0).alias("minutes"))


def light_phase(opened: Column, closed: Column, now: Column) -> Column:
    """before / open / last-light / after; a half-known day may be unknown."""
    left = half_up((closed - now) / 60000.0)
    both = opened.isNotNull() & closed.isNotNull()
    return (F.when(both & (now < opened), "before").when(both & (now > closed), "after")
            .when(both & (left <= 30), "last-light").when(both, "open")
            .when(closed.isNotNull() & (now > closed), "after")
            .when(opened.isNotNull() & (now < opened), "before")
            .otherwise("unknown"))


def sit_by_ms(window: Column, opened: Column, closed: Column) -> Column:
    return F.when(window == "AM", opened).otherwise(closed - 2.5 * HOUR_MS)


def walk_minutes(metres: Column) -> Column:
    return F.ceil(metres / WALK_MPS / 60.0)


def leave_by_ms(window: Column, opened: Column, closed: Column, metres: Column) -> Column:
    """When to start walking: sit time less settling and the walk, unknown walk = 0."""
    minutes = F.lit(SETTLE_MIN) + F.coalesce(walk_minutes(metres), F.lit(0))
    return sit_by_ms(window, opened, closed) - minutes * 60000.0


def local_date(now_ms: Column, offset_s: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"),
                      F.floor((now_ms + offset_s * 1000.0) / DAY_MS).cast("int"))


def clock_face(ts: Column) -> Column:
    return F.lower(F.date_format(ts, "h:mm a"))
