"""How long each camera was really watching: the denominators.

Everything here is at camera-day or camera-hour grain, so its size follows the
calendar. Sun times are computed once per camera-day and reused by its 24 hours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.constants import DAY_STATES
from fieldlens.functions import solar
from fieldlens.functions.compass import octant
from fieldlens.functions.num import half_up

WEATHER = ["wind_dir", "wind_mph", "temp_f", "pressure_inhg"]


def utc_hour(ms):
    return F.floor(ms / solar.HOUR_MS)


def watched_hours(camera_days: DataFrame, cameras: DataFrame, weather: DataFrame) -> DataFrame:
    """24 rows per live camera-day in solar time, with light band and weather.

    Watched-hour starts are shifted by longitude, so weather and sightings meet
    them on the UTC hour that contains the start.
    """
    live = (camera_days.where(F.col("state") == "live").select("camera_id", "day")
            .join(cameras.select("camera_id", "location_id", "lat", "lng"), "camera_id")
            .withColumn("midnight", solar.day_start_ms(F.col("day")) - solar.solar_offset_ms(F.col("lng"))))
    sunned = solar.with_sun(live, F.col("midnight") + solar.DAY_MS / 2, F.col("lat"), F.col("lng"))
    hours = (sunned.withColumn("local_hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
             .withColumn("ms", F.col("midnight") + F.col("local_hour") * solar.HOUR_MS)
             .select("camera_id", "location_id", "day", "local_hour", "ms",
                     utc_hour(F.col("ms")).alias("hour_no"),
                     solar.band_from_sun(F.col("ms"), F.col("sunrise"), F.col("sunset")).alias("band")))
    wx = weather.select("location_id", utc_hour(solar.millis(F.col("hour_utc"))).alias("hour_no"),
                        *WEATHER, F.lit(True).alias("has_weather"))
    return (hours.join(wx, ["location_id", "hour_no"], "left")
            .withColumn("wind_octant", octant(F.col("wind_dir")))
            .withColumn("has_weather", F.coalesce("has_weather", F.lit(False))))


def light_window(camera_days: DataFrame, cameras: DataFrame) -> DataFrame:
    """Earliest, latest and mean sunrise and sunset in solar hours over live days."""
    off = solar.solar_offset_ms(F.col("lng"))
    live = (camera_days.where(F.col("state") == "live").select("camera_id", "day").distinct()
            .join(cameras.select("camera_id", "lat", "lng"), "camera_id"))
    days = (solar.with_sun(live, solar.day_start_ms(F.col("day")) - off, F.col("lat"), F.col("lng"))
            .where(F.col("sunrise").isNotNull())
            .withColumn("rise", ((F.col("sunrise") + off) % solar.DAY_MS) / solar.HOUR_MS)
            .withColumn("set", ((F.col("sunset") + off) % solar.DAY_MS) / solar.HOUR_MS))
    return days.groupBy("camera_id").agg(
        F.count("*").alias("days"),
        *[f(c).alias(f"{c}_{n}") for c in ("rise", "set")
          for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])


def day_spine(spans: DataFrame, first: str, last: str) -> DataFrame:
    """One row per day between two date columns."""
    return spans.withColumn("day", F.explode(F.sequence(F.col(first), F.col(last))))


def day_states(camera_days: DataFrame, spans: DataFrame) -> DataFrame:
    """Every day of every camera's span; a day nobody recorded is `unknown`.

    spans: camera_id, from_day, to_day.
    """
    return (day_spine(spans, "from_day", "to_day").drop("from_day", "to_day")
            .join(camera_days.select("camera_id", "day", "state"), ["camera_id", "day"], "left")
            .withColumn("state", F.coalesce("state", F.lit("unknown"))))


def live_day_summary(camera_days: DataFrame, spans: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("state") == s).alias(s.replace("-", "_")) for s in DAY_STATES]
    return day_states(camera_days, spans).groupBy("camera_id").agg(
        *counts, F.count("*").alias("span_days"))


def share_pct(part, whole):
    return F.when(whole > 0, half_up(100.0 * part / whole))
