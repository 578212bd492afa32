"""Scoring and choosing sits from forecast hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldlens.constants import INHG_PER_HPA, OFF_SEASON_CAP, RATING_FLOORS, TIER_RANK
from fieldlens.functions import solar
from fieldlens.functions.num import half_up_to


def day_over_day_drop(highs: DataFrame, keys: list[str]) -> DataFrame:
    """Yesterday's high minus today's, 0 on the first day: (keys, day, high) in."""
    prev = F.lag("high").over(W.partitionBy(*keys).orderBy("day"))
    return highs.withColumn("drop_f", F.coalesce(prev - F.col("high"), F.lit(0.0)))


def window_trend(hours: DataFrame, keys: list[str]) -> DataFrame:
    """Per sit window: last minus first pressure and the middle hour's wind direction.

    A window has a handful of hours, so its ordered list is short by nature.
    """
    ordered = F.array_sort(F.collect_list(F.struct("at", "pressure", "wind_dir")))
    mid = F.get("h", F.floor(F.size("h") / 2).cast("int"))["wind_dir"]
    return hours.groupBy(*keys).agg(ordered.alias("h")).select(
        *keys, (F.element_at("h", -1)["pressure"] - F.get("h", F.lit(0))["pressure"]).alias("trend"),
        mid.alias("mid_wind_dir"))


def _part(points: Column, reason: str, tier: str) -> Column:
    """One scored part; received wisdom (tier D) is shown but scores nothing."""
    worth = F.lit(0) if tier == "D" else points
    return F.struct(worth.cast("int").alias("points"), F.lit(reason).alias("reason"), F.lit(tier).alias("tier"))


def weather_parts(window: Column, temp: Column, normal: Column, drop: Column, wind: Column,
                  rain: Column, cloud: Column, pressure_inhg: Column, trend: Column) -> Column:
    """The weather's contributions as an array of {points, reason, tier}."""
    gap = temp - normal
    pm, am = window == "PM", window == "AM"
    temperature = (F.when(pm & (gap <= -8), _part(F.lit(4), "cold evening", "B"))
                   .when(am & (gap >= 8), _part(F.lit(3), "warm morning", "B"))
                   .when(pm & (gap >= 12), _part(F.lit(-3), "warm evening", "B"))
                   .when(gap.isNotNull(), _part(F.lit(0), "near normal", "B")))
    front = (F.when(drop >= 15, _part(F.lit(3), "much colder than yesterday", "B"))
             .when(drop >= 8, _part(F.lit(2), "colder than yesterday", "B")))
    breeze = (F.when(wind <= 2, _part(F.lit(-3), "dead calm", "B"))
              .when(wind <= 15, _part(F.lit(3), "steady wind", "C"))
              .when(wind <= 22, _part(F.lit(0), "gusty", "B"))
              .when(wind > 22, _part(F.lit(-2), "strong wind", "C")))
    wet = (F.when(rain >= 0.4, _part(F.lit(-8), "rain", "B"))
           .when(rain >= 0.05, _part(F.lit(0), "light rain", "B")))
    sky = F.when(cloud >= 70, _part(F.lit(0), "overcast", "D"))
    glass = F.when(pressure_inhg.isNotNull(), _part(F.lit(0), "barometer", "D"))
    tendency = F.when(F.abs(trend) >= 0.12, _part(F.lit(0), "pressure trend", "D"))
    return F.array_compact(F.array(temperature, front, breeze, wet, sky, glass, tendency))


def rating(total: Column) -> Column:
    out = F.lit("poor")
    for floor, name in reversed(RATING_FLOORS):
        out = F.when(total >= floor, name).otherwise(out)
    return out


def evidence_tier(parts: Column) -> Column:
    """{tier, driver}: the tier of the points, weighted by size, and the largest part."""
    scoring = F.filter(parts, lambda p: p["points"] != 0)
    ranks = F.create_map(*[F.lit(v) for kv in TIER_RANK.items() for v in kv])
    weight = F.aggregate(scoring, F.lit(0.0), lambda acc, p: acc + F.abs(p["points"]))
    total = F.aggregate(scoring, F.lit(0.0), lambda acc, p: acc + F.abs(p["points"]) * ranks[p["tier"]])
    mean = total / weight
    tier = (F.when(mean >= 4.5, "Y").when(mean >= 3.5, "A").when(mean >= 2.5, "B")
            .when(mean >= 1.5, "C").when(mean.isNotNull(), "D"))
    first = F.aggregate(scoring, F.struct(F.lit(0).alias("points"), F.lit(None).cast("string").alias("reason")),
                        lambda acc, p: F.when(F.abs(p["points"]) > F.abs(acc["points"]), F.struct(
                            p["points"].alias("points"), p["reason"].alias("reason"))).otherwise(acc))
    return F.when(F.size(scoring) > 0, F.struct(tier.alias("tier"), first["reason"].alias("driver")))


def score_windows(hours: DataFrame, keys: list[str]) -> DataFrame:
    """Score each sit window: hours(keys, day, window, at, temp, wind, wind_dir, precip, cloud, pressure_hpa, drop_f).

    Additive parts: season phase, weather, moon (worth nothing); off season is capped.
    """
    group = keys + ["day", "window"]
    trend = window_trend(hours.withColumn("pressure", F.col("pressure_hpa") * INHG_PER_HPA), group)
    agg = hours.groupBy(*group).agg(
        F.avg("temp").alias("temp"), F.avg("wind").alias("wind"), F.avg("cloud").alias("cloud"),
        F.avg("pressure_hpa").alias("hpa"), F.coalesce(F.sum("precip"), F.lit(0.0)).alias("rain"),
        F.max("drop_f").alias("drop_f"))
    s = (agg.join(trend, group).withColumn("season", solar.season_phase(F.col("day")))
         .withColumn("moon", solar.moon_phase(solar.day_start_ms(F.col("day")) + solar.DAY_MS / 2)))
    season = F.struct(F.col("season.score").cast("int").alias("points"), F.col("season.phase").alias("reason"),
                      F.col("season.tier").alias("tier"))
    wx = weather_parts(F.col("window"), F.col("temp"), solar.seasonal_normal_f(F.col("day")), F.col("drop_f"),
                       F.col("wind"), F.col("rain"), F.col("cloud"), F.col("hpa") * INHG_PER_HPA, F.col("trend"))
    moon = _part(F.lit(0), "moon", "D")
    parts = F.concat(F.array(season), wx, F.array(moon))
    s = s.withColumn("parts", parts).withColumn("raw", F.aggregate(
        "parts", F.lit(0), lambda acc, p: acc + p["points"]))
    over = (F.col("season.phase") == "Off season") & (F.col("raw") > OFF_SEASON_CAP)
    cap = F.struct((F.lit(OFF_SEASON_CAP) - F.col("raw")).alias("points"), F.lit("off season").alias("reason"),
                   F.lit("A").alias("tier"))
    s = s.withColumn("parts", F.when(over, F.array_append("parts", cap)).otherwise(F.col("parts")))
    s = s.withColumn("total", F.when(over, F.lit(OFF_SEASON_CAP)).otherwise(F.col("raw")))
    return s.withColumn("e", evidence_tier(F.col("parts"))).select(
        *group, "total", rating(F.col("total")).alias("rating"), "parts", F.col("season.phase").alias("phase"),
        "temp", "wind", "rain", F.col("mid_wind_dir").alias("wind_dir"),
        half_up_to(F.col("hpa") * INHG_PER_HPA, 2).alias("pressure_inhg"),
        half_up_to(F.col("moon.illum"), 2).alias("moon_illum"), F.col("e.tier").alias("evidence_tier"),
        F.col("e.driver").alias("driver"))


def best_camera_per_window(scored: DataFrame, camera: str = "camera_id") -> DataFrame:
    """One row per (day, window): the best camera, the others listed in `also_at`.

    The best is an aggregate, so no window is gathered to rank it.
    """
    best = scored.groupBy("day", "window").agg(
        F.max_by(F.struct(camera, "total", "rating"), F.struct(F.col("total"), -F.col(camera))).alias("b"),
        F.count("*").alias("cameras"), F.array_sort(F.collect_set(camera)).alias("all"))
    return best.select("day", "window", f"b.{camera}", "b.total", "b.rating", "cameras",
                       F.array_remove("all", F.col(f"b.{camera}")).alias("also_at"))


def top_plan(ranked: DataFrame, count: int = 12) -> DataFrame:
    return ranked.orderBy(F.col("total").desc(), "day", "window").limit(count)


def leading_parts(parts: Column, at_least: int = 3, count: int = 3) -> Column:
    return F.slice(F.filter(parts, lambda p: F.abs(p["points"]) >= at_least), 1, count)


def upcoming(sits: DataFrame, now: Column, count: int = 2) -> DataFrame:
    """The next sits by the clock, not by score: sits(starts_ms, ends_ms)."""
    return sits.where(F.col("ends_ms") > now).orderBy("starts_ms", "window").limit(count)


def plan_freshness(sits: DataFrame, now: Column) -> DataFrame:
    """{sits, ahead, stale, last_ended} in one row."""
    ahead = F.count_if(F.col("ends_ms") > now)
    return sits.agg(F.count("*").alias("sits"), ahead.alias("ahead"),
                    ((F.count("*") > 0) & (ahead == 0)).alias("stale"), F.max("ends_ms").alias("last_ended_ms"))


def best_ahead(sits: DataFrame, now: Column) -> DataFrame:
    """The highest total still ahead; the earlier wins a tie."""
    return sits.where(F.col("ends_ms") > now).agg(
        F.max_by(F.struct("day", "window", "total"), F.struct(F.col("total"), -F.col("starts_ms"))).alias("b")
    ).select("b.day", "b.window", "b.total")
