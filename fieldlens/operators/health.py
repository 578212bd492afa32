"""Camera health, transmission quota and the state of a camera-day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.constants import (QUOTA_MIN_ELAPSED_DAYS,
                                 QUOTA_PROJECTION_FLOOR_DAYS, QUOTA_WARN_AT, SILENT_AFTER_HOURS, SILENT_DAYS)

from fieldlens.functions.num import at_least, at_most

LEVELS = ["ok", "warn", "bad"]


def _days(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 86_400_000_000


def quota(cameras: DataFrame, now: Column) -> DataFrame:
    """Adds quota columns: remaining, pct, days, burn per day, dry date, level.

    Needs photo_count, photo_limit, cycle_start, cycle_end (dates or timestamps).
    """
    limit = F.when(F.col("photo_limit") > 0, F.col("photo_limit"))
    used = F.when(F.col("photo_count") >= 0, F.col("photo_count"))
    known = limit.isNotNull() & used.isNotNull()
    out = (cameras.withColumn("_limit", F.when(known, limit)).withColumn("_used", F.when(known, used))
           .withColumn("remaining", at_least(F.col("_limit") - F.col("_used"), 0))
           .withColumn("quota_pct", at_most(F.col("_used") / F.col("_limit"), 1.0))
           .withColumn("days_left", F.when(F.col("_limit").isNotNull(), at_least(
               F.floor(_days(F.col("cycle_end").cast("timestamp"), now)), 0)))
           .withColumn("_elapsed", F.when(F.col("_limit").isNotNull(), at_least(
               _days(now, F.col("cycle_start").cast("timestamp")), 0.0))))
    burning = (F.col("remaining") > 0) & (F.col("_elapsed") >= QUOTA_MIN_ELAPSED_DAYS) & (F.col("_used") > 0)
    out = (out.withColumn("per_day", F.when(burning, F.col("_used") / F.col("_elapsed")))
           .withColumn("_dry_in", F.col("remaining") / F.col("per_day"))
           .withColumn("dry_on", F.to_date(F.timestamp_micros(
               (F.unix_micros(now) + F.col("_dry_in") * 86_400_000_000).cast("bigint"))))
           .withColumn("days_early", at_least(F.floor(F.col("days_left") - F.col("_dry_in")), 0)))
    runs_dry = (F.col("dry_on").isNotNull() & (F.col("days_left") > QUOTA_PROJECTION_FLOOR_DAYS)
                & (F.col("days_early") > 0))
    level = (F.when(F.col("remaining") == 0, "bad").when(F.col("quota_pct") >= QUOTA_WARN_AT, "warn")
             .when(runs_dry, "warn").otherwise("ok"))
    return out.withColumn("quota_level", level).drop("_limit", "_used", "_elapsed", "_dry_in")


def fleet_quota(quotas: DataFrame) -> DataFrame:
    return quotas.agg(F.sum("photo_count").alias("used"), F.sum("photo_limit").alias("limit"),
                      F.count_if(F.col("quota_level") != "ok").alias("flagged"))


def health(quotas: DataFrame, now: Column) -> DataFrame:
    """Worst of age, battery, quota and counter gaps, with a reason for each that counts.

    Optional column gap_recent: photos missing within the recent window.
    """
    age = F.floor(_days(now, F.col("last_seen")))
    gap = F.col("gap_recent") if "gap_recent" in quotas.columns else F.lit(0)
    rules = [
        (age.isNull(), 1, F.lit("never reported")),
        (age >= SILENT_DAYS, 2, F.concat(F.lit("silent "), age.cast("string"), F.lit(" days"))),
        ((age >= 7) & (age < SILENT_DAYS), 1, F.concat(F.lit("quiet "), age.cast("string"), F.lit(" days"))),
        (F.col("battery") <= 10, 2, F.concat(F.lit("battery "), F.col("battery").cast("string"), F.lit("%"))),
        ((F.col("battery") > 10) & (F.col("battery") <= 30), 1,
         F.concat(F.lit("battery "), F.col("battery").cast("string"), F.lit("%"))),
        (F.col("quota_level") == "bad", 2, F.lit("quota spent")),
        (F.col("quota_level") == "warn", 1, F.lit("quota low")),
        (gap > 0, 1, F.lit("photos never sent")),
    ]
    worst = F.greatest(*[F.when(test, rank).otherwise(0) for test, rank, _ in rules])
    notes = F.array_compact(F.array(*[F.when(test, note) for test, _, note in rules]))
    return (quotas.withColumn("age_days", age)
            .withColumn("health", F.get(F.array(*map(F.lit, LEVELS)), worst)).withColumn("notes", notes))


def day_state(last_seen: Column, now: Column, remaining: Column) -> Column:
    """silent, unknown, quota-dark or live, decided in that order."""
    return (F.when(_days(now, last_seen) * 24 > SILENT_AFTER_HOURS, "silent")
            .when(last_seen.isNull(), "unknown")
            .when(remaining == 0, "quota-dark").otherwise("live"))


def placement_drift(cameras: DataFrame) -> DataFrame:
    """Effective point and how far the owner's pin sits from the reported fix."""
    from fieldlens.functions import geo
    from fieldlens.functions.num import half_up
    p = geo.effective_point(F.col("placed_lat"), F.col("placed_lng"), F.col("lat"), F.col("lng"))
    drift = half_up(geo.haversine_m(F.col("lat"), F.col("lng"), F.col("placed_lat"), F.col("placed_lng")))
    return cameras.withColumn("p", p).select(
        *[c for c in cameras.columns if c not in ("lat", "lng")], F.col("p.lat").alias("lat"),
        F.col("p.lng").alias("lng"), "p.corrected", F.when(F.col("p.corrected"), drift).alias("from_fix_m"))


def one_per_model(cameras: DataFrame, key: str) -> DataFrame:
    """One representative camera of every model (the least key)."""
    return cameras.groupBy(F.coalesce("model", F.lit("(no model reported)")).alias("model")).agg(
        F.min(key).alias(key), F.count("*").alias("cameras"))


def name_filter(name: Column, ident: Column, words: list[str]) -> Column:
    """Any of the substrings in name or id, case-insensitive; no words keeps everything."""
    if not words:
        return F.lit(True)
    test = F.lit(False)
    for w in words:
        test = test | F.lower(name).contains(w.lower()) | F.lower(ident).contains(w.lower())
    return test


def camera_view_rows(cameras: DataFrame) -> DataFrame:
    """Cameras as a reader wants them: effective point, drift, facing and its text.

    cameras: camera_id, lat, lng, placed_lat, placed_lng, view {lng, lat, label, spread}.
    """
    from fieldlens.functions import lanes
    placed = placement_drift(cameras)
    return placed.withColumn("facing", lanes.camera_view(F.col("lat"), F.col("lng"), F.col("view"))).withColumn(
        "facing_text", lanes.facing_line(F.col("facing")))
