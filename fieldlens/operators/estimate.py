"""Share of watched days with a visit, with an honest interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.constants import LIGHT_BANDS, MIN_LIVE_DAYS, Z95
from fieldlens.functions import solar
from fieldlens.operators.exposure import live_day_summary


def wilson(k: Column, n: Column, z: float = Z95) -> Column:
    """{point, lo, hi}: Wilson score interval, null unless 0 <= k <= n and n > 0."""
    p = k / n
    z2 = z * z
    denom = 1.0 + z2 / n
    centre = (p + z2 / (2.0 * n)) / denom
    half = (F.lit(z) / denom) * F.sqrt(p * (1.0 - p) / n + z2 / (4.0 * n * n))
    return F.when((n > 0) & (k >= 0) & (k <= n), F.struct(
        p.alias("point"), F.greatest(F.lit(0.0), centre - half).alias("lo"),
        F.least(F.lit(1.0), centre + half).alias("hi")))


def band_estimates(visits: DataFrame, camera_days: DataFrame, cameras: DataFrame,
                   spans: DataFrame, min_live_days: int = MIN_LIVE_DAYS) -> DataFrame:
    """Every camera and band at once: seen days over live days, refused below the minimum.

    visits(camera_id, started_at); spans(camera_id, from_day, to_day). A visit on a day
    that was not live is counted apart and never enters the share.
    """
    ms = F.col("ms")
    placed = visits.where(F.col("started_at").isNotNull()).select(
        "camera_id", solar.millis(F.col("started_at")).alias("ms")).join(
        cameras.select("camera_id", "lat", "lng"), "camera_id")
    banded = (solar.with_solar_band(placed, ms, F.col("lat"), F.col("lng"))
              .withColumn("day", solar.solar_day(ms, F.col("lng"))))
    by_day = banded.groupBy("camera_id", "band", "day").agg(F.count("*").alias("visits"))
    live = (camera_days.where(F.col("state") == "live").select("camera_id", "day")
            .join(spans, "camera_id").where(F.col("day").between(F.col("from_day"), F.col("to_day")))
            .select("camera_id", "day", F.lit(True).alias("was_live")))
    seen = (by_day.join(live, ["camera_id", "day"], "left").groupBy("camera_id", "band")
            .agg(F.count_if(F.col("was_live")).alias("seen"),
                 F.coalesce(F.sum(F.when(F.col("was_live").isNull(), F.col("visits"))),
                            F.lit(0)).alias("off_live")))
    base = live_day_summary(camera_days, spans).withColumn(
        "band", F.explode(F.array(*map(F.lit, LIGHT_BANDS))))
    out = base.join(seen, ["camera_id", "band"], "left").na.fill(0, ["seen", "off_live"])
    ok = F.col("live") >= min_live_days
    return (out.withColumn("w", F.when(ok, wilson(F.col("seen"), F.col("live"))))
            .withColumn("refused", ~ok)
            .select("camera_id", "band", "live", "seen", "off_live", "quota_dark", "silent",
                    "unknown", "span_days", "w.point", "w.lo", "w.hi", "refused"))
