"""Cameras compared with each other under the same conditions.

Denominator here is every weather hour at the camera's location, not only its live
hours; `rates` uses the other one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldlens.constants import MIN_HOURS
from fieldlens.functions import solar
from fieldlens.functions.compass import compass_point, points_apart
from fieldlens.functions.num import half_up, half_up_to
from fieldlens.operators.exposure import utc_hour

RUNGS = [3, 2, 1, 0]


def tagged_hours(cameras: DataFrame, weather: DataFrame) -> DataFrame:
    """Every weather hour of a camera's location with its band and wind point."""
    rows = (cameras.select("camera_id", "location_id", "lat", "lng")
            .join(weather.select("location_id", "hour_utc", "wind_dir", "pressure_inhg"), "location_id")
            .withColumn("ms", solar.millis(F.col("hour_utc"))))
    return (solar.with_light_band(rows, F.col("ms"), F.col("lat"), F.col("lng"))
            .select("camera_id", "ms", utc_hour(F.col("ms")).alias("hour_no"), "band",
                    solar.is_daylight(F.col("band")).alias("daylight"),
                    compass_point(F.col("wind_dir")).alias("wind"), "pressure_inhg"))


def conditions(sits: DataFrame) -> DataFrame:
    """The distinct (window, wind) questions asked by sits, one row per ladder rung.

    Rung 3: same band and wind; 2: daylight and wind; 1: same band; 0: daylight.
    A question without a known wind has only the last two.
    """
    asked = sits.select("window", "wind").distinct()
    rung = F.explode(F.when(F.col("wind").isNotNull(), F.array(*map(F.lit, RUNGS)))
                     .otherwise(F.array(F.lit(1), F.lit(0))))
    return (asked.withColumn("question", F.concat_ws("/", "window", F.coalesce("wind", F.lit("?"))))
            .withColumn("target_band", solar.band_for_window(F.col("window")))
            .withColumn("rung", rung))


def _profile(hours: DataFrame, hits: DataFrame) -> DataFrame:
    """Hours and hits per camera, band and wind: at most 5 x 17 rows per camera."""
    joined = hours.join(hits, ["camera_id", "hour_no"], "left")
    return (joined.groupBy("camera_id", "band", "daylight", "wind")
            .agg(F.count("*").alias("hours"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits")))


def matched_evidence(cameras: DataFrame, hours: DataFrame, sightings: DataFrame,
                     sits: DataFrame, min_hours: int = MIN_HOURS) -> DataFrame:
    """Per question and camera: matched hours, detections and rate on the chosen rung.

    The chosen rung is the narrowest on which two cameras clear the minimum (or the
    only camera does) and is the same for all cameras of the question. Every camera has a
    row for every question: zero hours where nothing of it matched, and a null rung for a
    question no rung can answer. Hours are first folded to a (band, wind) profile per
    camera, so asking many questions costs nothing in photo volume. sightings: camera_id,
    taken_at.
    """
    hits = sightings.groupBy("camera_id", utc_hour(solar.millis(F.col("taken_at")))
                             .alias("hour_no")).agg(F.count("*").alias("hits"))
    profile = _profile(hours, hits)
    # each profile cell lists the questions it answers, so the join below is an equi join
    asked = conditions(sits)
    by_band = F.col("rung").isin(1, 3)
    keyed = asked.withColumn("k_band", F.when(by_band, F.col("target_band")).otherwise("daylight"))
    cells = (profile.withColumnRenamed("wind", "cell_wind")
             .withColumn("k_band", F.explode(F.array_compact(F.array(
                 F.when(F.col("band").isin("dawn", "dusk"), F.col("band")),
                 F.when(F.col("daylight"), F.lit("daylight"))))))
             .join(F.broadcast(keyed), "k_band")          # at most 34 questions of four rungs
             .where((F.col("rung") <= 1) | (points_apart(F.col("cell_wind"), F.col("wind")) <= 1)))
    matched = cells.groupBy("question", "rung", "camera_id").agg(
        F.sum("hours").alias("hours"), F.sum("hits").alias("detections"))
    fleet = cameras.agg(F.count("*").alias("fleet"))
    cleared = (matched.where(F.col("hours") >= min_hours).groupBy("question", "rung")
               .agg(F.count("*").alias("cleared")))
    enough = cleared.join(F.broadcast(fleet)).where(
        (F.col("cleared") >= 2) | ((F.col("fleet") == 1) & (F.col("cleared") == 1)))
    chosen = enough.groupBy("question").agg(F.max("rung").alias("rung"))
    rate = F.when(F.col("hours") >= min_hours, half_up_to(
        100.0 * F.col("detections") / F.col("hours"), 1))
    # one row that lists the questions, at most 34, so every camera meets each of them once
    answers = (asked.select("question").distinct().join(chosen, "question", "left")
               .agg(F.collect_list(F.struct("question", "rung")).alias("answers")))
    spine = (cameras.select("camera_id").join(F.broadcast(answers))
             .select("camera_id", F.explode("answers").alias("a")).select("camera_id", "a.question", "a.rung"))
    return (spine.join(matched, ["question", "rung", "camera_id"], "left").na.fill(0, ["hours", "detections"])
            .withColumn("enough", F.col("hours") >= min_hours).withColumn("per100", rate))


def nocturnal_shares(sightings: DataFrame, cameras: DataFrame) -> DataFrame:
    """Per camera: all sightings and the percentage after dark."""
    ms = F.col("ms")
    # the band changes within an hour, so rows are reduced to distinct instants first
    instants = (sightings.groupBy("camera_id", solar.millis(F.col("taken_at")).alias("ms"))
                .agg(F.count("*").alias("n"))
                .join(cameras.select("camera_id", "lat", "lng"), "camera_id"))
    dark = ~solar.is_daylight(F.col("band"))
    return (solar.with_light_band(instants, ms, F.col("lat"), F.col("lng")).groupBy("camera_id")
            .agg(F.sum("n").alias("sightings"),
                 half_up(100.0 * F.sum(F.when(dark, F.col("n")).otherwise(0)) / F.sum("n"))
                 .alias("nocturnal_share")))


def confidence(evidence: DataFrame) -> DataFrame:
    """Tier per question from volume, separation of the top two and narrowness; `none` without enough hours."""
    top = evidence.where(F.col("enough")).withColumn("r", F.row_number().over(
        W.partitionBy("question").orderBy(F.col("per100").desc(), "camera_id"))).where(F.col("r") <= 2)
    two = top.groupBy("question").agg(F.max(F.when(F.col("r") == 1, F.col("per100"))).alias("best"),
                                      F.max(F.when(F.col("r") == 2, F.col("per100"))).alias("next"))
    agg = evidence.groupBy("question", "rung").agg(
        F.count_if("enough").alias("cameras"), F.sum(F.when(F.col("enough"), F.col("hours"))).alias("hours")).join(two, "question", "left")
    gap = F.col("best") - F.col("next")
    floor = F.when(F.col("best") == 0, 1.0).otherwise(F.col("best")) * 0.5
    volume = F.when(F.col("hours") >= 400, 3).when(F.col("hours") >= 120, 2).otherwise(1)
    separation = F.when(gap >= floor, 2).when(gap > 0, 1).otherwise(0)
    score = F.when(F.col("cameras") > 0, volume + separation + F.when(F.col("rung") >= 2, 1).otherwise(0))
    return (agg.withColumn("gap", gap).withColumn("score", score)
            .withColumn("tier", F.when(F.col("cameras") == 0, "none").when(F.col("score") >= 5, "strong")
                        .when(F.col("score") >= 3, "moderate").otherwise("weak"))
            .drop("best", "next"))
