"""Detection rates per 100 watched hours, kept apart by who made the claim.

Sightings are reduced to counts per (camera, source, UTC hour) before any join, so
a camera that holds a third of all photos still contributes one row per hour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.constants import (AXIS_TIERS, LIGHT_BANDS, MIN_HOURS, OCTANTS, PRESSURE_BANDS,
                                 PRESSURE_HIGH_ABOVE, PRESSURE_LOW_BELOW, TEMP_BANDS)
from fieldlens.functions import solar
from fieldlens.operators.exposure import utc_hour

SOURCES = ["yours", "camera"]
AXIS_BUCKETS = {"light": LIGHT_BANDS, "wind": OCTANTS,
                "temp": [k for k, _, _ in TEMP_BANDS], "pressure": PRESSURE_BANDS}


def rate_per_100(hits: Column, hours: Column, min_hours: int = MIN_HOURS) -> Column:
    """Null below the minimum hours: too little watching has no rate, not a zero rate."""
    return F.when(hours >= min_hours, hits / hours * 100.0)


def source_of(detection_source: Column, confirmed: Column) -> Column:
    """`yours` once a person confirmed it, `camera` for an unreviewed machine claim."""
    return (F.when(confirmed, "yours")
            .when((detection_source == "camera-ai") & ~confirmed, "camera"))


def sightings(detections: DataFrame, photos: DataFrame, species: str | None = None) -> DataFrame:
    """Detection rows with camera, instant and provenance; the two sources never mix."""
    d = detections.withColumn("claim", source_of(F.col("source"), F.col("confirmed")))
    if species is not None:
        d = d.where(F.col("species") == species)
    return (d.where(F.col("claim").isNotNull())
            .join(photos.select("photo_id", "camera_id", "taken_at"), "photo_id")
            .where(F.col("taken_at").isNotNull()))


def hourly_hits(sight: DataFrame, *extra: str) -> DataFrame:
    """Sightings per camera, claim and UTC hour."""
    return sight.groupBy("camera_id", "claim", *extra,
                         utc_hour(solar.millis(F.col("taken_at"))).alias("hour_no")
                         ).agg(F.count("*").alias("hits"))


def temp_band(t: Column) -> Column:
    out = F.lit(None).cast("string")
    for key, low, high in TEMP_BANDS:
        test = F.lit(True)
        test = test if low is None else test & (t >= low)
        test = test if high is None else test & (t < high)
        out = F.when(test & t.isNotNull(), F.lit(key)).otherwise(out)
    return out


def pressure_band(p: Column) -> Column:
    return (F.when(p < PRESSURE_LOW_BELOW, "low").when(p > PRESSURE_HIGH_ABOVE, "high")
            .when(p.isNotNull(), "mid"))


def with_axes(hours: DataFrame) -> DataFrame:
    """Long form: one row per watched hour and axis, bucket null when unknown."""
    known_light = F.when(F.col("band").isin(LIGHT_BANDS), F.col("band"))
    pairs = F.array(*[F.struct(F.lit(a).alias("axis"), b.alias("bucket")) for a, b in (
        ("light", known_light), ("wind", F.col("wind_octant")),
        ("temp", temp_band(F.col("temp_f"))), ("pressure", pressure_band(F.col("pressure_inhg"))))])
    return (hours.select("camera_id", "hour_no", F.explode(pairs).alias("p"))
            .select("camera_id", "hour_no", "p.axis", "p.bucket"))


def _bucket_spine(cameras: DataFrame) -> DataFrame:
    every = F.array(*[F.struct(F.lit(s).alias("claim"), F.lit(a).alias("axis"),
                               F.lit(b).alias("bucket"))
                      for s in SOURCES for a, bs in AXIS_BUCKETS.items() for b in bs])
    return cameras.select("camera_id", F.explode(every).alias("x")).select("camera_id", "x.*")


def axis_rates(hours: DataFrame, hits: DataFrame, cameras: DataFrame,
               min_hours: int = MIN_HOURS) -> DataFrame:
    """Every (camera, claim, axis, bucket) cell with hits, hours and rate."""
    cut = with_axes(hours)
    denom = (cut.where(F.col("bucket").isNotNull()).groupBy("camera_id", "axis", "bucket")
             .agg(F.count("*").alias("hours")))
    num = (cut.where(F.col("bucket").isNotNull()).join(hits, ["camera_id", "hour_no"])
           .groupBy("camera_id", "claim", "axis", "bucket").agg(F.sum("hits").alias("hits")))
    tier = F.create_map(*[F.lit(v) for kv in AXIS_TIERS.items() for v in kv])
    return (_bucket_spine(cameras)
            .join(denom, ["camera_id", "axis", "bucket"], "left")
            .join(num, ["camera_id", "claim", "axis", "bucket"], "left")
            .na.fill(0, ["hits", "hours"])
            .withColumn("tier", tier[F.col("axis")])
            .withColumn("rate", rate_per_100(F.col("hits"), F.col("hours"), min_hours)))


def unknown_hours(hours: DataFrame) -> DataFrame:
    """Watched hours each axis could not place, per camera."""
    return (with_axes(hours).groupBy("camera_id", "axis")
            .agg(F.count_if(F.col("bucket").isNull()).alias("unknown")))


def solar_curve(hours: DataFrame, sight: DataFrame, cameras: DataFrame,
                min_hours: int = MIN_HOURS) -> DataFrame:
    """Rate for each of the 24 solar hours; hours with nothing stay as rows."""
    spine = (cameras.select("camera_id", F.explode(F.array(*map(F.lit, SOURCES))).alias("claim"))
             .withColumn("local_hour", F.explode(F.sequence(F.lit(0), F.lit(23)))))
    denom = hours.groupBy("camera_id", "local_hour").agg(F.count("*").alias("hours"))
    num = (sight.join(cameras.select("camera_id", "lng"), "camera_id")
           .groupBy("camera_id", "claim", solar.solar_hour(
               solar.millis(F.col("taken_at")), F.col("lng")).cast("int").alias("local_hour"))
           .agg(F.count("*").alias("hits")))
    return (spine.join(denom, ["camera_id", "local_hour"], "left")
            .join(num, ["camera_id", "claim", "local_hour"], "left")
            .na.fill(0, ["hits", "hours"])
            .withColumn("rate", rate_per_100(F.col("hits"), F.col("hours"), min_hours)))


def board(hours: DataFrame, sight: DataFrame, cameras: DataFrame,
          min_hours: int = MIN_HOURS) -> DataFrame:
    """Whole-record rate per camera and claim; a camera without a rate ranks last."""
    spine = cameras.select("camera_id", F.explode(F.array(*map(F.lit, SOURCES))).alias("claim"))
    denom = hours.groupBy("camera_id").agg(
        F.count("*").alias("hours"), F.count_if("has_weather").alias("weather_hours"))
    num = sight.groupBy("camera_id", "claim").agg(F.count("*").alias("hits"))
    return (spine.join(denom, "camera_id", "left").join(num, ["camera_id", "claim"], "left")
            .na.fill(0, ["hits", "hours", "weather_hours"])
            .withColumn("rate", rate_per_100(F.col("hits"), F.col("hours"), min_hours)))


def rate_lookup(rates: DataFrame, claim: str, axis: str, bucket: str) -> DataFrame:
    """One condition's rate per camera next to the highest over cameras."""
    cell = rates.where((F.col("claim") == claim) & (F.col("axis") == axis)
                       & (F.col("bucket") == bucket)).select("camera_id", "axis", "bucket", "rate")
    peak = cell.groupBy("axis", "bucket").agg(
        F.coalesce(F.max("rate"), F.lit(0.0)).alias("peak"))
    return cell.join(peak, ["axis", "bucket"])


def individual_camera_rates(hours: DataFrame, sight: DataFrame, individuals: DataFrame,
                            min_hours: int = MIN_HOURS) -> DataFrame:
    """Per named animal and camera it was confirmed at; other pairs are left out.

    An animal confirmed nowhere has one row with no camera and zero hits.
    """
    denom = hours.groupBy("camera_id").agg(F.count("*").alias("hours"))
    num = (sight.where((F.col("claim") == "yours") & F.col("individual_id").isNotNull())
           .groupBy("individual_id", "camera_id").agg(F.count("*").alias("hits")))
    return (individuals.join(num, "individual_id", "left").join(denom, "camera_id", "left").na.fill(0, ["hits", "hours"])
            .withColumn("rate", rate_per_100(F.col("hits"), F.col("hours"), min_hours)))


def individual_curve(hours: DataFrame, sight: DataFrame, individuals: DataFrame,
                     cameras: DataFrame, min_hours: int = MIN_HOURS) -> DataFrame:
    """A named animal's 24-hour curve pooled over cameras; unseen animals keep zeros."""
    denom = hours.groupBy("local_hour").agg(F.count("*").alias("hours"))
    mine = sight.where((F.col("claim") == "yours") & F.col("individual_id").isNotNull())
    num = (mine.join(cameras.select("camera_id", "lng"), "camera_id")
           .groupBy("individual_id", solar.solar_hour(solar.millis(F.col("taken_at")), F.col("lng"))
                    .cast("int").alias("local_hour")).agg(F.count("*").alias("hits")))
    return (individuals.withColumn("local_hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
            .join(denom, "local_hour", "left")
            .join(num, ["individual_id", "local_hour"], "left").na.fill(0, ["hits", "hours"])
            .withColumn("rate", rate_per_100(F.col("hits"), F.col("hours"), min_hours)))
