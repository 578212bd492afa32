"""The flagship answer: what every camera measured in each part of the day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.constants import LIGHT_BANDS
from fieldlens.operators import exposure, rates
from fieldlens.operators.visits import visits


def camera_band_board(photos: DataFrame, detections: DataFrame, camera_days: DataFrame,
                      cameras: DataFrame, weather: DataFrame, claim: str = "yours") -> DataFrame:
    """Per camera and light band: watched hours, hits, rate, and the camera's visits."""
    hours = exposure.watched_hours(camera_days, cameras, weather).where(F.col("band").isin(LIGHT_BANDS))
    hits = rates.hourly_hits(rates.sightings(detections, photos).where(F.col("claim") == claim))
    cells = (hours.select("camera_id", "hour_no", "band")
             .join(hits.select("camera_id", "hour_no", "hits"), ["camera_id", "hour_no"], "left")
             .groupBy("camera_id", "band")
             .agg(F.count("*").alias("hours"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits")))
    per_camera = visits(photos).groupBy("camera_id").agg(F.count("*").alias("visits"))
    return (cells.join(per_camera, "camera_id")
            .withColumn("rate", rates.rate_per_100(F.col("hits"), F.col("hours"))))
