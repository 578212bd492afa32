"""Hunting pressure and food around a stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.constants import (FIELD_REACH_M, FRESH_CUT_DAYS, PRESSURE_WINDOW_DAYS,
                                 RECOVERY_DAYS)
from fieldlens.functions import geo
from fieldlens.functions.num import half_up_to
from fieldlens.operators.spatial import k_nearest

NEAREST_FIELDS = 3


def sit_pressure(sits: DataFrame, now: Column) -> DataFrame:
    """Per stand with sits: decayed burn over the window, and the points it costs.

    A stand without a row here has unknown pressure, not zero pressure.
    """
    when = F.coalesce(F.col("ended_at"), F.col("started_at"),
                      F.timestamp_seconds(F.unix_date("date") * 86400 + 43200))
    ago = (F.unix_micros(now) - F.unix_micros(when)) / 86_400_000_000
    recent = (ago >= 0) & (ago <= PRESSURE_WINDOW_DAYS)
    agg = sits.where(F.col("stand_id").isNotNull()).groupBy("stand_id").agg(
        F.count("*").alias("logged"), F.count_if(recent).alias("recent_sits"),
        F.coalesce(F.sum(F.when(recent, F.exp(-ago / RECOVERY_DAYS))), F.lit(0.0)).alias("burn"),
        F.min(F.when(recent, ago)).alias("last"))
    points = (F.when(F.col("burn") >= 1.8, -6).when(F.col("burn") >= 1.2, -4)
              .when(F.col("burn") >= 0.4, -2).when(F.col("last") >= 10, 2).otherwise(0))
    return agg.select("stand_id", "logged", "recent_sits", half_up_to(F.col("burn"), 2).alias("burn"),
                      half_up_to(F.col("last"), 1).alias("last_days_ago"), points.alias("pressure_points"))


def field_points(crop: Column, cut_date: Column, day: Column) -> Column:
    """What one nearby field is worth on a day."""
    since = F.datediff(day, cut_date)
    fresh = since.between(0, int(FRESH_CUT_DAYS))
    cold = F.month(day).isin(11, 12, 1)
    return (F.when((crop == "alfalfa") & since.between(0, 30), 3)
            .when(fresh & crop.isin("corn", "soybeans"), 5).when(fresh, 3)
            .when((crop == "corn") & cut_date.isNull(), -3)
            .when((crop == "brassicas") & cold, 4).otherwise(0))


def food_scores(stands: DataFrame, fields: DataFrame, day: Column) -> DataFrame:
    """Per stand: the nearest three fields within reach, their points summed and clamped."""
    centred = fields.withColumn("centre", geo.ring_vertex_mean(F.col("ring"))).select(
        "field_id", "crop", "cut_date", "centre.lat", "centre.lng")
    near = k_nearest(stands, centred, "field_id", NEAREST_FIELDS, FIELD_REACH_M, ["crop", "cut_date"])
    per_site = (near.withColumn("p", field_points(F.col("crop"), F.col("cut_date"), day))
                .groupBy("lat", "lng").agg(F.count("*").alias("fields"), F.sum("p").alias("p")))
    return (stands.select("stand_id", "lat", "lng").join(per_site, ["lat", "lng"], "left")
            .select("stand_id", F.coalesce("fields", F.lit(0)).alias("fields"),
                    F.greatest(F.lit(-6), F.least(F.lit(8), F.coalesce("p", F.lit(0)))).alias("food_points")))
