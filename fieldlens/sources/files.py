"""Landed files: photo logs, camera exports, plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PHOTO_LOG = "photo_id STRING, camera_id STRING, taken_at TIMESTAMP, url STRING, tags ARRAY<STRING>"


def append_photo_log(photos: DataFrame, path: str) -> None:
    photos.select("photo_id", "camera_id", "taken_at", "url", "tags").write.mode("append").json(path)


def read_photo_log(spark: SparkSession, path: str) -> DataFrame:
    """The whole log, newest first; lines that are not JSON are left out."""
    rows = spark.read.schema(PHOTO_LOG).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col("photo_id").isNotNull()).orderBy(F.col("taken_at").desc_nulls_last(), "photo_id")


def export_cameras(cameras: DataFrame, quotas: DataFrame, now, path: str) -> None:
    """The camera table with its quota columns as CSV: nulls empty, quotes where needed."""
    age = F.floor((F.unix_micros(now) - F.unix_micros("last_seen")) / 86_400_000_000)
    rows = (cameras.join(quotas.select("camera_id", "quota_level", "per_day", "dry_on"), "camera_id", "left")
            .withColumn("photos_per_day", F.format_string("%.2f", "per_day")).withColumn("days_since_seen", age).drop("per_day"))
    rows.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").option(
        "quoteAll", False).option("escape", '"').csv(path)


def write_plan(ranked: DataFrame, path: str) -> None:
    ranked.write.mode("overwrite").json(path)


def read_plan(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stored plan; malformed lines are no plan."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
