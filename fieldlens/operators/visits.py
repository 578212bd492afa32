"""Photo visits: gap sessions per camera.

Two photos in the same slot of one gap width can never be further apart than the
gap, so a slot always belongs to one visit. Aggregating photos to slots first
(map-side combine) leaves the ordered step with one row per slot: its size is
bounded by the calendar, not by how many photos a busy camera took.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldlens.constants import VISIT_GAP_SECONDS


def slot_of(ts: Column, gap_seconds: int = VISIT_GAP_SECONDS) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(gap_seconds * 1_000_000))


def _slots(photos: DataFrame, gap_seconds: int) -> DataFrame:
    """One row per (camera, slot) with the visit it falls in."""
    gap_us = gap_seconds * 1_000_000
    dated = photos.where(F.col("taken_at").isNotNull())
    slots = dated.groupBy("camera_id", slot_of(F.col("taken_at"), gap_seconds).alias("slot")).agg(
        F.min(F.unix_micros("taken_at")).alias("first_us"),
        F.max(F.unix_micros("taken_at")).alias("last_us"), F.count("*").alias("photos"))
    w = W.partitionBy("camera_id").orderBy("slot")
    opens = F.coalesce(F.col("first_us") - F.lag("last_us").over(w) > gap_us, F.lit(True))
    running = W.partitionBy("camera_id").orderBy("slot").rowsBetween(W.unboundedPreceding, 0)
    return (slots.withColumn("opens", opens.cast("int"))
            .withColumn("visit_no", F.sum("opens").over(running)))


def visits(photos: DataFrame, gap_seconds: int = VISIT_GAP_SECONDS) -> DataFrame:
    """photos(camera_id, taken_at) -> visits(camera_id, visit_no, started/ended, count)."""
    return (_slots(photos, gap_seconds).groupBy("camera_id", "visit_no")
            .agg(F.min("first_us").alias("s"), F.max("last_us").alias("e"),
                 F.sum("photos").alias("photo_count"))
            .select("camera_id", "visit_no", F.timestamp_micros("s").alias("started_at"),
                    F.timestamp_micros("e").alias("ended_at"), "photo_count"))


def assign_visits(photos: DataFrame, gap_seconds: int = VISIT_GAP_SECONDS) -> DataFrame:
    """Photos with the visit_no they belong to; undated photos keep a null visit."""
    keyed = photos.withColumn("slot", slot_of(F.col("taken_at"), gap_seconds))
    lookup = _slots(photos, gap_seconds).select("camera_id", "slot", "visit_no")
    return keyed.join(lookup, ["camera_id", "slot"], "left").drop("slot")


def grouping_counts(photos: DataFrame, gap_seconds: int = VISIT_GAP_SECONDS) -> DataFrame:
    """{visits, grouped, ungrouped} in one row."""
    made = _slots(photos, gap_seconds).select(F.col("opens").cast("bigint").alias("visits"),
                                              F.col("photos").alias("grouped"),
                                              F.lit(0).cast("bigint").alias("ungrouped"))
    left = photos.where(F.col("taken_at").isNull()).select(
        *[F.lit(v).cast("bigint").alias(c) for c, v in (("visits", 0), ("grouped", 0), ("ungrouped", 1))])
    return made.unionByName(left).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c)
                                        for c in ("visits", "grouped", "ungrouped")])


def span_seconds(started: Column, ended: Column) -> Column:
    return F.floor((F.unix_micros(ended) - F.unix_micros(started)) / 1_000_000 + 0.5)


def carry_reviews(new: DataFrame, old: DataFrame) -> DataFrame:
    """Keep review state when visits are rebuilt.

    A rebuilt visit inherits the latest review of any old visit of its camera that
    overlaps it. Matching is by shared day first so the overlap test is an equi join.
    """
    def days(df):
        return F.explode(F.sequence(F.to_date("started_at"), F.to_date("ended_at")))

    held = old.where(F.col("reviewed_at").isNotNull()).select(
        "camera_id", days(old).alias("day"), F.col("started_at").alias("old_start"),
        F.col("ended_at").alias("old_end"), "reviewed_at", "notes")
    hits = (new.select("camera_id", "visit_no", "started_at", "ended_at", days(new).alias("day"))
            .join(held, ["camera_id", "day"])
            .where((F.col("old_start") <= F.col("ended_at"))
                   & (F.col("old_end") >= F.col("started_at")))
            .groupBy("camera_id", "visit_no")
            .agg(F.max(F.struct("reviewed_at", "notes")).alias("r")))
    return (new.join(hits, ["camera_id", "visit_no"], "left")
            .select(*[new[c] for c in new.columns], F.col("r.reviewed_at").alias("reviewed_at"),
                    F.col("r.notes").alias("notes")))
