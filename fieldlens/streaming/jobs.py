"""Continuous forms of the batch jobs.

Sources are any streaming frame with the named columns. Stateful jobs keep bounded state
per key: an id until the watermark passes, an open session, one carried row per camera or track
(`ordered`), whose rows are put in order by Spark before the state is touched, so answers do not
depend on how rows are dealt into files, triggers or Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.constants import MIN_HOURS, VISIT_GAP_SECONDS
from fieldlens.operators import counters, gates
from fieldlens.operators.rates import rate_per_100
from fieldlens.operators.tracks import usable_fixes
from fieldlens.session import cut_lineage
from fieldlens.sources.store import merge_camera_days
from fieldlens.streaming.ordered import OrderedBatches


def landed_photos(spark: SparkSession, folder: str, schema, files_per_batch: int = 100) -> DataFrame:
    """Photo rows from a landing folder; new files are picked up as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def first_seen(photos: DataFrame, late: str = "1 day") -> DataFrame:
    """Each photo id once within the lateness allowed: a re-run poll lands nothing twice."""
    return photos.withWatermark("taken_at", late).dropDuplicatesWithinWatermark(["photo_id"])


def visit_stream(photos: DataFrame, gap_seconds: int = VISIT_GAP_SECONDS, late: str = "1 hour") -> DataFrame:
    """Finished visits, emitted once the watermark passes their gap (append mode)."""
    session = F.session_window("taken_at", f"{gap_seconds} seconds")
    return (photos.withWatermark("taken_at", late).groupBy("camera_id", session)
            .agg(F.count("*").alias("photo_count"), F.max("taken_at").alias("ended_at"))
            .select("camera_id", F.col("session_window.start").alias("started_at"), "ended_at", "photo_count"))


def camera_day_upsert(target: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer that merges observations into day partitions of a parquet table.

    Only the touched days are read and rewritten. A batch goes to a new version folder per
    day first, so a lost executor or a replayed batch leaves the old version readable.
    Versions grow with what the table holds, whatever checkpoint the stream started from.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = merge_camera_days(batch)
        version = F.lit(0)
        try:
            held = spark.read.parquet(target)
        except AnalysisException as nothing:
            if nothing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            held = None                         # nothing stored yet
        if held is not None:
            version = F.lit((held.agg(F.max("version")).first()[0] or 0) + 1)
            # the small list of touched days prunes partitions before anything else is read
            held = held.join(F.broadcast(rows.select("day").distinct()), "day", "left_semi")
            newest = held.groupBy("day").agg(F.max("version").alias("version"))
            current = held.join(newest, ["day", "version"], "left_semi").drop("version")
            rows = merge_camera_days(rows.unionByName(current))
        rows.withColumn("version", version).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("day", "version").parquet(target)
    return write


def current_camera_days(spark: SparkSession, target: str) -> DataFrame:
    held = spark.read.parquet(target)
    newest = held.groupBy("day").agg(F.max("version").alias("version"))
    return held.join(newest, ["day", "version"], "left_semi").drop("version")


def hourly_counts(photos: DataFrame, late: str = "1 hour") -> DataFrame:
    """Photos per camera and hour, final once the watermark passes the hour."""
    return (photos.withWatermark("taken_at", late).groupBy("camera_id", F.window("taken_at", "1 hour"))
            .agg(F.count("*").alias("hits"))
            .select("camera_id", F.col("window.start").alias("hour_utc"), "hits"))


def hourly_rates(counts: DataFrame, live_hours: DataFrame, min_hours: int = MIN_HOURS) -> DataFrame:
    """Finished hours against the live-hour table: live_hours(camera_id, hour_utc, hours_to_date)."""
    return counts.join(live_hours, ["camera_id", "hour_utc"]).withColumn(
        "rate", rate_per_100(F.col("hits"), F.col("hours_to_date"), min_hours))


TRACK_FATES = "track_id bigint, seq bigint, t_ms double, lat double, lng double, acc double, fate string"
FIXES = "track_id bigint, seq bigint, t_ms double, lat double, lng double, acc double, at timestamp"


def live_track(target: str, late_seconds: int = 0) -> OrderedBatches:
    """Fates of running walks' fixes: position, accuracy, speed and step gates, the last fix of each track carried.

    A foreachBatch writer for fixes(track_id, seq, t_ms, lat, lng, acc, at): `at` is when a fix was
    recorded and says how long it may be late. Fixes of a trigger are gated in order of seq by `gates`.
    Unlike the batch, a stream does not know a walk's last fix, so none is kept for being it.
    """
    def step(rows: DataFrame, carried: DataFrame) -> tuple[DataFrame, DataFrame]:
        tagged = cut_lineage(usable_fixes(rows).withColumn("fate", F.when(F.col("t_ms").isNull(), "unusable").otherwise(F.col("fate"))))
        fates, last = gates.gated(tagged.where("fate = 'fix'").drop("fate", "at"), carried)
        return tagged.where("fate != 'fix'").drop("at").unionByName(fates), last
    return OrderedBatches(target, step, ["track_id"], "at", gates.STATE_SCHEMA, late_seconds)


COUNTER_HOLES = "camera_id bigint, after_n bigint, before_n bigint, missing bigint"
COUNTER_CARRY = "camera_id bigint, last_n bigint, top bigint"


def counter_monitor(target: str, late_seconds: int = 0) -> OrderedBatches:
    """Holes as they appear: a counter more than one above the highest of its run so far.

    A foreachBatch writer for photos(camera_id, taken_at, n). A fall of more than the reset limit
    below the photo before starts a new run; a smaller step back is a late photo. Photos are ordered
    by camera-hour; between hours and triggers goes one row a camera.
    """
    def step(rows: DataFrame, carried: DataFrame) -> tuple[DataFrame, DataFrame]:
        return counters.live_holes(rows, carried)
    return OrderedBatches(target, step, ["camera_id"], "taken_at", COUNTER_CARRY, late_seconds)
