"""Streaming jobs run to completion over the whole event table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

import fieldlens.queries.sequences  # noqa: F401
import fieldlens.queries.space  # noqa: F401
import fieldlens.queries.statistics  # noqa: F401
from fieldlens.functions.num import round6
from fieldlens.operators import exposure
from fieldlens.queries.registry import query, table_sql
from fieldlens.session import ensure_checkpoint_dir
from fieldlens.streaming import jobs
from fieldlens.streaming.ordered import answers


def _stream(b, table: str) -> DataFrame:
    schema = b.table(table).schema
    return b.spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(b.folder)


def _photos(b) -> DataFrame:
    return _stream(b, "events").select(F.col("event_id").alias("photo_id"), (F.col("user_id") % 5).alias("camera_id"),
                                       F.col("ts").cast("timestamp").alias("taken_at"), F.col("event_id"))


def _drain(b, out: DataFrame) -> DataFrame:
    """Run a stream over everything that is there into parquet beside the checkpoints."""
    ensure_checkpoint_dir(b.spark)
    base = f"{b.spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    q = (out.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return b.spark.read.schema(out.schema).parquet(f"{base}/out")


@query("stream_first_seen", needs=("photo",), sql="SELECT camera_id, count(*) AS photos FROM photo GROUP BY 1")
def stream_first_seen(b):
    return _drain(b, jobs.first_seen(_photos(b))).groupBy("camera_id").agg(F.count("*").alias("photos"))


@query("stream_visits", needs=("visit", "photo"), sql="""
SELECT camera_id, s AS start_us, e AS end_us, photo_count FROM visit WHERE e + 300000000 <= (SELECT max(us) FROM photo)""")
def stream_visits(b):
    """Visits closed by the watermark: those whose gap has passed when the input ends."""
    out = _drain(b, jobs.visit_stream(_photos(b), late="0 seconds"))
    return out.select("camera_id", F.unix_micros("started_at").alias("start_us"), F.unix_micros("ended_at").alias("end_us"), "photo_count")


@query("stream_hourly_counts", needs=("photo",), sql="""
SELECT camera_id, us // 3600000000 AS hour_no, count(*) AS hits FROM photo GROUP BY 1, 2
HAVING (us // 3600000000 + 1) * 3600000000 <= (SELECT max(us) // 1000 * 1000 FROM photo)""")
def stream_hourly_counts(b):
    out = _drain(b, jobs.hourly_counts(_photos(b), late="0 seconds"))
    return out.select("camera_id", F.floor(F.unix_seconds("hour_utc") / 3600).alias("hour_no"), "hits")


@query("stream_hourly_rates", needs=("photo", "watched"), sql="""
WITH n AS (SELECT camera_id, us // 3600000000 AS hour_no, count(*) AS hits FROM photo GROUP BY 1, 2
  HAVING (us // 3600000000 + 1) * 3600000000 <= (SELECT max(us) // 1000 * 1000 FROM photo)),
h AS (SELECT camera_id, hour_no, count(*) AS k FROM watched GROUP BY 1, 2),
l AS (SELECT camera_id, hour_no, CAST(sum(k) OVER (PARTITION BY camera_id ORDER BY hour_no) AS BIGINT) AS hours FROM h)
SELECT n.camera_id, n.hour_no, n.hits, l.hours, round(CASE WHEN l.hours >= 10 THEN n.hits / l.hours * 100e0 END, 6) AS rate
FROM n JOIN l ON l.camera_id = n.camera_id AND l.hour_no = n.hour_no""")
def stream_hourly_rates(b):
    """Finished hours of the stream against the camera's watched hours up to then."""
    counts = _drain(b, jobs.hourly_counts(_photos(b), late="0 seconds"))
    hours = exposure.watched_hours(b.camera_days(), b.cameras(), b.weather()).groupBy("camera_id", "hour_no").agg(F.count("*").alias("k"))
    so_far = F.sum("k").over(W.partitionBy("camera_id").orderBy("hour_no"))
    live = hours.select("camera_id", F.timestamp_seconds(F.col("hour_no") * 3600).alias("hour_utc"), so_far.alias("hours_to_date"))
    return jobs.hourly_rates(counts, live).select(
        "camera_id", F.floor(F.unix_seconds("hour_utc") / 3600).alias("hour_no"), "hits", F.col("hours_to_date").alias("hours"), round6("rate").alias("rate"))


@query("stream_camera_days", needs=("photo",), sql="""
SELECT camera_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, arg_max(event_id % 4, {'t': ts, 'e': event_id % 4}) AS state, max(event_id % 50) AS photos
FROM (SELECT user_id % 5 AS camera_id, ts, event_id FROM events) GROUP BY 1, 2""")
def stream_camera_days(b):
    """Observations merged into camera-days micro-batch by micro-batch, then read back."""
    ensure_checkpoint_dir(b.spark)
    base = f"{b.spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    seen = _photos(b).select("camera_id", F.to_date("taken_at").alias("day"), (F.col("event_id") % 4).alias("state"),
                             (F.col("event_id") % 50).alias("photos"), F.col("taken_at").alias("observed_at"))
    q = (seen.writeStream.foreachBatch(jobs.camera_day_upsert(f"{base}/days")).option("checkpointLocation", f"{base}/state")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return jobs.current_camera_days(b.spark, f"{base}/days").select("camera_id", F.col("day").cast("string").alias("day"), "state", "photos")


def _arrivals(b, table: str, at: str, parts: int = 4) -> tuple[DataFrame, object]:
    """A table as it would land: by quarters of its time span one after the other, each in several files in any order."""
    ensure_checkpoint_dir(b.spark)
    folder = f"{b.spark.sparkContext.getCheckpointDir()}/landed-{uuid.uuid4().hex}"
    rows = b.table(table)
    lo, hi = rows.agg(F.min(F.unix_micros(F.col(at).cast("timestamp"))), F.max(F.unix_micros(F.col(at).cast("timestamp")))).first()
    span = ((hi or 0) - (lo or 0)) // parts + 1
    quarter = F.floor((F.unix_micros(F.col(at).cast("timestamp")) - F.lit(lo or 0)) / span)
    for k in range(parts):
        rows.where(quarter == k).repartition(3, F.xxhash64(at)).write.mode("append").parquet(folder)
    stream = b.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    return stream, span // 1_000_000 + 1


def _drain_ordered(b, rows: DataFrame, writer, schema: str) -> DataFrame:
    q = (rows.writeStream.foreachBatch(writer).option("checkpointLocation", f"{writer.target}-state").trigger(availableNow=True).start())
    q.awaitTermination()
    writer.finish(b.spark, rows.schema)
    return answers(b.spark, writer.target, schema)


def _target(b) -> str:
    ensure_checkpoint_dir(b.spark)
    return f"{b.spark.sparkContext.getCheckpointDir()}/ordered-{uuid.uuid4().hex}"


table_sql("live_hole", """SELECT camera_id, max(n) OVER (PARTITION BY camera_id, epoch ORDER BY us, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after_n, n AS before_n
  FROM epoched""", ("epoched",))


@query("stream_counter_holes", needs=("live_hole",), sql="""
SELECT camera_id, after_n, before_n, before_n - after_n - 1 AS missing FROM live_hole WHERE before_n > after_n + 1""")
def stream_counter_holes(b):
    """The events as landing files, several triggers, files of a quarter in any order."""
    events, late = _arrivals(b, "events", "ts")
    numbered = events.select((F.col("user_id") % 5).alias("camera_id"), F.col("ts").cast("timestamp").alias("taken_at"),
                             F.when(F.col("event_id") % 17 != 0, F.col("event_id") % 3000).alias("n"))
    return _drain_ordered(b, numbered, jobs.counter_monitor(_target(b), late), jobs.COUNTER_HOLES)


@query("stream_live_tracks", needs=("track_fate",), sql="SELECT track_id, seq, fate FROM track_fate")
def stream_live_tracks(b):
    events, late = _arrivals(b, "events", "ts")
    fixes = b.fixes(events).withColumn("at", F.timestamp_micros((F.col("t_ms") * 1000).cast("long")))
    return _drain_ordered(b, fixes, jobs.live_track(_target(b), late), jobs.TRACK_FATES).select("track_id", "seq", "fate")
