"""Photos the camera numbered that never arrived: holes in the counter sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldlens.constants import COUNTER_RESET_DROP, GAP_RECENT_DAYS
from fieldlens.session import cut_lineage

COUNTER_BLOCK = 10_000


def counter_of(name: Column) -> Column:
    """Last run of digits in the base name of a file."""
    base = F.regexp_replace(F.element_at(F.split(name, r"[\\/]"), -1), r"\.[^.]*$", "")
    runs = F.regexp_extract_all(base, F.lit(r"(\d+)"), F.lit(1))
    return F.when(F.size(runs) > 0, F.element_at(runs, -1).try_cast("bigint"))


def _chunk_epochs(photos: DataFrame) -> DataFrame:
    """Usable rows with the epoch they fall in, counted from the start of their own hour.

    An hour of one camera is what one task orders, however many photos the camera has.
    """
    w = W.partitionBy("camera_id", "chunk").orderBy("taken_at", "n")
    rows = (photos.where(F.col("n").isNotNull() & F.col("taken_at").isNotNull())
            .select("camera_id", F.date_trunc("hour", "taken_at").alias("chunk"), "taken_at", "n"))
    reset = F.coalesce(F.col("n") < F.lag("n").over(w) - COUNTER_RESET_DROP, F.lit(False))
    return rows.withColumn("reset", reset.cast("int")).withColumn(
        "local", F.sum("reset").over(w.rowsBetween(W.unboundedPreceding, 0)))


def _chunk_offsets(rows: DataFrame) -> DataFrame:
    """How many epochs a camera had started before each hour: one row per camera-hour.

    Kept as files: the photos are ordered once for it, whatever is asked of it later.
    """
    order = F.struct("taken_at", "n")
    chunks = rows.groupBy("camera_id", "chunk").agg(
        F.min_by("n", order).alias("first_n"), F.max_by("n", order).alias("last_n"), F.max("local").alias("inner"))
    w = W.partitionBy("camera_id").orderBy("chunk")
    edge = F.coalesce(F.col("first_n") < F.lag("last_n").over(w) - COUNTER_RESET_DROP, F.lit(False)).cast("int")
    started = (chunks.withColumn("edge", edge)
               .withColumn("before", F.coalesce(F.sum(F.col("inner") + F.col("edge")).over(
                   w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))))
    return cut_lineage(started.select("camera_id", "chunk", (F.col("before") + F.col("edge")).alias("offset"), "inner"))


def first_arrivals(photos: DataFrame, offsets: DataFrame | None = None) -> DataFrame:
    """Earliest instant of every counter of every epoch.

    The ordered work is one window per camera-hour; what crosses the hour is carried by a
    table with one row per camera-hour. A drop of more than the reset limit against the
    photo before starts an epoch.
    """
    rows = _chunk_epochs(photos)
    hourly = rows.groupBy("camera_id", "chunk", "local", "n").agg(F.min("taken_at").alias("at"))
    return (hourly.join(_chunk_offsets(rows) if offsets is None else offsets, ["camera_id", "chunk"])
            .groupBy("camera_id", (F.col("offset") + F.col("local")).alias("epoch"), "n")
            .agg(F.min("at").alias("at")))


def counter_gaps(photos: DataFrame, offsets: DataFrame | None = None) -> DataFrame:
    """One row per hole: the counters either side, when they were taken, how many are missing.

    Counters are ordered inside blocks; the hole between two blocks comes from the blocks'
    own first and last counters.
    """
    firsts = first_arrivals(photos, offsets).withColumn("block", F.floor(F.col("n") / COUNTER_BLOCK))
    group = ["camera_id", "epoch"]
    w = W.partitionBy(*group, "block").orderBy("n")
    here = F.struct("n", "at")
    inside = firsts.select(*group, F.lag(here).over(w).alias("a"), here.alias("b"))
    ends = firsts.groupBy(*group, "block").agg(F.min(here).alias("b"), F.max(here).alias("top"))
    across = ends.select(*group, F.lag("top").over(W.partitionBy(*group).orderBy("block")).alias("a"), "b")
    pairs = inside.unionByName(across).where(F.col("b.n") - F.col("a.n") > 1)
    return pairs.select(*group, F.col("a.n").alias("after_n"), F.col("a.at").alias("after_at"),
                        F.col("b.n").alias("before_n"), F.col("b.at").alias("before_at"),
                        (F.col("b.n") - F.col("a.n") - 1).alias("missing"))


def live_holes(photos: DataFrame, carried: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Holes of photos(camera_id, taken_at, n) after carried(camera_id, last_n, top), and what to carry on.

    Each row is (camera_id, after_n, before_n, missing): a counter, and the highest of its run before
    it. Photos are ordered inside their camera-hour; runs that cross hours, and the carried row of a
    camera, meet in tables of a row an hour and run.
    """
    rows = (photos.where(F.col("n").isNotNull() & F.col("taken_at").isNotNull())
            .select(F.col("camera_id").cast("long"), F.date_trunc("hour", "taken_at").alias("chunk"), "taken_at", F.col("n").cast("long")))
    hour = W.partitionBy("camera_id", "chunk").orderBy("taken_at", "n")
    rows = cut_lineage(rows.withColumn("prev", F.lag("n").over(hour)))
    order = F.struct("taken_at", "n")
    chunks = rows.groupBy("camera_id", "chunk").agg(F.min_by("n", order).alias("first_n"), F.max_by("n", order).alias("last_n"))
    by_camera = W.partitionBy("camera_id").orderBy("chunk")
    edge = (chunks.withColumn("prev_n", F.lag("last_n").over(by_camera)).join(carried.select("camera_id", F.col("last_n").alias("old_n")), "camera_id", "left")
            .select("camera_id", "chunk", "last_n", F.coalesce(F.col("first_n") < F.coalesce("prev_n", "old_n") - COUNTER_RESET_DROP, F.lit(False)).cast("int").alias("edge")))
    reset = F.coalesce(F.col("n") < F.col("prev") - COUNTER_RESET_DROP, F.lit(False)).cast("int")
    local = rows.withColumn("local", F.sum(reset).over(hour.rowsBetween(W.unboundedPreceding, 0)))
    run = W.partitionBy("camera_id", "chunk", "local").orderBy("taken_at", "n").rowsBetween(W.unboundedPreceding, -1)
    local = cut_lineage(local.withColumn("inside", F.max("n").over(run)))

    runs = local.groupBy("camera_id", "chunk", "local").agg(F.max("n").alias("most"))
    inner = runs.groupBy("camera_id", "chunk").agg(F.max("local").alias("inner")).join(edge, ["camera_id", "chunk"])
    before = F.coalesce(F.sum(F.col("inner") + F.col("edge")).over(by_camera.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("edge")
    runs = runs.join(inner.select("camera_id", "chunk", before.alias("offset")), ["camera_id", "chunk"]).withColumn("epoch", F.col("offset") + F.col("local"))
    old = carried.select("camera_id", F.lit(None).cast("timestamp").alias("chunk"), F.lit(0).cast("long").alias("local"), F.col("top").alias("most"),
                         F.lit(0).cast("long").alias("epoch"))
    in_epoch = W.partitionBy("camera_id", "epoch").orderBy(F.col("chunk").asc_nulls_first(), "local").rowsBetween(W.unboundedPreceding, -1)
    runs = cut_lineage(runs.select("camera_id", "chunk", "local", "most", "epoch").unionByName(old).withColumn("handed", F.max("most").over(in_epoch)))
    top = F.greatest("inside", "handed")
    holes = (local.join(runs.select("camera_id", "chunk", "local", "handed"), ["camera_id", "chunk", "local"])
             .select("camera_id", top.alias("after_n"), F.col("n").alias("before_n")).where(F.col("before_n") > F.col("after_n") + 1)
             .withColumn("missing", F.col("before_n") - F.col("after_n") - 1))
    last = chunks.groupBy("camera_id").agg(F.max_by("last_n", "chunk").alias("last_n"))
    tops = runs.groupBy("camera_id").agg(F.max_by(F.greatest("most", "handed"), F.struct("epoch", F.coalesce("chunk", F.lit("0001-01-01").cast("timestamp")), "local")).alias("top"))
    return holes, last.join(tops, "camera_id").select("camera_id", "last_n", "top")


def gap_summary(photos: DataFrame, now: Column) -> DataFrame:
    """Per camera: counted, skipped, resets, missing, recent missing, level, newest hole."""
    base = photos.groupBy("camera_id").agg(
        F.count_if(F.col("n").isNotNull() & F.col("taken_at").isNotNull()).alias("counted"),
        F.count_if(F.col("n").isNull() | F.col("taken_at").isNull()).alias("skipped"))
    offsets = _chunk_offsets(_chunk_epochs(photos))
    resets = offsets.groupBy("camera_id").agg(
        F.max(F.col("offset") + F.col("inner")).alias("resets"))
    fresh = F.unix_micros(now) - F.unix_micros("before_at") <= GAP_RECENT_DAYS * 86_400_000_000
    gaps = counter_gaps(photos, offsets).groupBy("camera_id").agg(
        F.count("*").alias("gaps"), F.sum("missing").alias("missing"),
        F.sum(F.when(fresh, F.col("missing")).otherwise(0)).alias("recent"),
        F.max_by(F.struct("after_at", "before_at"), F.struct("before_at", "after_at")).alias("newest"))
    return (base.join(resets, "camera_id", "left").join(gaps, "camera_id", "left")
            .na.fill(0, ["resets", "gaps", "missing", "recent"])
            .withColumn("level", F.when(F.col("recent") > 0, "warn").otherwise("ok"))
            .select("camera_id", "counted", "skipped", "resets", "gaps", "missing", "recent", "level",
                    F.col("newest.after_at").alias("after_at"),
                    F.col("newest.before_at").alias("before_at")))
