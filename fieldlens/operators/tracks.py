"""Cleaning recorded walks: accuracy, speed and step gates, then line simplification.

The speed and step gates compare each fix with the last one KEPT, which no window can
express; `gates` passes chunks of walks at once. Simplification splits long segments of all
tracks at their farthest points in rounds of aggregates, and finishes short ones one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldlens.constants import MAX_ACCURACY_M, MIN_EPSILON_M
from fieldlens.functions import geo
from fieldlens.functions.num import half_up, half_up_to
from fieldlens.operators import gates
from fieldlens.operators.orderstat import order_statistic
from fieldlens.session import cut_lineage


def usable_fixes(fixes: DataFrame) -> DataFrame:
    """Tag each fix: unusable position, inaccurate, or good enough to look at."""
    bad = (F.col("lat").isNull() | F.col("lng").isNull() | (F.abs("lat") > 90) | (F.abs("lng") > 180))
    poor = F.col("acc").isNull() | (F.col("acc") > MAX_ACCURACY_M)
    return fixes.withColumn("fate", F.when(bad, "unusable").when(poor, "accuracy").otherwise("fix"))


def gate_fixes(fixes: DataFrame, chunk: int = gates.CHUNK) -> DataFrame:
    """fixes(track_id, seq, t_ms, lat, lng, acc) with `fate`: kept, speed or stationary.

    `seq` is the recording order. A fix too fast for a walker against the last kept fix is
    dropped; a step shorter than the fix's own error is stationary.
    """
    fates, _ = gates.gated(usable_fixes(fixes).where(F.col("fate") == "fix").drop("fate"), chunk=chunk)
    # the last accepted fix always stays, so the line reaches where the walk ended
    ends = fates.where(F.col("fate") != "speed").groupBy("track_id").agg(F.max("seq").alias("end_seq"))
    last_one = (F.col("fate") == "stationary") & (F.col("seq") == F.col("end_seq"))
    return (fates.join(ends, "track_id", "left")
            .withColumn("fate", F.when(last_one, "kept").otherwise(F.col("fate"))).drop("end_seq"))


def _kept_inside(lat: np.ndarray, lng: np.ndarray, eps: float) -> np.ndarray:
    """Positions a line from its first to its last point needs, these two left out."""
    keep, todo = [], [(0, len(lat) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        r = np.radians(lat[a])
        m_lat, m_lng = 111132.92 - 559.82 * np.cos(2 * r), 111412.84 * np.cos(r) - 93.5 * np.cos(3 * r)
        x, y = (lng[a + 1:b] - lng[a]) * m_lng, (lat[a + 1:b] - lat[a]) * m_lat
        bx, by = (lng[b] - lng[a]) * m_lng, (lat[b] - lat[a]) * m_lat
        len2 = bx * bx + by * by
        t = np.zeros(len(x)) if len2 == 0 else np.clip((x * bx + y * by) / len2, 0.0, 1.0)
        d = np.sqrt((x - t * bx) ** 2 + (y - t * by) ** 2)
        far = int(d.argmax())
        if d[far] > eps:
            mid = a + 1 + far
            keep.append(mid)
            todo += [(a, mid), (mid, b)]
    return np.array(keep, int)


def _short_segments(inner: DataFrame) -> DataFrame:
    """(track_id, seq, lat, lng) that segments of few points need: a task holds one segment."""
    rows = (inner.select("track_id", F.col("a.seq").alias("a_seq"), "seq", "lat", "lng", "eps", F.col("a.lat").alias("a_lat"), F.col("a.lng").alias("a_lng"),
                         F.col("b.lat").alias("b_lat"), F.col("b.lng").alias("b_lng"))
            .repartition("track_id", "a_seq").sortWithinPartitions("track_id", "a_seq", "seq"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None

        def solved(part: pd.DataFrame) -> pd.DataFrame:
            out = []
            for _, g in part.groupby(["track_id", "a_seq"], sort=False):
                one = g.iloc[0]
                lat = np.concatenate([[one.a_lat], g["lat"].to_numpy(), [one.b_lat]])
                lng = np.concatenate([[one.a_lng], g["lng"].to_numpy(), [one.b_lng]])
                out.append(g.iloc[_kept_inside(lat, lng, one.eps) - 1])
            return pd.concat(out)[["track_id", "seq", "lat", "lng"]]
        for batch in batches:
            whole = batch if held is None else pd.concat([held, batch])
            if not len(whole):
                continue
            last = (whole["track_id"] == whole["track_id"].iloc[-1]) & (whole["a_seq"] == whole["a_seq"].iloc[-1])
            held = whole[last]                             # the last segment may go on in the next batch
            if not last.all():
                yield solved(whole[~last])
        if held is not None:
            yield solved(held)
    return rows.mapInPandas(run, "track_id bigint, seq bigint, lat double, lng double")


def simplify(points: DataFrame, epsilon: DataFrame, few: int = gates.CHUNK) -> DataFrame:
    """Keep the points a line needs: points(track_id, seq, lat, lng), epsilon(track_id, eps).

    While a segment has more than `few` points, each round finds the farthest point of every
    long segment (a partial aggregate) and splits there when it is farther than the track's
    epsilon. Segments of fewer points are finished one by one, many at once.
    """
    ends = points.groupBy("track_id").agg(
        F.min(F.struct("seq", "lat", "lng")).alias("a"), F.max(F.struct("seq", "lat", "lng")).alias("b"))
    kept = cut_lineage(ends.select("track_id", F.explode(F.array("a", "b")).alias("p"))
                       .select("track_id", "p.seq", "p.lat", "p.lng").distinct())
    inner = cut_lineage(points.join(ends, "track_id").join(epsilon, "track_id").where(
        (F.col("seq") > F.col("a.seq")) & (F.col("seq") < F.col("b.seq"))))
    segment = ["track_id", "a", "b"]
    while True:
        long = cut_lineage(inner.groupBy(*segment).agg(F.count("*").alias("n")).where(F.col("n") > few).drop("n"))
        if long.isEmpty():
            return kept.unionByName(_short_segments(inner))
        kept = kept.unionByName(_short_segments(inner.join(long, segment, "left_anti")))
        inner = inner.join(long, segment, "left_semi")
        d = geo.point_segment_m(F.col("lat"), F.col("lng"), F.col("a.lat"), F.col("a.lng"),
                                F.col("b.lat"), F.col("b.lng"))
        here = F.struct("seq", "lat", "lng")
        split = (inner.withColumn("d", d).groupBy("track_id", "a", "b", "eps")
                 .agg(F.max("d").alias("far"), F.max_by(here, F.struct(F.col("d"), -F.col("seq"))).alias("mid"))
                 .where(F.col("far") > F.col("eps")).select("track_id", "a", "b", "mid"))
        split = cut_lineage(split)
        kept = kept.unionByName(split.select("track_id", "mid.seq", "mid.lat", "mid.lng"))
        before = F.col("seq") < F.col("mid.seq")
        inner = cut_lineage(
            inner.join(split, segment).where(F.col("seq") != F.col("mid.seq"))
            .withColumns({"a": F.when(before, F.col("a")).otherwise(F.col("mid")),
                          "b": F.when(before, F.col("mid")).otherwise(F.col("b"))}).drop("mid"))


def build_tracks(fixes: DataFrame) -> DataFrame:
    """Per track: fixes, used, what was dropped and why, length, duration, quality."""
    gated = cut_lineage(gate_fixes(fixes))
    counts = usable_fixes(fixes).groupBy("track_id").agg(
        F.count("*").alias("fixes"), F.count_if(F.col("fate") == "unusable").alias("unusable"),
        F.count_if(F.col("fate") == "accuracy").alias("inaccurate"))
    passed = F.col("fate") != "speed"
    fates = gated.groupBy("track_id").agg(
        F.count_if(F.col("fate") == "speed").alias("speed"), F.count_if(F.col("fate") == "stationary").alias("stationary"),
        F.count_if(passed).alias("accepted"), F.min(F.when(passed, F.col("t_ms"))).alias("started_ms"),
        F.max(F.when(passed, F.col("t_ms"))).alias("ended_ms"))
    mid = order_statistic(gated.where(passed), ["track_id"], "acc", 0.5, "median_acc").drop("n")
    eps = mid.select("track_id", F.greatest(F.lit(MIN_EPSILON_M), F.col("median_acc") / 2).alias("eps"))
    line = simplify(gated.where(F.col("fate") == "kept").select("track_id", "seq", "lat", "lng"), eps)
    w = W.partitionBy("track_id").orderBy("seq")
    leg = geo.haversine_m(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng"))
    length = line.withColumn("leg", leg).groupBy("track_id").agg(
        F.count("*").alias("used"), F.coalesce(F.sum("leg"), F.lit(0.0)).alias("length"))
    out = (counts.join(fates, "track_id", "left").join(mid, "track_id", "left").join(length, "track_id", "left")
           .na.fill(0, ["speed", "stationary", "accepted", "used", "length"]))
    seconds = half_up((F.col("ended_ms") - F.col("started_ms")) / 1000.0)
    share = F.col("accepted") / F.greatest(F.lit(1), F.col("fixes"))
    quality = (F.when((F.col("used") < 2) | (F.col("accepted") < 5), "unusable").when(share < 0.4, "poor")
               .when(F.col("median_acc") > 20, "rough").otherwise("good"))
    pace = F.when((F.col("length") > 100) & (seconds > 0), half_up(seconds / (F.col("length") / 1000.0)))
    return out.select("track_id", "fixes", "used", "unusable", "inaccurate", "speed", "stationary", "accepted",
                      half_up_to(F.col("median_acc"), 1).alias("median_acc"), half_up(F.col("length")).alias("length_m"),
                      seconds.alias("seconds"), pace.alias("pace_s_per_km"), quality.alias("quality"))
