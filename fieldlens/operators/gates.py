"""Speed and step gates of recorded walks, in chunks that run in parallel.

Both gates compare a fix with the last one that passed, so a walk is sequential by definition,
but only until two passes agree: from the first fix at which a pass with the right state and one
without it hold the same state, they go on alike. A long walk is cut into chunks, every chunk is
passed at once as if the walk began there, and a chunk is passed again only while the state its
predecessor hands on differs from the one it was passed with, which settles in a round or two.
A task holds one Arrow batch and the state of one walk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldlens.constants import HAVERSINE_RADIUS_M, MAX_SPEED_MPS, MIN_EPSILON_M
from fieldlens.session import cut_lineage

#: Fixes of a chunk, on average.
CHUNK = 8192
#: What a walk hands on: the last fix that was not too fast, and where the last kept one lay.
STATE = ("s_t", "s_lat", "s_lng", "m_lat", "m_lng")
STATE_SCHEMA = "track_id bigint, s_t double, s_lat double, s_lng double, m_lat double, m_lng double"


def metres(lat1: float, lng1: float, lat2: float, lng2: float) -> float:
    a, b = math.radians(lat1), math.radians(lat2)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lng2 - lng1) / 2) ** 2
    return 2 * HAVERSINE_RADIUS_M * math.asin(min(1.0, math.sqrt(h)))


def passed(state: tuple | None, t, lat: float, lng: float, acc: float) -> tuple[str, tuple]:
    """Fate of a usable fix after a state, and the state after it."""
    if state is None:
        return "kept", (t, lat, lng, lat, lng)
    then, s_lat, s_lng, m_lat, m_lng = state
    if t is not None and then is not None and t > then and metres(s_lat, s_lng, lat, lng) / ((t - then) / 1000.0) > MAX_SPEED_MPS:
        return "speed", state
    if metres(m_lat, m_lng, lat, lng) >= max(MIN_EPSILON_M, 2 * acc):
        return "kept", (t, lat, lng, lat, lng)
    return "stationary", (t, lat, lng, m_lat, m_lng)


def _pass(rows: DataFrame, states: DataFrame) -> DataFrame:
    """Fates of rows(track_id, chunk, seq, t_ms, lat, lng, acc) after states(track_id, chunk, *STATE).

    kind 1: a fix with its fate. kind 2: a chunk's last state.
    """
    none = F.lit(None).cast("double")
    fixes = rows.select("track_id", "chunk", F.lit(1).alias("kind"), F.col("seq").cast("long"), *[F.col(c).cast("double") for c in ("t_ms", "lat", "lng", "acc")],
                        *[none.alias(c) for c in STATE])
    given = states.select("track_id", "chunk", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("seq"), *[none.alias(c) for c in ("t_ms", "lat", "lng", "acc")], *STATE)
    ordered = fixes.unionByName(given).repartition("track_id", "chunk").sortWithinPartitions("track_id", "chunk", "kind", "seq")
    names = ordered.columns + ["fate"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None

        def end():
            return (*at, 2, None, None, None, None, None, *state, None)
        kinds = None
        for batch in batches:
            kinds = [*batch.schema.types, pa.string()]
            out = []
            for track, chunk, kind, seq, t, lat, lng, acc, *given in zip(*(c.to_pylist() for c in batch.columns)):
                if (track, chunk) != at:
                    if state is not None:
                        out.append(end())
                    at, state = (track, chunk), None
                if kind == 0:
                    state = tuple(given)
                    continue
                fate, state = passed(state, t, lat, lng, acc)
                out.append((track, chunk, 1, seq, t, lat, lng, acc, None, None, None, None, None, fate))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(end(), kinds)], names)
    return ordered.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in ordered.dtypes) + ", fate string")


def gated(good: DataFrame, states: DataFrame | None = None, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Fates of usable fixes, and each walk's last state.

    good(track_id, seq, t_ms, lat, lng, acc), seq a whole number in recording order; states
    (track_id, *STATE) holds what walks that go on were handed. Fates are kept, speed, stationary.
    """
    spark = good.sparkSession
    states = spark.createDataFrame([], STATE_SCHEMA) if states is None else states
    spans = good.groupBy("track_id").agg(F.count("*").alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    long = spans.where(F.col("n") > chunk).select(
        "track_id", "lo", ((F.col("hi") - F.col("lo") + 1) / F.ceil(F.col("n") / chunk)).alias("width"))
    some = not long.isEmpty()
    if some:
        good = good.join(long, "track_id", "left").withColumn("chunk", F.coalesce(F.floor((F.col("seq") - F.col("lo")) / F.col("width")), F.lit(0)).cast("int"))
    else:
        good = good.withColumn("chunk", F.lit(0))
    first = good.groupBy("track_id").agg(F.min("chunk").alias("chunk")) if some else good.select("track_id", "chunk").distinct()
    handed = states.join(first, "track_id", "left_semi").withColumn("chunk", F.lit(0))
    done = cut_lineage(_pass(good, handed))
    if some:
        by_track = W.partitionBy("track_id").orderBy("chunk")
        told = None
        while True:
            ends = done.where("kind = 2").select("track_id", "chunk", *STATE)
            before = ends.select("track_id", "chunk", *[F.lag(c).over(by_track).alias(c) for c in STATE], F.lag("chunk").over(by_track).alias("_before"))
            before = cut_lineage(before.where("_before is not null").drop("_before"))
            fresh = before if told is None else before.join(told, [
                before["track_id"] == told["track_id"], before["chunk"] == told["chunk"], *[before[c].eqNullSafe(told[c]) for c in STATE]], "left_anti")
            if fresh.isEmpty():
                break
            again = _pass(done.where("kind = 1").join(fresh.select("track_id", "chunk"), ["track_id", "chunk"], "left_semi"), fresh)
            rest = done.join(fresh.select("track_id", "chunk"), ["track_id", "chunk"], "left_anti")
            told, done = before, cut_lineage(rest.unionByName(again))
    fates = done.where("kind = 1").select("track_id", "seq", "t_ms", "lat", "lng", "acc", "fate")
    last = F.max_by(F.struct(*STATE), "chunk").alias("s")
    return fates, done.where("kind = 2").groupBy("track_id").agg(last).select("track_id", "s.*")
