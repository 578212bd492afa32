"""What bursts of hashed frames show: empty-scene matches and the way an animal crossed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from fieldlens.constants import (MIN_DRIFT_COLS, MIN_FRAMES_SELF, MIN_SUBJECT_BITS, WIND_BITS,
                                 WIND_MIN_BASELINE)
from fieldlens.functions import hashes
from fieldlens.functions.num import wrap360
from fieldlens.operators.chunked import with_running_sum
from fieldlens.session import cut_lineage

#: One more than the bits that may differ: hashes that close agree on all of at least one band.
BANDS = WIND_BITS + 1
#: Pairs that one band value may make before it is divided again, and how often it may be.
HOT_PAIRS, DEPTH = 1 << 14, 3


def bit_orders(base: DataFrame) -> DataFrame:
    """(camera_id, order): the 256 bit positions of a camera's hashes, those that tell most first.

    A bit tells most when half the hashes set it. Dealt out in turn, every band gets its share
    of telling bits, and what never changes in a camera's view (a sky) makes no band of its own.
    """
    kind = base.schema["camera_id"].dataType.simpleString()

    def count(batches):
        held: dict = {}

        def out():
            rows = [(c, k, int(x), n) for c, (n, ones) in held.items() for k, x in enumerate(ones)]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((camera, pa.int32(), pa.int64(), pa.int64()))],
                                              ["camera_id", "bit", "ones", "n"])
        camera = pa.null()
        for batch in batches:
            camera = batch.schema.field(0).type
            cameras = batch.column(0).to_pylist()
            bits = np.unpackbits(np.frombuffer(b"".join(bytes.fromhex(h[3:]) for h in batch.column(1).to_pylist()), np.uint8).reshape(-1, 32), axis=1)
            for c in set(cameras):
                mine = bits[[x == c for x in cameras]] if len(set(cameras)) > 1 else bits
                n, ones = held.get(c, (0, np.zeros(256, np.int64)))
                held[c] = (n + len(mine), ones + mine.sum(0, dtype=np.int64))
            if len(held) > 1000:
                yield out()
                held.clear()
        if held:
            yield out()
    counts = base.select("camera_id", "phash").mapInArrow(count, f"camera_id {kind}, bit int, ones long, n long").groupBy("camera_id", "bit").agg(
        F.sum("ones").alias("ones"), F.sum("n").alias("n"))
    tells = F.abs(F.col("ones") / F.col("n") - 0.5)
    return counts.groupBy("camera_id").agg(F.sort_array(F.collect_list(F.struct(tells.alias("t"), "bit"))).alias("o")).select("camera_id", F.col("o.bit").alias("order"))


def _banded(rows: DataFrame, orders: DataFrame, depth: int) -> DataFrame:
    """rows(camera_id, h, key, p0 ..) once a band: key of the bits of one part (at most 20), p<depth> which part.

    Parts are dealt from the bits that the bands chosen before leave out.
    """
    names = [c for c in rows.columns if c != "key"]
    held = rows.join(orders, "camera_id").select(*names, "key", "order")
    schema = held.drop("order").schema.add("values", ArrayType(LongType()))

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            bits = np.unpackbits(np.frombuffer(b"".join(bytes.fromhex(h[3:]) for h in at["h"].to_pylist()), np.uint8).reshape(-1, 256 // 8), axis=1)
            bits = np.take_along_axis(bits, at["order"].flatten().to_numpy(zero_copy_only=False).reshape(-1, 256), axis=1)
            values = np.zeros((batch.num_rows, BANDS), np.int64)
            chosen = np.zeros((batch.num_rows, depth), np.int64)
            for d in range(depth):
                chosen[:, d] = at[f"p{d}"].to_numpy(zero_copy_only=False)
            for parts in set(map(tuple, chosen.tolist())):
                mine = np.flatnonzero((chosen == parts).all(axis=1))
                rest = np.arange(256)
                for part in parts:
                    rest = rest[np.arange(len(rest)) % BANDS != part]
                for k in range(BANDS):
                    of = rest[k::BANDS]
                    values[mine, k] = bits[np.ix_(mine, of)].astype(np.int64) @ (1 << np.arange(len(of), dtype=np.int64))
            spans = pa.array(np.arange(0, values.size + 1, BANDS, dtype=np.int32))
            out = pa.ListArray.from_arrays(spans, pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([*(at[c] for c in (*names, "key")), out], [*names, "key", "values"])
    part = F.col(f"p{depth}")
    return (held.mapInArrow(work, schema).select(*names, "key", F.posexplode("values").alias(f"p{depth}", "value"))
            .select(*names, part, F.xxhash64("key", part, "value").alias("key")))


def candidate_pairs(left: DataFrame, right: DataFrame, orders: DataFrame) -> DataFrame:
    """(camera_id, f, b): all pairs of hashes of left(camera_id, f) and right(camera_id, b) at most 12 bits apart, and some more.

    Such hashes agree on all of one of BANDS bands. A band value that would make more than
    HOT_PAIRS pairs is not joined but divided: its hashes agree on the band, so they agree on
    all of one of BANDS parts of the bits it leaves out.
    """
    start = lambda df, name: df.select("camera_id", F.col(name).alias("h"), F.lit(0).cast("long").alias("key"))
    one, other, pairs = start(left, "f"), start(right, "b"), None
    group = ["camera_id", "key"]
    for depth in range(DEPTH):
        one, other = (cut_lineage(_banded(x, orders, depth)) for x in (one, other))
        hot = (one.groupBy(*group).agg(F.count("*").alias("n")).join(other.groupBy(*group).agg(F.count("*").alias("m")), group)
               .where(F.col("n") * F.col("m") > HOT_PAIRS).select(*group))
        hot = cut_lineage(hot.limit(0) if depth == DEPTH - 1 else hot)
        cold = one.join(hot, group, "left_anti").select(*group, F.col("h").alias("f")).join(other.select(*group, F.col("h").alias("b")), group).drop("key")
        pairs = cold if pairs is None else pairs.unionByName(cold)
        if hot.isEmpty():
            break
        one, other = (x.join(hot, group, "left_semi") for x in (one, other))
    return pairs


def empty_matches(frames: DataFrame, baseline: DataFrame) -> DataFrame:
    """Frames with the fewest bits to their own camera's empty scenes, null when none is close.

    frames(photo_id, camera_id, phash), baseline(camera_id, phash). Hashes meet by bands of bits
    that change (`candidate_pairs`), so none at most 12 bits apart is lost; copies of a hash are
    reduced to one first.
    """
    base = cut_lineage(baseline.where(hashes.is_hash(F.col("phash"))).groupBy("camera_id", "phash").agg(
        F.count("*").alias("copies")))
    size = base.groupBy("camera_id").agg(F.sum("copies").alias("of"))
    distinct = (frames.where(hashes.is_hash(F.col("phash"))).select("camera_id", F.col("phash").alias("f"))
                .distinct())
    known = base.select("camera_id", F.col("phash").alias("b"))
    # a copy of an empty scene is zero bits away: settled by equality, it never meets a band
    same = distinct.join(known.withColumnRenamed("b", "f"), ["camera_id", "f"], "left_semi").withColumn(
        "bits", F.lit(0))
    other = distinct.join(known.withColumnRenamed("b", "f"), ["camera_id", "f"], "left_anti")
    met = candidate_pairs(other, known, cut_lineage(bit_orders(base)))
    close = (met.withColumns({"fw": hashes.words(F.col("f")), "bw": hashes.words(F.col("b"))}).groupBy("camera_id", "f")
             .agg(F.min(hashes.hamming_words(F.col("fw"), F.col("bw"))).alias("bits"))
             .where(F.col("bits") <= WIND_BITS))
    best = same.unionByName(close).withColumnRenamed("f", "phash")
    return (frames.join(best, ["camera_id", "phash"], "left").join(size, "camera_id", "left")
            .withColumn("bits", F.when(F.col("of") >= WIND_MIN_BASELINE, F.col("bits")))
            .withColumn("of", F.when(F.col("bits").isNotNull(), F.col("of"))))


def visit_matches(matched: DataFrame) -> DataFrame:
    """A visit is an empty scene only when every frame matches; its figure is the worst frame."""
    return (matched.groupBy("visit_id").agg(F.bool_and(F.col("bits").isNotNull()).alias("all"),
                                            F.max("bits").alias("bits"))
            .select("visit_id", F.when(F.col("all"), F.col("bits")).alias("bits")))


def _digits(frames: DataFrame) -> DataFrame:
    """Sixty-four rows per frame: each hex digit as four bits with its first column."""
    digit = F.posexplode(F.split(F.substring("phash", 4, 64), ""))
    return (frames.select("visit_id", "photo_id", digit.alias("k", "d")).where(F.col("k") < 64)
            .withColumn("v", F.conv("d", 16, 10).cast("int"))
            .select("visit_id", "photo_id", "k",
                    *[F.getbit(F.col("v"), F.lit(3 - j)).cast("int").alias(f"b{j}") for j in range(4)]))


def subject_columns(frames: DataFrame) -> DataFrame:
    """Per frame: changed bits against the burst's own majority background and their mean column.

    The background needs at least three hashed frames. Bits are counted by (visit, digit),
    so no burst is ever held whole in one place.
    """
    usable = frames.where(hashes.is_hash(F.col("phash")))
    bits = _digits(usable)
    background = bits.groupBy("visit_id", "k").agg(
        F.count("*").alias("frames"),
        *[(F.sum(f"b{j}") * 2 > F.count("*")).cast("int").alias(f"g{j}") for j in range(4)]
    ).where(F.col("frames") >= MIN_FRAMES_SELF)
    changed = [(F.col(f"b{j}") != F.col(f"g{j}")).cast("int") for j in range(4)]
    col0 = F.col("k") % 4 * 4
    per = bits.join(background, ["visit_id", "k"]).groupBy("visit_id", "photo_id").agg(
        F.sum(changed[0] + changed[1] + changed[2] + changed[3]).alias("bits"),
        F.sum(sum((changed[j] * (col0 + j) for j in range(1, 4)), changed[0] * col0)).alias("weighted"))
    return per.select("visit_id", "photo_id", "bits", (F.col("weighted") / F.col("bits")).alias("column"))


def crossings(frames: DataFrame) -> DataFrame:
    """Per visit: frames, drift between its first and second half, and left / right / null.

    frames(visit_id, photo_id, taken_at, phash).
    """
    base = frames.groupBy("visit_id").agg(F.count_if(hashes.is_hash(F.col("phash"))).alias("frames"))
    # one narrow row per frame with a subject: kept, because the steps below read it three times
    seen = cut_lineage(subject_columns(frames).where(F.col("bits") >= MIN_SUBJECT_BITS)
                       .join(frames.select("photo_id", "taken_at"), "photo_id")
                       .withColumn("hour", F.date_trunc("hour", "taken_at")).withColumn("one", F.lit(1)))
    placed = with_running_sum(seen, ["visit_id"], "hour", ["taken_at", "photo_id"], "one", "nth")
    half = placed.join(seen.groupBy("visit_id").agg(F.count("*").alias("subjects")), "visit_id")
    first = F.col("nth") <= F.greatest(F.lit(1), F.floor(F.col("subjects") / 2))
    second = F.col("nth") > F.floor(F.col("subjects") / 2)
    drift = half.where(F.col("subjects") >= 2).groupBy("visit_id", "subjects").agg(
        (F.avg(F.when(second, F.col("column"))) - F.avg(F.when(first, F.col("column")))).alias("drift"))
    way = F.when(F.col("drift") >= MIN_DRIFT_COLS, "right").when(F.col("drift") <= -MIN_DRIFT_COLS, "left")
    why = (F.when(F.col("frames") < 2, "single frame").when(F.col("frames") < MIN_FRAMES_SELF, "no background")
           .when(F.col("drift").isNull(), "too few subjects").when(way.isNull(), "did not cross"))
    return (base.join(drift, "visit_id", "left").withColumn("crossing", way).withColumn("why", why)
            .select("visit_id", "frames", "subjects", "drift", "crossing", "why"))


def headings(crossed: DataFrame, visits: DataFrame, facings: DataFrame) -> DataFrame:
    """Compass heading of each crossing: the camera's facing turned a quarter either way.

    visits(visit_id, camera_id), facings(camera_id, facing_deg); no facing leaves a note.
    """
    turn = F.when(F.col("crossing") == "right", 90.0).when(F.col("crossing") == "left", -90.0)
    note = F.coalesce("why", F.when(F.col("facing_deg").isNull(), F.lit("no facing set")))
    return (crossed.join(visits, "visit_id").join(facings, "camera_id", "left")
            .withColumn("heading_deg", wrap360(F.col("facing_deg") + turn)).withColumn("note", note)
            .select("visit_id", "camera_id", "crossing", "heading_deg", "note"))
