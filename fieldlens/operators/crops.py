"""Crop seasons from greenness readings: harvest state, curves, rotation and verdicts.

Readings are one row per field and date, so every ordered step runs over a group
bounded by the season's dates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from fieldlens.constants import (CROP_WORDS, CURVE_STEP_DAYS, CUT_DROP, CUT_LEVEL, FAST_DAYS, MAX_SHIFT_DAYS,
                                 MIN_CLEAR_PIXELS, MIN_REFERENCE_FIELDS, PERSISTENT_CROPS,
                                 PRIOR_WEIGHT, SEARCH_RADII_M, SHIFT_PENALTY, STANDING_FRACTION,
                                 UNUSABLE_SCENE_CLASSES)
from fieldlens.functions.num import half_up
from fieldlens.operators.spatial import counts_within, points_in_polygons, sites
from fieldlens.session import cut_lineage


def clear_steps(readings: DataFrame, key: str = "field_id") -> DataFrame:
    """Cloud-free readings with the reading before each."""
    w = W.partitionBy(key).orderBy("date")
    return (readings.where(F.col("ndvi").isNotNull())
            .withColumns({"prev_date": F.lag("date").over(w), "prev_ndvi": F.lag("ndvi").over(w)}))


def harvest_states(readings: DataFrame, today: Column, key: str = "field_id") -> DataFrame:
    """standing, cut, cut-or-senesced, senescing or unknown for every field.

    The first fall after the peak that is deep enough and ends bare decides; looks more
    than FAST_DAYS apart cannot tell a harvest from a slow drydown.
    """
    steps = clear_steps(readings, key)
    shape = steps.groupBy(key).agg(
        F.count("*").alias("looks"), F.max("ndvi").alias("peak"),
        F.max_by("date", F.struct(F.col("ndvi"), -F.unix_date("date"))).alias("peak_date"),
        F.max(F.struct("date", "ndvi")).alias("last"))
    falls = (steps.join(shape.select(key, "peak_date"), key)
             .where((F.col("prev_date") >= F.col("peak_date")) & (F.col("ndvi") <= CUT_LEVEL)
                    & (F.col("prev_ndvi") - F.col("ndvi") >= CUT_DROP))
             .groupBy(key).agg(F.min(F.struct("date", "prev_date")).alias("fall")))
    gap = F.datediff(F.col("fall.date"), F.col("fall.prev_date"))
    thin = (F.col("looks") < 3) | (F.col("peak") < CUT_LEVEL + CUT_DROP)
    state = (F.when(thin, "unknown").when(gap <= FAST_DAYS, "cut").when(gap > FAST_DAYS, "cut-or-senesced")
             .when(F.col("last.ndvi") >= F.col("peak") * STANDING_FRACTION, "standing")
             .otherwise("senescing"))
    since = F.when(F.col("state").isin("cut", "cut-or-senesced"), F.col("fall.date")).when(
        F.col("state") == "senescing", F.col("peak_date"))
    return (shape.join(falls, key, "left").withColumn("state", state).withColumn("since", since)
            .select(key, "looks", "state", "since", F.when(F.col("looks") >= 3, F.col("peak")).alias("peak"),
                    F.when(F.col("looks") >= 3, F.col("last.ndvi")).alias("latest"),
                    F.col("last.date").alias("latest_date"),
                    F.greatest(F.lit(0), F.datediff(today, F.col("last.date"))).alias("stale_days")))


def curve_points(readings: DataFrame, key: str = "field_id", step: int = CURVE_STEP_DAYS) -> DataFrame:
    """Readings interpolated onto a regular grid from each field's first clear look.

    Every pair of neighbouring looks fills the grid days it spans, so no search is needed.
    """
    w = W.partitionBy(key)
    start, looks = F.min("date").over(w), F.count("*").over(w)
    rows = clear_steps(readings, key).withColumns({"t0": start, "looks": looks}).where("looks >= 3")
    x1, x0 = F.datediff("date", "t0"), F.datediff("prev_date", "t0")
    segs = rows.where(F.col("prev_date").isNotNull()).select(
        key, x0.alias("x0"), x1.alias("x1"), F.col("prev_ndvi").alias("y0"), F.col("ndvi").alias("y1"))
    low = F.when(F.col("x0") == 0, 0).otherwise(F.floor(F.col("x0") / step) + 1).cast("int")
    high = F.floor(F.col("x1") / step).cast("int")
    return (segs.where(low <= high).withColumn("i", F.explode(F.sequence(low, high)))
            .select(key, "i", (F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("i") * step - F.col("x0"))
                               / (F.col("x1") - F.col("x0"))).alias("v")))


def field_looks(readings: DataFrame, key: str = "field_id") -> DataFrame:
    """(key, x, y): a field's clear looks in order of date, days since the first and greenness.

    One row a field with three clear looks or more, bounded by the season's dates. Its curve is
    interpolated where it is needed and never stored: it has many more points than looks.
    """
    spark = readings.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    looks = (readings.where(F.col("ndvi").isNotNull()).repartition(parts, key).groupBy(key)
             .agg(F.sort_array(F.collect_list(F.struct("date", "ndvi"))).alias("l")).where(F.size("l") >= 3)
             .select(key, F.filter("l", lambda p: p["date"].isNotNull()).alias("l")).where(F.size("l") >= 2))
    return cut_lineage(looks.select(key, F.transform("l", lambda p: F.datediff(p["date"], F.col("l")[0]["date"])).alias("x"),
                                    F.col("l.ndvi").cast("array<double>").alias("y")))


#: Fields whose curves are worked out at once in a task.
CURVES_AT_ONCE = 256
#: Fields looked at to say where a reference's median may lie; every field is counted.
SAMPLED_FIELDS = 40_000


def _points_of(batch: pa.RecordBatch, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, i, v) of the curve points of a batch's fields, as `curve_points` has them."""
    lengths = batch.column("x").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    y = batch.column("y").flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.flatnonzero(row[1:] == row[:-1]) + 1
    x0, x1, y0, rise = x[at - 1], x[at], y[at - 1], y[at] - y[at - 1]
    low, high = np.where(x0 == 0, 0, x0 // step + 1), x1 // step
    many = np.maximum(high - low + 1, 0)
    k = np.repeat(np.arange(len(at)), many)
    i = np.arange(len(k)) - np.repeat(np.cumsum(many) - many, many) + low[k]
    return row[at][k], i, y0[k] + rise[k] * (i * step - x0[k]) / (x1 - x0)[k]


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, CURVES_AT_ONCE):
            yield batch.slice(start, CURVES_AT_ONCE)


def _brackets(crop: str, step: int):
    """Per crop the values between which the median of a position lies by the sampled curves, none where there are few."""
    def work(sample: pa.Table) -> pa.Table:
        parts = [_points_of(part, step) for batch in sample.combine_chunks().to_batches() for part in _sliced(iter([batch]))]
        i, v = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
        order = np.lexsort((v, i))
        i, v = i[order], v[order]
        at, first, m = np.unique(i, return_index=True, return_counts=True)
        margin = 2.25 * np.sqrt(m)                          # four and a half deviations of a sample's median
        low, high = np.floor(m / 2 - margin).astype(np.int64) - 1, np.ceil(m / 2 + margin).astype(np.int64) + 1
        least = np.where(low >= 0, v[first + np.clip(low, 0, m - 1)], -np.inf)
        most = np.where(high < m, v[first + np.clip(high, 0, m - 1)], np.inf)
        return pa.table({"crop": pa.array([sample.column(crop)[0].as_py()] * len(at)), "i": at.astype(np.int32), "lo": least, "hi": most})
    return work


def reference_curves(looks: DataFrame, labels: DataFrame, key: str = "field_id",
                     min_curves: int = 3, step: int = CURVE_STEP_DAYS) -> DataFrame:
    """Position-wise median curve of each crop's labelled fields, three curves at least.

    A sample of the fields says between which values a position's median lies. All curves are then
    counted: only values between them leave their task, of the lesser ones how many there are. A median that does
    not lie there is looked for among all values of its position in a second pass, so the result is exact.
    Crop kinds and positions are few, so tables of them are held by every task.
    """
    named = cut_lineage(looks.join(labels.select(key, "crop"), key).where(F.col("crop").isNotNull()))
    kinds = named.groupBy("crop").agg(F.count_distinct(key).alias("curves"), F.count("*").alias("n"), F.max(F.element_at("x", -1)).alias("last")).collect()
    total, width = sum(k["n"] for k in kinds), max((k["last"] // step + 1 for k in kinds), default=1)
    crops = sorted(k["crop"] for k in kinds if k["curves"] >= min_curves)
    lo, hi = np.full((len(crops), width), -np.inf), np.full((len(crops), width), np.inf)
    which = {c: n for n, c in enumerate(crops)}
    if total > SAMPLED_FIELDS:
        sample = named.where(F.pmod(F.xxhash64(key), F.lit(-(-total // SAMPLED_FIELDS))) == 0)
        for r in sample.groupBy("crop").applyInArrow(_brackets("crop", step), "crop string, i int, lo double, hi double").collect():
            if r["crop"] in which:
                lo[which[r["crop"]], r["i"]], hi[which[r["crop"]], r["i"]] = r["lo"], r["hi"]
    wanted, found = np.ones((len(crops), width), bool), None
    while crops and wanted.any():
        now = cut_lineage(_ranked(named, crops, lo, hi, wanted, step))
        lost = now.where(F.col("a").isNull() | F.col("b").isNull()).select("c", "i").collect()
        good = now.where(F.col("a").isNotNull() & F.col("b").isNotNull())
        found = good if found is None else found.unionByName(good)
        wanted = np.zeros_like(wanted)
        for r in lost:
            wanted[r["c"], r["i"]], lo[r["c"], r["i"]], hi[r["c"], r["i"]] = True, -np.inf, np.inf
    names = F.array(*map(F.lit, crops))
    if found is None:
        return looks.sparkSession.createDataFrame([], "crop string, i int, v double")
    return found.select(F.get(names, F.col("c")).alias("crop"), "i", ((F.col("a") + F.col("b")) / 2).alias("v"))


def _ranked(named: DataFrame, crops: list[str], lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray, step: int) -> DataFrame:
    """(c, i, a, b): the two middle values of each wanted crop and position; null where outside lo to hi."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        which = {c: n for n, c in enumerate(crops)}
        below, n = np.zeros(lo.shape, np.int64), np.zeros(lo.shape, np.int64)
        for part in _sliced(batches):
            kind = np.array([which.get(c, -1) for c in part.column("crop").to_pylist()], np.int64)
            row, i, v = _points_of(part, step)
            c = kind[row]
            kept = c >= 0
            kept[kept] = wanted[c[kept], i[kept]]
            c, i, v = c[kept], i[kept], v[kept]
            under = v < lo[c, i]
            flat = c * lo.shape[1] + i
            below += np.bincount(flat[under], minlength=lo.size).reshape(lo.shape)
            n += np.bincount(flat, minlength=lo.size).reshape(lo.shape)
            near = ~under & ~(v > hi[c, i])                  # not a number stays here, the greatest of all
            yield pa.record_batch([pa.array(c[near].astype(np.int32)), pa.array(i[near].astype(np.int32)), pa.array(v[near]),
                                   pa.nulls(int(near.sum()), pa.int64()), pa.nulls(int(near.sum()), pa.int64())], ["c", "i", "v", "below", "n"])
        c, i = np.nonzero(n)
        yield pa.record_batch([pa.array(c.astype(np.int32)), pa.array(i.astype(np.int32)), pa.nulls(len(c), pa.float64()),
                               pa.array(below[c, i]), pa.array(n[c, i])], ["c", "i", "v", "below", "n"])
    rows = named.select("crop", "x", "y").mapInArrow(work, "c int, i int, v double, below long, n long")
    whole = W.partitionBy("c", "i")
    rank = F.count("v").over(whole.orderBy("v").rowsBetween(W.unboundedPreceding, 0)) + F.sum("below").over(whole) - 1
    ranked = rows.withColumns({"rank": rank, "total": F.sum("n").over(whole)}).where(F.col("v").isNotNull() | F.col("n").isNotNull())
    at = lambda r: F.max(F.when(F.col("v").isNotNull() & (F.col("rank") == r), F.col("v")))
    return ranked.groupBy("c", "i").agg(at(F.floor((F.col("total") - 1) / 2)).alias("a"), at(F.floor(F.col("total") / 2)).alias("b"))


def best_shifts(looks: DataFrame, references: DataFrame, key: str = "field_id", step: int = CURVE_STEP_DAYS) -> DataFrame:
    """Smallest penalised distance of every field's curve to every reference over shifts.

    The references are few (crop kinds times positions of a season), so every task holds them with all their shifts
    side by side. Products of matrices give all distances of some fields at once, with a bound of their rounding; those that may be the
    least of their crop are then summed point by point. Four common positions at least.
    """
    span = MAX_SHIFT_DAYS // CURVE_STEP_DAYS
    shifts = np.arange(-span, span + 1)
    rows = references.collect()
    crops = sorted({r["crop"] for r in rows})
    width = max((r["i"] for r in rows), default=0) + span + 1
    ref = np.full((len(crops), len(shifts), width), np.nan)
    has = np.zeros(ref.shape, bool)
    for r in rows:
        for k, s in enumerate(shifts):
            if r["i"] + s >= 0 and r["v"] is not None:
                ref[crops.index(r["crop"]), k, r["i"] + s], has[crops.index(r["crop"]), k, r["i"] + s] = r["v"], True
    ref, has = ref.reshape(-1, width), has.reshape(-1, width)
    penalty = np.tile([1.0 + SHIFT_PENALTY * abs(int(s) * CURVE_STEP_DAYS) / MAX_SHIFT_DAYS for s in shifts], len(crops))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = has.astype(float).T
        zeroed = np.where(has, ref, 0.0)
        for part in _sliced(batches):
            row, i, v = _points_of(part, step)
            near = i < width
            row, i, v = row[near], i[near], v[near]
            curve, seen = np.zeros((part.num_rows, width)), np.zeros((part.num_rows, width), bool)
            curve[row, i], seen[row, i] = v, True
            with np.errstate(all="ignore"):
                n, square = seen.astype(float) @ held, (curve * curve) @ held
                own = seen.astype(float) @ (zeroed * zeroed).T
                apart, slack = square - 2.0 * (curve @ zeroed.T) + own, 1e-11 * (square + own)
                least, most = (np.where(n >= 4, np.sqrt(np.maximum(a, 0.0) / n) * penalty, np.inf) for a in (apart - slack, apart + slack))
                ceiling = np.fmin.reduce(most.reshape(len(most), len(crops), -1), axis=2)
                maybe = (n >= 4) & ~(least > np.repeat(ceiling, len(shifts), axis=1))
            f, k = np.nonzero(maybe)
            exact, order = np.full(maybe.shape, np.nan), np.full(maybe.shape, np.inf)
            for at in range(0, len(f), 2048):
                a, b = f[at:at + 2048], k[at:at + 2048]
                gap = np.where(seen[a] & has[b], curve[a] - zeroed[b], 0.0)
                exact[a, b] = np.sqrt(np.einsum("ij,ij->i", gap, gap) / n[a, b]) * penalty[b]
            order[f, k] = np.where(np.isnan(exact[f, k]), np.finfo(float).max, exact[f, k])
            order = order.reshape(len(order), len(crops), -1)
            f, c = np.nonzero(np.isfinite(order).any(axis=2))
            s = order.argmin(axis=2)[f, c]
            yield pa.record_batch([part.column(key).take(pa.array(f)), pa.array([crops[x] for x in c], pa.string()),
                                   pa.array(exact[f, c * len(shifts) + s]), pa.array((shifts[s] * CURVE_STEP_DAYS).astype(np.int32))],
                                  [key, "crop", "rmse", "shift_days"])
    schema = StructType([looks.schema[key], StructField("crop", StringType()), StructField("rmse", DoubleType()), StructField("shift_days", IntegerType())])
    if not crops:
        return looks.sparkSession.createDataFrame([], schema)
    return looks.select(key, "x", "y").mapInArrow(work, schema)


def classify(fits: DataFrame, prior: DataFrame, key: str = "field_id",
             temperature: float = 0.06) -> DataFrame:
    """Curve likelihood times rotation prior, with refusals: one row per field and crop.

    prior(field, crop, p); a crop without one gets 0.02. `verdict` is set only on the
    winning crop, and only when it leads by 0.15 and fits within 0.12.
    """
    w = W.partitionBy(key)
    p = F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(0.02))
    like = F.exp(-F.col("rmse") / temperature)
    rows = (fits.join(prior, [key, "crop"], "left").withColumn("like", like)
            .withColumn("post", F.col("like") * F.pow(p, F.lit(PRIOR_WEIGHT)))
            .withColumn("confidence", F.col("post") / F.sum("post").over(w))
            .withColumn("curve_only", F.col("like") / F.sum("like").over(w))
            .withColumn("crops", F.count("*").over(w)))
    order = W.partitionBy(key).orderBy(F.col("confidence").desc(), "crop")
    ranked = rows.withColumns({"rank": F.row_number().over(order),
                               "runner_up": F.lead("confidence").over(order)})
    why = (F.when(F.col("crops") < 2, "too few references")
           .when(F.col("confidence") - F.col("runner_up") < 0.15, "too close to call")
           .when(F.col("rmse") > 0.12, "no good match"))
    first = F.col("rank") == 1
    return ranked.select(key, "crop", "rank", "rmse", "shift_days", "confidence", "curve_only",
                         F.when(first & why.isNull(), F.col("crop")).alias("verdict"),
                         F.when(first, why).alias("why"))


def rotation_prior(history: DataFrame, key: str = "field_id") -> DataFrame:
    """What a field's crop history says about this year: (field, crop, p).

    history(field, year, crop) has one row per year, so windows are bounded by the years.
    """
    known = history.where(F.col("crop").isNotNull())
    w = W.partitionBy(key).orderBy("year")
    whole = W.partitionBy(key)
    rows = known.withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(whole)})
    row_crop = F.col("crop").isin("corn", "soybeans")
    last = rows.where(F.col("i") == F.col("n") - 1).select(key, F.col("crop").alias("last"))
    back = W.partitionBy(key).orderBy(F.col("year").desc())
    four = known.where(row_crop).withColumns({
        "back": F.row_number().over(back), "older": F.lead("crop").over(back)}).where(F.col("back") <= 4)
    same = (F.col("back") < F.col("kept")) & (F.col("crop") == F.col("older"))
    alternating = four.withColumn("kept", F.count("*").over(whole)).groupBy(key).agg(
        ((F.count("*") >= 3) & (F.count_if(same) == 0)).alias("alternates"))
    weight = F.pow(F.lit(1.5), F.col("i")) * F.when(F.col("i") == F.col("n") - 1, 0.4).otherwise(1.0)
    scored = rows.select(key, "crop", weight.alias("score"))
    persistent = last.where(F.col("last").isin(PERSISTENT_CROPS)).select(
        key, F.col("last").alias("crop"), F.lit(6.0).alias("score"))
    turn = (last.join(alternating.where("alternates"), key).where(F.col("last").isin("corn", "soybeans")))
    other = F.when(F.col("last") == "corn", "soybeans").otherwise("corn")
    bonus = turn.select(key, F.explode(F.array(
        F.struct(other.alias("crop"), F.lit(8.0).alias("score")),
        F.struct(F.col("last").alias("crop"), F.lit(1.5).alias("score")))).alias("b")).select(key, "b.*")
    total = (scored.unionByName(persistent).unionByName(bonus).groupBy(key, "crop")
             .agg(F.sum("score").alias("score")))
    return total.select(key, "crop", (F.col("score") / F.sum("score").over(whole)).alias("p"))


def crop_guess(category: Column) -> Column:
    """Land-cover category text to a crop kind: that of the first known word in it."""
    known = F.array(*[F.struct(F.lit(word).alias("word"), F.lit(kind).alias("kind")) for word, kind in CROP_WORDS])
    return F.get(F.filter(known, lambda k: F.contains(F.lower(category), k["word"])), F.lit(0))["kind"]


def zonal_ndvi(pixels: DataFrame, fields: DataFrame, step: float = 0.01) -> DataFrame:
    """Per field and scene: clear, clouded and missing pixels and the median greenness.

    pixels(scene, lat, lng, red, nir, klass); under MIN_CLEAR_PIXELS clear ones is null.
    """
    rings = fields.select("field_id", F.array("ring").alias("rings"))
    hit = points_in_polygons(pixels, rings, step)
    missing = F.col("red").isNull() | F.col("nir").isNull() | F.col("klass").isNull()
    clouded = ~missing & (F.col("klass").isin(UNUSABLE_SCENE_CLASSES) | (F.col("nir") + F.col("red") == 0))
    clear = ~missing & ~clouded
    ndvi = (F.col("nir") - F.col("red")) / F.when(F.col("nir") + F.col("red") != 0, F.col("nir") + F.col("red"))
    tagged = hit.select("field_id", "scene", missing.alias("missing"), clouded.alias("clouded"),
                        clear.alias("clear"), F.when(clear, ndvi).alias("ndvi"))
    # a scene holds each pixel once, so a group is bounded by the field's area
    counts = tagged.groupBy("field_id", "scene").agg(
        *[F.count_if(c).alias(c) for c in ("clear", "clouded", "missing")], F.median("ndvi").alias("ndvi"))
    covered = F.col("clear") + F.col("clouded")
    return (counts.withColumn("ndvi", F.when(F.col("clear") >= MIN_CLEAR_PIXELS, F.col("ndvi")))
            .withColumn("clear_fraction", F.when(covered > 0, F.col("clear") / covered).otherwise(0.0)))


def reference_radius(targets: DataFrame, labelled: DataFrame,
                     radii: list[float] = SEARCH_RADII_M, need: int = MIN_REFERENCE_FIELDS) -> DataFrame:
    """Per target site: the least radius holding enough corn and soybean fields, or the widest.

    Fields are counted by cells, whole ones without looking at their fields; labelled points at
    one coordinate count together.
    """
    spots = targets.select("lat", "lng").where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).distinct()
    refs = cut_lineage(sites(labelled.where(F.col("crop").isin("corn", "soybeans")), "field_id", "crop").select("lat", "lng", "crop", "at_site"))
    found = None
    for r in radii:
        here = counts_within(spots, refs, r, "at_site", ["crop"]).withColumn("radius", F.lit(r))
        found = here if found is None else found.unionByName(here)
    many = lambda crop, r: F.coalesce(F.sum(F.when((F.col("crop") == crop) & (F.col("radius") == r), F.col("n"))), F.lit(0))
    counts = found.groupBy(F.col("lat").alias("s_lat"), F.col("lng").alias("s_lng")).agg(*[
        F.struct(F.lit(r).alias("radius"), many("corn", r).alias("corn"),
                 many("soybeans", r).alias("soybeans")).alias(f"r{i}") for i, r in enumerate(radii)])
    rungs = F.array(*[F.col(f"r{i}") for i in range(len(radii))])
    good = F.filter(rungs, lambda x: (x["corn"] >= need) & (x["soybeans"] >= need))
    pick = F.when(F.size(good) > 0, good[0]).otherwise(rungs[len(radii) - 1])
    out = counts.select(F.col("s_lat").alias("lat"), F.col("s_lng").alias("lng"), pick.alias("p"),
                        (F.size(good) > 0).alias("enough")).select("lat", "lng", "p.*", "enough")
    return targets.join(out, ["lat", "lng"], "left")


def class_mix(classes: DataFrame, *by: str) -> DataFrame:
    """Share of each land class, whole percent."""
    counts = classes.where(F.col("category").isNotNull()).groupBy(*by, "category").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(*by)) if by else None
    if by:
        return counts.withColumn("pct", half_up(100.0 * F.col("n") / total))
    whole = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(whole)).select("category", "n", half_up(
        100.0 * F.col("n") / F.col("total")).alias("pct"))


def disagreements(fields: DataFrame, scans: DataFrame, key: str = "field_id") -> DataFrame:
    """Where a field's record and its scan tell different stories; agreeing fields vanish."""
    cut = F.col("cut_date").isNotNull()
    notes = F.array_compact(F.array(
        F.when(F.col("verdict").isNotNull() & (F.col("verdict") != F.col("crop")), F.concat(
            F.lit("recorded as "), "crop", F.lit(", looks like "), "verdict")),
        F.when((F.col("state") == "cut") & ~cut, F.concat(F.lit("looks cut since "), F.col("since").cast("string"))),
        F.when(cut & (F.col("state") == "standing"), F.lit("recorded as cut, still standing"))))
    return fields.join(scans, key).select(key, notes.alias("notes")).where(F.size("notes") > 0)


def tile_with_most_scenes(scenes: DataFrame, key: str = "field_id") -> DataFrame:
    """Keep each field's scenes from the imagery tile that has most of them."""
    counts = scenes.groupBy(key, "tile").agg(F.count("*").alias("n"))
    best = counts.groupBy(key).agg(F.max_by("tile", F.struct(F.col("n"), F.col("tile"))).alias("tile"))
    return scenes.join(best.hint("merge"), [key, "tile"], "left_semi")


def fields_due(fields: DataFrame, scans: DataFrame, now: Column, ttl_days: int) -> DataFrame:
    """Fields whose scan is missing or older than the limit, in the growing months only."""
    stale = F.col("scanned_at").isNull() | (
        F.unix_micros("scanned_at") < F.unix_micros(now) - ttl_days * 86_400_000_000)
    return (fields.join(scans.select("field_id", "scanned_at"), "field_id", "left")
            .where(stale & F.month(now).between(4, 11)))


def thin_scenes(scenes: DataFrame, keep: int, key: str = "field_id") -> DataFrame:
    """About `keep` scenes per field, evenly spread, the clearest near each even mark.

    scenes(field, scene_id, date, cloud). A mark wants the clearest of the scenes around it, then the
    nearest; a scene wanted by several goes to the earliest mark and the others take their next best.
    So marks choose in order, from at most five scenes each: a field's choice is one small array
    however many scenes it has, and no rows are joined. Fields of no more scenes keep them all.
    """
    by_date = W.partitionBy(key).orderBy("date", "scene_id")
    placed = (scenes.select(key, "scene_id", "date", F.coalesce("cloud", F.lit(100.0)).alias("cloud"))
              .withColumns({"j": F.row_number().over(by_date) - 1, "n": F.count("*").over(W.partitionBy(key))}))
    j, n = F.col("j"), F.col("n")
    mark = lambda k: (n - 1) * (k / float(keep - 1))
    near = lambda x: F.least(F.greatest(x, F.lit(0)), F.lit(keep - 1)).cast("int")
    step = F.lit(float(keep - 1)) / F.greatest(n - 1, F.lit(1))
    marks = F.filter(F.sequence(near(F.floor((j - 3) * step)), near(F.ceil((j + 3) * step))),
                     lambda k: (j >= F.floor(mark(k)) - 1) & (j <= F.ceil(mark(k)) + 1))
    asks = F.transform(marks, lambda k: F.struct(k.alias("k"), "cloud", F.abs(j - mark(k)).alias("gap"), "j", "scene_id"))
    rows = placed.select(key, "scene_id", F.when(n > keep, asks).alias("asks"))
    few = rows.where(F.col("asks").isNull()).select(key, "scene_id")
    wishes = rows.where(F.col("asks").isNotNull()).select(key, F.explode("asks").alias("ask")).groupBy(key).agg(F.sort_array(F.collect_list("ask")).alias("asks"))
    scene = placed.select(F.struct("j", "scene_id").alias("s")).schema["s"].dataType
    none = F.struct(F.lit(-1).alias("k"), F.array().cast(ArrayType(scene)).alias("taken"))

    def choose(held, ask):
        """Wishes come by mark, best first: a mark not served yet takes a scene not taken yet."""
        took = F.struct(ask["j"].alias("j"), ask["scene_id"].alias("scene_id"))
        return F.when((ask["k"] > held["k"]) & ~F.exists(held["taken"], lambda x: x["j"] == ask["j"]), F.struct(
            ask["k"].alias("k"), F.concat(held["taken"], F.array(took)).alias("taken"))).otherwise(held)
    chosen = wishes.select(key, F.explode(F.aggregate("asks", none, choose)["taken"]).alias("s")).select(key, "s.scene_id")
    return few.unionByName(chosen)
