"""Ordered operators against plain sequential reference answers."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlens.operators import chunked, counters, crops, exposure, frames, gates, journal, orderstat, randomise, tracks
from fieldlens.operators.visits import assign_visits, carry_reviews, grouping_counts, visits

T0 = dt.datetime(2024, 1, 1)


def photos(spark, seconds_by_camera):
    rows = [(f"{c}-{i}", c, None if s is None else T0 + dt.timedelta(seconds=s))
            for c, seq in seconds_by_camera.items() for i, s in enumerate(seq)]
    return spark.createDataFrame(rows, "photo_id string, camera_id string, taken_at timestamp")


def test_three_hundred_seconds_merge_and_one_more_splits(spark):
    df = photos(spark, {"a": [0, 300, 601], "b": [299.5, 599.5]})
    got = {(r.camera_id, r.visit_no): r.photo_count for r in visits(df).collect()}
    assert got == {("a", 1): 2, ("a", 2): 1, ("b", 1): 2}


def test_visits_match_a_sequential_pass_and_count_undated(spark):
    rng = random.Random(3)
    data = {c: sorted(rng.uniform(0, 40000) for _ in range(120)) + [None] for c in "abc"}
    df = photos(spark, data)
    want = {}
    for c, seq in data.items():
        n, last = 0, None
        for s in (x for x in seq if x is not None):
            n += last is None or round((s - last) * 1e6) > 300_000_000
            last = s
        want[c] = n
    got = {r.camera_id: r["count"] for r in visits(df).groupBy("camera_id").count().collect()}
    assert got == want
    assert grouping_counts(df).first().asDict() == {"visits": sum(want.values()), "grouped": 360, "ungrouped": 3}
    assert assign_visits(df).where("visit_no IS NULL").count() == 3


def test_one_hot_camera_with_many_equal_instants(spark):
    df = photos(spark, {"hot": [5.0] * 500 + [400.0], "cold": [1.0]})
    assert {(r.camera_id, r.photo_count) for r in visits(df).collect()} == {("hot", 500), ("hot", 1), ("cold", 1)}


def test_reviews_survive_a_rebuild(spark):
    old = visits(photos(spark, {"a": [0, 100, 5000]})).withColumn(
        "reviewed_at", F.when(F.col("photo_count") == 2, F.lit(T0))).withColumn("notes", F.lit("seen"))
    new = visits(photos(spark, {"a": [0, 100, 350, 5000]}))
    got = {r.photo_count: r.reviewed_at for r in carry_reviews(new, old).collect()}
    assert got == {3: T0, 1: None}


def test_empty_input(spark):
    df = photos(spark, {"a": []})
    assert visits(df).count() == 0
    assert grouping_counts(df).first().asDict() == {"visits": 0, "grouped": 0, "ungrouped": 0}


def test_chunked_previous_and_sum_equal_plain_windows(spark):
    rng = random.Random(1)
    rows = [(k, i // 7, i, rng.randrange(100)) for k in ("x", "y") for i in range(60) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "k string, chunk int, pos int, v int")
    prev = {(r.k, r.pos): r.p for r in chunked.with_previous(df, ["k"], "chunk", ["pos"], {"v": "p"}).collect()}
    run = {(r.k, r.pos): r.s for r in chunked.with_running_sum(df, ["k"], "chunk", ["pos"], "v", "s").collect()}
    for k in ("x", "y"):
        last, total = None, 0
        for _, _, pos, v in (r for r in rows if r[0] == k):
            assert prev[(k, pos)] == last
            total, last = total + v, v
            assert run[(k, pos)] == total


def sequential_gaps(rows):
    """rows: sorted (t, n). Epochs on a drop over 100, earliest instant per counter, then holes."""
    epochs, last = [], None
    for t, n in rows:
        if last is None or n < last - 100:
            epochs.append({})
        epochs[-1].setdefault(n, t)
        last = n
    out = set()
    for i, e in enumerate(epochs):
        ns = sorted(e)
        out |= {(i, a, b, b - a - 1) for a, b in zip(ns, ns[1:]) if b - a > 1}
    return out


def test_counter_gaps_against_a_sequential_pass(spark):
    rng = random.Random(7)
    rows, n, t = [], 9000, 0
    for _ in range(400):
        t += rng.choice([30, 3000, 40000])
        n = rng.choice([n + 1, n + 1, n + 4, n - 3, n + 1, 5 if rng.random() < 0.03 else n + 1])
        rows.append((t, n))
    df = spark.createDataFrame([("c", T0 + dt.timedelta(seconds=t), n) for t, n in rows], "camera_id string, taken_at timestamp, n bigint")
    got = {(r.epoch, r.after_n, r.before_n, r.missing) for r in counters.counter_gaps(df).collect()}
    assert got == sequential_gaps(sorted(rows))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 101, 1000])
def test_order_statistics_are_exact(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.lognormal(size=n), 3).tolist() + [None]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    s = sorted(v for v in values if v is not None)
    assert orderstat.order_statistic(df, ["g"], "v").first()["stat"] == s[n // 2]
    assert orderstat.exact_median(df, ["g"], "v").first()["median"] == pytest.approx(float(np.median(s)), abs=1e-12)
    assert orderstat.nearest_rank(df, ["g"], "v", 0.95, "p").first()["p"] == s[int(np.floor(0.95 * (n - 1) + 0.5))]


@pytest.mark.parametrize("shape", ["spread", "copies", "two values", "skewed", "descending"])
def test_ranks_are_refined_until_few_values_are_left(spark, monkeypatch, shape):
    """Groups far above the bound, and some below it: never more than ORDERED values of a group are ordered."""
    monkeypatch.setattr(orderstat, "ORDERED", 40)
    monkeypatch.setattr(orderstat, "PARTS", 8)
    rng = np.random.default_rng(1)
    made = {"spread": lambda n: rng.normal(size=n), "copies": lambda n: np.round(rng.normal(size=n), 2), "two values": lambda n: np.r_[np.zeros(n // 2), np.ones(n - n // 2)],
            "skewed": lambda n: np.exp(5 * rng.normal(size=n)), "descending": lambda n: np.arange(n, 0, -1.0)}[shape]
    groups = {"a": made(9001), "b": made(6000), "c": made(41), "d": made(40), "e": made(7), "f": made(1)}
    df = spark.createDataFrame([(g, float(v)) for g, values in groups.items() for v in values] + [("a", None), ("none", None), (None, 1.0)], "g string, v double")
    left = []
    whole = orderstat._narrowed

    def watched(*a):
        out = whole(*a)
        left.append(out.groupBy(*a[1]).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0])
        return out
    monkeypatch.setattr(orderstat, "_narrowed", watched)
    ranked = {g: np.sort(v) for g, v in groups.items()}
    for few in (False, True):
        got = {r.g: (r.n, r.stat) for r in orderstat.order_statistic(df, ["g"], "v", few=few).collect()}
        assert got == {g: (len(v), v[len(v) // 2]) for g, v in ranked.items()}
    assert {r.g: r.median for r in orderstat.exact_median(df, ["g"], "v").collect()} == {g: (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2 for g, v in ranked.items()}
    assert {r.g: r.p for r in orderstat.nearest_rank(df, ["g"], "v", 0.05, "p").collect()} == {g: v[int(np.floor(0.05 * (len(v) - 1) + 0.5))] for g, v in ranked.items()}
    everything = np.sort(np.concatenate([*groups.values(), [1.0]]))
    assert orderstat.order_statistic(df, [], "v").first()["stat"] == everything[len(everything) // 2]
    assert left and max(left) <= 40
    assert orderstat.order_statistic(df.limit(0), ["g"], "v").collect() == []


def test_order_statistic_in_a_hot_group_of_copies(spark):
    df = spark.range(30000).select(F.lit("g").alias("g"), F.when(F.col("id") < 20000, 5.0).otherwise(F.col("id").cast("double")).alias("v"))
    assert orderstat.order_statistic(df, ["g"], "v").first()["stat"] == 5.0


def readings(spark, series):
    return spark.createDataFrame([(f, dt.date(2024, 5, 1) + dt.timedelta(days=d), v) for f, s in series.items() for d, v in s],
                                 "field_id string, date date, ndvi double")


def test_harvest_states(spark):
    series = {
        "standing": [(0, 0.3), (20, 0.8), (40, 0.7)], "cut": [(0, 0.3), (20, 0.8), (25, 0.75), (37, 0.2), (50, 0.2)],
        "slow": [(0, 0.3), (20, 0.8), (33, 0.3)], "senescing": [(0, 0.4), (20, 0.8), (40, 0.5)],
        "never": [(0, 0.2), (20, 0.3), (40, 0.2)], "thin": [(0, 0.8), (5, 0.1)],
        "cloud": [(0, 0.3), (20, 0.8), (25, None), (32, 0.2)],
        "edge": [(0, 0.3), (20, 0.55), (32, 0.35)],                # exactly at every threshold
    }
    got = {r.field_id: r.state for r in crops.harvest_states(readings(spark, series), F.lit("2024-12-01").cast("date")).collect()}
    assert got == {"standing": "standing", "cut": "cut", "slow": "cut-or-senesced", "senescing": "senescing", "never": "unknown",
                   "thin": "unknown", "cloud": "cut", "edge": "cut"}


def test_curve_points_interpolate_and_stop_at_the_last_look(spark):
    got = {r.i: r.v for r in crops.curve_points(readings(spark, {"f": [(0, 0.0), (6, 0.6), (10, 1.0)]})).collect()}
    assert got == pytest.approx({0: 0.0, 1: 0.4, 2: 0.8})
    assert crops.curve_points(readings(spark, {"f": [(0, 0.0), (6, 0.6)]})).count() == 0


def test_rotation_prior_alternation(spark):
    rows = [("f", 2018 + i, c) for i, c in enumerate(["corn", "soybeans", "corn", "soybeans"])]
    got = {r.crop: r.p for r in crops.rotation_prior(spark.createDataFrame(rows, "field_id string, year int, crop string")).collect()}
    corn = 8 + 1 + 1.5 ** 2
    soy = 1.5 + 1.5 + 1.5 ** 3 * 0.4
    assert got == pytest.approx({"corn": corn / (corn + soy), "soybeans": soy / (corn + soy)})


def test_thin_scenes_against_a_sequential_pick(spark):
    rng = random.Random(5)
    clouds = [rng.choice([0.0, 10.0, 10.0, 60.0]) for _ in range(40)]
    rows = [("f", i, dt.date(2024, 4, 1) + dt.timedelta(days=i), c) for i, c in enumerate(clouds)]
    df = spark.createDataFrame(rows + [("g", 900, dt.date(2024, 4, 1), 5.0)], "field_id string, scene_id bigint, date date, cloud double")
    taken = []
    for i in range(14):
        mark = 39 * (i / 13)
        near = [j for j in range(max(0, int(np.floor(mark)) - 1), min(40, int(np.ceil(mark)) + 2)) if j not in taken]
        if near:
            taken.append(min(near, key=lambda j: (clouds[j], abs(j - mark))))
    got = {f: sorted(r.scene_id for r in part) for f, part in _by(crops.thin_scenes(df, 14).collect(), "field_id")}
    assert got == {"f": sorted(taken), "g": [900]}


def _by(rows, name):
    keys = sorted({r[name] for r in rows})
    return [(k, [r for r in rows if r[name] == k]) for k in keys]


def burst(columns):
    """Hashes with a block of set bits at a column over ten rows."""
    out = []
    for col in columns:
        grid = [[1 if 4 <= r < 14 and col is not None and col <= c < col + 3 else 0 for c in range(16)] for r in range(16)]
        bits = "".join(str(b) for row in grid for b in row)
        out.append("d1:" + "".join(f"{int(bits[i:i + 4], 2):x}" for i in range(0, 256, 4)))
    return out


def frame_rows(spark, visits_):
    rows = [(v, f"{v}-{i}", T0 + dt.timedelta(minutes=40 * i), h) for v, hs in visits_.items() for i, h in enumerate(hs)]
    return spark.createDataFrame(rows, "visit_id string, photo_id string, taken_at timestamp, phash string")


def test_crossings_left_right_and_reasons(spark):
    df = frame_rows(spark, {"right": burst([0, 4, 8, 12]), "left": burst([12, 8, 4, 0]), "still": burst([None, 6, None, 6, None]),
                            "one": burst([3]), "two": burst([0, 9]), "bad": ["x", "y"]})
    got = {r.visit_id: (r.crossing, r.why) for r in frames.crossings(df).collect()}
    assert got["right"] == ("right", None) and got["left"] == ("left", None)
    assert got["still"] == (None, "did not cross") and got["one"] == (None, "single frame")
    assert got["two"] == (None, "no background") and got["bad"][0] is None


def test_empty_matches_twelve_bits_and_baseline_of_three(spark):
    base = [f"d1:{'0' * 60}{k:04x}" for k in (1, 2, 4)]
    near, far = "d1:" + "7ff8" + "0" * 60, "d1:" + "fff8" + "0" * 60        # 12 and 13 bits, plus one bit of the base
    shots = spark.createDataFrame([("a", "c", "d1:" + "7ff" + "0" * 57 + "0001"), ("b", "c", far), ("d", "few", base[0])],
                                  "photo_id string, camera_id string, phash string")
    b = spark.createDataFrame([("c", h) for h in base] + [("few", h) for h in base[:2]], "camera_id string, phash string")
    got = {r.photo_id: (r.bits, r.of) for r in frames.empty_matches(shots, b).collect()}
    assert got == {"a": (11, 3), "b": (None, None), "d": (None, None)}


def test_missing_day_is_unknown(spark):
    days = spark.createDataFrame([("c", dt.date(2024, 1, 1), "live"), ("c", dt.date(2024, 1, 3), "silent")], "camera_id string, day date, state string")
    span = spark.createDataFrame([("c", dt.date(2024, 1, 1), dt.date(2024, 1, 5))], "camera_id string, from_day date, to_day date")
    r = exposure.live_day_summary(days, span).first()
    assert (r.live, r.silent, r.unknown, r.span_days) == (1, 1, 3, 5)


# ---- statistics that must find a planted effect and must not invent one -------------------

def sits(spark, rows):
    return spark.createDataFrame(rows, "rating string, deer int, stand_id int")


def test_permutation_finds_a_planted_order_and_repeats(spark):
    names = journal.RATING_ORDER
    df = sits(spark, [(names[i % 5], i % 5 + (i // 5) % 2, 1) for i in range(60)])
    a, b = randomise.permutation_p(df, 1000).first(), randomise.permutation_p(df, 1000).first()
    assert a["p"] == b["p"] and 0 < a["p"] <= 0.01 and a["rho"] > 0.8


def test_permutation_does_not_invent_one(spark):
    rng = random.Random(11)
    df = sits(spark, [(rng.choice(journal.RATING_ORDER), rng.randrange(6), 1) for _ in range(200)])
    assert randomise.permutation_p(df, 1000).first()["p"] > 0.05


def test_calibration_refuses_thin_and_one_class_journals(spark):
    few = sits(spark, [("good", 1, 1)] * 11)
    assert journal.calibration(few).first()["verdict"] == "not enough sits"
    one_class = sits(spark, [("good", i % 4, 1) for i in range(20)] + [("fair", 1, 1)] * 2)
    assert journal.calibration(one_class).first()["verdict"] == "no comparison group"
    flat = sits(spark, [("good", 2, 1)] * 10 + [("fair", 2, 1)] * 10)
    assert journal.calibration(flat).first()["verdict"] == "no variation"
    uncounted = sits(spark, [("good", None, 1)] * 20)
    assert journal.calibration(uncounted).first()["uncounted"] == 20


def test_stratified_test_finds_a_shift_and_refuses_a_thin_pool(spark):
    pool = [("x", s, float(v % 100)) for s in ("day", "night") for v in range(400)] + [("thin", "day", 1.0)] * 5
    seen = [("x", "day", 95.0)] * 8 + [("x", "night", 90.0)] * 8 + [("thin", "day", 1.0)] * 4
    cols = "who string, stratum string, value double"
    got = {r.who: r for r in randomise.stratified_test(spark.createDataFrame(seen, cols), spark.createDataFrame(pool, cols), ["who"], 1000).collect()}
    assert got["x"].p < 0.01 and got["x"].expected == pytest.approx(49.5)
    assert got["thin"].p is None and not got["thin"].ok


# ---- tracks -----------------------------------------------------------------------------

def test_gates_and_simplification_against_a_sequential_walk(spark):
    rng = random.Random(2)
    rows, lat, t = [], 44.0, 0
    for i in range(120):
        t += 20_000
        lat += rng.choice([0.0, 0.00001, 0.0002, 0.0003])
        rows.append((1, i, float(t), lat + (0.5 if i % 17 == 5 else 0.0), -90.0 + rng.uniform(0, 0.0001), rng.choice([3.0, 8.0, 60.0])))
    df = spark.createDataFrame(rows, "track_id bigint, seq bigint, t_ms double, lat double, lng double, acc double")
    got = {r.seq: r.fate for r in tracks.gate_fixes(df).collect()}
    last = moved = None
    want = {}
    for _, s, tm, la, ln, acc in rows:
        if acc > 50:
            continue
        if last and gates.metres(last[1], last[2], la, ln) / ((tm - last[0]) / 1000) > 3:
            want[s] = "speed"
            continue
        last = (tm, la, ln)
        if moved is None or gates.metres(*moved, la, ln) >= max(4, 2 * acc):
            moved, want[s] = (la, ln), "kept"
        else:
            want[s] = "stationary"
    end = max(s for s, f in want.items() if f != "speed")
    want[end] = "kept"
    assert got == want

    kept = [(r[1], r[3], r[4]) for r in rows if want.get(r[1]) == "kept"]

    def dist(p, a, b):
        r = np.radians(a[1])
        ml, mg = 111132.92 - 559.82 * np.cos(2 * r), 111412.84 * np.cos(r) - 93.5 * np.cos(3 * r)
        x, y, bx, by = (p[2] - a[2]) * mg, (p[1] - a[1]) * ml, (b[2] - a[2]) * mg, (b[1] - a[1]) * ml
        k = min(1, max(0, (x * bx + y * by) / (bx * bx + by * by)))
        return np.hypot(x - k * bx, y - k * by)

    def recurse(lo, hi):
        far = max(range(lo + 1, hi), key=lambda i: dist(kept[i], kept[lo], kept[hi]), default=None)
        if far is None or dist(kept[far], kept[lo], kept[hi]) <= 4:
            return set()
        return {far} | recurse(lo, far) | recurse(far, hi)

    line = recurse(0, len(kept) - 1) | {0, len(kept) - 1}
    pts = spark.createDataFrame([(1, *k) for k in kept], "track_id bigint, seq bigint, lat double, lng double")
    eps = spark.createDataFrame([(1, 4.0)], "track_id bigint, eps double")
    for few in (1, 6, 100):                     # splits in rounds only, some rounds, finished at once
        assert {r.seq for r in tracks.simplify(pts, eps, few).collect()} == {kept[i][0] for i in line}


def sequential_gates(rows):
    """{(track, seq): fate} and each track's last state, one fix after the other."""
    states, fates = {}, {}
    for track, seq, t, lat, lng, acc in sorted(rows, key=lambda r: r[:2]):
        fates[track, seq], states[track] = gates.passed(states.get(track), t, lat, lng, acc)
    return fates, states


@pytest.mark.parametrize("chunk", [3, 10, 64, 1000])
def test_chunks_of_a_walk_agree_with_one_pass(spark, chunk):
    """Standing still for long, jumps at chunk borders and a walk that is too fast throughout: states meet late or never."""
    rng = random.Random(chunk)
    rows = []
    for track in range(1, 5):
        lat, t = 44.0, 0
        for i in range(300):
            t += rng.choice([0, 1000, 20_000])
            lat += {1: rng.choice([0.0, 0.00002, 0.0002]), 2: 0.0, 3: 0.01, 4: 0.00001}[track]
            wild = 0.5 if track == 1 and i % 17 in (5, 6) else 0.0
            rows.append((track, i * 3, None if i % 29 == 7 else float(t), lat + wild, -90.0 + rng.uniform(0, 0.00003), rng.choice([3.0, 8.0, 30.0])))
    good = spark.createDataFrame(rows, "track_id bigint, seq bigint, t_ms double, lat double, lng double, acc double")
    fates, last = gates.gated(good, chunk=chunk)
    want, states = sequential_gates(rows)
    assert {(r.track_id, r.seq): r.fate for r in fates.collect()} == want
    assert {r.track_id: tuple(r)[1:] for r in last.collect()} == states


def test_gates_of_no_fixes(spark):
    empty = spark.createDataFrame([], "track_id bigint, seq bigint, t_ms double, lat double, lng double, acc double")
    assert tracks.gate_fixes(empty).collect() == [] and tracks.build_tracks(empty).collect() == []


def test_track_quality(spark):
    rows = [(1, i, i * 20000.0, 44.0 + i * 0.0002, -90.0, 5.0) for i in range(12)] + [(2, i, i * 1000.0, 44.0, -90.0, 80.0) for i in range(6)]
    df = spark.createDataFrame(rows, "track_id bigint, seq bigint, t_ms double, lat double, lng double, acc double")
    got = {r.track_id: (r.quality, r.used, r.inaccurate) for r in tracks.build_tracks(df).collect()}
    assert got == {1: ("good", 2, 0), 2: ("unusable", 0, 6)}


# ---- hash bands -------------------------------------------------------------------------

def hashed(value):
    return f"d1:{value:064x}"


def test_constant_sky_does_not_raise_pairs(spark, monkeypatch):
    """Half the frames of a camera share a plain sky of 96 bits; every near hash is still met, and few others are."""
    rng = random.Random(12)
    sky = (1 << 96) - 1
    base = [rng.getrandbits(256) | (sky if k % 2 else 0) for k in range(400)]
    shots = [rng.getrandbits(256) | (sky if k % 2 else 0) for k in range(400)]
    for b in base[::5]:                             # some frames 0 to 14 bits from a scene
        near = b
        for bit in rng.sample(range(256), rng.randrange(15)):
            near ^= 1 << bit
        shots.append(near)
    left = spark.createDataFrame([("c", hashed(x)) for x in shots] + [("other", hashed(base[0]))], "camera_id string, f string")
    right = spark.createDataFrame([("c", hashed(x)) for x in base], "camera_id string, b string")
    orders = frames.bit_orders(right.withColumnRenamed("b", "phash")).cache()
    want = {(hashed(x), hashed(y)) for x in shots for y in base if (x ^ y).bit_count() <= 12}
    for hot in (1 << 14, 30, 2):                    # groups joined as they are, some divided, all divided to the end
        monkeypatch.setattr(frames, "HOT_PAIRS", hot)
        met = frames.candidate_pairs(left, right, orders).collect()
        assert {r.camera_id for r in met} == {"c"} and want <= {(r.f, r.b) for r in met}
        assert len(met) < 0.02 * len(shots) * len(base) + 13 * len(want)
    df = spark.createDataFrame([(k, "c", hashed(x)) for k, x in enumerate(shots)], "photo_id bigint, camera_id string, phash string")
    got = {r.photo_id: r.bits for r in frames.empty_matches(df, right.withColumnRenamed("b", "phash")).collect()}
    least = [min((x ^ y).bit_count() for y in base) for x in shots]
    assert got == {k: (n if n <= 12 else None) for k, n in enumerate(least)}


# ---- draws from urns of any size ---------------------------------------------------------

def test_draws_from_large_urns_follow_their_law():
    """Mean and spread of draws from urns of 3 * 10**9, and the step of ln gamma against its sum of logarithms."""
    rng = np.random.default_rng(5)
    for a, d in [(3e9, 7.0), (1e12, -2000.0), (150.0, 3.0)]:
        assert randomise._log_gamma_step(a, d) == pytest.approx(sum(math.log(a + i) for i in range(int(d))) if d > 0 else -sum(math.log(a - i) for i in range(1, int(-d) + 1)), rel=1e-12)
    for good, bad, draws in [(2 * 10**9, 10**9, 10**9), (40, 3 * 10**9, 10**9), (3 * 10**9, 25, 2 * 10**9), (10**9, 2 * 10**9, 30)]:
        got = np.array([randomise.hypergeometric(rng, good, bad, draws) for _ in range(4000)], float)
        n = good + bad
        mean, var = draws * good / n, draws * (good / n) * (bad / n) * (n - draws) / (n - 1)
        assert abs(got.mean() - mean) < 5 * math.sqrt(var / 4000) and abs(got.var() / var - 1) < 0.15
    took = randomise.multivariate(rng, np.array([10**9, 2 * 10**9, 5, 0]), 2 * 10**9)
    assert took.sum() == 2 * 10**9 and (took <= [10**9, 2 * 10**9, 5, 0]).all() and randomise.hypergeometric(rng, 3 * 10**9, 0, 7) == 7


def test_permutation_of_three_billion_sits(spark, monkeypatch):
    """Counts stand for the sits: 3 * 10**9 of them, with a link between rating and deer, and without."""
    def chance(more):
        rows = [(x, y, 10**8 + (more if x == y else 0)) for x in range(5) for y in range(6)]
        return randomise.permutation_p(spark.createDataFrame(rows, "x bigint, y bigint, m bigint"), 60).first()
    monkeypatch.setattr(randomise, "contingency", lambda sits: sits)
    assert chance(10**5)["p"] < 0.02
    even = chance(0)
    assert even is None or even["p"] > 0.02


# ---- crop curves ---------------------------------------------------------------------------------------------


def _season(spark, seed, fields=120):
    """Looks of fields with gaps and equal values, and their curves point by point."""
    rng = np.random.default_rng(seed)
    rows, curves = [], {}
    for f in range(fields):
        days = np.sort(rng.choice(200, int(rng.integers(3, 14)), replace=False))
        values = np.round(rng.integers(0, 11, len(days)) * 0.09, 6)
        rows += [(f, dt.date(2024, 4, 1) + dt.timedelta(days=int(d)), float(v)) for d, v in zip(days, values)]
        x = days - days[0]
        curves[f] = {0: values[0]}
        for i in range(1, int(x[-1]) // 4 + 1):
            k = int(np.searchsorted(x, i * 4))
            curves[f][i] = values[k - 1] + (values[k] - values[k - 1]) * (i * 4 - x[k - 1]) / (x[k] - x[k - 1])
    labels = [(f, ["corn", "oats", "clover"][f % 3]) for f in range(fields - 1)] + [(fields - 1, "pasture")]
    readings = spark.createDataFrame(rows + [(0, dt.date(2024, 3, 1), None)], "field_id long, date date, ndvi double")
    return readings, spark.createDataFrame(labels, "field_id long, crop string"), curves, labels


def _medians(curves, labels):
    held = {}
    for f, crop in labels:
        for i, v in curves[f].items():
            held.setdefault((crop, i), []).append(v)
    return {k: float(np.median(v)) for k, v in held.items() if k[0] != "pasture"}


@pytest.mark.parametrize("miss", [False, True])
def test_reference_curves_are_exact_medians_whatever_the_sample_says(spark, monkeypatch, miss):
    readings, labels, curves, known = _season(spark, 5)
    monkeypatch.setattr(crops, "SAMPLED_FIELDS", 40)
    if miss:                                                 # a sample that misleads: every bracket lies too high
        import pyarrow as pa
        real = crops._brackets
        monkeypatch.setattr(crops, "_brackets", lambda *a: lambda t: (lambda r: r.set_column(2, "lo", pa.array([0.85] * len(r))))(real(*a)(t)))
    got = {(r.crop, r.i): r.v for r in crops.reference_curves(crops.field_looks(readings), labels).collect()}
    want = _medians(curves, known)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_best_shifts_are_those_of_trying_all(spark):
    readings, labels, curves, known = _season(spark, 6)
    looks = crops.field_looks(readings)
    assert looks.count() == len(curves) and set(looks.columns) == {"field_id", "x", "y"}     # a row a field, not one a point
    refs = _medians(curves, known)
    refs |= {("own", i): v for i, v in curves[7].items()}                                    # a field's own curve: nothing apart
    got = {(r.field_id, r.crop): (r.rmse, r.shift_days) for r in crops.best_shifts(
        looks, spark.createDataFrame([(c, i, float(v)) for (c, i), v in refs.items()], "crop string, i int, v double")).collect()}
    want = {}
    for f, curve in curves.items():
        for crop in {c for c, _ in refs}:
            fits = []
            for s in range(-3, 4):
                gaps = [v - refs[crop, i - s] for i, v in curve.items() if (crop, i - s) in refs]
                if len(gaps) >= 4:
                    fits.append((float(np.sqrt(np.sum(np.square(gaps)) / len(gaps)) * (1 + 0.35 * abs(s * 4) / 12)), s * 4))
            if fits:
                want[f, crop] = min(fits)
    assert got.keys() == want.keys()
    assert all(got[k][0] == pytest.approx(want[k][0], abs=1e-12) for k in want)
    assert all(got[k][1] == want[k][1] for k in want) and got[7, "own"] == (0.0, 0)
