"""Joins whose sides grow are shuffled; what a task or the driver holds does not grow with the tables."""

import datetime as dt
import math
import random

from fieldlens.operators import crops, frames, routes, spatial


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_side_of_a_distance_join_is_broadcast(spark):
    left = spark.createDataFrame([(1, 44.0, -90.0), (2, 44.1, -90.0)], "a long, lat double, lng double")
    right = spark.createDataFrame([(7, 44.0005, -90.0), (8, 45.0, -90.0)], "b long, lat double, lng double")
    pairs = spatial.near_pairs(left, right, 200.0, ["a"], ["b"])
    assert "Broadcast" not in plan_of(pairs)
    assert [(r.a, r.b) for r in pairs.collect()] == [(1, 7)]


def test_points_near_targets_are_those_of_all_pairs(spark):
    walks = spark.createDataFrame([(1, 5, [(-90.0, 44.0), (-90.0, 44.001)]), (2, 6, [(179.9999, 0.0)])],
                                  "route_id long, stand_id long, points array<struct<lng:double,lat:double>>")
    targets = spark.createDataFrame([(5, 44.0015, -90.0), (6, 0.0, -179.9999)], "target_id long, lat double, lng double")
    got = {(r.route_id, r.pos, r.target_id, round(r.to_target)) for r in routes.points_near_targets(walks, targets).collect()}
    assert got == {(1, 0, 5, 0), (1, 1, 5, 0), (2, 0, 6, 90)}


def test_band_keys_are_made_once_a_hash(spark):
    """No expression a bit (before: conv of every digit once a bit of every band); keys agree just where the bits of a band do."""
    rng = random.Random(4)
    values = [rng.getrandbits(256) for _ in range(20)]
    values += [x ^ (1 << rng.randrange(256)) for x in values]
    order = list(range(256))
    rng.shuffle(order)
    rows = spark.createDataFrame([("c", f"d1:{x:064x}", 0, k % 2) for k, x in enumerate(values)], "camera_id string, h string, key long, p0 int")
    got = frames._banded(rows, spark.createDataFrame([("c", order)], "camera_id string, order array<int>"), 1)
    assert "conv(" not in plan_of(got)
    keys = {(r.h, r.p0, r.p1): r.key for r in got.collect()}
    assert len(keys) == len(values) * frames.BANDS
    parts = {}
    for k, x in enumerate(values):
        bits = [x >> (255 - p) & 1 for i, p in enumerate(order) if i % frames.BANDS != k % 2]
        for part in range(frames.BANDS):
            parts[f"d1:{x:064x}", k % 2, part] = (k % 2, part, tuple(bits[part::frames.BANDS]))
    for a in parts:
        for b in parts:
            if a[1:] == b[1:]:
                assert (keys[a] == keys[b]) == (parts[a] == parts[b])


def test_thin_scenes_needs_no_rounds_of_jobs(spark):
    """One plan without a join, whose rows are those of a pick mark by mark (before: jobs and joins round by round)."""
    rng = random.Random(6)
    clouds = {f: [rng.choice([0.0, 0.0, 10.0, None]) for _ in range(n)] for f, n in [("a", 15), ("b", 16), ("c", 29), ("d", 14), ("e", 200)]}
    rows = [(f, 7 if f == "c" else i, dt.date(2024, 1, 1) + dt.timedelta(days=i), c) for f, cs in clouds.items() for i, c in enumerate(cs)]
    out = crops.thin_scenes(spark.createDataFrame(rows, "field_id string, scene_id bigint, date date, cloud double"), 14)
    assert "Join" not in plan_of(out)
    want = []
    for f, cs in clouds.items():
        n, taken = len(cs), []
        for k in range(14 if n > 14 else 0):
            mark = (n - 1) * (k / 13.0)
            free = [j for j in range(max(0, math.floor(mark) - 1), min(n, math.ceil(mark) + 2)) if j not in taken]
            taken += [min(free, key=lambda j: (100.0 if cs[j] is None else cs[j], abs(j - mark), j))] if free else []
        want += [(f, 7 if f == "c" else j) for j in (taken if n > 14 else range(n))]
    assert sorted((r.field_id, r.scene_id) for r in out.collect()) == sorted(want)
