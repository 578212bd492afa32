"""Spatial and iterative operators against brute force."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlens.operators import grounds, iterate, raster, routes, spatial

R = 6371000.0


def metres(a, b):
    h = (math.sin(math.radians(b[0] - a[0]) / 2) ** 2
         + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2)
    return 2 * R * math.asin(min(1.0, math.sqrt(h)))


def points(spark, rows, key="id"):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(rows)], f"{key} bigint, lat double, lng double")


@pytest.mark.parametrize("centre", [(44.0, -90.0), (0.0, 0.0), (-33.0, 179.999), (89.97, 10.0), (-89.99, -170.0), (60.0, -180.0)])
def test_near_pairs_is_complete_anywhere_on_earth(spark, centre):
    rng = random.Random(str(centre))
    wide = 0.05 / max(0.02, math.cos(math.radians(centre[0])))
    def spot():
        lng = centre[1] + rng.uniform(-wide, wide)
        return (max(-90.0, min(90.0, centre[0] + rng.uniform(-0.05, 0.05))), (lng + 540) % 360 - 180)
    left, right = [spot() for _ in range(60)], [spot() for _ in range(60)]
    got = [(r.a, r.b) for r in spatial.near_pairs(points(spark, left, "a"), points(spark, right, "b"), 2000.0, ["a"], ["b"]).collect()]
    want = {(i, j) for (i, p), (j, q) in itertools.product(enumerate(left), enumerate(right)) if metres(p, q) <= 2000}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_nearest_k_and_any(spark):
    rng = random.Random(4)
    left = [(44 + rng.random() * 0.1, -90 + rng.random() * 0.1) for _ in range(30)]
    right = [(44 + rng.random() * 0.1, -90 + rng.random() * 0.1) for _ in range(20)] * 2
    a, b = points(spark, left, "a"), points(spark, right, "b")
    got = {r.a: r.b for r in spatial.nearest(a, b, "a", "b", 3000.0).collect()}
    far = {r.a: r.b for r in spatial.nearest_any(a, b, "b", 50.0).collect()}
    three = {}
    for r in spatial.k_nearest(a, b, "b", 3, 3000.0, []).join(a, ["lat", "lng"]).collect():
        three.setdefault(r.a, {})[r["rank"]] = r.b
    for i, p in enumerate(left):
        order = sorted((round(metres(p, q), 6), j) for j, q in enumerate(right))
        assert far[i] == order[0][1]
        assert got[i] == (order[0][1] if order[0][0] <= 3000 else None)
        assert three.get(i, {}) == {k + 1: j for k, (d, j) in enumerate(order[:3]) if d <= 3000}


def test_nearby_counts_copies_once_each(spark):
    a = points(spark, [(44.0, -90.0)] * 3, "a")
    b = points(spark, [(44.001, -90.0)] * 4 + [(45.0, -90.0)], "b")
    assert {(r.a, r.nearby, r.b) for r in spatial.nearby_summary(a, b, "b", 400.0).collect()} == {(i, 4, 0) for i in range(3)}


def union_find(n, edges):
    root = list(range(n))
    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_connected_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(60, 100), rng.randrange(60, 100)) for _ in range(30)] + [(55, 55)]
    got = {r.id: r.component for r in iterate.connected_components(
        spark.range(100), spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert [got[i] for i in range(100)] == union_find(100, edges)


def test_connected_components_around_a_hub(spark):
    edges = [(500, i) for i in range(300)]
    got = iterate.connected_components(spark.range(501), spark.createDataFrame(edges, "src bigint, dst bigint"))
    assert {r.component for r in got.where("id < 300 OR id = 500").collect()} == {0}


def test_clusters_equal_single_linkage(spark):
    rng = random.Random(12)
    pts = []
    for _ in range(25):
        c = (44 + rng.random() * 0.4, -90 + rng.random() * 0.4)
        pts += [(c[0] + rng.gauss(0, 0.006), c[1] + rng.gauss(0, 0.006)) for _ in range(8)]
    pts += [(45.0, -91.0), (45.0 + 2000 / R * 180 / math.pi * 0.99999, -91.0), (45.0 + 2001 / R * 180 / math.pi + 1.0, -91.0)]
    edges = [(i, j) for i, j in itertools.combinations(range(len(pts)), 2) if metres(pts[i], pts[j]) <= 2000]
    want = union_find(len(pts), edges)
    got = {r.id: r.ground_id for r in grounds.cluster_pins(points(spark, pts), "id").collect()}
    assert [got[i] for i in range(len(pts))] == want


def test_first_come_locations_equal_a_sequential_pass(spark):
    rng = random.Random(8)
    pts = [(44 + rng.random() * 0.08, -90 + rng.random() * 0.08) for _ in range(80)]
    held, want = [], []
    for i, p in enumerate(pts):
        q = (math.floor(p[0] * 1e4 + 0.5) / 1e4, math.floor(p[1] * 1e4 + 0.5) / 1e4)
        near = min(((metres(q, h), o) for o, h in held if metres(q, h) <= 2000), default=None)
        if near is None:
            held.append((i, q))
        want.append(i if near is None else near[1])
    got = {r.id: r.loc_order for r in grounds.leader_locations(points(spark, pts), "id").collect()}
    assert [got[i] for i in range(80)] == want


def test_accumulation_along_a_forest(spark):
    rng = random.Random(10)
    nxt = [None if i == 0 or rng.random() < 0.05 else rng.randrange(max(0, i - 3), i) for i in range(200)]
    want = [0] * 200
    for i in range(200):
        j = i
        while j is not None:
            want[j] += i + 1
            j = nxt[j]
    df = spark.createDataFrame([(1, i, n, i + 1) for i, n in enumerate(nxt)], "g int, id bigint, next bigint, v bigint")
    got = {r.id: r.v for r in iterate.accumulate_downstream(df, ["g"], "v", "sum").collect()}
    assert [got[i] for i in range(200)] == want


# ---- terrain ----------------------------------------------------------------------------

def grid(spark, z, spacing=10.0):
    rows, cols = z.shape
    cells = spark.createDataFrame([(1, c, r, None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(rows) for c in range(cols)],
                                  "grid_id int, c int, r int, z double")
    info = spark.createDataFrame([(1, -90.0, 44.0, 0.0001, 0.0001, cols, rows, spacing)],
                                 "grid_id int, west double, south double, d_lng double, d_lat double, cols int, rows int, spacing_m double")
    return cells, info


def test_plane_slope_and_aspect(spark):
    r, c = np.mgrid[0:6, 0:7]
    cells, info = grid(spark, 100.0 + c * 10.0)                       # rises to the east, so it faces west
    got = raster.slope_aspect(cells, info).where("slope IS NOT NULL").collect()
    assert len(got) == 4 * 5
    assert all(x.slope == pytest.approx(45) and x.aspect == pytest.approx(270) for x in got)
    flat = raster.slope_aspect(grid(spark, np.full((4, 4), 5.0))[0], info).where("slope IS NOT NULL").collect()
    assert all(x.slope == 0 and x.aspect is None for x in flat)


def rough(seed, n=16):
    rng = np.random.default_rng(seed)
    r, c = np.mgrid[0:n, 0:n]
    z = np.abs(c - n // 2) * 2.0 + r * 0.7 + rng.uniform(0, 1.2, (n, n))
    z[2, 3] = np.nan
    return z


DIRS = [(1, 0, 1), (-1, 0, 1), (0, 1, 1), (0, -1, 1), (1, 1, 2 ** .5), (1, -1, 2 ** .5), (-1, 1, 2 ** .5), (-1, -1, 2 ** .5)]


def flow_of(z):
    n, to, acc = z.shape[0], {}, {}
    for r, c in itertools.product(range(n), range(n)):
        if np.isnan(z[r, c]):
            continue
        best, drop = None, 0.0
        for dc, dr, d in DIRS:
            y, x = r + dr, c + dc
            if 0 <= y < n and 0 <= x < n and not np.isnan(z[y, x]) and (z[r, c] - z[y, x]) / d > drop:
                best, drop = (y, x), (z[r, c] - z[y, x]) / d
        to[(r, c)], acc[(r, c)] = best, 1
    for cell in sorted(to, key=lambda k: -z[k]):
        if to[cell]:
            acc[to[cell]] += acc[cell]
    return to, acc


def smooth(z):
    out = np.full_like(z, np.nan)
    for r, c in itertools.product(*map(range, z.shape)):
        if not np.isnan(z[r, c]):
            out[r, c] = np.nanmean(z[max(0, r - 1):r + 2, max(0, c - 1):c + 2])
    return out


def trace(z, min_cells=6, min_drop=1 / 3.280839895):
    s = smooth(z)
    to, acc = flow_of(s)
    on = {k for k in acc if acc[k] >= max(8, z.size * 0.01)}
    fed = {to[k] for k in on if to[k] in on}
    seen, out = set(), set()
    for cell in sorted(on):
        if cell in fed or cell in seen:
            continue
        path, cur = [], cell
        while cur in on and cur not in seen:
            seen.add(cur)
            path.append(cur)
            cur = to[cur]
        if cur in on:
            path.append(cur)
        drop = abs(s[path[0]] - s[path[-1]])
        if len(path) >= min_cells and drop >= min_drop:
            out.add((cell, len(path), acc[path[-1]]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_channels_equal_sequential_tracing(spark, seed):
    z = rough(seed)
    cells, info = grid(spark, z)
    got = {((r["head"] >> 32, r["head"] & 0xFFFFFFFF), r.path_cells, r.drains) for r in raster.channels(cells, info).collect()}
    assert got == trace(z) and got


def test_saddle_is_found_once(spark):
    r, c = np.mgrid[0:15, 0:15]
    cells, info = grid(spark, 100 + ((c - 7.0) ** 2 - (r - 7.0) ** 2) * 0.5)
    got = raster.saddles(cells, info).collect()
    assert got and all(abs(x.c - 7) <= 5 and abs(x.r - 7) <= 5 for x in got)
    for a, b in itertools.combinations(got, 2):
        assert abs(a.c - b.c) >= 6 or abs(a.r - b.r) >= 6
    plane = raster.saddles(grid(spark, 100 + c * 2.0)[0], info)
    assert plane.count() == 0


def test_bench_on_a_slope(spark):
    r, c = np.mgrid[0:20, 0:20]
    z = np.where(r < 8, r * 4.0, np.where(r < 11, 32.0, (r - 10) * 4.0 + 32.0))
    cells, info = grid(spark, z)
    got = raster.benches(raster.slope_aspect(cells, info), info).collect()
    assert got and all(8 <= x.r <= 10 for x in got)


def test_contour_of_a_cone_is_one_closed_line_per_level(spark):
    r, c = np.mgrid[0:21, 0:21]
    cells, info = grid(spark, 50.0 - np.hypot(r - 10.1, c - 9.9) * 1.37)
    steps = raster.contour_steps(cells)
    lines = raster.contour_lines(raster.contour_segments(cells, steps))
    ends = lines.select("line_id", F.explode(F.array("a", "b")).alias("p")).groupBy(
        "line_id", F.round("p.x", 7), F.round("p.y", 7)).count()
    per = lines.groupBy("level").agg(F.countDistinct("line_id").alias("n")).collect()
    inner = [x for x in per if x.level > 50.0 - 9 * 1.37]
    assert inner and all(x.n == 1 for x in inner)
    closed = ends.join(lines.where(F.col("level") > 50.0 - 9 * 1.37).select("line_id").distinct(), "line_id")
    assert closed.where("count != 2").count() == 0


def test_flat_ground_has_no_contours(spark):
    cells, _ = grid(spark, np.full((5, 5), 3.0))
    assert raster.contour_steps(cells).count() == 0


# ---- routes -----------------------------------------------------------------------------

def test_unknown_wind_is_not_clean(spark):
    line = F.array(*[F.struct(F.lit(-90.0).alias("lng"), F.lit(44.0 - 0.0005 * i).alias("lat")) for i in (3, 2, 1)])
    walks = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "route_id bigint, stand_id bigint").withColumn("points", line)
    target = spark.createDataFrame([(1, 44.0, -90.0), (9, 44.0, -90.0015)], "target_id bigint, lat double, lng double")
    winds = spark.createDataFrame([(1, 180.0), (2, 0.0), (3, None)], "route_id bigint, wind_from_deg double")
    near = routes.points_near_targets(walks, target)
    got = {r.route_id: r.ok for r in routes.assess_routes(walks, routes.scent_hits(near, winds), winds).collect()}
    assert got == {1: False, 2: True, 3: None}


def test_neighbours_across_tile_borders(spark, monkeypatch):
    monkeypatch.setattr(raster, "TILE", 5)
    draw = random.Random(8)
    known = {(g, c, r): draw.random() for g in (1, 2) for c in range(13) for r in range(11) if draw.random() < 0.8}
    cells = spark.createDataFrame([(g, c, r, known.get((g, c, r))) for g in (1, 2) for c in range(13) for r in range(11)], "grid_id bigint, c int, r int, z double")
    pairs = [(-3, 1), (0, 0), (2, -2), (0, 3)]
    got = {tuple(x)[:3]: tuple(x)[3:] for x in raster.neighbours(cells, pairs).collect()}
    want = {}
    for g, c, r in itertools.product((1, 2), range(13), range(11)):         # every cell, known or not, with its own value first
        want[g, c, r] = (known.get((g, c, r)), *(known.get((g, c + dc, r + dr)) for dc, dr in pairs))
    assert got == want
    smooth = {tuple(x)[:3]: x.z for x in raster.smoothed(cells).collect()}
    for (g, c, r), z in smooth.items():
        near = [known[k] for dc in (-1, 0, 1) for dr in (-1, 0, 1) if (k := (g, c + dc, r + dr)) in known]
        assert (z is None) == ((g, c, r) not in known) and (z is None or abs(z - sum(near) / len(near)) < 1e-12)


def test_contours_reach_the_top_of_great_relief(spark):
    cells = spark.createDataFrame([(1, c, r, 200.0 * (c + r)) for c in range(11) for r in range(11)], "grid_id bigint, c int, r int, z double")
    steps = raster.contour_steps(cells)
    step = steps.first().step_ft
    assert step == 500
    levels = sorted({round(x.level * 3.280839895 / step) for x in raster.contour_segments(cells, steps).select("level").collect()})
    assert levels[-1] == int(4000 * 3.280839895 // step) and levels == list(range(levels[0], levels[-1] + 1))


# ---- polygons by cells ------------------------------------------------------------------

def even_odd(rings, lat, lng):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            odd ^= ((ay > lat) != (by > lat)) and lng < (bx - ax) * (lat - ay) / (by - ay) + ax
    return odd


def odd_shapes():
    """Rings on cell borders, with holes, islands, slivers, spikes, repeated corners, and one far wider than a cell."""
    rng = random.Random(9)
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    star = [(5 + (2.5 if k % 2 else 0.4) * math.cos(k * math.pi / 9), 5 + (2.5 if k % 2 else 0.4) * math.sin(k * math.pi / 9)) for k in range(18)]
    comb = [(0.0, 0.0)] + [p for k in range(12) for p in ((k * 0.5, 3.0), (k * 0.5 + 0.25, 0.1))] + [(6.0, 0.0)]
    wild = [(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(40)]
    return [[box(0, 0, 1, 1)], [box(0, 0, 8, 8), box(2, 2, 3, 3)], [box(1, 1, 6, 6), box(2, 2, 4, 4), box(3, 3, 2, 2)], [star], [comb], [wild],
            [box(2, 2, 5, 0.001)], [[(1, 1), (4, 1), (4, 1), (4, 4), (1, 1)]], [[(0, 0), (9, 0), (9, 5), (4.5, 5), (4.5, 9), (0, 9)]], [[(1, 1), (2, 2)]], [[]], [],
            [box(0.25, 0.25, 0.1, 0.1), box(9.5, 9.5, 0.4, 0.4)], [[(-3, -3), (13, -3), (5, 13)]]]


@pytest.mark.parametrize("step", [0.25, 1.0, 40.0])
def test_points_in_polygons_equal_testing_every_edge(spark, step):
    rng = random.Random(10)
    shapes = odd_shapes()
    spots = [(rng.uniform(-4, 14), rng.uniform(-4, 14)) for _ in range(500)]
    spots += [(x * 0.5, y * 0.5) for x in range(-2, 20) for y in range(-2, 20)]                 # on corners, borders and cell edges
    spots += [(x * 0.25 + rng.choice([0, 1e-12, -1e-12]), rng.choice([0.1, 1.0, 2.0, 3.0, 5.0]) + rng.choice([0, 1e-12, -1e-12])) for x in range(40)]
    spots += [p for rings in shapes for ring in rings for p in ring]
    pts = spark.createDataFrame([(i, float(y), float(x)) for i, (x, y) in enumerate(spots)], "i int, lat double, lng double")
    struct = [(k, [[(float(x), float(y)) for x, y in ring] for ring in rings], f"n{k}") for k, rings in enumerate(shapes)] + [(99, None, None)]
    polygons = spark.createDataFrame(struct, "k int, rings array<array<struct<lng:double,lat:double>>>, name string")
    got = [(r.i, r.k) for r in spatial.points_in_polygons(pts, polygons, step).collect()]
    want = {(i, k) for i, (x, y) in enumerate(spots) for k, rings in enumerate(shapes) if even_odd(rings, y, x)}
    assert len(got) == len(set(got)) and set(got) == want


def test_cells_inside_a_polygon_hold_no_edges(spark):
    """Edges stay with the cells they touch: their number follows the outline, not the area or the points."""
    ring = [(5 + 5 * math.cos(k * math.pi / 100), 5 + 5 * math.sin(k * math.pi / 100)) for k in range(200)]
    polygons = spark.createDataFrame([(1, [ring])], "k int, rings array<array<struct<lng:double,lat:double>>>")
    cells = spatial.polygon_cells(polygons, 0.1).selectExpr("near is null as whole", "coalesce(size(near), 0) as n").collect()
    assert sum(r.whole for r in cells) > 7000 and max(r.n for r in cells) <= 4 and sum(r.n for r in cells) < 900


# ---- thinning by tiles ------------------------------------------------------------------

def greedy(spots, apart):
    kept = set()
    for r, c in sorted((r, c) for c, r in spots):
        if not any(abs(c - kc) < apart and abs(r - kr) < apart for kc, kr in kept):
            kept.add((c, r))
    return kept


@pytest.mark.parametrize("tile,apart", [(7, 4), (16, 6), (16, 16), (512, 8)])
def test_thinning_equals_one_pass_in_cell_order(spark, tile, apart):
    rng = random.Random(tile)
    spots = {1: {(rng.randrange(60), rng.randrange(60)) for _ in range(900)}, 2: {(c, r) for c in range(40) for r in range(30)}, 3: {(c, 5) for c in range(150)},
             4: {(c, c // 3 + 2) for c in range(90)} | {(80 - c, c) for c in range(80)}, 5: set()}
    df = spark.createDataFrame([(g, c, r, float(c)) for g, found in spots.items() for c, r in found], "grid_id bigint, c int, r int, v double")
    got = raster.spaced(df, apart, tile).collect()
    assert len(got) == len(set(got)) and all(r.v == r.c for r in got)
    assert {g: {(r.c, r.r) for r in got if r.grid_id == g} for g in spots} == {g: greedy(found, apart) for g, found in spots.items()}


def test_thinning_rounds_follow_tiles_not_cells(spark, monkeypatch):
    """A flat strip 1,500 cells wide: a chain of 250 kept cells across 12 tiles."""
    rounds = []
    whole = raster.cut_lineage
    monkeypatch.setattr(raster, "cut_lineage", lambda df: rounds.append(1) or whole(df))
    strip = spark.range(1500).selectExpr("1 as grid_id", "cast(id as int) as c", "3 as r")
    assert {r.c for r in raster.spaced(strip, 6, 128).collect()} == set(range(0, 1500, 6))
    assert len(rounds) <= 2 * 12 + 1


# ---- counts in a circle -----------------------------------------------------------------

@pytest.mark.parametrize("centre,radius", [((44.0, -90.0), 2000.0), ((0.0, 0.0), 10_000.0), ((-33.0, 179.999), 5000.0), ((89.97, 10.0), 10_000.0), ((-89.999, 50.0), 2000.0),
                                           ((60.0, -180.0), 10_000.0), ((71.0, 20.0), 300_000.0)])
def test_counts_within_equal_measuring_every_pair(spark, centre, radius):
    rng = random.Random(str(centre))
    tall = 1.6 * radius / 111_000
    wide = min(179.0, tall / max(1e-6, math.cos(math.radians(centre[0]))))
    def spot():
        return max(-90.0, min(90.0, centre[0] + rng.uniform(-tall, tall))), (centre[1] + rng.uniform(-wide, wide) + 540) % 360 - 180
    targets, places = [spot() for _ in range(12)], [spot() for _ in range(1500)]
    places += targets[:3] + [places[0]] * 2 + [(centre[0], centre[1])]
    kinds = ["corn", "oats"]
    pts = spark.createDataFrame([(*p, k % 3 + 1, kinds[k % 2]) for k, p in enumerate(places)] + [(None, 1.0, 5, "corn")], "lat double, lng double, w int, kind string")
    left = spark.createDataFrame(targets + targets[:2] + [(None, 0.0)], "lat double, lng double")
    got = {(r.lat, r.lng, r.kind): r.n for r in spatial.counts_within(left, pts, radius, "w", ["kind"]).collect()}
    want = {}
    for t in targets:
        for k, p in enumerate(places):
            if metres(t, p) <= radius:
                key = (*t, kinds[k % 2])
                want[key] = want.get(key, 0) + k % 3 + 1
    assert got == want and want


def test_counts_within_look_at_few_points(spark):
    """Of 40,000 points inside the circle the plan measures those near its line; the rest are summed by cells."""
    from fieldlens.functions import geo
    points_ = spark.range(40_000).selectExpr("44 + (id % 200 - 100) * 0.0004 as lat", "-90 + (floor(id / 200) - 100) * 0.0006 as lng", "1 as w").cache()
    target = spark.createDataFrame([(44.0, -90.0)], "lat double, lng double")
    out = spatial.counts_within(target, points_, 6000.0, "w", [])
    n = out.first()["n"]
    want = points_.where(geo.haversine_m(F.lit(44.0), F.lit(-90.0), F.col("lat"), F.col("lng")) <= 6000.0).count()
    assert n == want and want > 30_000
    seen = joined_rows(out)
    assert seen and max(seen) < 0.35 * want


def joined_rows(df):
    """Rows each join of a run of df gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    out, todo = [], [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
        if "Join" in node.nodeName():
            metric = node.metrics().get("numOutputRows")
            out.append(metric.get().value())
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return out


# ---- contour lines in order -------------------------------------------------------------

def test_pieces_of_contour_lines_follow_each_other(spark):
    """Every line is walked once from end to end: closed rings, lines cut off by the edge, several levels and grids."""
    rng = random.Random(3)
    hills = {1: lambda c, r: 30 - math.hypot(c - 9, r - 8), 2: lambda c, r: 3 * math.sin(c / 2.3) + 2 * math.cos(r / 1.7) + 0.01 * rng.random(), 3: lambda c, r: c * 1.03 + 0.2}
    cells = spark.createDataFrame([(g, c, r, float(f(c, r))) for g, f in hills.items() for c in range(20) for r in range(18)], "grid_id bigint, c int, r int, z double")
    segments = raster.contour_segments(cells, raster.contour_steps(cells))
    rows = raster.contour_lines(segments).collect()
    assert len(rows) == segments.count()
    by_line = {}
    for x in rows:
        a, b = ((round(p.x, 6), round(p.y, 6)) for p in ((x.b, x.a) if x.turned else (x.a, x.b)))
        by_line.setdefault(x.line_id, []).append((x.position, a, b, x.grid_id, x.level))
    closed = 0
    for line in by_line.values():
        line.sort()
        assert [p[0] for p in line] == list(range(1, len(line) + 1)) and len({p[3:] for p in line}) == 1
        assert all(one[2] == other[1] for one, other in zip(line, line[1:]))
        closed += line[0][1] == line[-1][2]
    assert 0 < closed < len(by_line)


def test_contour_rounds_carry_longs_and_walk_once(spark, monkeypatch):
    """Before, texts of some fifty characters went through all rounds and the chains were walked twice."""
    cells = spark.createDataFrame([(1, c, r, 30 - math.hypot(c - 9.0, r - 8.0)) for c in range(80) for r in range(18)], "grid_id bigint, c int, r int, z double")
    walked, real = [], raster.accumulate_downstream
    monkeypatch.setattr(raster, "accumulate_downstream", lambda nodes, *rest: (walked.append(nodes.schema["id"].dataType.typeName()), real(nodes, *rest))[1])
    segments = raster.contour_segments(cells, raster.contour_steps(cells))
    rows = raster.contour_lines(segments).collect()
    assert walked == ["long"] and len(rows) == segments.count()
    places = {}
    for x in rows:
        places.setdefault(x.line_id, []).append(x.position)
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())


def test_stars_need_no_rounds(spark, monkeypatch):
    """What is a star already is told from one count of neighbours; before, two rounds of joins found nothing to change."""
    from fieldlens.operators import iterate
    written, real = [], iterate.cut_lineage
    monkeypatch.setattr(iterate, "cut_lineage", lambda df: (written.append(1), real(df))[1])
    nodes = spark.range(30)
    edges = nodes.where("id % 10 > 0").select(F.col("id").alias("src"), (F.col("id") - F.col("id") % 10).alias("dst"))
    got = {r.id: r.component for r in iterate.connected_components(nodes, edges).collect()}
    assert got == {i: i - i % 10 for i in range(30)} and len(written) == 1
    chain = nodes.where("id > 0").select(F.col("id").alias("src"), (F.col("id") - 1).alias("dst"))
    assert {r.component for r in iterate.connected_components(nodes, chain).collect()} == {0}
    local = iterate.local_stars(chain.withColumn("block", F.col("src") % 3), ["block"])
    assert {r.component for r in iterate.connected_components(nodes, local).collect()} == {0}


def test_equal_wishes_meet_the_grids_once(spark, monkeypatch):
    """Twelve hundred wishes at four places: the pairs are those of four, and every wish has its answer."""
    from fieldlens.sources import grids as stored
    boxes = spark.createDataFrame([(1, 5, 0.0, 0.0, 1.0, 1.0), (2, 10, 0.0, 0.0, 1.0, 1.0), (3, 5, 2.0, 2.0, 2.2, 2.2), (4, 20, 4.0, 4.0, 5.0, 5.0)],
                                  "grid_id int, spacing_m int, west double, south double, east double, north double")
    at = {0: (0.5, 1), 1: (2.1, 3), 2: (2.15, None), 3: (4.5, None)}
    wanted = spark.createDataFrame([(n, at[n % 4][0], at[n % 4][0], at[n % 4][0] + 0.1, at[n % 4][0] + 0.1, 10) for n in range(1200)] + [(-1, None, 0.5, 0.6, 0.6, 10)],
                                   "want_id int, west double, south double, east double, north double, spacing_m int")
    met, real = [], stored.points_in_boxes
    monkeypatch.setattr(stored, "points_in_boxes", lambda points, *rest: (met.append(points.count()), real(points, *rest))[1])
    out = stored.grid_covering(wanted, boxes)
    assert {r.want_id: r.grid_id for r in out.collect()} == {n: at[n % 4][1] for n in range(1200)} | {-1: None}
    assert met == [4]


def test_polygons_are_dealt_before_they_become_cells(spark):
    """Edges and cells are made after the shuffle, grouped once, and no side of the join goes whole to a task."""
    ring = F.array(*[F.struct(F.lit(x).alias("lng"), F.lit(y).alias("lat")) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))])
    polygons = spark.range(3).select(F.col("id").alias("k"), F.array(ring).alias("rings"))
    found = spatial.points_in_polygons(spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 0.5)], "i int, lat double, lng double"), polygons, 0.3)
    assert sorted((r.i, r.k) for r in found.collect()) == [(1, 0), (1, 1), (1, 2)]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert "RepartitionByExpression [_poly" in spatial.polygon_cells(polygons, 0.3)._jdf.queryExecution().optimizedPlan().toString()
