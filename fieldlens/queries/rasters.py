"""Terrain over the elevation patches."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

import fieldlens.queries.tables  # noqa: F401
from fieldlens.functions.num import round6
from fieldlens.operators import raster
from fieldlens.queries.registry import query, table_sql
from fieldlens.sources import grids as grid_source

table_sql("cell", """SELECT p_partkey // 400 AS grid_id, c, r, CASE WHEN p_partkey % 97 <> 0 THEN 200e0
    + ((CAST(c AS DOUBLE) - 10e0) * (CAST(c AS DOUBLE) - 10e0) - (CAST(r AS DOUBLE) - 9e0) * (CAST(r AS DOUBLE) - 9e0)) * 0.4e0
    + (CAST(c AS DOUBLE) - 10e0) * (CAST(r AS DOUBLE) - 9e0) * 0.15e0 + CAST(p_size AS DOUBLE) * 0.02e0 END AS z
  FROM (SELECT *, CAST(p_partkey % 400 % 20 AS INT) AS c, CAST(p_partkey % 400 // 20 AS INT) AS r FROM part)""")
N8 = "nw:-1:1 n:0:1 ne:1:1 w:-1:0 e:1:0 sw:-1:-1 s:0:-1 se:1:-1"
_COLS = ", ".join(f"max(CASE WHEN b.c = a.c + {dc} AND b.r = a.r + {dr} THEN b.z END) AS {n}"
                  for n, dc, dr in (x.split(":") for x in N8.split()))
table_sql("nine", f"""SELECT a.grid_id, a.c, a.r, any_value(a.z) AS z, {_COLS}, avg(b.z) AS mean FROM cell a JOIN cell b
  ON b.grid_id = a.grid_id AND b.c BETWEEN a.c - 1 AND a.c + 1 AND b.r BETWEEN a.r - 1 AND a.r + 1 GROUP BY 1, 2, 3""", ("cell",))
table_sql("grad", """SELECT grid_id, c, r, ((ne + 2 * e + se) - (nw + 2 * w + sw)) / (8 * 12e0) AS dx,
  ((nw + 2 * n + ne) - (sw + 2 * s + se)) / (8 * 12e0) AS dy FROM nine""", ("nine",))
table_sql("slope", """SELECT grid_id, c, r, degrees(atan(sqrt(dx * dx + dy * dy))) AS slope,
  CASE WHEN sqrt(dx * dx + dy * dy) >= 1e-9 THEN (degrees(atan2(-dx, -dy)) + 360) % 360 END AS aspect FROM grad""", ("grad",))


@query("terrain_slope_aspect", needs=("slope",), sql="""
SELECT grid_id, c, r, round(slope, 6) AS slope, round(aspect, 6) AS aspect FROM slope""")
def terrain_slope_aspect(b):
    return raster.slope_aspect(b.elevation_cells(), b.elevation_grids()).withColumns(
        {"slope": round6("slope"), "aspect": round6("aspect")})


@query("terrain_smoothed", needs=("nine",), sql="""
SELECT grid_id, c, r, round(CASE WHEN z IS NOT NULL THEN mean END, 6) AS z FROM nine""")
def terrain_smoothed(b):
    return raster.smoothed(b.elevation_cells()).withColumn("z", round6("z"))


@query("terrain_stats", needs=("cell",), sql="""
SELECT grid_id, count(*) AS count, round(min(z), 6) AS min, round(max(z), 6) AS max, round(avg(z), 6) AS mean, round(max(z) - min(z), 6) AS relief,
  round(list_sort(list(z))[CAST(floor(0.05e0 * (count(*) - 1) + 0.5) AS INT) + 1], 6) AS p5,
  round(list_sort(list(z))[CAST(floor(0.95e0 * (count(*) - 1) + 0.5) AS INT) + 1], 6) AS p95 FROM cell WHERE z IS NOT NULL GROUP BY 1""")
def terrain_stats(b):
    s = raster.grid_stats(b.elevation_cells())
    return s.select("grid_id", "count", *[round6(c).alias(c) for c in ("min", "max", "mean", "relief", "p5", "p95")])


@query("terrain_summary", needs=("cell", "slope"), sql="""
WITH h AS (SELECT grid_id, count(z) > 0 AS covered, min(z) * 3.280839895e0 AS lo, max(z) * 3.280839895e0 AS hi, (max(z) - min(z)) * 3.280839895e0 AS rel FROM cell GROUP BY 1),
s AS (SELECT grid_id, list_sort(list(slope) FILTER (WHERE slope IS NOT NULL))[CAST(floor(count(slope) / 2) AS INT) + 1] AS mid, max(slope) AS mx FROM slope GROUP BY 1)
SELECT h.grid_id, covered, floor(lo * 10 + 0.5) / 10 AS min_ft, floor(hi * 10 + 0.5) / 10 AS max_ft, floor(rel * 10 + 0.5) / 10 AS relief_ft,
  floor(mid * 10 + 0.5) / 10 AS median_slope, floor(mx * 10 + 0.5) / 10 AS max_slope, coalesce(mx >= 8, false) AS steep_enough FROM h JOIN s ON s.grid_id = h.grid_id""")
def terrain_summary(b):
    cells = b.elevation_cells()
    return raster.terrain_summary(cells, raster.slope_aspect(cells, b.elevation_grids()))


@query("terrain_hillshade", needs=("grad", "cell"), sql="""
WITH g AS (SELECT c.grid_id, c.c, c.r, n.dx * 1e0 AS dx0, n.dy AS dy0, q.zf FROM cell c JOIN (SELECT grid_id, CASE WHEN max(z) > min(z) THEN
    greatest(1e0, least(60e0, 0.15e0 * 19 * 12e0 / (max(z) - min(z)))) ELSE 1e0 END AS zf FROM cell GROUP BY 1) q ON q.grid_id = c.grid_id
  LEFT JOIN grad n ON n.grid_id = c.grid_id AND n.c = least(18, greatest(1, c.c)) AND n.r = least(18, greatest(1, c.r))),
v AS (SELECT grid_id, c, r, (-dx0 * zf * (sin(radians(315e0)) * cos(radians(45e0))) - dy0 * zf * (cos(radians(315e0)) * cos(radians(45e0))) + sin(radians(45e0)))
  / sqrt(dx0 * zf * dx0 * zf + dy0 * zf * dy0 * zf + 1) AS v FROM g)
SELECT grid_id, c, r, CASE WHEN v IS NOT NULL THEN CAST(floor(255 * greatest(0e0, v) + 0.5) AS BIGINT) END AS shade FROM v""")
def terrain_hillshade(b):
    return raster.hillshade(b.elevation_cells(), b.elevation_grids())


table_sql("flow", """SELECT grid_id, c, r, o.dc AS dc, o.dr AS dr FROM (SELECT a.grid_id, a.c, a.r, list_sort(list({'d': -(a.z - b.z) / CASE WHEN a.c <> b.c AND a.r <> b.r THEN sqrt(2e0) ELSE 1e0 END,
    'i': list_position([{'x': 1, 'y': 0}, {'x': -1, 'y': 0}, {'x': 0, 'y': 1}, {'x': 0, 'y': -1}, {'x': 1, 'y': 1}, {'x': 1, 'y': -1}, {'x': -1, 'y': 1}, {'x': -1, 'y': -1}], {'x': b.c - a.c, 'y': b.r - a.r}),
    'dc': b.c - a.c, 'dr': b.r - a.r}) FILTER (WHERE b.z < a.z))[1] AS o FROM cell a LEFT JOIN cell b ON b.grid_id = a.grid_id
    AND b.c BETWEEN a.c - 1 AND a.c + 1 AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.z IS NOT NULL WHERE a.z IS NOT NULL GROUP BY 1, 2, 3)""", ("cell",))


@query("terrain_flow_directions", needs=("flow",), sql="""
SELECT grid_id, c, r, CASE WHEN dc IS NOT NULL THEN CAST(r + dr AS BIGINT) * 4294967296 + c + dc END AS next FROM flow""")
def terrain_flow_directions(b):
    return raster.flow_directions(b.elevation_cells()).select("grid_id", "c", "r", "next")


def _accumulation_sql() -> str:
    from fieldlens.queries.registry import with_tables
    return with_tables(("flow",), """WITH f AS (SELECT grid_id, r * 1000 + c AS id, CASE WHEN dc IS NOT NULL THEN (r + dr) * 1000 + c + dc END AS nxt FROM flow),
w AS (SELECT grid_id, id AS start, id AS spot FROM f UNION ALL SELECT w.grid_id, w.start, f.nxt FROM w JOIN f ON f.grid_id = w.grid_id AND f.id = w.spot WHERE f.nxt IS NOT NULL)
SELECT grid_id, CAST(spot % 1000 AS INT) AS c, CAST(spot // 1000 AS INT) AS r, count(*) AS acc FROM w GROUP BY 1, 2, 3""").replace("WITH ", "WITH RECURSIVE ", 1)


@query("terrain_flow_accumulation", sql=_accumulation_sql())
def terrain_flow_accumulation(b):
    return raster.flow_accumulation(raster.flow_directions(b.elevation_cells())).select("grid_id", "c", "r", "acc")


@query("terrain_drainages")
def terrain_drainages(b):
    return raster.channels(b.elevation_cells(), b.elevation_grids())


def _channel_sql() -> str:
    from fieldlens.queries.registry import with_tables
    return with_tables(("flow",), """WITH f AS (SELECT grid_id, r * 4294967296 + c AS id, CASE WHEN dc IS NOT NULL THEN (r + dr) * 4294967296 + c + dc END AS nxt FROM flow),
w AS (SELECT grid_id, id AS start, id AS spot FROM f UNION ALL SELECT w.grid_id, w.start, f.nxt FROM w JOIN f ON f.grid_id = w.grid_id AND f.id = w.spot WHERE f.nxt IS NOT NULL),
acc AS (SELECT grid_id, spot AS id, count(*) AS acc FROM w GROUP BY 1, 2 HAVING count(*) >= 8),
ch AS (SELECT acc.grid_id, acc.id, acc.acc, k.id AS nxt FROM acc JOIN f ON f.grid_id = acc.grid_id AND f.id = acc.id LEFT JOIN acc k ON k.grid_id = acc.grid_id AND k.id = f.nxt),
hd AS (SELECT grid_id, id FROM ch WHERE NOT EXISTS (SELECT 1 FROM ch p WHERE p.grid_id = ch.grid_id AND p.nxt = ch.id)),
dn AS (SELECT grid_id, id AS head, id AS spot FROM hd UNION ALL SELECT dn.grid_id, dn.head, ch.nxt FROM dn JOIN ch ON ch.grid_id = dn.grid_id AND ch.id = dn.spot WHERE ch.nxt IS NOT NULL)
SELECT ch.grid_id, CAST(ch.id AS BIGINT) AS id, ch.acc, CAST(min(dn.head) AS BIGINT) AS head FROM ch JOIN dn ON dn.grid_id = ch.grid_id AND dn.spot = ch.id GROUP BY 1, 2, 3""").replace("WITH ", "WITH RECURSIVE ", 1)


@query("terrain_channel_cells", sql=_channel_sql())
def terrain_channel_cells(b):
    out = raster.channel_cells(b.elevation_cells(), b.elevation_grids(), smooth=False)
    return out.select("grid_id", "id", "acc", "head")


@query("terrain_ridges")
def terrain_ridges(b):
    return raster.channels(b.elevation_cells(), b.elevation_grids(), invert=True)


_RING = ", ".join(f"({i}, {math.floor(math.cos(i / 8 * math.pi) * 3 + 0.5)}, {math.floor(math.sin(i / 8 * math.pi) * 3 + 0.5)})" for i in range(16))
table_sql("saddle", f"""SELECT grid_id, c, r, floor(least(list_max(d), -list_min(d)) * 3.280839895e0 * 10 + 0.5) / 10 AS relief_ft
  FROM (SELECT a.grid_id, a.c, a.r, list(b.z - a.z ORDER BY o.i) AS d FROM cell a CROSS JOIN (VALUES {_RING}) o(i, dc, dr)
    JOIN cell b ON b.grid_id = a.grid_id AND b.c = a.c + o.dc AND b.r = a.r + o.dr
    WHERE a.z IS NOT NULL AND b.z IS NOT NULL AND a.c BETWEEN 3 AND 16 AND a.r BETWEEN 3 AND 16 GROUP BY 1, 2, 3 HAVING count(*) = 16)
  WHERE list_max(d) >= 1.5 AND -list_min(d) >= 1.5
    AND list_sum(list_transform(range(16), lambda i: CASE WHEN (d[i + 1] > 0) <> (d[(i + 1) % 16 + 1] > 0) THEN 1 ELSE 0 END)) = 4""", ("cell",))
table_sql("bench", """SELECT a.grid_id, a.c, a.r, floor(any_value(a.slope) * 10 + 0.5) / 10 AS slope_deg,
    CAST(floor(100e0 * count(*) FILTER (WHERE b.slope >= 8) / count(*) + 0.5) AS BIGINT) AS steep_around
  FROM slope a JOIN slope b ON b.grid_id = a.grid_id AND b.c BETWEEN a.c - 4 AND a.c + 4 AND b.r BETWEEN a.r - 4 AND a.r + 4
  WHERE a.slope <= 4 AND b.slope IS NOT NULL AND a.c BETWEEN 4 AND 15 AND a.r BETWEEN 4 AND 15 GROUP BY 1, 2, 3
  HAVING count(*) FILTER (WHERE b.slope >= 8) * 1e0 / count(*) >= 0.35""", ("slope",))


def _thinned(table: str, apart: int) -> str:
    """Greedy thinning one candidate after the other, by row, then column."""
    from fieldlens.queries.registry import with_tables
    return with_tables((table,), f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY r, c) AS k FROM {table}),
walk AS (SELECT grid_id, k, [{{'c': c, 'r': r}}] AS kept FROM o WHERE k = 1
  UNION ALL SELECT o.grid_id, o.k, CASE WHEN len(list_filter(walk.kept, lambda p: abs(p.c - o.c) < {apart} AND abs(p.r - o.r) < {apart})) = 0
    THEN list_append(walk.kept, {{'c': o.c, 'r': o.r}}) ELSE walk.kept END FROM walk JOIN o ON o.grid_id = walk.grid_id AND o.k = walk.k + 1),
last AS (SELECT grid_id, unnest(arg_max(kept, k)) AS p FROM walk GROUP BY 1)
SELECT o.* EXCLUDE (k) FROM o JOIN last ON last.grid_id = o.grid_id AND last.p.c = o.c AND last.p.r = o.r""").replace("WITH ", "WITH RECURSIVE ", 1)


@query("terrain_saddle_cells", needs=("saddle",), sql="SELECT * FROM saddle")
def terrain_saddle_cells(b):
    return raster.saddle_cells(b.elevation_cells(), b.elevation_grids())


@query("terrain_saddles", sql=_thinned("saddle", 6))
def terrain_saddles(b):
    return raster.saddles(b.elevation_cells(), b.elevation_grids())


@query("terrain_bench_cells", needs=("bench",), sql="SELECT * FROM bench")
def terrain_bench_cells(b):
    slopes = raster.slope_aspect(b.elevation_cells(), b.elevation_grids())
    return raster.bench_cells(slopes, b.elevation_grids())


@query("terrain_benches", sql=_thinned("bench", 8))
def terrain_benches(b):
    slopes = raster.slope_aspect(b.elevation_cells(), b.elevation_grids())
    return raster.benches(slopes, b.elevation_grids())


table_sql("cstep", """SELECT grid_id, lo, hi, list_filter([1, 2, 5, 10, 20, 40, 100, 200, 500, 1000, 2000, 5000, 10000, 20000, 50000, 100000], lambda x: x >= coalesce(
    list_filter([1, 2, 5, 10, 20, 40, 100], lambda y: y >= typ * 3.280839895e0 / 12)[1], 100) AND ceil((hi - lo) * 3.280839895e0 / x) <= 60)[1] AS step_ft
  FROM (SELECT grid_id, min(z) AS lo, max(z) AS hi, list_sort(list(z))[CAST(floor(0.95e0 * (count(*) - 1) + 0.5) AS INT) + 1]
    - list_sort(list(z))[CAST(floor(0.05e0 * (count(*) - 1) + 0.5) AS INT) + 1] AS typ FROM cell WHERE z IS NOT NULL GROUP BY 1)""", ("cell",))


@query("contour_intervals", needs=("cstep",), sql="SELECT grid_id, step_ft FROM cstep")
def contour_intervals(b):
    return raster.contour_steps(b.elevation_cells()).select("grid_id", "step_ft")


@query("contour_pieces_by_level", needs=("cstep", "cell"), sql="""
WITH q AS (SELECT a.grid_id, a.z AS z0, b.z AS z1, d.z AS z2, e.z AS z3 FROM cell a
  JOIN cell b ON b.grid_id = a.grid_id AND b.c = a.c + 1 AND b.r = a.r JOIN cell d ON d.grid_id = a.grid_id AND d.c = a.c + 1 AND d.r = a.r + 1
  JOIN cell e ON e.grid_id = a.grid_id AND e.c = a.c AND e.r = a.r + 1 WHERE a.z IS NOT NULL AND b.z IS NOT NULL AND d.z IS NOT NULL AND e.z IS NOT NULL),
l AS (SELECT grid_id, step_ft, hi, CAST(unnest(range(CAST(ceil(lo / (step_ft / 3.280839895e0)) AS BIGINT), CAST(floor(hi / (step_ft / 3.280839895e0)) AS BIGINT) + 2)) AS BIGINT) AS k FROM cstep),
m AS (SELECT grid_id, k, k * (step_ft / 3.280839895e0) AS lev FROM l WHERE k * (step_ft / 3.280839895e0) <= hi),
c AS (SELECT q.grid_id, m.k, (z0 > lev)::INT + 2 * (z1 > lev)::INT + 4 * (z2 > lev)::INT + 8 * (z3 > lev)::INT AS code FROM q JOIN m ON m.grid_id = q.grid_id)
SELECT grid_id, k, CAST(sum(CASE WHEN code IN (5, 10) THEN 2 ELSE 1 END) AS BIGINT) AS pieces FROM c WHERE code BETWEEN 1 AND 14 GROUP BY 1, 2""")
def contour_pieces_by_level(b):
    cells = b.elevation_cells()
    steps = raster.contour_steps(cells)
    segs = raster.contour_segments(cells, steps).join(steps.select("grid_id", "step_ft"), "grid_id")
    k = F.floor(F.col("level") * 3.280839895 / F.col("step_ft") + 0.5)
    return segs.groupBy("grid_id", k.alias("k")).agg(F.count("*").alias("pieces"))


@query("contour_lines")
def contour_lines(b):
    cells = b.elevation_cells()
    return raster.line_summary(raster.contour_lines(raster.contour_segments(cells, raster.contour_steps(cells))))


@query("contour_line_pieces")
def contour_line_pieces(b):
    """Every piece of every contour line with its place in the line."""
    cells = b.elevation_cells()
    lines = raster.contour_lines(raster.contour_segments(cells, raster.contour_steps(cells)))
    return lines.select("grid_id", round6("level").alias("level"), "line_id", "position", "turned", "c", "r", "piece")


@query("elevation_at_points", needs=("cell",), sql="""
WITH p AS (SELECT c_custkey AS point_id, g, (c_custkey % 230) / 12e0 AS fc, (c_custkey % 190) / 10e0 AS fr FROM (SELECT c_custkey,
    c_custkey % (SELECT max(grid_id) + 1 FROM cell) AS g FROM customer)),
q AS (SELECT point_id, g, fc, fr, floor(fc) AS c, floor(fr) AS r FROM p)
SELECT q.point_id, round(z0.z * (1 - (fc - q.c)) * (1 - (fr - q.r)) + z1.z * (fc - q.c) * (1 - (fr - q.r)) + z2.z * (1 - (fc - q.c)) * (fr - q.r) + z3.z * (fc - q.c) * (fr - q.r), 4) AS elevation
FROM q LEFT JOIN cell z0 ON z0.grid_id = g AND z0.c = q.c AND z0.r = q.r LEFT JOIN cell z1 ON z1.grid_id = g AND z1.c = q.c + 1 AND z1.r = q.r
LEFT JOIN cell z2 ON z2.grid_id = g AND z2.c = q.c AND z2.r = q.r + 1 LEFT JOIN cell z3 ON z3.grid_id = g AND z3.c = q.c + 1 AND z3.r = q.r + 1""")
def elevation_at_points(b):
    k = F.col("c_custkey")
    count = b.elevation_grids().agg(F.count("*").alias("grids"))
    pts = b.table("customer").select(k.alias("point_id")).join(F.broadcast(count)).withColumn(
        "grid_id", F.col("point_id") % F.col("grids"))
    fc, fr = (F.col("point_id") % 230) / 12.0, (F.col("point_id") % 190) / 10.0
    # positions in cell units, turned into degrees of a unit grid
    unit = b.elevation_grids().select("grid_id", F.lit(0.0).alias("west"), F.lit(0.0).alias("south"),
                                      F.lit(1.0).alias("d_lng"), F.lit(1.0).alias("d_lat"))
    placed = pts.select("point_id", "grid_id", fr.alias("lat"), fc.alias("lng"))
    out = raster.elevation_at(placed, b.elevation_cells(), unit)
    return out.select("point_id", (F.floor(F.col("elevation") * 1e4 + 0.5) / 1e4).alias("elevation"))


@query("grid_pack_round_trip", needs=("cell",), sql="SELECT grid_id, c, r, round(z, 6) AS z FROM cell")
def grid_pack_round_trip(b):
    packed = grid_source.pack_rows(b.elevation_cells(), b.elevation_grids())
    return grid_source.explode_rows(packed).withColumn("z", round6("z"))
