"""Crop seasons over the greenness readings."""

from __future__ import annotations

from pyspark.sql import functions as F

import fieldlens.queries.tables  # noqa: F401
from fieldlens.constants import MAX_SCENES, SCAN_TTL_DAYS
from fieldlens.functions import geo
from fieldlens.functions.num import round6
from fieldlens.operators import context, crops
from fieldlens.queries.registry import query, table_sql

TODAY = "2001-11-15"
CROPS9 = "['corn','soybeans','alfalfa','winter-wheat','oats','clover','brassicas','pasture','other']"

table_sql("rstep", """SELECT *, lag(date) OVER w AS prev_date, lag(ndvi) OVER w AS prev_ndvi FROM reading
  WINDOW w AS (PARTITION BY field_id ORDER BY date)""", ("reading",))
table_sql("harvest", f"""WITH s AS (SELECT field_id, count(*) AS looks, max(ndvi) AS peak, max(date) AS last_date,
    arg_max(ndvi, date) AS last_ndvi FROM rstep GROUP BY 1),
p AS (SELECT r.field_id, min(r.date) AS peak_date FROM rstep r JOIN s ON s.field_id = r.field_id AND r.ndvi = s.peak GROUP BY 1),
f AS (SELECT r.field_id, min(r.date) AS fall_date, arg_min(r.prev_date, r.date) AS fall_prev FROM rstep r JOIN p ON p.field_id = r.field_id
  WHERE r.prev_date >= p.peak_date AND r.ndvi <= 0.35e0 AND r.prev_ndvi - r.ndvi >= 0.2e0 GROUP BY 1),
j AS (SELECT s.*, p.peak_date, f.fall_date, CASE WHEN s.looks < 3 OR s.peak < 0.55e0 THEN 'unknown'
    WHEN f.fall_date - f.fall_prev <= 12 THEN 'cut' WHEN f.fall_date IS NOT NULL THEN 'cut-or-senesced'
    WHEN s.last_ndvi >= s.peak * 0.75e0 THEN 'standing' ELSE 'senescing' END AS state
  FROM s JOIN p ON p.field_id = s.field_id LEFT JOIN f ON f.field_id = s.field_id)
SELECT field_id, looks, state, CASE WHEN state IN ('cut', 'cut-or-senesced') THEN fall_date WHEN state = 'senescing' THEN peak_date END AS since,
  CASE WHEN looks >= 3 THEN peak END AS peak, CASE WHEN looks >= 3 THEN last_ndvi END AS latest, last_date,
  greatest(0, DATE '{TODAY}' - last_date) AS stale_days FROM j""", ("rstep",))


def _harvest(b):
    return crops.harvest_states(b.readings(), F.lit(TODAY).cast("date"))


@query("harvest_states", needs=("harvest",), sql="""
SELECT field_id, looks, state, CAST(since AS VARCHAR) AS since, peak, latest, CAST(last_date AS VARCHAR) AS latest_date,
  CAST(stale_days AS INT) AS stale_days FROM harvest""")
def harvest_states(b):
    return _harvest(b).withColumns({c: F.col(c).cast("string") for c in ("since", "latest_date")})


table_sql("curve", """SELECT field_id, i, y0 + (y1 - y0) * (i * 4 - x0) / CAST(x1 - x0 AS DOUBLE) AS v
  FROM (SELECT *, unnest(range(CASE WHEN x0 = 0 THEN 0 ELSE x0 // 4 + 1 END, x1 // 4 + 1)) AS i
    FROM (SELECT r.field_id, r.prev_date - t.t0 AS x0, r.date - t.t0 AS x1, r.prev_ndvi AS y0, r.ndvi AS y1 FROM rstep r
      JOIN (SELECT field_id, min(date) AS t0 FROM rstep GROUP BY 1 HAVING count(*) >= 3) t ON t.field_id = r.field_id
      WHERE r.prev_date IS NOT NULL))""", ("rstep",))


@query("curve_points", needs=("curve",), sql="""
SELECT field_id, CAST(i AS INT) AS i, round(v, 6) AS v FROM curve""")
def curve_points(b):
    return crops.curve_points(b.readings()).withColumn("v", round6("v"))


table_sql("refcurve", f"""SELECT crop, i, median(v) AS v FROM (SELECT c.*, {CROPS9}[p.p_size % 9 + 1] AS crop FROM curve c
    JOIN part p ON p.p_partkey = c.field_id) GROUP BY 1, 2
  HAVING crop IN (SELECT crop FROM (SELECT DISTINCT {CROPS9}[p.p_size % 9 + 1] AS crop, c.field_id FROM curve c
    JOIN part p ON p.p_partkey = c.field_id) GROUP BY 1 HAVING count(*) >= 3)""", ("curve",))


def _references(b, looks=None):
    return crops.reference_curves(crops.field_looks(b.readings()) if looks is None else looks, b.fields())


@query("reference_curves", needs=("refcurve",), sql="""
SELECT crop, CAST(i AS INT) AS i, round(v, 6) AS v FROM refcurve""")
def reference_curves(b):
    return _references(b).withColumn("v", round6("v"))


table_sql("fit", """SELECT field_id, crop, min(rmse) AS rmse, arg_min(s, rmse) * 4 AS shift_days FROM (
  SELECT c.field_id, r.crop, c.s, sqrt(sum((c.v - r.v) * (c.v - r.v)) / count(*)) * (1 + 0.35e0 * abs(c.s * 4) / 12e0) AS rmse
  FROM (SELECT *, unnest([-3, -2, -1, 0, 1, 2, 3]) AS s FROM curve) c JOIN refcurve r ON r.i = c.i - c.s GROUP BY 1, 2, 3 HAVING count(*) >= 4) GROUP BY 1, 2""", ("curve", "refcurve"))


def _fits(b):
    looks = crops.field_looks(b.readings())
    return crops.best_shifts(looks, _references(b, looks))


@query("best_shifts", needs=("fit",), sql="""
SELECT field_id, crop, round(rmse, 6) AS rmse, CAST(shift_days AS INT) AS shift_days FROM fit""")
def best_shifts(b):
    return _fits(b).withColumn("rmse", round6("rmse"))


table_sql("chist", """SELECT l_partkey AS field_id, year(l_shipdate) AS y,
  ['corn', 'soybeans', 'alfalfa', NULL, 'corn'][CAST(sum(l_quantity) AS BIGINT) % 5 + 1] AS crop FROM lineitem GROUP BY 1, 2""")
table_sql("prior", """WITH k AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY field_id) AS n
  FROM chist WHERE crop IS NOT NULL WINDOW w AS (PARTITION BY field_id ORDER BY y)),
l AS (SELECT field_id, crop AS last FROM k WHERE i = n - 1),
cs AS (SELECT field_id, crop, lag(crop) OVER (PARTITION BY field_id ORDER BY y) AS before FROM (
  SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY y DESC) AS back FROM k WHERE crop IN ('corn', 'soybeans')) WHERE back <= 4),
alt AS (SELECT field_id FROM cs GROUP BY 1 HAVING count(*) >= 3 AND count(*) FILTER (WHERE crop = before) = 0),
s AS (SELECT field_id, crop, pow(1.5e0, i) * CASE WHEN i = n - 1 THEN 0.4e0 ELSE 1e0 END AS score FROM k
  UNION ALL SELECT field_id, last, 6e0 FROM l WHERE last IN ('alfalfa', 'clover', 'pasture')
  UNION ALL SELECT l.field_id, CASE last WHEN 'corn' THEN 'soybeans' ELSE 'corn' END, 8e0 FROM l JOIN alt ON alt.field_id = l.field_id WHERE last IN ('corn', 'soybeans')
  UNION ALL SELECT l.field_id, last, 1.5e0 FROM l JOIN alt ON alt.field_id = l.field_id WHERE last IN ('corn', 'soybeans'))
SELECT field_id, crop, sum(score) / sum(sum(score)) OVER (PARTITION BY field_id) AS p FROM s GROUP BY 1, 2""", ("chist",))


@query("rotation_prior", needs=("prior",), sql="""SELECT field_id, crop, round(p, 6) AS p FROM prior""")
def rotation_prior(b):
    return crops.rotation_prior(b.crop_history()).withColumn("p", round6("p"))


table_sql("verdict", """WITH r AS (SELECT f.*, exp(-f.rmse / 0.06e0) AS lk,
  exp(-f.rmse / 0.06e0) * pow(greatest(coalesce(p.p, 0e0), 0.02e0), 0.6e0) AS post FROM fit f
  LEFT JOIN prior p ON p.field_id = f.field_id AND p.crop = f.crop),
c AS (SELECT *, post / sum(post) OVER w AS confidence, lk / sum(lk) OVER w AS curve_only, count(*) OVER w AS crops FROM r
  WINDOW w AS (PARTITION BY field_id)),
k AS (SELECT *, row_number() OVER w AS rank, lead(confidence) OVER w AS nxt FROM c WINDOW w AS (PARTITION BY field_id ORDER BY confidence DESC, crop)),
y AS (SELECT *, CASE WHEN crops < 2 THEN 'too few references' WHEN confidence - nxt < 0.15e0 THEN 'too close to call'
  WHEN rmse > 0.12e0 THEN 'no good match' END AS why FROM k)
SELECT field_id, crop, rank, confidence, curve_only, CASE WHEN rank = 1 AND why IS NULL THEN crop END AS verdict,
  CASE WHEN rank = 1 THEN why END AS why FROM y""", ("fit", "prior"))


def _verdicts(b):
    return crops.classify(_fits(b), crops.rotation_prior(b.crop_history()))


@query("crop_verdicts", needs=("verdict",), sql="""
SELECT field_id, crop, CAST(rank AS INT) AS rank, round(confidence, 6) AS confidence, round(curve_only, 6) AS curve_only, verdict, why FROM verdict""")
def crop_verdicts(b):
    return _verdicts(b).select("field_id", "crop", "rank", round6("confidence").alias("confidence"),
                               round6("curve_only").alias("curve_only"), "verdict", "why")


@query("field_season_scan", needs=("harvest", "verdict"), sql="""
SELECT h.field_id, h.looks, h.state, CAST(h.since AS VARCHAR) AS since, v.verdict, coalesce(v.why,
  CASE WHEN v.field_id IS NULL THEN 'not enough cloud-free looks' END) AS verdict_why
FROM harvest h LEFT JOIN (SELECT * FROM verdict WHERE rank = 1) v ON v.field_id = h.field_id""")
def field_season_scan(b):
    from fieldlens.plans.season import field_scans
    out = field_scans(_harvest(b), _verdicts(b))
    return out.select("field_id", "looks", "state", F.col("since").cast("string").alias("since"), "verdict", "verdict_why")


@query("scan_disagreements", needs=("harvest", "verdict"), sql=f"""
WITH f AS (SELECT p_partkey AS field_id, {CROPS9}[p_size % 9 + 1] AS crop, p_partkey % 3 <> 0 AS cut FROM part),
j AS (SELECT h.field_id, concat_ws('; ', CASE WHEN v.verdict <> f.crop THEN 'recorded as ' || f.crop || ', looks like ' || v.verdict END,
  CASE WHEN h.state = 'cut' AND NOT f.cut THEN 'looks cut since ' || CAST(h.since AS VARCHAR) END,
  CASE WHEN f.cut AND h.state = 'standing' THEN 'recorded as cut, still standing' END) AS notes
FROM harvest h JOIN f ON f.field_id = h.field_id LEFT JOIN (SELECT * FROM verdict WHERE rank = 1) v ON v.field_id = h.field_id)
SELECT field_id, notes FROM j WHERE notes <> ''""")
def scan_disagreements(b):
    from fieldlens.plans.season import field_scans
    scans = field_scans(_harvest(b), _verdicts(b))
    return crops.disagreements(b.fields().select("field_id", "crop", "cut_date"), scans).select(
        "field_id", F.array_join("notes", "; ").alias("notes"))


@query("field_scans_due", needs=("harvest",), sql="""
SELECT p_partkey AS field_id FROM part LEFT JOIN harvest h ON h.field_id = p_partkey
WHERE h.field_id IS NULL OR CAST(h.last_date AS TIMESTAMP) < TIMESTAMP '2001-10-20 06:00:00' - INTERVAL 5 DAY""")
def field_scans_due(b):
    scans = _harvest(b).select("field_id", F.col("latest_date").cast("timestamp").alias("scanned_at"))
    return crops.fields_due(b.fields().select("field_id"), scans, F.lit("2001-10-20 06:00:00").cast("timestamp"),
                            SCAN_TTL_DAYS).select("field_id")


RING = """[{'x': lng - d, 'y': lat - d}, {'x': lng + d, 'y': lat - d}, {'x': lng + d * 1.5e0, 'y': lat + d}, {'x': lng - d, 'y': lat + d}]"""
table_sql("sfield", f"""SELECT field_id, {RING} AS ring FROM (SELECT p_partkey AS field_id, 30e0 + CAST(p_partkey % 2000 AS DOUBLE) * 0.01e0 AS lat,
  -120e0 + CAST((p_partkey // 2000) % 12500 AS DOUBLE) * 0.0048e0 AS lng, 0.0005e0 + CAST(p_size % 7 AS DOUBLE) * 0.0001e0 AS d FROM part)""")
table_sql("sedge", """SELECT field_id, e.a.x AS xa, e.a.y AS ya, e.b.x AS xb, e.b.y AS yb FROM (SELECT field_id, unnest([
  {'a': ring[1], 'b': ring[2]}, {'a': ring[2], 'b': ring[3]}, {'a': ring[3], 'b': ring[4]}, {'a': ring[4], 'b': ring[1]}]) AS e FROM sfield)""", ("sfield",))
table_sql("pixel", """SELECT row_number() OVER () AS pid, l_linestatus AS scene,
  30e0 + CAST(l_partkey % 2000 AS DOUBLE) * 0.01e0 + (CAST(l_linenumber AS DOUBLE) - 4e0) * 0.00017e0 AS lat,
  -120e0 + CAST((l_partkey // 2000) % 12500 AS DOUBLE) * 0.0048e0 + (CAST(l_linenumber AS DOUBLE) - 3e0) * 0.00021e0 AS lng,
  CASE WHEN l_quantity <> 50 THEN l_tax * 1000 + 100 END AS red, l_discount * 5000 + 150 AS nir, CAST(l_quantity AS INT) % 12 AS klass FROM lineitem""")


@query("zonal_ndvi", needs=("sedge", "pixel"), sql="""
WITH hit AS (SELECT e.field_id, p.pid, any_value(p.scene) AS scene, any_value(p.red) AS red, any_value(p.nir) AS nir, any_value(p.klass) AS klass
  FROM pixel p JOIN sedge e ON (e.ya > p.lat) <> (e.yb > p.lat)
    AND p.lng < (e.xb - e.xa) * (p.lat - e.ya) / (e.yb - e.ya) + e.xa GROUP BY 1, 2 HAVING count(*) % 2 = 1),
t AS (SELECT *, red IS NULL AS missing, red IS NOT NULL AND klass IN (0, 1, 3, 8, 9, 10, 11) AS clouded FROM hit)
SELECT field_id, scene, count(*) FILTER (WHERE NOT missing AND NOT clouded) AS clear, count(*) FILTER (WHERE clouded) AS clouded,
  count(*) FILTER (WHERE missing) AS missing,
  round(CASE WHEN count(*) FILTER (WHERE NOT missing AND NOT clouded) >= 8 THEN
    median(CASE WHEN NOT missing AND NOT clouded THEN (nir - red) / (nir + red) END) END, 6) AS ndvi FROM t GROUP BY 1, 2""")
def zonal_ndvi(b):
    return crops.zonal_ndvi(b.pixels(), b.spread_fields()).select(
        "field_id", "scene", "clear", "clouded", "missing", round6("ndvi").alias("ndvi"))


@query("scene_tiles", sql="""
WITH s AS (SELECT l_partkey AS field_id, CAST(l_suppkey % 3 AS VARCHAR) AS tile, l_orderkey * 8 + l_linenumber AS scene_id FROM lineitem),
c AS (SELECT field_id, tile, count(*) AS n FROM s GROUP BY 1, 2),
b AS (SELECT field_id, tile FROM (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY n DESC, tile DESC) AS r FROM c) WHERE r = 1)
SELECT s.field_id, s.tile, s.scene_id FROM s JOIN b ON b.field_id = s.field_id AND b.tile = s.tile""")
def scene_tiles(b):
    return crops.tile_with_most_scenes(b.scenes()).select("field_id", "tile", "scene_id")


@query("scene_thinning")
def scene_thinning(b):
    return crops.thin_scenes(crops.tile_with_most_scenes(b.scenes()), MAX_SCENES)


@query("reference_radius", sql="""
WITH t AS (SELECT s_suppkey AS target_id, 44e0 + CAST(s_suppkey % 97 AS DOUBLE) * 0.01e0 AS lat, -90e0 - CAST(s_suppkey % 89 AS DOUBLE) * 0.012e0 AS lng FROM supplier),
r AS (SELECT 44e0 + CAST(p_partkey % 97 AS DOUBLE) * 0.01e0 AS lat, -90e0 - CAST(p_partkey % 89 AS DOUBLE) * 0.012e0 AS lng,
  ['corn','soybeans','alfalfa','winter-wheat','oats','clover','brassicas','pasture','other'][p_size % 9 + 1] AS crop FROM part),
p AS (SELECT t.target_id, r.crop, 2 * 6371000e0 * asin(least(1e0, sqrt(pow(sin(radians(r.lat - t.lat) / 2), 2)
    + cos(radians(t.lat)) * cos(radians(r.lat)) * pow(sin(radians(r.lng - t.lng) / 2), 2)))) AS m
  FROM t JOIN r ON r.crop IN ('corn', 'soybeans') AND abs(r.lat - t.lat) < 0.1),
c AS (SELECT target_id, count(*) FILTER (WHERE crop = 'corn' AND m <= 2000) AS c2, count(*) FILTER (WHERE crop = 'soybeans' AND m <= 2000) AS s2,
  count(*) FILTER (WHERE crop = 'corn' AND m <= 5000) AS c5, count(*) FILTER (WHERE crop = 'soybeans' AND m <= 5000) AS s5,
  count(*) FILTER (WHERE crop = 'corn' AND m <= 10000) AS c10, count(*) FILTER (WHERE crop = 'soybeans' AND m <= 10000) AS s10,
  count(*) FILTER (WHERE m <= 10000) AS any10 FROM p GROUP BY 1),
k AS (SELECT *, CASE WHEN c2 >= 8 AND s2 >= 8 THEN 2000e0 WHEN c5 >= 8 AND s5 >= 8 THEN 5000e0 ELSE 10000e0 END AS radius FROM c WHERE any10 > 0)
SELECT t.target_id, k.radius, CASE k.radius WHEN 2000 THEN c2 WHEN 5000 THEN c5 ELSE c10 END AS corn,
  CASE k.radius WHEN 2000 THEN s2 WHEN 5000 THEN s5 ELSE s10 END AS soybeans,
  CASE k.radius WHEN 2000 THEN true WHEN 5000 THEN true ELSE c10 >= 8 AND s10 >= 8 END AS enough
FROM t LEFT JOIN k ON k.target_id = t.target_id""")
def reference_radius(b):
    lat, lng = b.place(F.col("s_suppkey"))
    targets = b.table("supplier").select(F.col("s_suppkey").alias("target_id"), lat, lng)
    plat, plng = b.place(F.col("field_id"))
    labelled = b.fields().select("field_id", "crop", plat, plng)
    out = crops.reference_radius(targets, labelled)
    return out.select("target_id", "radius", "corn", "soybeans", F.when(F.col("radius").isNotNull(), F.col("enough")).alias("enough"))


@query("crop_mix", sql="""
SELECT category, count(*) AS n, CAST(floor(100e0 * count(*) / sum(count(*)) OVER () + 0.5) AS BIGINT) AS pct
FROM (SELECT p_type AS category FROM part) GROUP BY 1""")
def crop_mix(b):
    return crops.class_mix(b.table("part").select(F.col("p_type").alias("category")))


@query("crop_guesses", sql="""
SELECT p_partkey AS field_id, CASE p_size % 10 WHEN 0 THEN 'corn' WHEN 1 THEN 'soybeans' WHEN 2 THEN 'alfalfa' WHEN 3 THEN 'winter-wheat'
  WHEN 4 THEN 'oats' WHEN 5 THEN 'clover' WHEN 6 THEN 'brassicas' WHEN 7 THEN 'pasture' WHEN 8 THEN 'corn' END AS crop FROM part""")
def crop_guesses(b):
    words = F.array(*map(F.lit, ["Sweet Corn", "Soybeans", "Alfalfa", "Winter Wheat", "Oats", "Clover/Wildflowers",
                                 "Turnips", "Grassland/Pasture", "Dbl Crop Corn/Soybeans", "Open Water"]))
    cat = F.get(words, (F.col("p_size") % 10).cast("int"))
    return b.table("part").select(F.col("p_partkey").alias("field_id"), crops.crop_guess(cat).alias("crop"))


@query("stand_food", sql=f"""
WITH s AS (SELECT c_custkey AS stand_id, c_custkey % 97 AS a, c_custkey % 89 AS b FROM customer),
f AS (SELECT p_partkey AS field_id, p_partkey % 97 AS a, p_partkey % 89 AS b, {CROPS9}[p_size % 9 + 1] AS crop,
  CASE WHEN p_partkey % 3 <> 0 THEN DATE '2023-11-10' - (DATE '2023-09-20' + CAST(p_partkey % 60 AS INT)) END AS since FROM part),
n AS (SELECT s.stand_id, f.*, row_number() OVER (PARTITION BY s.stand_id ORDER BY f.m, f.field_id) AS r
  FROM s JOIN (SELECT *, p_size_m AS m FROM (SELECT f.*, q.p_size % 7 AS p_size_m FROM f JOIN part q ON q.p_partkey = f.field_id)) f ON f.a = s.a AND f.b = s.b),
p AS (SELECT stand_id, CASE WHEN crop = 'alfalfa' AND since BETWEEN 0 AND 30 THEN 3 WHEN since BETWEEN 0 AND 21 AND crop IN ('corn', 'soybeans') THEN 5
  WHEN since BETWEEN 0 AND 21 THEN 3 WHEN crop = 'corn' AND since IS NULL THEN -3 WHEN crop = 'brassicas' THEN 4 ELSE 0 END AS p FROM n WHERE r <= 3)
SELECT s.stand_id, count(p.p) AS fields, CAST(greatest(-6, least(8, coalesce(sum(p.p), 0))) AS INT) AS food_points
FROM s LEFT JOIN p ON p.stand_id = s.stand_id GROUP BY 1""")
def stand_food(b):
    out = context.food_scores(b.stands(), b.fields(), F.lit("2023-11-10").cast("date"))
    return out.withColumn("food_points", F.col("food_points").cast("int"))
