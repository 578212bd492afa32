"""Joins in space: near, nearest, inside, in view, downwind."""

from __future__ import annotations

from pyspark.sql import functions as F

import fieldlens.queries.relational  # noqa: F401
from fieldlens.functions import geo, lanes
from fieldlens.functions.num import half_up, round6
from fieldlens.operators import grounds, parcels, routes, spatial, tracks
from fieldlens.queries.registry import query, table_sql
from fieldlens.queries.tables import bearing_sql, haversine_sql, wrap_sql

SPREAD_LAT = "30e0 + CAST({0} % 2000 AS DOUBLE) * 0.01e0"
SPREAD_LNG = "-120e0 + CAST(({0} // 2000) % 12500 AS DOUBLE) * 0.0048e0"
table_sql("sstand", f"""SELECT c_custkey AS stand_id, c_nationkey AS ground_id, {SPREAD_LAT.format("c_custkey")} AS lat,
  {SPREAD_LNG.format("c_custkey")} AS lng FROM customer""")


@query("stands_near_cameras", needs=("stand", "fleet"), sql=f"""
SELECT s.stand_id, count(f.camera_id) AS nearby, min(f.camera_id) AS camera_id,
  CASE WHEN count(f.camera_id) > 0 THEN CAST(floor(min({haversine_sql("s.lat", "s.lng", "f.lat", "f.lng")}) + 0.5) AS BIGINT) END AS metres
FROM stand s LEFT JOIN fleet f ON abs(f.lat - s.lat) < 0.01 AND {haversine_sql("s.lat", "s.lng", "f.lat", "f.lng")} <= 400 GROUP BY 1""")
def stands_near_cameras(b):
    out = spatial.nearby_summary(b.stands().select("stand_id", "lat", "lng"), b.fleet().select("camera_id", "lat", "lng"),
                                 "camera_id", 400.0)
    return out.select("stand_id", "nearby", "camera_id", half_up(F.col("metres")).alias("metres"))


@query("pin_pairs_in_reach", needs=("pin",), sql=f"""
WITH s AS (SELECT lat, lng, count(*) AS k, min(pin_id) AS pin_id FROM pin GROUP BY 1, 2)
SELECT a.pin_id AS pin_id, count(*) AS places, CAST(sum(b.k) AS BIGINT) AS pins FROM s a JOIN s b
ON abs(a.lat - b.lat) < 0.02 AND {haversine_sql("a.lat", "a.lng", "b.lat", "b.lng")} <= 2000 GROUP BY 1""")
def pin_pairs_in_reach(b):
    spots = spatial.sites(b.pins(), "pin_id")
    left = spots.select("lat", "lng", "pin_id")
    right = spots.select("lat", "lng", F.col("at_site").alias("k"))
    return spatial.near_pairs(left, right, 2000.0, ["pin_id"], ["k"]).groupBy("pin_id").agg(
        F.count("*").alias("places"), F.sum("k").alias("pins"))


table_sql("pinsite", "SELECT lat, lng, min(pin_id) AS pin_id FROM pin GROUP BY 1, 2", ("pin",))
GROUND_SQL = f"""WITH RECURSIVE e AS (SELECT a.pin_id AS a, b.pin_id AS b FROM pinsite a JOIN pinsite b
    ON abs(a.lat - b.lat) < 0.02 AND {haversine_sql("a.lat", "a.lng", "b.lat", "b.lng")} <= 2000),
r AS (SELECT pin_id, pin_id AS root FROM pinsite UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.pin_id),
c AS (SELECT pin_id, min(root) AS ground_id FROM r GROUP BY 1)"""


def _recursive(needs: tuple[str, ...], body: str) -> str:
    from fieldlens.queries.registry import with_tables
    return with_tables(needs, body.replace("WITH RECURSIVE ", "WITH ", 1)).replace("WITH ", "WITH RECURSIVE ", 1)


GROUNDS = _recursive(("pinsite", "pin"), GROUND_SQL + """
SELECT c.ground_id, count(*) AS size, count(*) FILTER (WHERE p.kind = 'camera') AS cameras,
  count(*) FILTER (WHERE p.kind = 'stand') AS stands, round(min(p.lat), 6) AS south, round(max(p.lng), 6) AS east
FROM pin p JOIN pinsite s ON s.lat = p.lat AND s.lng = p.lng JOIN c ON c.pin_id = s.pin_id GROUP BY 1""")


@query("ground_clusters", sql=GROUNDS)
def ground_clusters(b):
    g = grounds.grounds(grounds.cluster_pins(b.pins(), "pin_id"))
    return g.select("ground_id", "size", "cameras", "stands", round6("south").alias("south"), round6("east").alias("east"))


@query("ground_names", sql=_recursive(("pinsite", "pin"), GROUND_SQL + """,
v AS (SELECT c.ground_id, p.property, count(*) AS n FROM pin p JOIN pinsite s ON s.lat = p.lat AND s.lng = p.lng
  JOIN c ON c.pin_id = s.pin_id WHERE p.property IS NOT NULL GROUP BY 1, 2),
k AS (SELECT ground_id, property, row_number() OVER (PARTITION BY ground_id ORDER BY n DESC, property) AS r FROM v)
SELECT c.ground_id, any_value(k.property) AS name,
  concat_ws(', ', CASE count(*) FILTER (WHERE p.kind = 'camera') WHEN 0 THEN NULL WHEN 1 THEN '1 camera' ELSE count(*) FILTER (WHERE p.kind = 'camera') || ' cameras' END,
   CASE count(*) FILTER (WHERE p.kind = 'stand') WHEN 0 THEN NULL WHEN 1 THEN '1 stand' ELSE count(*) FILTER (WHERE p.kind = 'stand') || ' stands' END) AS label
FROM pin p JOIN pinsite s ON s.lat = p.lat AND s.lng = p.lng JOIN c ON c.pin_id = s.pin_id
LEFT JOIN k ON k.ground_id = c.ground_id AND k.r = 1 GROUP BY 1"""))
def ground_names(b):
    g = grounds.grounds(grounds.cluster_pins(b.pins(), "pin_id"))
    return g.select("ground_id", "name", grounds.ground_label(F.col("cameras"), F.col("stands"), F.col("markers")).alias("label"))


table_sql("nground", """SELECT s_nationkey AS ground_id, min(lat) AS south, max(lat) AS north, min(lng) AS west, max(lng) AS east,
  (min(lat) + max(lat)) / 2 AS lat, (min(lng) + max(lng)) / 2 AS lng FROM (SELECT s_nationkey,
  44e0 + CAST(s_suppkey % 97 AS DOUBLE) * 0.01e0 AS lat, -90e0 - CAST(s_suppkey % 89 AS DOUBLE) * 0.012e0 AS lng FROM supplier) GROUP BY 1""")


@query("ground_of_points", needs=("stand", "nground"), sql=f"""
WITH d AS (SELECT s.stand_id, g.ground_id, s.lat BETWEEN g.south AND g.north AND s.lng BETWEEN g.west AND g.east AS inside,
  {haversine_sql("s.lat", "s.lng", "g.lat", "g.lng")} AS m FROM stand s, nground g),
k AS (SELECT *, row_number() OVER (PARTITION BY stand_id ORDER BY CASE WHEN inside THEN 0 ELSE 1 END, m, ground_id) AS r FROM d WHERE inside OR m <= 2000)
SELECT s.stand_id, k.ground_id FROM stand s LEFT JOIN k ON k.stand_id = s.stand_id AND k.r = 1""")
def ground_of_points(b):
    lat, lng = b.place(F.col("s_suppkey"))
    sup = b.table("supplier").select(F.col("s_nationkey").alias("ground_id"), lat, lng)
    g = sup.groupBy("ground_id").agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lng").alias("west"),
                                     F.max("lng").alias("east")).withColumns({
        "lat": (F.col("south") + F.col("north")) / 2, "lng": (F.col("west") + F.col("east")) / 2})
    return grounds.ground_at(b.stands().select("stand_id", "lat", "lng"), g).select("stand_id", "ground_id")


WEATHER_PLACES = """WITH RECURSIVE o AS (SELECT s_suppkey AS camera_id, (s_suppkey * 2654435761) % 4294967296 AS seen,
    floor((44e0 + CAST(s_suppkey % 97 AS DOUBLE) * 0.01e0) * 10000 + 0.5) / 10000 AS lat, floor((-90e0 - CAST(s_suppkey % 89 AS DOUBLE) * 0.012e0) * 10000 + 0.5) / 10000 AS lng,
    row_number() OVER (ORDER BY (s_suppkey * 2654435761) % 4294967296) AS i FROM supplier),
st AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(seen BIGINT, lat DOUBLE, lng DOUBLE)[]) AS held, CAST(NULL AS BIGINT) AS camera_id, CAST(NULL AS BIGINT) AS loc
  UNION ALL SELECT o.i, CASE WHEN n.seen IS NULL THEN list_append(st.held, {{'seen': o.seen, 'lat': o.lat, 'lng': o.lng}}) ELSE st.held END, o.camera_id, coalesce(n.seen, o.seen)
  FROM st JOIN o ON o.i = st.i + 1, LATERAL (SELECT list_sort(list_filter(list_transform(st.held, lambda h: {{'m': {d}, 'seen': h.seen}}), lambda x: x.m <= 2000))[1].seen AS seen) n)
SELECT camera_id, loc AS loc_order FROM st WHERE i > 0""".format(d=haversine_sql("o.lat", "o.lng", "h.lat", "h.lng"))


@query("weather_locations", sql=WEATHER_PLACES)
def weather_locations(b):
    cams = b.fleet().select("camera_id", (F.col("camera_id") * 2654435761 % 4294967296).alias("seen"), "lat", "lng")
    return grounds.leader_locations(cams, "seen").select("camera_id", "loc_order")


@query("finest_grid_at", needs=("stand",), sql="""
WITH g AS (SELECT s_suppkey AS grid_id, 5 + s_suppkey % 3 * 5 AS spacing, 44e0 + CAST(s_suppkey % 97 AS DOUBLE) * 0.01e0 - 0.015e0 AS south,
  -90e0 - CAST(s_suppkey % 89 AS DOUBLE) * 0.012e0 - 0.02e0 AS west FROM supplier),
k AS (SELECT s.stand_id, g.grid_id, row_number() OVER (PARTITION BY s.stand_id ORDER BY g.spacing, g.grid_id) AS r FROM stand s
  JOIN g ON s.lat BETWEEN g.south AND g.south + 0.03e0 AND s.lng BETWEEN g.west AND g.west + 0.04e0)
SELECT s.stand_id, k.grid_id FROM stand s LEFT JOIN k ON k.stand_id = s.stand_id AND k.r = 1""")
def finest_grid_at(b):
    from fieldlens.sources.grids import finest_grid_at as finest
    k = F.col("s_suppkey")
    lat, lng = b.place(k)
    boxes = b.table("supplier").select(k.alias("grid_id"), (k % 3 * 5 + 5).alias("spacing_m"), (lat - 0.015).alias("south"),
                                       (lng - 0.02).alias("west")).withColumns({
        "north": F.col("south") + 0.03, "east": F.col("west") + 0.04})
    return finest(b.stands().select("stand_id", "lat", "lng"), boxes).select("stand_id", "grid_id")


table_sql("parcel", f"""SELECT p_partkey, CASE WHEN p_partkey % 13 <> 0 THEN CAST(p_partkey AS VARCHAR) END AS parcel_id,
  nullif(concat_ws(' & ', CASE WHEN p_partkey % 7 <> 0 THEN p_name END, CASE WHEN p_partkey % 5 = 0 THEN p_brand END), '') AS owner,
  floor(p_retailprice / 7 * 100 + 0.5) / 100 AS acres, p_type AS county,
  ['residential', 'agricultural, agricultural forest', 'productive forest', NULL, NULL, 'commercial, tax-exempt'][p_size % 6 + 1] AS class_name,
  {SPREAD_LAT.format("p_partkey")} AS lat, {SPREAD_LNG.format("p_partkey")} AS lng, 0.0006e0 + CAST(p_size % 7 AS DOUBLE) * 0.0001e0 AS d FROM part""")


@query("parcels_normalised", needs=("parcel",), sql="""
SELECT parcel_id, owner, acres, county, class_name FROM parcel""")
def parcels_normalised(b):
    return parcels.normalise(b.raw_parcels()).select("parcel_id", "owner", "acres", "county", "class_name")


@query("parcels_by_owner", needs=("parcel",), sql="""
SELECT parcel_id, owner, acres FROM parcel WHERE upper(owner) LIKE '%RED%'""")
def parcels_by_owner(b):
    return parcels.by_owner(parcels.normalise(b.raw_parcels()), "red").select("parcel_id", "owner", "acres")


table_sql("inpar", """SELECT s.stand_id, s.ground_id, p.parcel_id, p.owner, p.acres, p.county FROM (SELECT stand_id, ground_id,
    lat + CAST(stand_id % 4 AS DOUBLE) * 0.0004e0 AS lat, lng FROM sstand) s
  JOIN parcel p ON p.lat - p.d <= s.lat AND s.lat < p.lat + p.d AND abs(s.lng - p.lng) < p.d""", ("sstand", "parcel"))


def _anchors(b):
    s = b.spread_stands()
    return s.withColumn("lat", F.col("lat") + (F.col("stand_id") % 4).cast("double") * 0.0004)


@query("points_in_parcels", needs=("inpar",), sql="SELECT stand_id, parcel_id, owner FROM inpar")
def points_in_parcels(b):
    land = parcels.normalise(b.raw_parcels())
    return spatial.points_in_polygons(_anchors(b).select("stand_id", "lat", "lng"), land, 0.01).select(
        "stand_id", "parcel_id", "owner")


@query("home_parcels", needs=("inpar", "sstand"), sql="""
WITH u AS (SELECT *, coalesce('id:' || parcel_id, 'owner:' || owner) AS key FROM inpar),
h AS (SELECT ground_id, key, min(stand_id) AS f, arg_min(acres, stand_id) AS acres, arg_min(county, stand_id) AS county FROM u WHERE key IS NOT NULL GROUP BY 1, 2),
v AS (SELECT ground_id, owner, row_number() OVER (PARTITION BY ground_id ORDER BY count(*) DESC, min(stand_id)) AS r FROM u WHERE owner IS NOT NULL GROUP BY 1, 2)
SELECT CAST(h.ground_id AS BIGINT) AS ground_id, count(*) AS parcels, CAST(floor(sum(coalesce(h.acres, 0)) + 0.5) AS BIGINT) AS acres,
  arg_min(h.county, h.f) AS county, any_value(v.owner) AS home_owner FROM h LEFT JOIN v ON v.ground_id = h.ground_id AND v.r = 1 GROUP BY 1""")
def home_parcels(b):
    under = parcels.home_parcels(_anchors(b), parcels.normalise(b.raw_parcels()), "ground_id", "stand_id")
    return parcels.home_summary(under, "ground_id", "stand_id")


# ---- cones ------------------------------------------------------------------------------

table_sql("viewer", f"""SELECT s_suppkey AS camera_id, {SPREAD_LAT.format("s_suppkey")} AS lat, {SPREAD_LNG.format("s_suppkey")} AS lng,
  CAST(s_suppkey * 47 % 360 AS DOUBLE) AS bearing, 21e0 + CAST(s_suppkey % 3 AS DOUBLE) * 20 AS spread, 25e0 + CAST(s_suppkey % 5 AS DOUBLE) * 40 AS reach FROM supplier""")
table_sql("vpoint", f"""SELECT c_custkey AS point_id, {SPREAD_LAT.format("c_custkey")} + CAST(c_custkey % 3 AS DOUBLE) * 0.0005e0 - 0.0004e0 AS lat,
  {SPREAD_LNG.format("c_custkey")} + CAST(c_custkey % 7 AS DOUBLE) * 0.0004e0 - 0.001e0 AS lng FROM customer""")


@query("camera_sees_points", needs=("viewer", "vpoint"), sql=f"""
SELECT v.camera_id, p.point_id FROM viewer v JOIN vpoint p ON abs(v.lat - p.lat) < 0.01
  AND {haversine_sql("v.lat", "v.lng", "p.lat", "p.lng")} <= v.reach
  AND abs({wrap_sql("(" + bearing_sql("v.lat", "v.lng", "p.lat", "p.lng") + ") - v.bearing + 180e0")} - 180e0) <= v.spread""")
def camera_sees_points(b):
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    lat, lng = b.spread(k)
    cams = b.table("supplier").select(k.alias("camera_id"), lat, lng, (k * 47 % 360).cast("double").alias("bearing"),
                                      (F.lit(21.0) + (k % 3).cast("double") * 20).alias("spread"),
                                      (F.lit(25.0) + (k % 5).cast("double") * 40).alias("reach"))
    plat, plng = b.spread(c)
    pts = b.table("customer").select(c.alias("point_id"), (plat + (c % 3).cast("double") * 0.0005 - 0.0004).alias("lat"),
                                     (plng + (c % 7).cast("double") * 0.0004 - 0.001).alias("lng"))
    near = spatial.near_pairs(cams, pts, 185.0, ["camera_id", "bearing", "spread", "reach"], ["point_id"])
    off = geo.angle_between(geo.bearing_deg(F.col("l_lat"), F.col("l_lng"), F.col("r_lat"), F.col("r_lng")), F.col("bearing"))
    return near.where((F.col("metres") <= F.col("reach")) & (off <= F.col("spread"))).select("camera_id", "point_id")


table_sql("rpoint", f"""SELECT route_id, pos, lat - 0.0006e0 * (5 - pos) + CAST(route_id % 5 AS DOUBLE) * 0.0002e0 AS lat,
  lng - 0.0004e0 * (5 - pos) AS lng, wind FROM (SELECT c_custkey AS route_id, unnest(range(6)) AS pos,
  {SPREAD_LAT.format("c_custkey")} AS lat, {SPREAD_LNG.format("c_custkey")} AS lng,
  CASE WHEN c_custkey % 10 <> 0 THEN CAST(c_custkey * 37 % 360 AS DOUBLE) END AS wind FROM customer)""")
table_sql("rnear", f"""SELECT r.*, s.stand_id AS target_id, {haversine_sql("r.lat", "r.lng", "s.lat", "s.lng")} AS m,
  {bearing_sql("r.lat", "r.lng", "s.lat", "s.lng")} AS brg FROM rpoint r JOIN sstand s ON abs(r.lat - s.lat) < 0.0025
  AND abs(r.lng - s.lng) < 0.005 AND {haversine_sql("r.lat", "r.lng", "s.lat", "s.lng")} <= 200""", ("rpoint", "sstand"))
table_sql("rhit", f"""SELECT route_id, target_id, min(m) AS m, arg_min(off, m) AS off, arg_min(pos, m) AS pos FROM (SELECT *,
  abs({wrap_sql("(wind + 180e0) - brg + 180e0")} - 180e0) AS off FROM rnear WHERE wind IS NOT NULL) WHERE off <= 30 GROUP BY 1, 2""", ("rnear",))


def _near(b):
    targets = b.spread_stands().select(F.col("stand_id").alias("target_id"), "lat", "lng")
    return routes.points_near_targets(b.routes(), targets)


@query("scent_hits", needs=("rhit",), sql="""
SELECT route_id, target_id, CAST(floor(m + 0.5) AS BIGINT) AS metres, CAST(floor(off + 0.5) AS BIGINT) AS off_deg FROM rhit""")
def scent_hits(b):
    return routes.scent_hits(_near(b), b.route_winds()).select("route_id", "target_id", "metres", "off_deg")


def _assessed(b):
    return routes.assess_routes(b.routes(), routes.scent_hits(_near(b), b.route_winds()), b.route_winds())


table_sql("assessed", f"""SELECT r.route_id, CAST(floor(sum(leg) + 0.5) AS BIGINT) AS length_m, any_value(wind) IS NOT NULL AS known,
  any_value(h.m) AS own FROM (SELECT *, CASE WHEN pos > 0 THEN {haversine_sql("lag(lat) OVER w", "lag(lng) OVER w", "lat", "lng")} END AS leg FROM rpoint
    WINDOW w AS (PARTITION BY route_id ORDER BY pos)) r LEFT JOIN rhit h ON h.route_id = r.route_id AND h.target_id = r.route_id GROUP BY 1""",
          ("rpoint", "rhit"))


@query("route_assessment", needs=("assessed",), sql="""
SELECT route_id, length_m, CASE WHEN known THEN own IS NULL END AS ok, CAST(floor(own + 0.5) AS BIGINT) AS own_m FROM assessed""")
def route_assessment(b):
    return _assessed(b).select("route_id", "length_m", "ok", "own_m")


@query("best_walks", needs=("assessed",), sql="""
WITH k AS (SELECT *, route_id % 50 AS st, CASE WHEN known THEN own IS NULL END AS ok FROM assessed),
o AS (SELECT *, row_number() OVER (PARTITION BY st ORDER BY CASE WHEN ok THEN 0 ELSE 1 END, route_id) AS r FROM k)
SELECT st AS stand_id, route_id, ok, length_m FROM o WHERE r = 1""")
def best_walks(b):
    return routes.best_walks(_assessed(b).withColumn("stand_id", F.col("route_id") % 50))


@query("route_clean_winds", needs=("rnear",), sql=f"""
WITH w AS (SELECT CAST(unnest(range(16)) AS INT) AS i), d AS (SELECT DISTINCT n.route_id, w.i FROM rnear n, w WHERE n.target_id = n.route_id
  AND abs({wrap_sql("(w.i * 22.5e0 + 180e0) - n.brg + 180e0")} - 180e0) <= 30)
SELECT c_custkey AS route_id, 16 - count(d.i) AS clean, string_agg(['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'][d.i + 1], ',' ORDER BY d.i) AS dirty
FROM customer LEFT JOIN d ON d.route_id = c_custkey GROUP BY 1""")
def route_clean_winds(b):
    owners = b.routes().select("route_id", F.col("stand_id").alias("target_id"))
    out = routes.route_winds(_near(b), owners)
    return out.select("route_id", F.size("clean").cast("bigint").alias("clean"),
                      F.nullif(F.array_join("dirty", ","), F.lit("")).alias("dirty"))


@query("nearest_access", needs=("stand",), sql=f"""
WITH a AS (SELECT p_partkey AS marker_id, 44e0 + CAST(p_partkey % 97 AS DOUBLE) * 0.01e0 AS lat,
  -90e0 - CAST(p_partkey % 89 AS DOUBLE) * 0.012e0 AS lng FROM part WHERE p_size % 8 = 6),
d AS (SELECT s.stand_id, a.marker_id, {haversine_sql("s.lat", "s.lng", "a.lat", "a.lng")} AS m FROM stand s, a)
SELECT stand_id, CAST(floor(min(m) + 0.5) AS BIGINT) AS metres FROM d GROUP BY 1""")
def nearest_access(b):
    access = b.markers().where(F.col("kind") == "access").select("marker_id", "lat", "lng")
    out = spatial.nearest_any(b.stands().select("stand_id", "lat", "lng"), access, "marker_id")
    return out.select("stand_id", half_up(F.col("metres")).alias("metres"))


# ---- walked tracks ----------------------------------------------------------------------

table_sql("fix", """SELECT user_id AS track_id, event_id AS seq, epoch_us(ts) / 1000.0e0 AS t_ms,
  44e0 + CAST(event_id % 500 AS DOUBLE) * 0.0002e0 + CASE WHEN event_id % 23 = 0 THEN 1e0 ELSE 0e0 END AS lat,
  -90e0 + CAST(event_id * 7 % 11 AS DOUBLE) * 0.00002e0 AS lng,
  CASE WHEN event_id % 31 <> 0 THEN CAST(event_id % 60 + 3 AS DOUBLE) END AS acc FROM events""")
table_sql("track_fate", """WITH RECURSIVE good AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY seq) AS k FROM fix WHERE acc <= 50),
  pass AS (
    SELECT track_id, k, seq, 'kept' AS fate, t_ms AS s_t, lat AS s_lat, lng AS s_lng, lat AS m_lat, lng AS m_lng FROM good WHERE k = 1
    UNION ALL
    SELECT track_id, k, seq, CASE WHEN fast THEN 'speed' WHEN far THEN 'kept' ELSE 'stationary' END AS fate,
      CASE WHEN fast THEN s_t ELSE t_ms END, CASE WHEN fast THEN s_lat ELSE lat END, CASE WHEN fast THEN s_lng ELSE lng END,
      CASE WHEN NOT fast AND far THEN lat ELSE m_lat END, CASE WHEN NOT fast AND far THEN lng ELSE m_lng END
    FROM (SELECT g.*, p.s_t, p.s_lat, p.s_lng, p.m_lat, p.m_lng,
        g.t_ms > p.s_t AND 2 * 6371000e0 * asin(least(1e0, sqrt(pow(sin(radians(g.lat - p.s_lat) / 2), 2)
          + cos(radians(p.s_lat)) * cos(radians(g.lat)) * pow(sin(radians(g.lng - p.s_lng) / 2), 2)))) / ((g.t_ms - p.s_t) / 1000e0) > 3 AS fast,
        2 * 6371000e0 * asin(least(1e0, sqrt(pow(sin(radians(g.lat - p.m_lat) / 2), 2)
          + cos(radians(p.m_lat)) * cos(radians(g.lat)) * pow(sin(radians(g.lng - p.m_lng) / 2), 2)))) >= greatest(4e0, 2 * g.acc) AS far
      FROM pass p JOIN good g ON g.track_id = p.track_id AND g.k = p.k + 1))
  SELECT track_id, seq, fate FROM pass UNION ALL SELECT track_id, seq, 'accuracy' AS fate FROM fix WHERE acc IS NULL OR acc > 50""", ("fix",))


@query("track_gate_fates", needs=("track_fate",), sql="""
SELECT f.track_id, f.seq, CASE WHEN f.fate = 'stationary' AND f.seq = e.seq THEN 'kept' ELSE f.fate END AS fate
FROM track_fate f JOIN (SELECT track_id, max(seq) AS seq FROM track_fate WHERE fate IN ('kept', 'stationary') GROUP BY 1) e ON e.track_id = f.track_id
WHERE f.fate <> 'accuracy'""")
def track_gate_fates(b):
    """What the speed and step gates make of every usable fix."""
    return tracks.gate_fixes(b.fixes()).select("track_id", "seq", "fate")


@query("track_cleaning")
def track_cleaning(b):
    return tracks.build_tracks(b.fixes())


table_sql("walked", """SELECT user_id AS track_id, event_id AS pos, 44e0 + CAST(event_id % 500 AS DOUBLE) * 0.0002e0 AS lat,
  -90e0 + CAST(event_id * 7 % 11 AS DOUBLE) * 0.0002e0 AS lng FROM events""")


@query("track_against_route", needs=("walked",), sql="""
WITH seg AS (SELECT unnest([{'a': {'x': -90e0, 'y': 44e0}, 'b': {'x': -89.999e0, 'y': 44.05e0}},
    {'a': {'x': -89.999e0, 'y': 44.05e0}, 'b': {'x': -90e0, 'y': 44.09e0}}]) AS s),
d AS (SELECT w.track_id, w.pos, (w.lng - s.a.x) * (111412.84e0 * cos(radians(s.a.y)) - 93.5e0 * cos(3 * radians(s.a.y))) AS x,
  (w.lat - s.a.y) * (111132.92e0 - 559.82e0 * cos(2 * radians(s.a.y))) AS y,
  (s.b.x - s.a.x) * (111412.84e0 * cos(radians(s.a.y)) - 93.5e0 * cos(3 * radians(s.a.y))) AS bx,
  (s.b.y - s.a.y) * (111132.92e0 - 559.82e0 * cos(2 * radians(s.a.y))) AS ey FROM walked w, seg),
t AS (SELECT *, greatest(0e0, least(1e0, (x * bx + y * ey) / (bx * bx + ey * ey))) AS t FROM d),
p AS (SELECT track_id, pos, min(sqrt(pow(x - t * bx, 2) + pow(y - t * ey, 2))) AS dev FROM t GROUP BY 1, 2)
SELECT track_id, count(*) AS points, CAST(floor(list_sort(list(dev))[CAST(floor(count(*) / 2) AS BIGINT) + 1] + 0.5) AS BIGINT) AS median_m,
  CAST(floor(max(dev) + 0.5) AS BIGINT) AS worst_m, floor(CAST(count(*) FILTER (WHERE dev > 40) AS DOUBLE) / count(*) * 100 + 0.5) / 100 AS off_fraction,
  max(dev) <= 40 AS followed FROM p GROUP BY 1 HAVING count(*) >= 2""")
def track_against_route(b):
    e = F.col("event_id")
    walked = b.table("events").select(F.col("user_id").alias("track_id"), F.col("user_id").alias("route_id"), e.alias("pos"),
                                      (F.lit(44.0) + (e % 500).cast("double") * 0.0002).alias("lat"),
                                      (F.lit(-90.0) + (e * 7 % 11).cast("double") * 0.0002).alias("lng"))
    line = F.array(*[F.struct(F.lit(x).alias("lng"), F.lit(y).alias("lat"))
                     for x, y in ((-90.0, 44.0), (-89.999, 44.05), (-90.0, 44.09))])
    plan = walked.select("route_id").distinct().withColumn("points", line)
    return routes.compare_to_route(walked, plan)


# ---- lanes ------------------------------------------------------------------------------

table_sql("lane", f"""SELECT c_custkey AS stand_id, i, lat, lng, tlat, tlng, CASE WHEN (c_custkey + i) % 3 <> 0 THEN 4e0 + i * 30 END AS spread,
  floor({bearing_sql("lat", "lng", "tlat", "tlng")} * 10 + 0.5) / 10 AS bearing,
  floor({haversine_sql("lat", "lng", "tlat", "tlng")} + 0.5) AS metres FROM (SELECT c_custkey, i, {SPREAD_LAT.format("c_custkey")} AS lat,
  {SPREAD_LNG.format("c_custkey")} AS lng, {SPREAD_LAT.format("c_custkey")} + (CAST((c_custkey * 3 + i) % 5 AS DOUBLE) - 2.2e0) * 0.0003e0 AS tlat,
  {SPREAD_LNG.format("c_custkey")} + (CAST((c_custkey * 7 + i * 2) % 5 AS DOUBLE) - 1.7e0) * 0.0003e0 AS tlng
  FROM (SELECT c_custkey, unnest(range(CAST(c_custkey % 4 AS BIGINT))) AS i FROM customer))""")


def _laned(b):
    k = F.col("c_custkey")
    lat, lng = b.spread(k)
    n = (k % 4).cast("int")

    def lane(i):
        s = (F.col("stand_id") + i) % 3
        return F.struct(
            (F.col("lat") + (((F.col("stand_id") * 3 + i) % 5).cast("double") - 2.2) * 0.0003).alias("lat"),
            (F.col("lng") + (((F.col("stand_id") * 7 + i * 2) % 5).cast("double") - 1.7) * 0.0003).alias("lng"),
            F.concat(F.lit("L"), i.cast("string")).alias("label"),
            F.when(s != 0, F.lit(4.0) + i * 30).alias("spread"))

    # a small file is read by one task, but its lanes are much work: stands are dealt to all cores
    rows = b.table("customer").select(k.alias("stand_id"), lat, lng, n.alias("n")).repartition(4 * b.spark.sparkContext.defaultParallelism, "stand_id")
    made = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(0), F.col("n") - 1), lane)).otherwise(
        F.slice(F.transform(F.sequence(F.lit(0), F.lit(0)), lane), 1, 0))
    return rows.withColumn("raw", made).withColumn("lanes", F.transform("raw", lambda x: lanes.lane_geometry(
        F.col("lat"), F.col("lng"), x)))


def _once(value):
    """A value that a filter on it neither works out again nor takes down to where the file is read."""
    return F.explode(F.array(value))


@query("lane_geometry", needs=("lane",), sql="""
SELECT stand_id, 'L' || i AS label, bearing, CAST(metres AS BIGINT) AS metres, coalesce(greatest(3e0, least(80e0, spread)), 10e0) AS spread,
  floor(2 * metres * tan(radians(coalesce(greatest(3e0, least(80e0, CASE WHEN spread IS NOT NULL THEN spread END)), 10e0))) * 10 + 0.5) / 10 AS width_m FROM (
  SELECT stand_id, i, bearing, metres, CASE WHEN spread IS NULL THEN 10e0 ELSE spread END AS spread FROM lane)""")
def lane_geometry(b):
    return _laned(b).select("stand_id", F.explode("lanes").alias("g")).select(
        "stand_id", "g.label", "g.bearing", "g.metres", "g.spread", "g.width_m")


@query("lane_huntable_winds", needs=("lane",), sql=f"""
WITH w AS (SELECT CAST(unnest(range(16)) AS INT) AS i), j AS (SELECT DISTINCT l.stand_id, w.i FROM lane l, w
  WHERE abs({wrap_sql("((w.i * 22.5e0 + 180e0) % 360e0) - l.bearing + 180e0")} - 180e0) <= 30 + CASE WHEN l.spread IS NULL THEN 10e0 ELSE greatest(3e0, least(80e0, l.spread)) END)
SELECT s.stand_id, string_agg(['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'][w.i + 1], ',' ORDER BY w.i) AS winds
FROM (SELECT DISTINCT stand_id FROM lane) s, w WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.stand_id = s.stand_id AND j.i = w.i) GROUP BY 1""")
def lane_huntable_winds(b):
    out = _laned(b).select("stand_id", _once(lanes.huntable_winds(F.col("lanes"))).alias("w"))
    return out.where(F.size("w") > 0).select("stand_id", F.array_join("w", ",").alias("winds"))


@query("stand_wind_sources", sql="""
SELECT c_custkey AS stand_id, CASE WHEN c_custkey % 4 > 0 THEN 'lanes' WHEN c_custkey % 3 = 0 THEN 'ticked' ELSE 'none' END AS source FROM customer""")
def stand_wind_sources(b):
    ticks = F.when(F.col("stand_id") % 3 == 0, F.array(F.lit("N"), F.lit("NE")))
    return _laned(b).select("stand_id", lanes.stand_winds(F.col("lanes"), ticks)["source"].alias("source"))


@query("grid_covering_box", needs=("stand",), sql="""
WITH g AS (SELECT s_suppkey AS grid_id, 5 + s_suppkey % 3 * 5 AS spacing, 44e0 + CAST(s_suppkey % 97 AS DOUBLE) * 0.01e0 - 0.015e0 AS south,
  -90e0 - CAST(s_suppkey % 89 AS DOUBLE) * 0.012e0 - 0.02e0 AS west FROM supplier),
k AS (SELECT s.stand_id, g.grid_id, row_number() OVER (PARTITION BY s.stand_id ORDER BY g.spacing, g.grid_id) AS r FROM stand s
  JOIN g ON s.lat >= g.south AND s.lng >= g.west AND s.lat + 0.001e0 <= g.south + 0.03e0 AND s.lng + 0.001e0 <= g.west + 0.04e0 AND g.spacing <= 10)
SELECT s.stand_id AS want_id, k.grid_id FROM stand s LEFT JOIN k ON k.stand_id = s.stand_id AND k.r = 1""")
def grid_covering_box(b):
    from fieldlens.sources.grids import grid_covering
    k = F.col("s_suppkey")
    lat, lng = b.place(k)
    boxes = b.table("supplier").select(k.alias("grid_id"), (k % 3 * 5 + 5).alias("spacing_m"), (lat - 0.015).alias("south"),
                                       (lng - 0.02).alias("west")).withColumns({
        "north": F.col("south") + 0.03, "east": F.col("west") + 0.04})
    wanted = b.stands().select(F.col("stand_id").alias("want_id"), F.col("lng").alias("west"), F.col("lat").alias("south"),
                               (F.col("lng") + 0.001).alias("east"), (F.col("lat") + 0.001).alias("north"), F.lit(10).alias("spacing_m"))
    return grid_covering(wanted, boxes).select("want_id", "grid_id")


@query("planned_grids", needs=("stand",), sql="""
SELECT stand_id, CAST(greatest(2, floor(0.004e0 / (12e0 / 110540e0) + 0.5) + 1) AS BIGINT) AS rows,
  CAST(greatest(2, floor((lng + 0.006e0 - lng) / (12e0 / (111320e0 * cos(radians((lat + 0.004e0 + lat) / 2)))) + 0.5) + 1) AS BIGINT) AS cols FROM stand""")
def planned_grids(b):
    from fieldlens.sources.grids import plan_grids
    want = b.stands().select("stand_id", F.col("lng").alias("west"), F.col("lat").alias("south"), (F.col("lng") + 0.006).alias("east"),
                             (F.col("lat") + 0.004).alias("north"), F.lit(12.0).alias("spacing_m"))
    return plan_grids(want).select("stand_id", "rows", "cols")


@query("default_centre_and_coverage", needs=("pin",), sql="""
SELECT CASE WHEN kind = 'camera' THEN 'camera' ELSE 'stand' END AS kind, count(*) AS pins, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng FROM pin GROUP BY ROLLUP (1)""")
def default_centre_and_coverage(b):
    return b.pins().rollup("kind").agg(F.count("*").alias("pins"), round6(F.avg("lat")).alias("lat"), round6(F.avg("lng")).alias("lng"))


@query("distinct_parcel_owners", needs=("parcel",), sql="""
SELECT DISTINCT coalesce('id:' || parcel_id, 'owner:' || owner) AS key FROM parcel WHERE coalesce(parcel_id, owner) IS NOT NULL""")
def distinct_parcel_owners(b):
    land = parcels.normalise(b.raw_parcels())
    return land.select(parcels.parcel_key(F.col("parcel_id"), F.col("owner")).alias("key")).where(F.col("key").isNotNull()).distinct()


@query("winds_compared", needs=("lane",), sql=f"""
WITH w AS (SELECT CAST(unnest(range(16)) AS INT) AS i), j AS (SELECT DISTINCT l.stand_id, w.i FROM lane l, w
  WHERE abs({wrap_sql("((w.i * 22.5e0 + 180e0) % 360e0) - l.bearing + 180e0")} - 180e0) <= 30 + CASE WHEN l.spread IS NULL THEN 10e0 ELSE greatest(3e0, least(80e0, l.spread)) END),
c AS (SELECT s.stand_id, w.i, NOT EXISTS (SELECT 1 FROM j WHERE j.stand_id = s.stand_id AND j.i = w.i) AS derived, w.i IN (0, 4, 8) AS ticked FROM (SELECT DISTINCT stand_id FROM lane) s, w)
SELECT stand_id, count(*) FILTER (WHERE ticked AND NOT derived) = 0 AND count(*) FILTER (WHERE derived AND NOT ticked) = 0 AS agree,
  count(*) FILTER (WHERE ticked AND NOT derived) AS only_ticked, count(*) FILTER (WHERE derived AND NOT ticked) AS only_derived FROM c GROUP BY 1""")
def winds_compared(b):
    ticked = F.array(F.lit("N"), F.lit("E"), F.lit("S"), F.lit("bogus"))
    out = _laned(b).select("stand_id", _once(lanes.winds_compared(lanes.huntable_winds(F.col("lanes")), ticked)).alias("c")).where(F.col("c").isNotNull())
    return out.select("stand_id", "c.agree", F.size("c.only_ticked").cast("bigint").alias("only_ticked"),
                      F.size("c.only_derived").cast("bigint").alias("only_derived"))
