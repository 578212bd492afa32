"""Column functions checked over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

import fieldlens.queries.planning as P
import fieldlens.queries.space  # noqa: F401
import fieldlens.queries.tables as T
from fieldlens.functions import compass, geo, hashes, lanes, score, solar
from fieldlens.functions.num import half_up, round6
from fieldlens.operators import routes
from fieldlens.operators.raster import undo_predictor
from fieldlens.queries.registry import query


def _pairs(b):
    k = F.col("c_custkey")
    lat, lng = b.place(k)
    return b.table("customer").select(k.alias("id"), lat, lng, (lat + (k % 7).cast("double") * 0.03 - 0.08).alias("lat2"),
                                      (lng + (k % 5).cast("double") * 0.05 - 0.09).alias("lng2"), (k * 47 % 360).cast("double").alias("deg"))


T.table_sql("pt", """SELECT *, lat + CAST(id % 7 AS DOUBLE) * 0.03e0 - 0.08e0 AS lat2, lng + CAST(id % 5 AS DOUBLE) * 0.05e0 - 0.09e0 AS lng2, CAST(id * 47 % 360 AS DOUBLE) AS deg
  FROM (SELECT c_custkey AS id, 44e0 + CAST(c_custkey % 97 AS DOUBLE) * 0.01e0 AS lat, -90e0 - CAST(c_custkey % 89 AS DOUBLE) * 0.012e0 AS lng FROM customer)""")


@query("geo_distance_bearing", needs=("pt",), sql=f"""
SELECT id, round({T.haversine_sql("lat", "lng", "lat2", "lng2")}, 4) AS metres, round({T.bearing_sql("lat", "lng", "lat2", "lng2")}, 5) AS bearing FROM pt""")
def geo_distance_bearing(b):
    c = {n: F.col(n) for n in ("lat", "lng", "lat2", "lng2")}
    m, d = geo.haversine_m(*c.values()), geo.bearing_deg(*c.values())
    return _pairs(b).select("id", (F.floor(m * 1e4 + 0.5) / 1e4).alias("metres"), (F.floor(d * 1e5 + 0.5) / 1e5).alias("bearing"))


@query("geo_offset_point", needs=("pt",), sql="""
SELECT id, round(lat + degrees(500e0 * cos(radians(deg)) / 6371008.8e0), 6) AS lat, round(lng + degrees(500e0 * sin(radians(deg)) / (6371008.8e0 * cos(radians(lat)))), 6) AS lng FROM pt""")
def geo_offset_point(b):
    p = geo.offset_point(F.col("lat"), F.col("lng"), F.col("deg"), F.lit(500.0))
    return _pairs(b).select("id", round6(p["lat"]).alias("lat"), round6(p["lng"]).alias("lng"))


@query("compass_and_octants", needs=("pt",), sql=f"""
SELECT id, {T.compass_sql("deg - 400e0")} AS point, {T.octant_sql("deg - 400e0")} AS octant,
  least(abs(CAST(floor(deg / 22.5e0 + 0.5) AS INT) % 16 - 3), 16 - abs(CAST(floor(deg / 22.5e0 + 0.5) AS INT) % 16 - 3)) AS from_ene FROM pt""")
def compass_and_octants(b):
    d = F.col("deg") - 400.0
    return _pairs(b).select("id", compass.compass_point(d).alias("point"), compass.octant(d).alias("octant"),
                            compass.points_apart(compass.compass_point(F.col("deg")), F.lit("ENE")).cast("int").alias("from_ene"))


@query("location_keys", needs=("pt",), sql="""
SELECT id, floor(lat2 * 10000 + 0.5) / 10000 AS lat4, floor(lng2 * 10000 + 0.5) / 10000 AS lng4, floor(lat2 * 100 + 0.5) / 100 AS lat2, floor(lng2 * 100 + 0.5) / 100 AS lng2 FROM pt""")
def location_keys(b):
    loc, cl = geo.location_key(F.col("lat2"), F.col("lng2")), geo.climate_key(F.col("lat2"), F.col("lng2"))
    return _pairs(b).select("id", loc["lat"].alias("lat4"), loc["lng"].alias("lng4"), cl["lat"].alias("lat2"), cl["lng"].alias("lng2"))


@query("tile_cover", needs=("pt",), sql="""
SELECT id, (x1 - x0 + 1) * (y1 - y0 + 1) AS tiles, x0 AS west_x, y0 AS north_y FROM (SELECT id, CAST(floor((lng + 180) / 360 * 4096) AS BIGINT) AS x0,
  CAST(floor((lng + 0.3e0 + 180) / 360 * 4096) AS BIGINT) AS x1, CAST(floor((1 - ln(tan(radians(lat + 0.2e0)) + 1 / cos(radians(lat + 0.2e0))) / pi()) / 2 * 4096) AS BIGINT) AS y0,
  CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 4096) AS BIGINT) AS y1 FROM pt)""")
def tile_cover(b):
    cover = geo.tile_cover(F.col("lng"), F.col("lat"), F.col("lng") + 0.3, F.col("lat") + 0.2, 12)
    t = _pairs(b).select("id", F.explode(cover).alias("t"))
    return t.groupBy("id").agg(F.count("*").alias("tiles"), F.min("t.x").alias("west_x"), F.min("t.y").alias("north_y"))


@query("utm_zones", needs=("pt",), sql="SELECT id, CAST(floor((((lng * 2 + 180) % 360 + 360) % 360) / 6) + 1 AS BIGINT) AS zone FROM pt")
def utm_zones(b):
    return _pairs(b).select("id", geo.utm_zone(F.col("lng") * 2.0).alias("zone"))


@query("projections", needs=("pt",), sql="""
WITH k AS (SELECT *, radians(lat) AS phi, 6378137e0 AS a, 0.0066943799901413165e0 AS e2, 0.0066943799901413165e0 / (1 - 0.0066943799901413165e0) AS ep2,
  radians(lng) - radians(floor((((lng + 180) % 360 + 360) % 360) / 6) * 6 - 177) AS dl FROM pt),
u AS (SELECT *, a / sqrt(1 - e2 * sin(phi) * sin(phi)) AS nu, tan(phi) * tan(phi) AS t, ep2 * cos(phi) * cos(phi) AS c, dl * cos(phi) AS aa,
  a * ((1 - e2 / 4 - 3 * pow(e2, 2) / 64 - 5 * pow(e2, 3) / 256) * phi - (3 * e2 / 8 + 3 * pow(e2, 2) / 32 + 45 * pow(e2, 3) / 1024) * sin(2 * phi)
    + (15 * pow(e2, 2) / 256 + 45 * pow(e2, 3) / 1024) * sin(4 * phi) - 35 * pow(e2, 3) / 3072 * sin(6 * phi)) AS m FROM k),
q AS (SELECT f.*, x.e AS e, (1 - x.z) * (sin(phi) / (1 - x.z * sin(phi) * sin(phi)) - ln((1 - x.e * sin(phi)) / (1 + x.e * sin(phi))) / (2 * x.e)) AS q,
  x.z AS z FROM u f, (SELECT 0.00669438002290e0 AS z, sqrt(0.00669438002290e0) AS e) x),
s AS (SELECT e, z, (1 - z) * (sin(radians(23e0)) / (1 - z * pow(sin(radians(23e0)), 2)) - ln((1 - e * sin(radians(23e0))) / (1 + e * sin(radians(23e0)))) / (2 * e)) AS q0,
  (1 - z) * (sin(radians(29.5e0)) / (1 - z * pow(sin(radians(29.5e0)), 2)) - ln((1 - e * sin(radians(29.5e0))) / (1 + e * sin(radians(29.5e0)))) / (2 * e)) AS q1,
  (1 - z) * (sin(radians(45.5e0)) / (1 - z * pow(sin(radians(45.5e0)), 2)) - ln((1 - e * sin(radians(45.5e0))) / (1 + e * sin(radians(45.5e0)))) / (2 * e)) AS q2,
  cos(radians(29.5e0)) / sqrt(1 - z * pow(sin(radians(29.5e0)), 2)) AS m1, cos(radians(45.5e0)) / sqrt(1 - z * pow(sin(radians(45.5e0)), 2)) AS m2
  FROM (SELECT 0.00669438002290e0 AS z, sqrt(0.00669438002290e0) AS e)),
n AS (SELECT *, (m1 * m1 - m2 * m2) / (q2 - q1) AS n, m1 * m1 + (m1 * m1 - m2 * m2) / (q2 - q1) * q1 AS c FROM s)
SELECT id, CAST(floor((0.9996e0 * nu * (aa + (1 - t + q.c) * pow(aa, 3) / 6 + (5 - 18 * t + t * t + 72 * q.c - 58 * ep2) * pow(aa, 5) / 120) + 500000) * 100 + 0.5) AS BIGINT) AS easting,
  CAST(floor(0.9996e0 * (m + nu * tan(phi) * (aa * aa / 2 + (5 - t + 9 * q.c + 4 * q.c * q.c) * pow(aa, 4) / 24 + (61 - 58 * t + t * t + 600 * q.c - 330 * ep2) * pow(aa, 6) / 720)) * 100 + 0.5) AS BIGINT) AS northing,
  CAST(floor(a * sqrt(n.c - n.n * q.q) / n.n * sin(n.n * (radians(lng) - radians(-96e0))) * 100 + 0.5) AS BIGINT) AS ax,
  CAST(floor((a * sqrt(n.c - n.n * q0) / n.n - a * sqrt(n.c - n.n * q.q) / n.n * cos(n.n * (radians(lng) - radians(-96e0)))) * 100 + 0.5) AS BIGINT) AS ay FROM q, n""")
def projections(b):
    u = geo.to_utm(F.col("lat"), F.col("lng"), geo.utm_zone(F.col("lng")))
    a = geo.to_albers(F.col("lat"), F.col("lng"))
    cm = {"easting": u["x"], "northing": u["y"], "ax": a["x"], "ay": a["y"]}
    return _pairs(b).select("id", *[half_up(c * 100.0).alias(n) for n, c in cm.items()])


@query("ring_measures", needs=("sfield",), sql=f"""
WITH e AS (SELECT field_id, e.a.x AS xa, e.a.y AS ya, e.b.x AS xb, e.b.y AS yb FROM (SELECT field_id, unnest([{{'a': ring[1], 'b': ring[2]}}, {{'a': ring[2], 'b': ring[3]}},
  {{'a': ring[3], 'b': ring[4]}}, {{'a': ring[4], 'b': ring[1]}}]) AS e FROM sfield))
SELECT field_id, round(sum({T.haversine_sql("ya", "xa", "yb", "xb")}), 3) AS perimeter_m,
  round(abs(sum(radians(xb - xa) * (2 + sin(radians(ya)) + sin(radians(yb)))) * 6371008.8e0 * 6371008.8e0 / 2) / 4046.8564224e0, 3) AS acres FROM e GROUP BY 1""")
def ring_measures(b):
    r = F.col("ring")
    return b.spread_fields().select("field_id", (F.floor(geo.ring_perimeter_m(r) * 1e3 + 0.5) / 1e3).alias("perimeter_m"),
                                    (F.floor(geo.ring_acres(r) * 1e3 + 0.5) / 1e3).alias("acres"))


@query("ring_centres", needs=("sfield",), sql="""
SELECT field_id, round((ring[1].y + ring[2].y + ring[3].y + ring[4].y) / 4, 6) AS mean_lat, round((ring[1].x + ring[2].x + ring[3].x + ring[4].x) / 4, 6) AS mean_lng,
  round((least(ring[1].x, ring[4].x) + greatest(ring[2].x, ring[3].x)) / 2, 6) AS box_lng FROM sfield""")
def ring_centres(b):
    m, c = geo.ring_vertex_mean(F.col("ring")), geo.ring_box_centre(F.col("ring"))
    return b.spread_fields().select("field_id", round6(m["lat"]).alias("mean_lat"), round6(m["lng"]).alias("mean_lng"), round6(c["lng"]).alias("box_lng"))


# ---- sun, moon, season ------------------------------------------------------------------

T.table_sql("sunpt", "SELECT photo_id, p.us / 1000e0 AS ms, c.lat + CAST(photo_id % 50 AS DOUBLE) AS lat, c.lng FROM photo p JOIN cam c ON c.camera_id = p.camera_id", ("photo", "cam"))


def _sun_points(b):
    return b.photos().join(b.cameras(), "camera_id").select(
        "photo_id", solar.millis(F.col("taken_at")).alias("ms"), (F.col("lat") + (F.col("photo_id") % 50).cast("double")).alias("lat"), "lng")


@query("sun_times", needs=("sunpt",), sql="WITH " + T.sun_tables("s", "sunpt", "ms") + """
SELECT photo_id, CAST(floor(sunrise / 1000 + 0.5) AS BIGINT) AS sunrise_s, CAST(floor(sunset / 1000 + 0.5) AS BIGINT) AS sunset_s FROM s""")
def sun_times(b):
    s = solar.with_sun(_sun_points(b), F.col("ms"), F.col("lat"), F.col("lng"))
    return s.select("photo_id", half_up(F.col("sunrise") / 1000.0).alias("sunrise_s"), half_up(F.col("sunset") / 1000.0).alias("sunset_s"))


@query("light_bands", needs=("sunpt",), sql="WITH " + T.sun_tables("s", "sunpt", "ms") + f", p2 AS (SELECT *, "
       "floor((ms + lng / 15e0 * 3600000e0) / 86400000e0) * 86400000e0 + 43200000e0 - lng / 15e0 * 3600000e0 AS noon_ms FROM sunpt), "
       + T.sun_tables("z", "p2", "noon_ms") + f"""
SELECT s.photo_id, {T.band_sql("s.ms", "s.sunrise", "s.sunset")} AS utc_band, {T.band_sql("z.ms", "z.sunrise", "z.sunset")} AS solar_band
FROM s JOIN z ON z.photo_id = s.photo_id""")
def light_bands(b):
    pts = _sun_points(b)
    one = solar.with_light_band(pts, F.col("ms"), F.col("lat"), F.col("lng")).withColumnRenamed("band", "utc_band")
    two = solar.with_solar_band(one, F.col("ms"), F.col("lat"), F.col("lng"))
    return two.select("photo_id", "utc_band", F.col("band").alias("solar_band"))


@query("solar_days_hours", needs=("sunpt",), sql="""
SELECT photo_id, CAST(DATE '1970-01-01' + CAST(floor((ms + lng / 15e0 * 3600000e0) / 86400000e0) AS INT) AS VARCHAR) AS day,
  CAST(floor((ms + lng / 15e0 * 3600000e0) / 3600000e0) AS BIGINT) % 24 AS hour FROM sunpt""")
def solar_days_hours(b):
    return _sun_points(b).select("photo_id", solar.solar_day(F.col("ms"), F.col("lng")).cast("string").alias("day"),
                                 solar.solar_hour(F.col("ms"), F.col("lng")).alias("hour"))


@query("moon_phases", sql="""
SELECT o_orderkey AS id, round((1 - cos(2 * pi() * f)) / 2, 6) AS illum, CASE WHEN f < 0.02e0 THEN 'new' WHEN f < 0.24e0 THEN 'waxing crescent' WHEN f < 0.27e0 THEN 'first quarter'
  WHEN f < 0.48e0 THEN 'waxing gibbous' WHEN f < 0.52e0 THEN 'full' WHEN f < 0.73e0 THEN 'waning gibbous' WHEN f < 0.77e0 THEN 'last quarter' WHEN f < 0.98e0 THEN 'waning crescent' ELSE 'new' END AS name
FROM (SELECT o_orderkey, (((epoch_us(o_orderdate) / 1e6 - 947182440e0) / 86400e0 / 29.530588853e0) % 1e0 + 1e0) % 1e0 AS f FROM orders)""")
def moon_phases(b):
    m = solar.moon_phase(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000.0)
    return b.table("orders").select(F.col("o_orderkey").alias("id"), round6(m["illum"]).alias("illum"), m["name"].alias("name"))


@query("season_phases", sql=f"""
SELECT id, {P.CALENDAR.format(*["'" + x + "'" for x in P.PHASES])} AS phase, {P.CALENDAR.format(10, 6, 18, 26, 30, 24, 16, 8, 12, 10, 2)} AS score, round({P.NORMAL}, 6) AS normal_f
FROM (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day FROM orders)""")
def season_phases(b):
    day = F.to_date("o_orderdate")
    s = solar.season_phase(day)
    return b.table("orders").select(F.col("o_orderkey").alias("id"), s["phase"].alias("phase"), s["score"].alias("score"),
                                    round6(solar.seasonal_normal_f(day)).alias("normal_f"))


@query("legal_light", sql="""
WITH h AS (SELECT o_orderkey AS id, epoch_us(date_trunc('day', o_orderdate)) / 1000e0 + 21600000e0 + (o_custkey % 60) * 60000e0 AS rise,
  epoch_us(date_trunc('day', o_orderdate)) / 1000e0 + 61200000e0 - (o_custkey % 50) * 60000e0 AS sett,
  epoch_us(date_trunc('day', o_orderdate)) / 1000e0 + (o_orderkey % 24) * 3600000e0 AS now, o_custkey % 900 AS m, CASE WHEN o_orderkey % 2 = 0 THEN 'AM' ELSE 'PM' END AS w FROM orders),
g AS (SELECT *, rise - 1800000e0 + 21600000e0 AS op, sett + 1200000e0 + 21600000e0 AS cl FROM h)
SELECT id, CAST(floor((cl - op) / 60000 + 0.5) AS BIGINT) AS minutes, CASE WHEN now < op THEN 'before' WHEN now > cl THEN 'after' WHEN floor((cl - now) / 60000 + 0.5) <= 30 THEN 'last-light' ELSE 'open' END AS phase,
  CAST(floor((CASE WHEN w = 'AM' THEN op ELSE cl - 9000000e0 END - (30 + ceil(m / 0.9e0 / 60)) * 60000) / 1000 + 0.5) AS BIGINT) AS leave_s FROM g""")
def legal_light(b):
    day = F.date_trunc("day", F.col("o_orderdate").cast("timestamp"))
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    rise = F.timestamp_micros(F.unix_micros(day) + 21_600_000_000 + (c % 60) * 60_000_000)
    sett = F.timestamp_micros(F.unix_micros(day) + 61_200_000_000 - (c % 50) * 60_000_000)
    off = F.lit(-21600)
    hours = solar.shooting_hours(solar.local_instant_ms(rise, off), solar.local_instant_ms(sett, off))
    now = solar.millis(day) + (o % 24) * solar.HOUR_MS
    rows = b.table("orders").select(o.alias("id"), hours.alias("h"), now.alias("now"), (c % 900).alias("m"),
                                    F.when(o % 2 == 0, "AM").otherwise("PM").alias("w"))
    leave = solar.leave_by_ms(F.col("w"), F.col("h.open"), F.col("h.close"), F.col("m"))
    return rows.select("id", F.col("h.minutes").alias("minutes"), solar.light_phase(
        F.col("h.open"), F.col("h.close"), F.col("now")).alias("phase"), half_up(leave / 1000.0).alias("leave_s"))


@query("local_dates", sql="""
SELECT event_id AS id, CAST(CAST(ts - INTERVAL 6 HOUR AS DATE) AS VARCHAR) AS day, strftime(ts, '%-I:%M ') || lower(strftime(ts, '%p')) AS clock, CAST(epoch_us(date_trunc('hour', ts)) AS BIGINT) AS hour_us FROM events""")
def local_dates(b):
    at = F.col("ts").cast("timestamp")
    return b.table("events").select(F.col("event_id").alias("id"), solar.local_date(solar.millis(at), F.lit(-21600)).cast("string").alias("day"),
                                    solar.clock_face(at).alias("clock"), F.unix_micros(solar.hour_key(at)).alias("hour_us"))


# ---- lanes, hashes, scores --------------------------------------------------------------

@query("lane_arithmetic", needs=("pt",), sql="""
SELECT id, round(2 * (id % 80 + 5) * tan(radians(coalesce(greatest(3e0, least(80e0, CASE WHEN id % 4 <> 0 THEN CAST(id % 100 AS DOUBLE) ELSE 10e0 END)), 10e0))), 4) AS width,
  floor(greatest(3e0, least(80e0, degrees(atan((id % 30 + 1) / (2e0 * (id % 80 + 5)))))) * 10 + 0.5) / 10 AS spread FROM pt""")
def lane_arithmetic(b):
    k = F.col("id")
    m = (k % 80 + 5).cast("double")
    width = lanes.lane_width_m(m, lanes.lane_spread(F.when(k % 4 != 0, (k % 100).cast("double"))))
    return _pairs(b).select("id", (F.floor(width * 1e4 + 0.5) / 1e4).alias("width"),
                            lanes.spread_for_width(m, (k % 30 + 1).cast("double")).alias("spread"))


@query("camera_facings", needs=("viewer",), sql=f"""
SELECT camera_id, floor(d * 10 + 0.5) / 10 AS bearing, {T.compass_sql("d")} AS point FROM (SELECT camera_id, {T.bearing_sql("lat", "lng", "lat + 0.0002e0", "lng + (camera_id % 5 - 2) * 0.0002e0")} AS d FROM viewer)""")
def camera_facings(b):
    k = F.col("s_suppkey")
    lat, lng = b.spread(k)
    rows = b.table("supplier").select(k.alias("camera_id"), lat, lng)
    view = F.struct((F.col("lng") + (F.col("camera_id") % 5 - 2).cast("double") * 0.0002).alias("lng"), (F.col("lat") + 0.0002).alias("lat"),
                    F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("spread"))
    v = lanes.camera_view(F.col("lat"), F.col("lng"), view)
    return rows.select("camera_id", v["bearing"].alias("bearing"), v["point"].alias("point"))


@query("scent_taints", needs=("pt",), sql=f"""
SELECT id, m <= 200 AND (m < 1e-6 OR abs({T.wrap_sql("(deg + 180e0) - brg + 180e0")} - 180e0) <= 30) AS taints FROM (SELECT id, deg,
  {T.haversine_sql("lat", "lng", "lat + 0.0011e0", "lng + (id % 3) * 0.0007e0")} AS m, {T.bearing_sql("lat", "lng", "lat + 0.0011e0", "lng + (id % 3) * 0.0007e0")} AS brg FROM pt)""")
def scent_taints(b):
    t = routes.taints(F.col("lat"), F.col("lng"), F.col("lat") + 0.0011, F.col("lng") + (F.col("id") % 3).cast("double") * 0.0007, F.col("deg"))
    return _pairs(b).select("id", t.alias("taints"))


@query("densified_walks", needs=("rpoint",), sql=f"""
SELECT route_id, CAST(1 + sum(CASE WHEN pos > 0 THEN greatest(1, ceil(leg / 25)) END) AS BIGINT) AS points FROM (SELECT *, CASE WHEN pos > 0 THEN
  {T.haversine_sql("lag(lat) OVER w", "lag(lng) OVER w", "lat", "lng")} END AS leg FROM rpoint WINDOW w AS (PARTITION BY route_id ORDER BY pos)) GROUP BY 1""")
def densified_walks(b):
    return b.routes().select("route_id", F.size(routes.densify(F.col("points"), 25.0)).cast("bigint").alias("points"))


@query("hash_distances", needs=("hash",), sql="""
SELECT photo_id, CAST(list_sum(list_transform(range(16), lambda i: bit_count(xor(CAST('0x' || substr(phash, CAST(4 + 4 * i AS INT), 4) AS INT), 21845)))) AS BIGINT) AS bits FROM hash""")
def hash_distances(b):
    other = F.lit("d1:" + "5" * 64)
    return b.hashes().select("photo_id", hashes.hamming(F.col("phash"), other).cast("bigint").alias("bits"))


@query("difference_hashes", sql="""
SELECT vec_id, 'd1:' || array_to_string(list_transform(range(64), lambda k: substr('0123456789abcdef', CAST(1 + list_sum(list_transform(range(4), lambda j:
  CASE WHEN g[1 + k // 4 * 17 + k % 4 * 4 + j] < g[2 + k // 4 * 17 + k % 4 * 4 + j] THEN CAST(pow(2, 3 - j) AS INT) ELSE 0 END)) AS INT), 1)), '') AS phash
FROM (SELECT vec_id, list_transform(range(272), lambda i: CAST(embedding[1 + (i * 7) % 64] AS DOUBLE)) AS g FROM embeddings)""")
def difference_hashes(b):
    gray = F.transform(F.sequence(F.lit(0), F.lit(271)), lambda i: F.get("embedding", (i * 7 % 64).cast("int")).cast("double"))
    rows = b.table("embeddings").select("vec_id", gray.alias("gray"))
    return rows.select("vec_id", hashes.difference_hash(F.col("gray")).alias("phash"))


@query("thermals", sql=f"""
SELECT p_partkey AS id, CASE WHEN p_size % 25 >= 12 THEN 'strong' WHEN p_size % 25 >= 5 THEN 'moderate' WHEN p_size % 25 >= 2 THEN 'weak' ELSE 'none' END AS strength,
  CASE WHEN p_size % 25 >= 2 THEN {T.wrap_sql("p_partkey * 31 % 360 + CASE WHEN p_partkey % 2 = 0 THEN 180e0 ELSE 0e0 END")} END AS from_deg FROM part""")
def thermals(b):
    k = F.col("p_partkey")
    t = score.thermal((F.col("p_size") % 25).cast("double"), (k * 31 % 360).cast("double"), F.when(k % 2 == 0, "AM").otherwise("PM"))
    return b.table("part").select(k.alias("id"), t["strength"].alias("strength"), t["from_deg"].alias("from_deg"))


@query("weather_words", sql="""
SELECT p_partkey AS id, CASE WHEN c = 0 THEN 'clear' WHEN c = 1 THEN 'mostly clear' WHEN c = 2 THEN 'partly cloudy' WHEN c = 3 THEN 'overcast' WHEN c IN (45, 48) THEN 'fog'
  WHEN c BETWEEN 51 AND 57 THEN 'drizzle' WHEN c IN (61, 80) THEN 'light rain' WHEN c IN (63, 81) THEN 'rain' WHEN c IN (65, 82) THEN 'heavy rain' WHEN c IN (66, 67) THEN 'freezing rain'
  WHEN c IN (71, 85) THEN 'light snow' WHEN c = 73 THEN 'snow' WHEN c IN (75, 77, 86) THEN 'heavy snow' WHEN c >= 95 THEN 'thunderstorm' END AS word FROM (SELECT p_partkey, p_partkey % 100 AS c FROM part)""")
def weather_words(b):
    return b.table("part").select(F.col("p_partkey").alias("id"), score.weather_word(F.col("p_partkey") % 100).alias("word"))


@query("sit_advice", needs=("sitscore",), sql="""
SELECT location_id, CAST(day AS VARCHAR) AS day, "window", CASE WHEN phase LIKE '%best week%' OR phase LIKE '%seeking%' THEN 'sit all day' WHEN phase LIKE '%closing%' THEN 'hunt the doe groups'
  WHEN phase LIKE '%transition%' THEN 'hunt tight to cover' WHEN phase LIKE '%Late season%' OR phase LIKE '%recovery%' THEN 'hunt the best feed in the afternoon' END AS advice FROM sitscore""")
def sit_advice(b):
    return P._scored(b).select("location_id", F.col("day").cast("string").alias("day"), "window", score.sit_advice(F.col("phase")).alias("advice"))


@query("predictor_undone", sql="""
SELECT l_orderkey AS row_id, string_agg(CAST(s AS VARCHAR), ',' ORDER BY l_linenumber, rn) AS vals FROM (SELECT *, CAST(sum(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, rn) AS BIGINT) % 256 AS s FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) AS rn FROM lineitem)) GROUP BY 1""")
def predictor_undone(b):
    rows = b.table("lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(F.transform(F.array_sort(F.collect_list(
        F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("values"))
    return undo_predictor(rows, 8).select("row_id", F.array_join(F.col("values").cast("array<string>"), ",").alias("vals"))


@query("owner_terms", sql="""
SELECT p_partkey AS id, trim(regexp_replace(regexp_replace(upper(p_name || ' #' || p_brand || '! & Sons, Inc.'), '[^A-Z0-9 &.,''-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS term FROM part""")
def owner_terms(b):
    from fieldlens.operators.parcels import owner_term
    text = F.concat("p_name", F.lit(" #"), "p_brand", F.lit("! & Sons, Inc."))
    return b.table("part").select(F.col("p_partkey").alias("id"), owner_term(text).alias("term"))


@query("tile_bounds", sql="""
SELECT p_partkey AS id, round(p_partkey % 4096 * (2 * pi() * 6378137e0 / 4096) - pi() * 6378137e0, 2) AS west, round(pi() * 6378137e0 - p_size * (2 * pi() * 6378137e0 / 4096), 2) AS north FROM part""")
def tile_bounds(b):
    t = geo.tile_bounds_3857(F.col("p_partkey") % 4096, F.col("p_size"), 12)
    return b.table("part").select(F.col("p_partkey").alias("id"), *[(F.signum(t[n]) * F.floor(F.abs(t[n]) * 100 + 0.5) / 100).alias(n)
                                                                    for n in ("west", "north")])


@query("views_from_bearings", needs=("pt",), sql="""
SELECT id, round(lat + degrees(greatest(1e0, CAST(id % 60 AS DOUBLE)) * cos(radians(deg)) / 6371008.8e0), 6) AS to_lat FROM pt""")
def views_from_bearings(b):
    v = lanes.view_from_bearing(F.col("lat"), F.col("lng"), F.col("deg"), (F.col("id") % 60).cast("double"))
    return _pairs(b).select("id", round6(v["lat"]).alias("to_lat"))
