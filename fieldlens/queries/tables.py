"""SQL table expressions matching `Bindings`, shared by the checks."""

from __future__ import annotations

from fieldlens.queries.registry import table_sql

table_sql("cam", """SELECT DISTINCT user_id % 5 AS camera_id, (user_id % 5) % 3 AS location_id,
  44e0 + CAST(user_id % 5 AS DOUBLE) * 0.013e0 AS lat,
  -90e0 - CAST(user_id % 5 AS DOUBLE) * 0.37e0 AS lng FROM events""")

table_sql("photo", """SELECT event_id AS photo_id, user_id % 5 AS camera_id, ts AS taken_at,
  epoch_us(ts) AS us, date_trunc('hour', ts) AS hour_utc, props AS raw FROM events""")

table_sql("det", """SELECT event_id AS photo_id, event_type AS species, 1 + event_id % 3 AS n,
  CASE WHEN event_id % 7 = 0 THEN user_id % 4 END AS individual_id,
  CASE WHEN event_id % 3 = 0 THEN 'manual' ELSE 'camera-ai' END AS source,
  (event_id % 3 = 0 OR event_id % 5 = 0) AS confirmed FROM events""")

table_sql("indiv", """SELECT CAST(n_nationkey AS BIGINT) AS individual_id,
  n_name AS individual_name FROM nation""")

table_sql("span", """SELECT user_id % 5 AS camera_id, CAST(min(ts) AS DATE) AS from_day,
  CAST(max(ts) AS DATE) AS to_day FROM events GROUP BY 1""")

table_sql("cday", """SELECT camera_id, day, CASE (extract(DAY FROM day) + camera_id) % 7
    WHEN 0 THEN 'quota-dark' WHEN 1 THEN 'silent' ELSE 'live' END AS state
  FROM (SELECT camera_id, CAST(unnest(generate_series(CAST(from_day AS TIMESTAMP),
    CAST(to_day AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM span)""", ("span",))

table_sql("wxd", """SELECT location_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day
  FROM (SELECT camera_id % 3 AS location_id, CAST(min(from_day) AS TIMESTAMP) AS a,
    CAST(max(to_day) AS TIMESTAMP) AS b FROM span GROUP BY 1)""", ("span",))

table_sql("wxh", """SELECT location_id, day, extract(DAY FROM day) AS dom,
  unnest(range(24)) AS h FROM wxd""", ("wxd",))

table_sql("wx", """SELECT location_id, CAST(day AS TIMESTAMP) + to_hours(CAST(h AS BIGINT)) AS hour_utc,
  CAST(epoch_us(CAST(day AS TIMESTAMP)) // 3600000000 + h AS BIGINT) AS hour_no,
  CAST(CASE WHEN (dom + h) % 19 <> 0 THEN (dom * 53 + h * 37 + location_id * 90) % 360 END AS DOUBLE) AS wind_dir,
  CAST((dom + h * 3 + location_id) % 25 AS DOUBLE) AS wind_mph,
  CAST(15 + (dom * 3 + h * 2 + location_id) % 60 AS DOUBLE) AS temp_f,
  29.5e0 + CAST((dom * 7 + h + location_id * 3) % 80 AS DOUBLE) * 0.01e0 AS pressure_inhg,
  CAST((dom + h) % 10 AS DOUBLE) * 0.02e0 AS precip_in,
  CAST((dom * 11 + h * 5) % 101 AS DOUBLE) AS cloud_pct FROM wxh""", ("wxh",))

table_sql("sight", """SELECT d.photo_id, d.species, d.n, d.individual_id, p.camera_id, p.us, p.taken_at,
  CASE WHEN d.confirmed THEN 'yours' ELSE 'camera' END AS claim
  FROM det d JOIN photo p ON p.photo_id = d.photo_id
  WHERE d.confirmed OR d.source = 'camera-ai'""", ("det", "photo"))

table_sql("sit", """SELECT o_orderkey AS sit_id, o_custkey % 10 AS stand_id,
  CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderkey % 2 = 0 THEN 'AM' ELSE 'PM' END AS "window",
  ['prime', 'strong', 'good', 'fair', 'poor'][CAST(substr(o_orderpriority, 1, 1) AS INT)] AS rating,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey % 6 END AS deer, o_custkey % 3 AS bucks,
  CAST((o_orderkey * 23) % 360 AS DOUBLE) AS predicted_wind_deg,
  CAST((o_orderkey * 23 + o_custkey % 4 * 20) % 360 AS DOUBLE) AS wind_deg,
  epoch_us(date_trunc('day', o_orderdate)) / 1e6 + CASE WHEN o_orderkey % 2 = 0 THEN 5 ELSE 15 END * 3600 AS start_s,
  epoch_us(date_trunc('day', o_orderdate)) / 1e6 + CASE WHEN o_orderkey % 2 = 0 THEN 5 ELSE 15 END * 3600
    + (o_custkey % 5) * 3600 AS end_s,
  (o_orderkey % 13 = 0) AS shot, (o_orderkey % 26 = 0) AS harvested FROM orders""")

table_sql("tele", """SELECT l_suppkey AS animal, l_returnflag AS sex,
  (l_orderkey * 7 + l_linenumber) % 24 AS hour, l_extendedprice AS rate, l_quantity AS temp,
  l_shipdate AS seen_at FROM lineitem""")

table_sql("reading", """SELECT l_partkey AS field_id, CAST(l_shipdate AS DATE) AS date,
  round(max(l_discount) * 9 + 0e0, 6) AS ndvi FROM lineitem GROUP BY 1, 2""")

table_sql("pin", """SELECT 'c' || c_custkey AS pin_id, 'stand' AS kind,
  44e0 + CAST(c_custkey % 97 AS DOUBLE) * 0.01e0 AS lat,
  -90e0 - CAST(c_custkey % 89 AS DOUBLE) * 0.012e0 AS lng, c_mktsegment AS property FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'camera',
  44e0 + CAST(s_suppkey % 97 AS DOUBLE) * 0.01e0,
  -90e0 - CAST(s_suppkey % 89 AS DOUBLE) * 0.012e0, NULL FROM supplier""")

table_sql("hash", """SELECT vec_id AS photo_id, CAST(label AS BIGINT) AS camera_id,
  'd1:' || array_to_string(list_transform(embedding, lambda v: substr('0123456789abcdef',
    1 + CASE WHEN CAST(v AS DOUBLE) > -0.1e0 THEN 8 ELSE 0 END
      + CASE WHEN CAST(v AS DOUBLE) > 0e0 THEN 4 ELSE 0 END
      + CASE WHEN CAST(v AS DOUBLE) > 0.05e0 THEN 2 ELSE 0 END
      + CASE WHEN CAST(v AS DOUBLE) > 0.1e0 THEN 1 ELSE 0 END, 1)), '') AS phash
  FROM embeddings""")

HAVERSINE = ("(2 * 6371000e0 * asin(least(1e0, sqrt(pow(sin(radians({b} - {a}) / 2), 2)"
             " + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2)))))")


def haversine_sql(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    return HAVERSINE.format(a=lat1, b=lat2, c=lng1, d=lng2)


def bearing_sql(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    d = f"radians({lng2} - {lng1})"
    return wrap_sql(f"degrees(atan2(sin({d}) * cos(radians({lat2})), cos(radians({lat1})) * sin(radians({lat2}))"
                    f" - sin(radians({lat1})) * cos(radians({lat2})) * cos({d}))) + 360e0")


def wrap_sql(x: str) -> str:
    return f"(((({x}) % 360e0) + 360e0) % 360e0)"


def compass_sql(deg: str) -> str:
    return ("['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW']"
            f"[CAST(floor({wrap_sql(deg)} / 22.5e0 + 0.5e0) AS INT) % 16 + 1]")


def octant_sql(deg: str) -> str:
    return ("['N','NE','E','SE','S','SW','W','NW']"
            f"[CAST(floor({wrap_sql(deg)} / 45e0 + 0.5e0) AS INT) % 8 + 1]")


def sun_steps(name: str, source: str, ms: str, lat: str = "lat", lng: str = "lng") -> list[tuple[str, str]]:
    """Table expressions ending in `name`: the source plus sunrise, sunset and noon in ms."""
    return [
        (f"{name}_a", f"SELECT *, floor({ms} / 86400000e0 - 10957.5e0 + 0.0008e0 + 0.5e0)"
                      f" - {lng} / 360e0 AS _noon FROM {source}"),
        (f"{name}_b", f"SELECT *, (357.5291e0 + 0.98560028e0 * _noon) % 360e0 AS _anom FROM {name}_a"),
        (f"{name}_c", "SELECT *, (_anom + 1.9148e0 * sin(radians(_anom)) + 0.02e0 * sin(radians(2 * _anom))"
                      f" + 0.0003e0 * sin(radians(3 * _anom)) + 180e0 + 102.9372e0) % 360e0 AS _ecl FROM {name}_b"),
        (f"{name}_d", "SELECT *, _noon + 0.0053e0 * sin(radians(_anom)) - 0.0069e0 * sin(radians(2 * _ecl)) AS _tr,"
                      f" asin(sin(radians(_ecl)) * sin(radians(23.44e0))) AS _decl FROM {name}_c"),
        (f"{name}_e", f"SELECT *, (sin(radians(-0.833e0)) - sin(radians({lat})) * sin(_decl))"
                      f" / (cos(radians({lat})) * cos(_decl)) AS _cw FROM {name}_d"),
        (f"{name}_f", "SELECT *, CASE WHEN _cw BETWEEN -1 AND 1 THEN"
                      f" degrees(acos(greatest(-1e0, least(1e0, _cw)))) / 360e0 END AS _half FROM {name}_e"),
        (name, "SELECT *, (_tr - _half + 10957.5e0) * 86400000e0 AS sunrise,"
               " (_tr + _half + 10957.5e0) * 86400000e0 AS sunset,"
               f" (_tr + 10957.5e0) * 86400000e0 AS noon FROM {name}_f"),
    ]


def sun_tables(name: str, source: str, ms: str, lat: str = "lat", lng: str = "lng") -> str:
    return ",\n".join(f"{n} AS ({q})" for n, q in sun_steps(name, source, ms, lat, lng))


def band_sql(ms: str, rise: str = "sunrise", sett: str = "sunset") -> str:
    w = "5400000e0"
    return (f"CASE WHEN {rise} IS NULL THEN 'unknown'"
            f" WHEN {ms} BETWEEN {rise} - {w} AND {rise} + {w} THEN 'dawn'"
            f" WHEN {ms} BETWEEN {sett} - {w} AND {sett} + {w} THEN 'dusk'"
            f" WHEN {ms} > {rise} + {w} AND {ms} < {sett} - {w} THEN 'day' ELSE 'night' END")


# watched hours, as table expressions: day grain, sun, then 24 rows each
table_sql("live_day", """SELECT d.camera_id, d.day, c.location_id, c.lat, c.lng,
  epoch_us(CAST(d.day AS TIMESTAMP)) / 1000e0 - c.lng / 15e0 * 3600000e0 AS midnight
  FROM cday d JOIN cam c ON c.camera_id = d.camera_id WHERE d.state = 'live'""", ("cday", "cam"))


previous = "live_day"
for step, text in sun_steps("live_sun", "live_day", "(midnight + 43200000e0)"):
    table_sql(step, text, (previous,))
    previous = step

table_sql("watched", """SELECT s.camera_id, s.location_id, s.day, s.local_hour, s.ms,
    CAST(floor(s.ms / 3600000e0) AS BIGINT) AS hour_no, s.lat, s.lng, """ + band_sql("s.ms", "s.sunrise", "s.sunset")
          + """ AS band, w.wind_dir, w.wind_mph, w.temp_f, w.pressure_inhg, """ + octant_sql("w.wind_dir")
          + """ AS wind_octant, w.location_id IS NOT NULL AS has_weather
  FROM (SELECT *, midnight + local_hour * 3600000e0 AS ms
        FROM (SELECT *, unnest(range(24)) AS local_hour FROM live_sun)) s
  LEFT JOIN wx w ON w.location_id = s.location_id
    AND w.hour_no = CAST(floor(s.ms / 3600000e0) AS BIGINT)""", ("live_sun", "wx"))
