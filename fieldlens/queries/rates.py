"""Exposure, rates, evidence and estimates over the camera tables."""

from __future__ import annotations

from pyspark.sql import functions as F

import fieldlens.queries.tables as T
from fieldlens.functions.num import round6
from fieldlens.operators import exposure, rates
from fieldlens.operators.visits import visits
from fieldlens.plans import board as board_plan
from fieldlens.queries.registry import query


def _hours(b):
    return exposure.watched_hours(b.camera_days(), b.cameras(), b.weather())


def _sight(b, species=None):
    return rates.sightings(b.detections(), b.photos(), species)


@query("camera_band_board", needs=("watched", "photo", "sight"), sql="""
WITH slots AS (SELECT camera_id, us, CASE WHEN lag(us) OVER (PARTITION BY camera_id ORDER BY us) IS NULL
    OR us - lag(us) OVER (PARTITION BY camera_id ORDER BY us) > 300000000 THEN 1 ELSE 0 END AS opens FROM photo),
v AS (SELECT camera_id, CAST(sum(opens) AS BIGINT) AS visits FROM slots GROUP BY 1),
den AS (SELECT camera_id, band, count(*) AS hours FROM watched WHERE band <> 'unknown' GROUP BY 1, 2),
num AS (SELECT w.camera_id, w.band, count(*) AS hits FROM watched w
  JOIN sight s ON s.camera_id = w.camera_id AND s.us // 3600000000 = w.hour_no AND s.claim = 'yours' GROUP BY 1, 2)
SELECT d.camera_id, d.band, d.hours, coalesce(n.hits, 0) AS hits, v.visits,
  round(CASE WHEN d.hours >= 10 THEN coalesce(n.hits, 0) / d.hours * 100e0 END, 6) AS rate
FROM den d LEFT JOIN num n ON n.camera_id = d.camera_id AND n.band = d.band
JOIN v ON v.camera_id = d.camera_id""")
def camera_band_board(b):
    out = board_plan.camera_band_board(b.photos(), b.detections(), b.camera_days(), b.cameras(),
                                       b.weather())
    return out.withColumn("rate", round6("rate"))


@query("watched_hours", needs=("watched",), sql="""
SELECT camera_id, CAST(day AS VARCHAR) AS day, CAST(local_hour AS INT) AS local_hour, hour_no, band,
  wind_octant, temp_f, pressure_inhg, has_weather FROM watched""")
def watched_hours(b):
    return _hours(b).select("camera_id", F.col("day").cast("string").alias("day"), "local_hour",
                            "hour_no", "band", "wind_octant", "temp_f", "pressure_inhg", "has_weather")


@query("sightings_by_source", needs=("sight",), sql="""
SELECT claim, species, count(*) AS sightings FROM sight GROUP BY 1, 2""")
def sightings_by_source(b):
    return _sight(b).groupBy("claim", "species").agg(F.count("*").alias("sightings"))


@query("solar_curve", needs=("watched", "sight", "cam"), sql="""
WITH spine AS (SELECT camera_id, claim, unnest(range(24)) AS local_hour
  FROM (SELECT camera_id, unnest(['yours', 'camera']) AS claim FROM cam)),
den AS (SELECT camera_id, local_hour, count(*) AS hours FROM watched GROUP BY 1, 2),
num AS (SELECT s.camera_id, s.claim, CAST(floor((s.us / 1000e0 + c.lng / 15e0 * 3600000e0) / 3600000e0) AS BIGINT) % 24 AS local_hour,
  count(*) AS hits FROM sight s JOIN cam c ON c.camera_id = s.camera_id GROUP BY 1, 2, 3)
SELECT sp.camera_id, sp.claim, CAST(sp.local_hour AS INT) AS local_hour, coalesce(n.hits, 0) AS hits,
  coalesce(d.hours, 0) AS hours,
  round(CASE WHEN d.hours >= 10 THEN coalesce(n.hits, 0) / d.hours * 100e0 END, 6) AS rate
FROM spine sp LEFT JOIN den d ON d.camera_id = sp.camera_id AND d.local_hour = sp.local_hour
LEFT JOIN num n ON n.camera_id = sp.camera_id AND n.claim = sp.claim AND n.local_hour = sp.local_hour""")
def solar_curve(b):
    return rates.solar_curve(_hours(b), _sight(b), b.cameras()).select(
        "camera_id", "claim", "local_hour", "hits", "hours", round6("rate").alias("rate"))


T.table_sql("cut", """SELECT camera_id, hour_no, unnest(['light', 'wind', 'temp', 'pressure']) AS axis,
  unnest([CASE WHEN band <> 'unknown' THEN band END, wind_octant,
    CASE WHEN temp_f < 20 THEN 'lt20' WHEN temp_f < 35 THEN '20s' WHEN temp_f < 50 THEN '30s'
         WHEN temp_f < 65 THEN '50s' WHEN temp_f >= 65 THEN 'gte65' END,
    CASE WHEN pressure_inhg < 29.8e0 THEN 'low' WHEN pressure_inhg > 30.1e0 THEN 'high'
         WHEN pressure_inhg IS NOT NULL THEN 'mid' END]) AS bucket FROM watched""", ("watched",))
T.table_sql("axis_cells", """SELECT sp.camera_id, sp.claim, sp.axis, sp.bucket, coalesce(d.hours, 0) AS hours,
  coalesce(n.hits, 0) AS hits, CASE WHEN d.hours >= 10 THEN coalesce(n.hits, 0) / d.hours * 100e0 END AS rate
FROM (SELECT camera_id, claim, x.axis AS axis, unnest(x.b) AS bucket FROM (
  SELECT camera_id, claim, unnest([{'axis': 'light', 'b': ['dawn', 'day', 'dusk', 'night']},
    {'axis': 'wind', 'b': ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW']},
    {'axis': 'temp', 'b': ['lt20', '20s', '30s', '50s', 'gte65']},
    {'axis': 'pressure', 'b': ['low', 'mid', 'high']}]) AS x
  FROM (SELECT camera_id, unnest(['yours', 'camera']) AS claim FROM cam))) sp
LEFT JOIN (SELECT camera_id, axis, bucket, count(*) AS hours FROM cut GROUP BY 1, 2, 3) d
  ON d.camera_id = sp.camera_id AND d.axis = sp.axis AND d.bucket = sp.bucket
LEFT JOIN (SELECT c.camera_id, s.claim, c.axis, c.bucket, count(*) AS hits FROM cut c
  JOIN sight s ON s.camera_id = c.camera_id AND s.us // 3600000000 = c.hour_no GROUP BY 1, 2, 3, 4) n
  ON n.camera_id = sp.camera_id AND n.claim = sp.claim AND n.axis = sp.axis AND n.bucket = sp.bucket""",
            ("cut", "sight", "cam"))


def _axis(b):
    return rates.axis_rates(_hours(b), rates.hourly_hits(_sight(b)), b.cameras())


@query("axis_rates", needs=("axis_cells",), sql="""
SELECT camera_id, claim, axis, bucket, hits, hours, round(rate, 6) AS rate,
  CASE axis WHEN 'light' THEN 'A' WHEN 'pressure' THEN 'D' ELSE 'B' END AS tier FROM axis_cells""")
def axis_rates(b):
    return _axis(b).select("camera_id", "claim", "axis", "bucket", "hits", "hours",
                           round6("rate").alias("rate"), "tier")


@query("axis_unknown_hours", needs=("cut",), sql="""
SELECT camera_id, axis, count(*) FILTER (WHERE bucket IS NULL) AS "unknown" FROM cut GROUP BY 1, 2""")
def axis_unknown_hours(b):
    return rates.unknown_hours(_hours(b))


@query("rate_lookup_and_peak", needs=("axis_cells",), sql="""
SELECT camera_id, axis, bucket, round(rate, 6) AS rate,
  round(coalesce(max(rate) OVER (), 0e0), 6) AS peak
FROM axis_cells WHERE claim = 'camera' AND axis = 'wind' AND bucket = 'NW'""")
def rate_lookup_and_peak(b):
    return rates.rate_lookup(_axis(b), "camera", "wind", "NW").select(
        "camera_id", "axis", "bucket", round6("rate").alias("rate"), round6("peak").alias("peak"))


@query("camera_board", needs=("watched", "sight", "cam"), sql="""
SELECT c.camera_id, c.claim, coalesce(w.hours, 0) AS hours, coalesce(w.wxh, 0) AS weather_hours,
  coalesce(n.hits, 0) AS hits, round(CASE WHEN w.hours >= 10 THEN coalesce(n.hits, 0) / w.hours * 100e0 END, 6) AS rate
FROM (SELECT camera_id, unnest(['yours', 'camera']) AS claim FROM cam) c
LEFT JOIN (SELECT camera_id, count(*) AS hours, count(*) FILTER (WHERE has_weather) AS wxh FROM watched GROUP BY 1) w
  ON w.camera_id = c.camera_id
LEFT JOIN (SELECT camera_id, claim, count(*) AS hits FROM sight GROUP BY 1, 2) n
  ON n.camera_id = c.camera_id AND n.claim = c.claim""")
def camera_board(b):
    return (rates.board(_hours(b), _sight(b), b.cameras())
            .withColumn("rate", round6("rate"))
            .orderBy("claim", F.col("rate").desc_nulls_last()))


@query("individual_camera_rates", needs=("watched", "sight", "indiv"), sql="""
SELECT i.individual_id, i.individual_name, s.camera_id, count(s.claim) AS hits, coalesce(any_value(w.hours), 0) AS hours,
  round(CASE WHEN any_value(w.hours) >= 10 THEN count(s.claim) / any_value(w.hours) * 100e0 END, 6) AS rate
FROM indiv i LEFT JOIN (SELECT * FROM sight WHERE claim = 'yours') s ON i.individual_id = s.individual_id
LEFT JOIN (SELECT camera_id, count(*) AS hours FROM watched GROUP BY 1) w ON w.camera_id = s.camera_id GROUP BY 1, 2, 3""")
def individual_camera_rates(b):
    return rates.individual_camera_rates(_hours(b), _sight(b), b.individuals()).select(
        "individual_id", "individual_name", "camera_id", "hits", "hours", round6("rate").alias("rate"))


@query("individual_curves", needs=("watched", "sight", "indiv", "cam"), sql="""
SELECT i.individual_id, CAST(i.local_hour AS INT) AS local_hour, d.hours, coalesce(n.hits, 0) AS hits,
  round(CASE WHEN d.hours >= 10 THEN coalesce(n.hits, 0) / d.hours * 100e0 END, 6) AS rate
FROM (SELECT individual_id, unnest(range(24)) AS local_hour FROM indiv) i
LEFT JOIN (SELECT local_hour, count(*) AS hours FROM watched GROUP BY 1) d ON d.local_hour = i.local_hour
LEFT JOIN (SELECT s.individual_id, CAST(floor((s.us / 1000e0 + c.lng / 15e0 * 3600000e0) / 3600000e0) AS BIGINT) % 24 AS local_hour,
    count(*) AS hits FROM sight s JOIN cam c ON c.camera_id = s.camera_id
    WHERE s.claim = 'yours' AND s.individual_id IS NOT NULL GROUP BY 1, 2) n
  ON n.individual_id = i.individual_id AND n.local_hour = i.local_hour""")
def individual_curves(b):
    return rates.individual_curve(_hours(b), _sight(b), b.individuals(), b.cameras()).select(
        "individual_id", "local_hour", "hours", "hits", round6("rate").alias("rate"))


@query("light_window", needs=("live_day",), sql="WITH " + T.sun_tables("lw", "live_day", "midnight") + """
SELECT camera_id, count(*) AS days, round(min(r), 6) AS rise_min, round(max(r), 6) AS rise_max,
  round(avg(r), 6) AS rise_mean, round(min(s), 6) AS set_min, round(max(s), 6) AS set_max, round(avg(s), 6) AS set_mean
FROM (SELECT camera_id, ((sunrise + lng / 15e0 * 3600000e0) % 86400000e0) / 3600000e0 AS r,
    ((sunset + lng / 15e0 * 3600000e0) % 86400000e0) / 3600000e0 AS s FROM lw WHERE sunrise IS NOT NULL)
GROUP BY 1""")
def light_window(b):
    df = exposure.light_window(b.camera_days(), b.cameras())
    return df.select("camera_id", "days", *[round6(c).alias(c) for c in df.columns
                                           if c not in ("camera_id", "days")])


@query("live_day_summary", needs=("cday", "span"), sql="""
SELECT s.camera_id, count(*) FILTER (WHERE d.state = 'live') AS live,
  count(*) FILTER (WHERE d.state = 'quota-dark') AS quota_dark, count(*) FILTER (WHERE d.state = 'silent') AS silent,
  count(*) FILTER (WHERE d.state IS NULL) AS "unknown", count(*) AS span_days
FROM (SELECT camera_id, CAST(unnest(generate_series(CAST(from_day AS TIMESTAMP) - INTERVAL 3 DAY,
  CAST(to_day AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM span) s
LEFT JOIN cday d ON d.camera_id = s.camera_id AND d.day = s.day GROUP BY 1""")
def live_day_summary(b):
    spans = b.camera_spans().withColumn("from_day", F.date_sub("from_day", 3))
    return exposure.live_day_summary(b.camera_days(), spans)
