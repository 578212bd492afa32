"""Estimates, evidence, journals, climatology, movement and randomisation tests."""

from __future__ import annotations

from pyspark.sql import functions as F

import fieldlens.queries.tables as T
from fieldlens.constants import MIN_SIGHTINGS
from fieldlens.functions import solar
from fieldlens.functions.compass import compass_point
from fieldlens.functions.num import round6
from fieldlens.operators import (context, estimate, evidence, journal, movement, randomise,
                                 rates, wind)
from fieldlens.operators.exposure import utc_hour
from fieldlens.operators.visits import visits
from fieldlens.queries.registry import query, table_sql

table_sql("visit", """SELECT camera_id, visit_no, min(us) AS s, max(us) AS e, count(*) AS photo_count
  FROM (SELECT camera_id, us, sum(opens) OVER (PARTITION BY camera_id ORDER BY us
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS visit_no
    FROM (SELECT camera_id, us, CASE WHEN us - lag(us) OVER (PARTITION BY camera_id ORDER BY us) <= 300000000
      THEN 0 ELSE 1 END AS opens FROM photo)) GROUP BY 1, 2""", ("photo",))

table_sql("vst", """SELECT v.camera_id, v.s / 1000e0 AS ms, c.lat, c.lng,
  floor((v.s / 1000e0 + c.lng / 15e0 * 3600000e0) / 86400000e0) * 86400000e0 + 43200000e0
    - c.lng / 15e0 * 3600000e0 AS noon_ms FROM visit v JOIN cam c ON c.camera_id = v.camera_id""", ("visit", "cam"))


@query("band_estimates", needs=("vst", "cday", "span"), sql="WITH " + T.sun_tables("vsun", "vst", "noon_ms") + """,
banded AS (SELECT camera_id, """ + T.band_sql("ms") + """ AS band,
  DATE '1970-01-01' + CAST(floor((ms + lng / 15e0 * 3600000e0) / 86400000e0) AS INT) AS day FROM vsun),
live AS (SELECT d.camera_id, d.day FROM cday d JOIN span s ON s.camera_id = d.camera_id
  WHERE d.state = 'live' AND d.day BETWEEN s.from_day AND s.to_day),
tot AS (SELECT d.camera_id, count(*) FILTER (WHERE state = 'live') AS live,
  count(*) FILTER (WHERE state = 'quota-dark') AS quota_dark, count(*) FILTER (WHERE state = 'silent') AS silent,
  count(*) AS span_days FROM cday d GROUP BY 1),
seen AS (SELECT b.camera_id, b.band, count(DISTINCT CASE WHEN l.day IS NOT NULL THEN b.day END) AS seen,
  count(*) FILTER (WHERE l.day IS NULL) AS off_live FROM banded b
  LEFT JOIN live l ON l.camera_id = b.camera_id AND l.day = b.day GROUP BY 1, 2),
j AS (SELECT t.*, b.band, coalesce(s.seen, 0) AS seen, coalesce(s.off_live, 0) AS off_live,
    CAST(coalesce(s.seen, 0) AS DOUBLE) / t.live AS p, CAST(t.live AS DOUBLE) AS n
  FROM (SELECT *, unnest(['dawn', 'day', 'dusk', 'night']) AS band FROM tot) b
  JOIN tot t ON t.camera_id = b.camera_id LEFT JOIN seen s ON s.camera_id = b.camera_id AND s.band = b.band)
SELECT camera_id, band, live, seen, off_live, quota_dark, silent, CAST(0 AS BIGINT) AS "unknown", span_days,
  CASE WHEN live >= 10 THEN round(p, 6) END AS point,
  CASE WHEN live >= 10 THEN round(greatest(0e0, (p + 3.8414588206941227e0 / (2 * n)) / (1 + 3.8414588206941227e0 / n)
    - 1.959963984540054e0 / (1 + 3.8414588206941227e0 / n) * sqrt(p * (1 - p) / n + 3.8414588206941227e0 / (4 * n * n))), 6) END AS lo,
  CASE WHEN live >= 10 THEN round(least(1e0, (p + 3.8414588206941227e0 / (2 * n)) / (1 + 3.8414588206941227e0 / n)
    + 1.959963984540054e0 / (1 + 3.8414588206941227e0 / n) * sqrt(p * (1 - p) / n + 3.8414588206941227e0 / (4 * n * n))), 6) END AS hi,
  live < 10 AS refused FROM j""")
def band_estimates(b):
    out = estimate.band_estimates(visits(b.photos()), b.camera_days(), b.cameras(), b.camera_spans())
    return out.withColumns({c: round6(c) for c in ("point", "lo", "hi")})


@query("band_estimates_recent", needs=("vst", "cday", "span"), sql="WITH " + T.sun_tables("vsun", "vst", "noon_ms") + """,
sp AS (SELECT camera_id, to_day - 14 AS from_day, to_day FROM span),
banded AS (SELECT camera_id, """ + T.band_sql("ms") + """ AS band,
  DATE '1970-01-01' + CAST(floor((ms + lng / 15e0 * 3600000e0) / 86400000e0) AS INT) AS day FROM vsun),
dd AS (SELECT d.camera_id, d.day, d.state FROM cday d JOIN sp s ON s.camera_id = d.camera_id
  WHERE d.day BETWEEN s.from_day AND s.to_day),
tot AS (SELECT camera_id, count(*) FILTER (WHERE state = 'live') AS live FROM dd GROUP BY 1),
seen AS (SELECT b.camera_id, b.band, count(DISTINCT b.day) AS seen FROM banded b
  JOIN dd l ON l.camera_id = b.camera_id AND l.day = b.day AND l.state = 'live' GROUP BY 1, 2)
SELECT t.camera_id, t.band, t.live, coalesce(s.seen, 0) AS seen,
  CASE WHEN t.live >= 10 THEN round(CAST(coalesce(s.seen, 0) AS DOUBLE) / t.live, 6) END AS point
FROM (SELECT camera_id, live, unnest(['dawn', 'day', 'dusk', 'night']) AS band FROM tot) t
LEFT JOIN seen s ON s.camera_id = t.camera_id AND s.band = t.band""")
def band_estimates_recent(b):
    spans = b.camera_spans().select("camera_id", F.date_sub("to_day", 14).alias("from_day"), "to_day")
    out = estimate.band_estimates(visits(b.photos()), b.camera_days(), b.cameras(), spans)
    return out.select("camera_id", "band", "live", "seen", round6("point").alias("point"))


# ---- evidence ---------------------------------------------------------------------------

table_sql("ehour", """SELECT c.camera_id, c.lat, c.lng, w.hour_no, CAST(w.hour_no AS DOUBLE) * 3600000e0 AS ms,
  w.wind_dir, w.pressure_inhg FROM cam c JOIN wx w ON w.location_id = c.location_id""", ("cam", "wx"))
previous = "ehour"
for step, text in T.sun_steps("ehour_sun", "ehour", "ms"):
    table_sql(step, text, (previous,))
    previous = step
table_sql("etag", f"""SELECT camera_id, hour_no, ms, {T.band_sql("ms")} AS band,
  {T.compass_sql("wind_dir")} AS wind, pressure_inhg FROM ehour_sun""", ("ehour_sun",))
table_sql("evid", f"""WITH q AS (SELECT DISTINCT "window", {T.compass_sql("predicted_wind_deg")} AS wind FROM sit),
h AS (SELECT t.*, coalesce(s.n, 0) AS hits, list_position(['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'], t.wind) AS wi
  FROM etag t LEFT JOIN (SELECT camera_id, us // 3600000000 AS hour_no, count(*) AS n FROM sight
    WHERE claim = 'yours' GROUP BY 1, 2) s ON s.camera_id = t.camera_id AND s.hour_no = t.hour_no),
r AS (SELECT "window", wind, list_position(['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'], wind) AS qi,
  CASE WHEN "window" = 'AM' THEN 'dawn' ELSE 'dusk' END AS target, unnest([3, 2, 1, 0]) AS rung FROM q),
m AS (SELECT r."window" || '/' || r.wind AS question, r.rung, h.camera_id, count(*) AS hours, CAST(sum(h.hits) AS BIGINT) AS detections
  FROM r JOIN h ON CASE WHEN r.rung IN (1, 3) THEN h.band = r.target ELSE h.band IN ('dawn', 'day', 'dusk') END
    AND (r.rung <= 1 OR least((h.wi - r.qi + 16) % 16, (r.qi - h.wi + 16) % 16) <= 1) GROUP BY 1, 2, 3),
ch AS (SELECT question, max(rung) AS rung FROM (SELECT question, rung FROM m WHERE hours >= 10
  GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1)
SELECT k.question, k.rung, k.camera_id, coalesce(m.hours, 0) AS hours, coalesce(m.detections, 0) AS detections, coalesce(m.hours, 0) >= 10 AS enough,
  CASE WHEN m.hours >= 10 THEN floor(100e0 * m.detections / m.hours * 10 + 0.5) / 10 END AS per100
FROM (SELECT q.question, ch.rung, cam.camera_id FROM (SELECT DISTINCT "window" || '/' || wind AS question FROM r) q
  LEFT JOIN ch ON ch.question = q.question, cam) k
LEFT JOIN m ON m.question = k.question AND m.rung = k.rung AND m.camera_id = k.camera_id""", ("etag", "sight", "sit", "cam"))


def _evidence(b):
    sits = b.sits().select("window", compass_point(F.col("predicted_wind_deg")).alias("wind"))
    mine = rates.sightings(b.detections(), b.photos()).where(F.col("claim") == "yours")
    hours = evidence.tagged_hours(b.cameras(), b.weather())
    return evidence.matched_evidence(b.cameras(), hours, mine, sits)


@query("matched_evidence", needs=("evid",), sql="""
SELECT question, rung, camera_id, hours, detections, enough, per100 FROM evid""")
def matched_evidence(b):
    return _evidence(b).select("question", "rung", "camera_id", "hours", "detections", "enough", "per100")


@query("evidence_confidence", needs=("evid",), sql="""
WITH r AS (SELECT *, CASE WHEN enough THEN row_number() OVER (PARTITION BY question, enough ORDER BY per100 DESC, camera_id) END AS rn FROM evid),
a AS (SELECT question, rung, count(*) FILTER (WHERE enough) AS cameras, CAST(sum(hours) FILTER (WHERE enough) AS BIGINT) AS hours,
  max(CASE WHEN rn = 1 THEN per100 END) AS best, max(CASE WHEN rn = 2 THEN per100 END) AS next FROM r GROUP BY 1, 2),
s AS (SELECT *, best - next AS gap, CASE WHEN hours >= 400 THEN 3 WHEN hours >= 120 THEN 2 ELSE 1 END
  + CASE WHEN best - next >= CASE WHEN best = 0 THEN 1e0 ELSE best END * 0.5 THEN 2 WHEN best - next > 0 THEN 1 ELSE 0 END
  + CASE WHEN rung >= 2 THEN 1 ELSE 0 END AS score FROM a)
SELECT question, rung, cameras, hours, round(gap, 6) AS gap, CASE WHEN cameras > 0 THEN score END AS score,
  CASE WHEN cameras = 0 THEN 'none' WHEN score >= 5 THEN 'strong' WHEN score >= 3 THEN 'moderate' ELSE 'weak' END AS tier FROM s""")
def evidence_confidence(b):
    return evidence.confidence(_evidence(b)).withColumn("gap", round6("gap"))


table_sql("nsight", """SELECT s.camera_id, s.us / 1000e0 AS ms, c.lat, c.lng FROM sight s
  JOIN cam c ON c.camera_id = s.camera_id WHERE s.claim = 'yours'""", ("sight", "cam"))


@query("nocturnal_share", needs=("nsight",), sql="WITH " + T.sun_tables("nsun", "nsight", "ms") + f"""
SELECT camera_id, count(*) AS sightings, CAST(floor(100e0 * count(*) FILTER (WHERE band IN ('night', 'unknown'))
  / count(*) + 0.5) AS BIGINT) AS nocturnal_share FROM (SELECT camera_id, {T.band_sql("ms")} AS band FROM nsun) GROUP BY 1""")
def nocturnal_share(b):
    mine = rates.sightings(b.detections(), b.photos()).where(F.col("claim") == "yours")
    return evidence.nocturnal_shares(mine, b.cameras())


# ---- journal ----------------------------------------------------------------------------

@query("journal_summary", needs=("sit",), sql="""
SELECT count(*) AS sits, count(deer) AS counted, count(*) - count(deer) AS uncounted,
  floor(sum(CASE WHEN h > 0 AND h < 24 THEN h ELSE 0 END) * 10 + 0.5) / 10 AS hours, CAST(sum(deer) AS BIGINT) AS deer,
  floor(avg(deer) * 100 + 0.5) / 100 AS deer_per_sit,
  floor(sum(deer) / sum(CASE WHEN h > 0 AND h < 24 THEN h ELSE 0 END) * 100 + 0.5) / 100 AS deer_per_hour,
  CAST(sum(bucks) AS BIGINT) AS bucks, count(*) FILTER (WHERE shot) AS shots,
  count(*) FILTER (WHERE harvested) AS harvests, count(*) FILTER (WHERE deer = 0) AS blank_sits
FROM (SELECT *, (end_s - start_s) / 3600e0 AS h FROM sit)""")
def journal_summary(b):
    return journal.summary(b.sits())


@query("rating_means", needs=("sit",), sql="""
SELECT list_position(['poor', 'fair', 'good', 'strong', 'prime'], rating) - 1 AS x, rating, count(*) AS sits,
  floor(avg(deer) * 100 + 0.5) / 100 AS deer_per_sit FROM sit WHERE deer IS NOT NULL GROUP BY 1, 2""")
def rating_means(b):
    return journal.rating_means(b.sits())


table_sql("ranked", """SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2e0 AS rx,
    rank() OVER (ORDER BY deer) + (count(*) OVER (PARTITION BY deer) - 1) / 2e0 AS ry
  FROM (SELECT list_position(['poor', 'fair', 'good', 'strong', 'prime'], rating) AS x, deer FROM sit
    WHERE deer IS NOT NULL)""", ("sit",))


@query("rating_spearman", needs=("ranked",), sql="""
SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM ranked""")
def rating_spearman(b):
    return journal.spearman(journal.contingency(b.sits())).withColumn("rho", round6("rho"))


@query("rating_calibration_sizes", needs=("sit", "ranked"), sql="""
SELECT (SELECT count(*) FROM sit) AS sits, (SELECT count(*) FROM sit WHERE deer IS NOT NULL) AS usable,
  (SELECT count(*) FROM sit WHERE deer IS NULL) AS uncounted,
  (SELECT count(DISTINCT rating) FROM sit WHERE deer IS NOT NULL) AS ratings,
  (SELECT count(*) FROM (SELECT rating FROM sit WHERE deer IS NOT NULL GROUP BY 1 HAVING count(*) >= 3)) AS spread,
  floor((SELECT corr(rx, ry) FROM ranked) * 100 + 0.5) / 100 AS rho, 'not tested' AS verdict""")
def rating_calibration_sizes(b):
    return journal.calibration(b.sits()).drop("p")


@query("rating_calibration")
def rating_calibration(b):
    p = randomise.permutation_p(b.sits())
    return journal.calibration(b.sits(), p)


@query("wind_forecast_accuracy", needs=("sit",), sql=f"""
SELECT count(*) AS sits, count(*) AS scored, CAST(0 AS BIGINT) AS skipped,
  CAST(floor(100e0 * count(*) FILTER (WHERE d = 0) / count(*) + 0.5) AS BIGINT) AS exact,
  CAST(floor(100e0 * count(*) FILTER (WHERE d <= 1 OR d = 15) / count(*) + 0.5) AS BIGINT) AS "close"
FROM (SELECT (CAST(floor(predicted_wind_deg / 22.5e0 + 0.5) AS INT) % 16
  - CAST(floor(wind_deg / 22.5e0 + 0.5) AS INT) % 16 + 16) % 16 AS d FROM sit)""")
def wind_forecast_accuracy(b):
    return journal.wind_accuracy(b.sits().select(
        compass_point(F.col("predicted_wind_deg")).alias("predicted_wind"),
        compass_point(F.col("wind_deg")).alias("wind_from")))


@query("stand_performance", needs=("sit",), sql="""
SELECT stand_id, count(*) AS sits, count(deer) AS counted, count(*) - count(deer) AS uncounted,
  CAST(sum(deer) AS BIGINT) AS deer, floor(avg(deer) * 100 + 0.5) / 100 AS deer_per_sit,
  CAST(sum(bucks) AS BIGINT) AS bucks, count(deer) >= 4 AS enough FROM sit GROUP BY 1""")
def stand_performance(b):
    return journal.stand_performance(b.sits())


NOW = "1998-06-15 12:00:00"


@query("stand_pressure", needs=("sit",), sql=f"""
SELECT stand_id, logged, recent_sits, floor(burn * 100 + 0.5) / 100 AS burn, floor(last * 10 + 0.5) / 10 AS last_days_ago,
  CASE WHEN burn >= 1.8 THEN -6 WHEN burn >= 1.2 THEN -4 WHEN burn >= 0.4 THEN -2 WHEN last >= 10 THEN 2 ELSE 0 END AS pressure_points
FROM (SELECT stand_id, count(*) AS logged, count(*) FILTER (WHERE r) AS recent_sits,
    coalesce(sum(CASE WHEN r THEN exp(-ago / 3e0) END), 0) AS burn, min(CASE WHEN r THEN ago END) AS last
  FROM (SELECT stand_id, ago, ago >= 0 AND ago <= 21 AS r FROM (SELECT stand_id,
    (epoch_us(TIMESTAMP '{NOW}') / 1e6 - end_s) / 86400e0 AS ago FROM sit)) GROUP BY 1)""")
def stand_pressure(b):
    return context.sit_pressure(b.sits(), F.lit(NOW).cast("timestamp"))


# ---- climatology ------------------------------------------------------------------------

table_sql("clim_hour", """SELECT h.location_id AS site, h.day, h.h AS hour, w.wind_dir, w.wind_mph,
  CASE WHEN h.h BETWEEN 6e0 + h.dom * 0.05e0 - 1.5e0 AND 6e0 + h.dom * 0.05e0 + 3.5e0 THEN 'AM'
       WHEN h.h BETWEEN 17e0 + h.dom * 0.03e0 - 3.5e0 AND 17e0 + h.dom * 0.03e0 + 0.5e0 THEN 'PM' END AS "window"
  FROM wxh h JOIN wx w ON w.location_id = h.location_id
    AND w.hour_no = epoch_us(CAST(h.day AS TIMESTAMP)) // 3600000000 + h.h
  WHERE w.wind_dir IS NOT NULL AND month(h.day) IN (9, 10, 11, 12, 1)""", ("wxh", "wx"))
table_sql("clim_point", f"""SELECT site, "window", {T.compass_sql("wind_dir")} AS point, wind_mph
  FROM clim_hour WHERE "window" IS NOT NULL""", ("clim_hour",))
table_sql("clim", """WITH c AS (SELECT site, 'all' AS "window", point, count(*) AS n FROM clim_point GROUP BY 1, 3
  UNION ALL SELECT site, "window", point, count(*) FROM clim_point GROUP BY 1, 2, 3),
sp AS (SELECT site, "window", unnest(['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW']) AS point
  FROM (SELECT site, unnest(['all', 'AM', 'PM']) AS "window" FROM (SELECT DISTINCT site FROM clim_point)))
SELECT sp.site, sp."window", sp.point, coalesce(c.n, 0) AS n,
  coalesce(floor(100e0 * coalesce(c.n, 0) / t.total * 10 + 0.5) / 10, 0e0) AS pct FROM sp
LEFT JOIN c ON c.site = sp.site AND c."window" = sp."window" AND c.point = sp.point
LEFT JOIN (SELECT site, "window", sum(n) AS total FROM c GROUP BY 1, 2) t ON t.site = sp.site AND t."window" = sp."window" """,
          ("clim_point",))
table_sql("swind", """SELECT c_custkey % 3 AS site, c_custkey AS stand_id, CASE WHEN c_custkey % 4 <> 0 THEN
  list_distinct([['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'][c_custkey % 5 * 3 + 1],
   ['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'][c_custkey % 3 * 4 + 2]]) END AS winds
  FROM customer""")


def _kept(b):
    dom = F.dayofmonth("day")
    hourly = b.weather().select(F.col("location_id").alias("site"), F.to_date("hour_utc").alias("day"),
                                F.hour("hour_utc").alias("hour"), "wind_dir", "wind_mph")
    daily = hourly.select("site", "day").distinct().select(
        "site", "day", (F.lit(6.0) + dom * 0.05).alias("sunrise_h"), (F.lit(17.0) + dom * 0.03).alias("sunset_h"))
    return wind.window_hours(hourly, daily)


def _stand_winds(b):
    return b.stands().select((F.col("stand_id") % 3).alias("site"), "stand_id",
                             F.split("good_winds", ",").alias("winds"))


@query("wind_climatology", needs=("clim",), sql="""SELECT site, "window", point, CAST(n AS BIGINT) AS n, pct FROM clim""")
def wind_climatology(b):
    return wind.climatology(_kept(b))


@query("wind_median_speed", needs=("clim_point",), sql="""
SELECT site, count(*) AS hours, list_sort(list(wind_mph))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median_mph
FROM clim_point GROUP BY 1""")
def wind_median_speed(b):
    return wind.median_speed(_kept(b))


@query("stand_wind_coverage", needs=("clim", "swind"), sql="""
WITH e AS (SELECT site, stand_id, unnest(winds) AS point FROM swind WHERE winds IS NOT NULL
  UNION ALL SELECT site, stand_id, NULL FROM swind WHERE winds IS NULL)
SELECT e.site, e.stand_id, floor(sum(CASE WHEN c."window" = 'all' THEN c.pct END) * 10 + 0.5) / 10 AS pct,
  floor(sum(CASE WHEN c."window" = 'AM' THEN c.pct END) * 10 + 0.5) / 10 AS am_pct,
  floor(sum(CASE WHEN c."window" = 'PM' THEN c.pct END) * 10 + 0.5) / 10 AS pm_pct
FROM e LEFT JOIN clim c ON c.site = e.site AND c.point = e.point GROUP BY 1, 2""")
def stand_wind_coverage(b):
    return wind.stand_coverage(_stand_winds(b), wind.climatology(_kept(b)))


@query("wind_coverage_gaps", needs=("clim", "swind"), sql="""
WITH cov AS (SELECT DISTINCT site, w AS point FROM (SELECT site, unnest(winds) AS w FROM swind)),
g AS (SELECT c.site, c.point, c.pct, row_number() OVER (PARTITION BY c.site ORDER BY c.pct DESC,
  list_position(['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'], c.point)) AS rank
  FROM clim c WHERE c."window" = 'all' AND c.pct > 0 AND NOT EXISTS (SELECT 1 FROM cov WHERE cov.site = c.site AND cov.point = c.point))
SELECT site, point, pct, CAST(rank AS INT) AS rank FROM g WHERE rank <= 4""")
def wind_coverage_gaps(b):
    return wind.coverage_gaps(_stand_winds(b), wind.climatology(_kept(b)))


@query("wind_season_covered", needs=("clim", "swind"), sql="""
SELECT c.site, floor(sum(c.pct) * 10 + 0.5) / 10 AS season_covered FROM clim c
JOIN (SELECT DISTINCT site, unnest(winds) AS point FROM swind) s ON s.site = c.site AND s.point = c.point
WHERE c."window" = 'all' GROUP BY 1""")
def wind_season_covered(b):
    return wind.season_covered(_stand_winds(b), wind.climatology(_kept(b)))


# ---- telemetry --------------------------------------------------------------------------

MEDIAN = "list_sort(list({0}))[CAST(floor(count({0}) / 2) AS BIGINT) + 1]"


@query("movement_by_hour", needs=("tele",), sql=f"""
WITH b AS (SELECT {MEDIAN.format("rate")} AS base FROM tele),
h AS (SELECT hour, count(*) AS n, {MEDIAN.format("rate")} AS med FROM tele GROUP BY 1)
SELECT s.hour, coalesce(h.n, 0) AS n, floor(h.med / b.base * 100 + 0.5) / 100 AS ratio, b.base
FROM (SELECT CAST(unnest(range(24)) AS BIGINT) AS hour) s LEFT JOIN h ON h.hour = s.hour, b""")
def movement_by_hour(b):
    return movement.by_hour(b.telemetry())


@query("movement_by_hour_one_sex", needs=("tele",), sql=f"""
WITH t AS (SELECT * FROM tele WHERE sex = 'A'), b AS (SELECT {MEDIAN.format("rate")} AS base FROM t),
h AS (SELECT hour, count(*) AS n, {MEDIAN.format("rate")} AS med FROM t GROUP BY 1)
SELECT s.hour, coalesce(h.n, 0) AS n, floor(h.med / b.base * 100 + 0.5) / 100 AS ratio, b.base
FROM (SELECT CAST(unnest(range(24)) AS BIGINT) AS hour) s LEFT JOIN h ON h.hour = s.hour, b""")
def movement_by_hour_one_sex(b):
    return movement.by_hour(b.telemetry(), "A")


@query("movement_by_temperature", needs=("tele",), sql=f"""
WITH h AS (SELECT hour, {MEDIAN.format("rate")} AS base FROM tele GROUP BY 1),
r AS (SELECT t.rate / h.base AS norm, CASE WHEN temp >= 0 AND temp < 10 THEN 0 WHEN temp >= 10 AND temp < 25 THEN 1
  WHEN temp >= 25 AND temp < 40 THEN 2 WHEN temp >= 40 AND temp < 60 THEN 3 END AS bucket FROM tele t JOIN h ON h.hour = t.hour)
SELECT [0e0, 10e0, 25e0, 40e0][bucket + 1] AS lo, [10e0, 25e0, 40e0, 60e0][bucket + 1] AS hi, count(*) AS n,
  floor({MEDIAN.format("norm")} * 100 + 0.5) / 100 AS ratio, floor(avg(norm) * 100 + 0.5) / 100 AS mean
FROM r WHERE bucket IS NOT NULL GROUP BY bucket""")
def movement_by_temperature(b):
    return movement.by_bucket(b.telemetry(), F.col("temp"), [0, 10, 25, 40, 60])


@query("study_extent", needs=("tele",), sql="""
SELECT floor(avg(44e0 + CAST(animal % 97 AS DOUBLE) * 0.01e0) * 10 + 0.5) / 10 AS lat,
  floor(avg(-90e0 - CAST(animal % 89 AS DOUBLE) * 0.012e0) * 10 + 0.5) / 10 AS lng, count(*) AS n,
  CAST(CAST(min(seen_at) AS DATE) AS VARCHAR) AS from_day, CAST(CAST(max(seen_at) AS DATE) AS VARCHAR) AS to_day FROM tele""")
def study_extent(b):
    lat, lng = b.place(F.col("animal"))
    out = movement.study_extent(b.telemetry().select("animal", "at", lat, lng))
    return out.withColumns({c: F.col(c).cast("string") for c in ("from_day", "to_day")})


# ---- individuals ------------------------------------------------------------------------

def _observed_and_pool(b):
    mine = (rates.sightings(b.detections(), b.photos())
            .where((F.col("claim") == "yours") & F.col("individual_id").isNotNull())
            .withColumn("ms", solar.millis(F.col("taken_at")))
            .withColumn("hour_no", utc_hour(F.col("ms")))
            .select("individual_id", "camera_id", "ms", "hour_no"))
    hours = evidence.tagged_hours(b.cameras(), b.weather()).select(
        "camera_id", "hour_no", F.col("ms").alias("hour_ms"), "band", "pressure_inhg")

    def factors(ms):
        return F.explode(F.array(
            F.struct(F.lit("moon").alias("factor"), F.round(solar.moon_phase(ms)["illum"], 9).alias("value")),
            F.struct(F.lit("barometer").alias("factor"), F.col("pressure_inhg").alias("value"))))

    seen = (mine.join(hours, ["camera_id", "hour_no"], "left")
            .withColumn("band", F.coalesce("band", F.lit("unknown"))).withColumn("f", factors(F.col("ms"))))
    observed = seen.select("individual_id", "f.factor", F.col("band").alias("stratum"), "f.value")
    where_seen = mine.select("individual_id", "camera_id").distinct()
    pool = (where_seen.join(hours, "camera_id").withColumn("f", factors(F.col("hour_ms")))
            .select("individual_id", "f.factor", F.col("band").alias("stratum"), "f.value"))
    return observed, pool


@query("individual_factor_means", needs=("sight", "etag"), sql="""
WITH mine AS (SELECT individual_id, camera_id, us / 1000e0 AS ms, us // 3600000000 AS hour_no FROM sight
  WHERE claim = 'yours' AND individual_id IS NOT NULL),
o AS (SELECT m.individual_id, coalesce(t.band, 'unknown') AS stratum, unnest(['moon', 'barometer']) AS factor,
  unnest([round((1 - cos(2 * pi() * ((((m.ms / 1000e0 - 947182440e0) / 86400e0 / 29.530588853e0) % 1e0 + 1e0) % 1e0))) / 2, 9), t.pressure_inhg]) AS value
  FROM mine m LEFT JOIN etag t ON t.camera_id = m.camera_id AND t.hour_no = m.hour_no),
p AS (SELECT w.individual_id, t.band AS stratum, unnest(['moon', 'barometer']) AS factor,
  unnest([round((1 - cos(2 * pi() * ((((t.ms / 1000e0 - 947182440e0) / 86400e0 / 29.530588853e0) % 1e0 + 1e0) % 1e0))) / 2, 9), t.pressure_inhg]) AS value
  FROM (SELECT DISTINCT individual_id, camera_id FROM mine) w JOIN etag t ON t.camera_id = w.camera_id),
n AS (SELECT individual_id, factor, stratum, count(*) AS need, sum(value) AS s FROM o WHERE value IS NOT NULL GROUP BY 1, 2, 3),
h AS (SELECT individual_id, factor, stratum, count(*) AS have, avg(value) AS pm FROM p WHERE value IS NOT NULL GROUP BY 1, 2, 3)
SELECT n.individual_id, n.factor, CAST(sum(need) AS BIGINT) AS n, round(sum(s) / sum(need), 6) AS observed,
  round(sum(need * pm) / sum(need), 6) AS expected, bool_and(coalesce(have, 0) >= 2 * need) AND sum(need) >= 2 AS ok
FROM n LEFT JOIN h ON h.individual_id = n.individual_id AND h.factor = n.factor AND h.stratum = n.stratum GROUP BY 1, 2""")
def individual_factor_means(b):
    observed, pool = _observed_and_pool(b)
    out = randomise.stratified_means(observed, pool, ["individual_id", "factor"])
    return out.withColumns({"observed": round6("observed"), "expected": round6("expected")})


@query("individual_factor_tests")
def individual_factor_tests(b):
    observed, pool = _observed_and_pool(b)
    tested = randomise.stratified_test(observed, pool, ["individual_id", "factor"])
    moon = F.col("factor") == "moon"
    named = tested.withColumn("high", F.when(moon, "bright moons").otherwise("high pressure")).withColumn(
        "low", F.when(moon, "dark moons").otherwise("low pressure"))
    return randomise.judge(named.withColumn(
        "p", F.when(F.col("n") >= MIN_SIGHTINGS, F.col("p")))).drop("high", "low")
