"""Scoring sit windows and ranking stands."""

from __future__ import annotations

from pyspark.sql import functions as F

import fieldlens.queries.crops  # noqa: F401
import fieldlens.queries.relational  # noqa: F401
from fieldlens.constants import COMPASS, FORECAST_TTL_MINUTES
from fieldlens.functions import solar
from fieldlens.functions.num import round6
from fieldlens.operators import context
from fieldlens.plans import planner, stands
from fieldlens.queries.registry import REGISTRY, query, table_sql

# forecast hours: each location stands for another time of the year
table_sql("fhour", """SELECT x.location_id, x.day + CAST(x.location_id * 145 AS INT) AS day, x.h,
  CASE WHEN x.h BETWEEN 5 AND 10 THEN 'AM' WHEN x.h BETWEEN 14 AND 18 THEN 'PM' END AS "window", w.temp_f AS temp, w.wind_mph AS wind,
  w.wind_dir, w.precip_in AS precip, w.cloud_pct AS cloud, w.pressure_inhg / 0.02952998751e0 AS hpa,
  coalesce(p.high - d.high, 0) AS drop_f FROM wxh x JOIN wx w ON w.location_id = x.location_id
    AND w.hour_no = epoch_us(CAST(x.day AS TIMESTAMP)) // 3600000000 + x.h
  JOIN (SELECT location_id, CAST(hour_utc AS DATE) AS day, max(temp_f) AS high FROM wx GROUP BY 1, 2) d ON d.location_id = x.location_id AND d.day = x.day
  LEFT JOIN (SELECT location_id, CAST(hour_utc AS DATE) AS day, max(temp_f) AS high FROM wx GROUP BY 1, 2) p ON p.location_id = x.location_id AND p.day = x.day - 1""",
          ("wxh", "wx"))
CALENDAR = """CASE WHEN strftime(day, '%m-%d') BETWEEN '09-01' AND '09-30' THEN {0} WHEN strftime(day, '%m-%d') BETWEEN '10-01' AND '10-17' THEN {1}
  WHEN strftime(day, '%m-%d') BETWEEN '10-18' AND '10-22' THEN {2} WHEN strftime(day, '%m-%d') BETWEEN '10-23' AND '11-04' THEN {3}
  WHEN strftime(day, '%m-%d') BETWEEN '11-05' AND '11-11' THEN {4} WHEN strftime(day, '%m-%d') BETWEEN '11-12' AND '11-15' THEN {5}
  WHEN strftime(day, '%m-%d') BETWEEN '11-16' AND '11-25' THEN {6} WHEN strftime(day, '%m-%d') BETWEEN '11-26' AND '12-10' THEN {7}
  WHEN strftime(day, '%m-%d') BETWEEN '12-11' AND '12-20' THEN {8} WHEN strftime(day, '%m-%d') >= '12-21' OR strftime(day, '%m-%d') <= '01-31' THEN {9} ELSE {10} END"""
PHASES = ["Early season", "October transition", "Pre-rut / scraping", "Peak rut — seeking", "Peak rut — best week", "Peak rut — closing",
          "Post-peak seeking", "Post-rut recovery", "Second rut", "Late season", "Off season"]
NORMAL = ("(([15,20,32,45,57,66,70,68,59,47,33,20][month(day)] * (1 - least(1e0, abs((day(day) - 15) / CAST(day(last_day(day)) AS DOUBLE))))"
          " + [15,20,32,45,57,66,70,68,59,47,33,20][CASE WHEN day(day) >= 15 THEN month(day) % 12 ELSE (month(day) + 10) % 12 END + 1]"
          " * least(1e0, abs((day(day) - 15) / CAST(day(last_day(day)) AS DOUBLE)))))")
table_sql("sitscore", f"""WITH a AS (SELECT location_id, day, "window", avg(temp) AS temp, avg(wind) AS wind, avg(cloud) AS cloud, avg(hpa) AS hpa,
    sum(precip) AS rain, max(drop_f) AS drop_f FROM fhour WHERE "window" IS NOT NULL GROUP BY 1, 2, 3),
p AS (SELECT *, {CALENDAR.format(10, 6, 18, 26, 30, 24, 16, 8, 12, 10, 2)} AS sp,
    {CALENDAR.format(2, 3, 4, 4, 4, 4, 3, 2, 3, 2, 4)} AS st, {CALENDAR.format(*["'" + x + "'" for x in PHASES])} AS phase,
    CASE WHEN "window" = 'PM' AND temp - {NORMAL} <= -8 THEN 4 WHEN "window" = 'AM' AND temp - {NORMAL} >= 8 THEN 3
      WHEN "window" = 'PM' AND temp - {NORMAL} >= 12 THEN -3 ELSE 0 END AS tp,
    CASE WHEN drop_f >= 15 THEN 3 WHEN drop_f >= 8 THEN 2 ELSE 0 END AS dp,
    CASE WHEN wind <= 2 THEN -3 WHEN wind <= 15 THEN 3 WHEN wind <= 22 THEN 0 ELSE -2 END AS wp,
    CASE WHEN wind <= 2 THEN 3 ELSE 2 END AS wt, CASE WHEN rain >= 0.4 THEN -8 ELSE 0 END AS rp FROM a),
t AS (SELECT *, sp + tp + dp + wp + rp AS raw FROM p),
u AS (SELECT *, CASE WHEN phase = 'Off season' AND raw > 5 THEN 5 ELSE raw END AS total, CASE WHEN phase = 'Off season' AND raw > 5 THEN raw - 5 ELSE 0 END AS cut FROM t)
SELECT *, (abs(sp) * st + abs(tp) * 3 + abs(dp) * 3 + abs(wp) * wt + abs(rp) * 3 + cut * 4) / CAST(abs(sp) + abs(tp) + abs(dp) + abs(wp) + abs(rp) + cut AS DOUBLE) AS tier_mean,
  CASE WHEN total >= 46 THEN 'PRIME' WHEN total >= 34 THEN 'strong' WHEN total >= 24 THEN 'good' WHEN total >= 14 THEN 'fair' ELSE 'poor' END AS rating FROM u""", ("fhour",))


def _scored(b):
    day = F.to_date("hour_utc")
    highs = b.weather().groupBy("location_id", day.alias("d0")).agg(F.max("temp_f").alias("high"))
    drops = planner.day_over_day_drop(highs.withColumnRenamed("d0", "day"), ["location_id"]).select(
        "location_id", F.col("day").alias("d0"), "drop_f")
    h = F.hour("hour_utc")
    hours = b.weather().select(
        "location_id", day.alias("d0"), F.col("hour_utc").alias("at"),
        F.when(h.between(5, 10), "AM").when(h.between(14, 18), "PM").alias("window"), F.col("temp_f").alias("temp"),
        F.col("wind_mph").alias("wind"), "wind_dir", F.col("precip_in").alias("precip"), F.col("cloud_pct").alias("cloud"),
        (F.col("pressure_inhg") / 0.02952998751).alias("pressure_hpa")).where(F.col("window").isNotNull())
    rows = hours.join(drops, ["location_id", "d0"]).withColumn(
        "day", F.date_add("d0", (F.col("location_id") * 145).cast("int"))).drop("d0")
    return planner.score_windows(rows, ["location_id"])


@query("sit_scores", needs=("sitscore",), sql="""
SELECT location_id, CAST(day AS VARCHAR) AS day, "window", total, rating, phase, round(temp, 6) AS temp, round(rain, 6) AS rain,
  CASE WHEN tier_mean >= 4.5 THEN 'Y' WHEN tier_mean >= 3.5 THEN 'A' WHEN tier_mean >= 2.5 THEN 'B' WHEN tier_mean >= 1.5 THEN 'C' ELSE 'D' END AS evidence_tier,
  floor(hpa * 0.02952998751e0 * 100 + 0.5) / 100 AS pressure_inhg FROM sitscore""")
def sit_scores(b):
    return _scored(b).select("location_id", F.col("day").cast("string").alias("day"), "window", "total", "rating", "phase",
                             round6("temp").alias("temp"), round6("rain").alias("rain"), "evidence_tier", "pressure_inhg")


@query("plan_best_camera", needs=("sitscore",), sql="""
SELECT CAST(day AS VARCHAR) AS day, "window", arg_max(location_id, total * 1000 - location_id) AS location_id, max(total) AS total, count(*) AS cameras
FROM (SELECT *, day - CAST(location_id * 145 AS INT) AS d0 FROM sitscore) GROUP BY 1, 2""")
def plan_best_camera(b):
    out = planner.best_camera_per_window(_scored(b), "location_id")
    return out.select(F.col("day").cast("string").alias("day"), "window", "location_id", "total", "cameras")


@query("top_plan", needs=("sitscore",), sql="""
SELECT CAST(day AS VARCHAR) AS day, "window", max(total) AS total FROM sitscore GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 12""")
def top_plan(b):
    out = planner.top_plan(planner.best_camera_per_window(_scored(b), "location_id"))
    return out.select(F.col("day").cast("string").alias("day"), "window", "total")


@query("plan_leading_parts", needs=("sitscore",), sql="""
SELECT location_id, CAST(day AS VARCHAR) AS day, "window", array_to_string(list_transform(list_filter([sp, tp, dp, wp, rp, -cut], lambda x: abs(x) >= 3)[1:3],
  lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS leading FROM sitscore""")
def plan_leading_parts(b):
    """The first three parts of every sit's score that weigh three points or more."""
    parts = planner.leading_parts(F.col("parts"))
    points = F.array_join(F.transform(parts, lambda p: p["points"].cast("string")), ",")
    return _scored(b).select("location_id", F.col("day").cast("string").alias("day"), "window", points.alias("leading"))


NOW_MS = 1713182400000                    # 2024-04-15T12:00:00Z
table_sql("clocked", """SELECT *, epoch_us(CAST(day AS TIMESTAMP)) / 1000e0 + CASE "window" WHEN 'AM' THEN 5 ELSE 14 END * 3600000e0 AS starts_ms,
  epoch_us(CAST(day AS TIMESTAMP)) / 1000e0 + CASE "window" WHEN 'AM' THEN 10 ELSE 18 END * 3600000e0 AS ends_ms FROM sitscore""", ("sitscore",))


def _clocked(b):
    start = solar.day_start_ms(F.col("day"))
    am = F.col("window") == "AM"
    return _scored(b).withColumns({"starts_ms": start + F.when(am, 5).otherwise(14) * solar.HOUR_MS,
                                   "ends_ms": start + F.when(am, 10).otherwise(18) * solar.HOUR_MS})


@query("next_sits", needs=("clocked",), sql=f"""
SELECT location_id, CAST(day AS VARCHAR) AS day, "window", total FROM clocked WHERE ends_ms > {NOW_MS} ORDER BY starts_ms, "window" LIMIT 2""")
def next_sits(b):
    return planner.upcoming(_clocked(b), F.lit(NOW_MS)).select("location_id", F.col("day").cast("string").alias("day"), "window", "total")


@query("best_sit_ahead", needs=("clocked",), sql=f"""
SELECT CAST(day AS VARCHAR) AS day, "window", total FROM clocked WHERE ends_ms > {NOW_MS} ORDER BY total DESC, starts_ms LIMIT 1""")
def best_sit_ahead(b):
    return planner.best_ahead(_clocked(b), F.lit(NOW_MS)).select(F.col("day").cast("string").alias("day"), "window", "total")


@query("plan_freshness", needs=("clocked",), sql=f"""
SELECT count(*) AS sits, count(*) FILTER (WHERE ends_ms > {NOW_MS}) AS ahead, count(*) FILTER (WHERE ends_ms > {NOW_MS}) = 0 AS stale,
  max(ends_ms) AS last_ended_ms FROM clocked""")
def plan_freshness(b):
    return planner.plan_freshness(_clocked(b), F.lit(NOW_MS))


@query("forecast_freshness", needs=("fleet",), sql="""
SELECT camera_id, last_seen IS NOT NULL AND epoch_us(TIMESTAMP '2024-01-20 00:30:00') - last_seen <= 2700000000 AS fresh FROM fleet""")
def forecast_freshness(b):
    from fieldlens.sources.store import fresh
    now = F.lit("2024-01-20 00:30:00").cast("timestamp")
    return b.fleet().select("camera_id", fresh(F.col("last_seen"), now, FORECAST_TTL_MINUTES).alias("fresh"))


# ---- stands -----------------------------------------------------------------------------

WINDOW, WIND, DAY, NOW = "AM", 200.0, "2023-11-10", "1998-06-15 12:00:00"
table_sql("scores", f"""WITH st AS (SELECT c_custkey AS stand_id, c_name AS stand_name, c_custkey % 97 AS a, c_custkey % 89 AS b, CASE WHEN c_custkey % 4 <> 0 THEN
    list_distinct([c_custkey % 5 * 3, c_custkey % 3 * 4 + 1]) END AS wi, c_custkey % 20 AS slope, c_custkey * 31 % 360 AS aspect FROM customer),
w AS (SELECT *, CASE WHEN wi IS NOT NULL THEN list_contains(wi, 9) END AS huntable,
  CASE WHEN slope >= 12 THEN 1e0 WHEN slope >= 5 THEN 0.6e0 WHEN slope >= 2 THEN 0.25e0 ELSE 0e0 END AS tw,
  list_contains(wi, CAST(floor(((aspect + 180) % 360) / 22.5e0 + 0.5) AS INT) % 16) AS suits FROM st),
ev AS (SELECT s_suppkey AS camera_id, s_suppkey % 97 AS a, s_suppkey % 89 AS b, s_suppkey % 40 * 5 + 10 AS hours, s_suppkey * 7 % 50 + 0.5e0 AS per100 FROM supplier WHERE s_suppkey % 4 <> 0),
n AS (SELECT w.stand_id, min(ev.camera_id) AS camera_id FROM w JOIN ev ON ev.a = w.a AND ev.b = w.b GROUP BY 1),
r AS (SELECT w.*, e.hours, e.per100, p.logged, coalesce(p.pressure_points, 0) AS pp, coalesce(f.food_points, 0) AS fp,
  CASE WHEN huntable IS NULL THEN 0 WHEN huntable THEN 30 ELSE -40 END AS wp,
  CASE WHEN tw = 0 OR wi IS NULL THEN 0 WHEN suits THEN CAST(floor(tw * 10 + 0.5) AS INT) ELSE CAST(floor(tw * -18 + 0.5) AS INT) END AS tp,
  CASE WHEN e.per100 IS NOT NULL THEN CAST(greatest(-8, least(18, floor(18e0 * (e.per100 / (SELECT max(per100) FROM ev) - 0.5e0) * 2 + 0.5))) AS INT) ELSE 0 END AS ep
  FROM w LEFT JOIN n ON n.stand_id = w.stand_id LEFT JOIN ev e ON e.camera_id = n.camera_id
  LEFT JOIN pressed p ON p.stand_id = w.stand_id LEFT JOIN fed f ON f.stand_id = w.stand_id)
SELECT *, CAST(wp + tp + ep + pp + fp AS INT) AS total FROM r""", ("pressed", "fed"))
table_sql("pressed", REGISTRY["stand_pressure"].sql)
table_sql("fed", REGISTRY["stand_food"].sql)


def _ranked(b):
    k = F.col("stand_id")
    s = b.stands().withColumns({
        "winds": F.split("good_winds", ","), "ticked": F.split("good_winds", ","),
        "wind_source": F.when(F.col("good_winds").isNotNull(), "ticked").otherwise("none"),
        "slope": (k % 20).cast("double"), "aspect": (k * 31 % 360).cast("double")})
    c = F.col("camera_id")
    cams = b.fleet().select("camera_id", "lat", "lng")
    ev = cams.select("camera_id", (c % 40 * 5 + 10).alias("hours"), ((c * 7 % 50).cast("double") + 0.5).alias("per100"),
                     (c % 4 != 0).alias("enough"))
    return stands.rank_stands(s, WINDOW, WIND, ev, cams, context.sit_pressure(b.sits(), F.lit(NOW).cast("timestamp")),
                              context.food_scores(b.stands(), b.fields(), F.lit(DAY).cast("date")))


@query("stand_ranking", needs=("scores",), sql="""
SELECT stand_id, stand_name, total, huntable, CASE WHEN slope >= 12 THEN 'strong' WHEN slope >= 5 THEN 'moderate' WHEN slope >= 2 THEN 'weak' ELSE 'none' END AS thermal,
  hours AS own_hours, logged IS NOT NULL AS pressure_known FROM scores""")
def stand_ranking(b):
    return stands.ordered(_ranked(b)).select("stand_id", "stand_name", "total", "huntable", "thermal", "own_hours", "pressure_known")


@query("stand_confidence", needs=("scores",), sql="""
WITH t AS (SELECT * FROM scores ORDER BY total DESC, stand_id LIMIT 2), g AS (SELECT max(total) - min(total) AS gap,
  (SELECT stand_id FROM scores ORDER BY total DESC, stand_id LIMIT 1) AS leader FROM t),
c AS (SELECT s.stand_id, CASE WHEN huntable IS NULL THEN 0 ELSE 1 + CASE WHEN hours >= 200 THEN 2 WHEN hours IS NOT NULL THEN 1 ELSE 0 END
  + CASE WHEN logged IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN s.stand_id = g.leader AND g.gap >= 15 THEN 1 WHEN s.stand_id = g.leader AND g.gap <= 3 THEN -1 ELSE 0 END END AS score,
  huntable FROM scores s, g)
SELECT stand_id, score, CASE WHEN huntable IS NULL THEN 'none' WHEN score >= 5 THEN 'high' WHEN score >= 3 THEN 'moderate' WHEN score >= 1 THEN 'low' ELSE 'none' END AS confidence FROM c""")
def stand_confidence(b):
    return stands.confidence(_ranked(b)).select("stand_id", "score", "confidence")


@query("stand_verdict", needs=("scores",), sql="""
WITH p AS (SELECT * FROM scores ORDER BY CASE WHEN huntable THEN 0 ELSE 1 END, total DESC, stand_id LIMIT 1)
SELECT (SELECT count(*) FROM scores) AS stands, (SELECT count(*) FROM scores WHERE huntable) AS huntable_stands,
  (SELECT count(*) FROM scores WHERE huntable IS NULL) AS unknown_stands, stand_id, total, huntable, stand_name || ' suits the wind' AS summary FROM p""")
def stand_verdict(b):
    return stands.verdict(_ranked(b)).select("stands", "huntable_stands", "unknown_stands", "stand_id", "total", "huntable", "summary")


@query("stand_leading_reasons", needs=("scores",), sql="""
SELECT stand_id, array_to_string(list_transform(list_sort(list_filter([{'k': -abs(wp), 'r': CASE WHEN wp > 0 THEN 'wind suits this stand' ELSE 'wind carries scent down a lane' END, 'p': wp},
  {'k': -abs(tp), 'r': CASE WHEN tp > 0 THEN 'thermal suits this stand' ELSE 'thermal works against this stand' END, 'p': tp},
  {'k': -abs(ep), 'r': 'own photographs', 'p': ep}, {'k': -abs(pp), 'r': 'recent pressure', 'p': pp}, {'k': -abs(fp), 'r': 'food nearby', 'p': fp}], lambda x: x.p <> 0)), lambda x: x.r || ' ' || x.p), '; ') AS why FROM scores""")
def stand_leading_reasons(b):
    why = F.transform(stands.leading_reasons(F.col("reasons")), lambda p: F.concat(
        p["reason"], F.lit(" "), p["points"].cast("string")))
    return _ranked(b).select("stand_id", F.array_join(why, "; ").alias("why"))
