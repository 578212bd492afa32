"""Ordered jobs: counters, harvests, curves, bursts."""

from __future__ import annotations

from pyspark.sql import functions as F

import fieldlens.queries.tables  # noqa: F401
from fieldlens.functions.num import round6
from fieldlens.operators import counters, frames
from fieldlens.queries.registry import query, table_sql

NOW = "2024-01-31 00:00:00"

table_sql("numbered", """SELECT user_id % 5 AS camera_id, epoch_us(ts) AS us,
  CASE WHEN event_id % 17 <> 0 THEN event_id % 3000 END AS n FROM events""")
table_sql("epoched", """SELECT *, sum(reset) OVER (PARTITION BY camera_id ORDER BY us, n
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS epoch
  FROM (SELECT *, CASE WHEN n < lag(n) OVER (PARTITION BY camera_id ORDER BY us, n) - 100 THEN 1 ELSE 0 END AS reset
    FROM numbered WHERE n IS NOT NULL)""", ("numbered",))
table_sql("holes", """SELECT camera_id, epoch, after_n, after_us, n AS before_n, us AS before_us, n - after_n - 1 AS missing
  FROM (SELECT *, lag(n) OVER w AS after_n, lag(us) OVER w AS after_us FROM
    (SELECT camera_id, epoch, n, min(us) AS us FROM epoched GROUP BY 1, 2, 3)
    WINDOW w AS (PARTITION BY camera_id, epoch ORDER BY n)) WHERE n - after_n > 1""", ("epoched",))


def _numbered(b):
    name = F.get_json_object("raw", "$.originName")
    return b.numbered_photos().select("camera_id", "taken_at", counters.counter_of(name).alias("n"))


@query("counter_gaps", needs=("holes",), sql="""
SELECT camera_id, CAST(epoch AS BIGINT) AS epoch, after_n, after_us, before_n, before_us, missing FROM holes""")
def counter_gaps(b):
    g = counters.counter_gaps(_numbered(b))
    return g.select("camera_id", "epoch", "after_n", F.unix_micros("after_at").alias("after_us"), "before_n",
                    F.unix_micros("before_at").alias("before_us"), "missing")


@query("counter_gap_summary", needs=("numbered", "epoched", "holes"), sql=f"""
SELECT n.camera_id, n.counted, n.skipped, e.resets, h.gaps, h.missing, h.recent,
  CASE WHEN h.recent > 0 THEN 'warn' ELSE 'ok' END AS level, h.newest.a AS after_us, h.newest.b AS before_us
FROM (SELECT camera_id, count(n) AS counted, count(*) - count(n) AS skipped FROM numbered GROUP BY 1) n
JOIN (SELECT camera_id, CAST(sum(reset) AS BIGINT) AS resets FROM epoched GROUP BY 1) e ON e.camera_id = n.camera_id
JOIN (SELECT camera_id, count(*) AS gaps, CAST(sum(missing) AS BIGINT) AS missing,
  CAST(sum(CASE WHEN epoch_us(TIMESTAMP '{NOW}') - before_us <= 30 * 86400000000 THEN missing ELSE 0 END) AS BIGINT) AS recent,
  arg_max({{'a': after_us, 'b': before_us}}, before_us) AS newest FROM holes GROUP BY 1) h ON h.camera_id = n.camera_id""")
def counter_gap_summary(b):
    s = counters.gap_summary(_numbered(b), F.lit(NOW).cast("timestamp"))
    return s.select("camera_id", "counted", "skipped", "resets", "gaps", "missing", "recent", "level",
                    F.unix_micros("after_at").alias("after_us"), F.unix_micros("before_at").alias("before_us"))


@query("pressure_trend", needs=("wx", "wxh"), sql="""
SELECT location_id, CAST(day AS VARCHAR) AS day, "window", round(arg_max(p, h) - arg_min(p, h), 6) AS trend,
  arg_min(wd, h) FILTER (WHERE rn = n // 2 + 1) AS mid_wind_dir FROM (
  SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY location_id, day, "window") AS n FROM (
    SELECT x.location_id, x.day, x.h, w.pressure_inhg AS p, w.wind_dir AS wd,
      CASE WHEN x.h BETWEEN 5 AND 10 THEN 'AM' WHEN x.h BETWEEN 14 AND 18 THEN 'PM' END AS "window"
    FROM wxh x JOIN wx w ON w.location_id = x.location_id
      AND w.hour_no = epoch_us(CAST(x.day AS TIMESTAMP)) // 3600000000 + x.h) WHERE "window" IS NOT NULL
  WINDOW w AS (PARTITION BY location_id, day, "window" ORDER BY h)) GROUP BY 1, 2, 3""")
def pressure_trend(b):
    from fieldlens.plans.planner import window_trend
    h = F.hour("hour_utc")
    rows = b.weather().select("location_id", F.to_date("hour_utc").alias("day"), F.col("hour_utc").alias("at"),
                              F.when(h.between(5, 10), "AM").when(h.between(14, 18), "PM").alias("window"),
                              F.col("pressure_inhg").alias("pressure"), "wind_dir").where(F.col("window").isNotNull())
    out = window_trend(rows, ["location_id", "day", "window"])
    return out.select("location_id", F.col("day").cast("string").alias("day"), "window",
                      round6("trend").alias("trend"), "mid_wind_dir")


@query("daily_high_drop", needs=("wx",), sql="""
SELECT location_id, CAST(day AS VARCHAR) AS day, high, coalesce(lag(high) OVER (PARTITION BY location_id ORDER BY day) - high, 0) AS drop_f
FROM (SELECT location_id, CAST(hour_utc AS DATE) AS day, max(temp_f) AS high FROM wx GROUP BY 1, 2)""")
def daily_high_drop(b):
    from fieldlens.plans.planner import day_over_day_drop
    highs = b.weather().groupBy("location_id", F.to_date("hour_utc").alias("day")).agg(F.max("temp_f").alias("high"))
    return day_over_day_drop(highs, ["location_id"]).select(
        "location_id", F.col("day").cast("string").alias("day"), "high", "drop_f")


# ---- bursts -----------------------------------------------------------------------------

table_sql("burst", """SELECT vec_id AS photo_id, vec_id // 4 AS visit_id, CAST(label AS BIGINT) AS camera_id,
  list_transform(range(64), lambda k: CASE WHEN k >= 16 AND k < 48 AND k % 4 = CASE vec_id // 4 % 3 WHEN 0 THEN vec_id % 4
      WHEN 1 THEN 3 - vec_id % 4 ELSE 1 END THEN 15 WHEN k >= 60 AND CAST(embedding[k + 1] AS DOUBLE) > 0.2e0 THEN 1 ELSE 0 END) AS d
  FROM embeddings""")
table_sql("burst_bit", """SELECT photo_id, visit_id, i, (d[i // 4 + 1] >> (3 - i % 4)) & 1 AS bit
  FROM (SELECT *, unnest(range(256)) AS i FROM burst)""", ("burst",))
table_sql("burst_col", """SELECT b.visit_id, b.photo_id, count(*) AS bits, avg(b.i % 16) AS col
  FROM burst_bit b JOIN (SELECT visit_id, i, CASE WHEN sum(bit) * 2 > count(*) THEN 1 ELSE 0 END AS bg
    FROM burst_bit GROUP BY 1, 2 HAVING count(*) >= 3) g ON g.visit_id = b.visit_id AND g.i = b.i
  WHERE b.bit <> g.bg GROUP BY 1, 2 HAVING count(*) >= 12""", ("burst_bit",))
table_sql("crossing", """SELECT v.visit_id, v.camera_id, v.frames, h.subjects, h.drift,
  CASE WHEN h.drift >= 1.5 THEN 'right' WHEN h.drift <= -1.5 THEN 'left' END AS crossing,
  CASE WHEN v.frames < 2 THEN 'single frame' WHEN v.frames < 3 THEN 'no background'
    WHEN h.drift IS NULL THEN 'too few subjects' WHEN abs(h.drift) < 1.5 THEN 'did not cross' END AS why
FROM (SELECT visit_id, min(camera_id) AS camera_id, count(*) AS frames FROM burst GROUP BY 1) v
LEFT JOIN (SELECT visit_id, max(n) AS subjects, avg(CASE WHEN rn > n // 2 THEN col END)
    - avg(CASE WHEN rn <= greatest(1, n // 2) THEN col END) AS drift
  FROM (SELECT *, row_number() OVER (PARTITION BY visit_id ORDER BY photo_id) AS rn,
    count(*) OVER (PARTITION BY visit_id) AS n FROM burst_col) WHERE n >= 2 GROUP BY 1) h ON h.visit_id = v.visit_id""",
          ("burst", "burst_col"))


@query("burst_crossings", needs=("crossing",), sql="""
SELECT visit_id, frames, subjects, round(drift, 6) AS drift, crossing, why FROM crossing""")
def burst_crossings(b):
    return frames.crossings(b.bursts()).withColumn("drift", round6("drift"))


@query("visit_headings", needs=("crossing",), sql="""
SELECT visit_id, camera_id, crossing, CASE WHEN camera_id % 4 <> 0 THEN CASE crossing
    WHEN 'right' THEN (camera_id * 40e0 + 90) % 360 WHEN 'left' THEN (camera_id * 40e0 + 270) % 360 END END AS heading_deg,
  coalesce(why, CASE WHEN camera_id % 4 = 0 THEN 'no facing set' END) AS note FROM crossing""")
def visit_headings(b):
    bursts = b.bursts()
    owners = bursts.groupBy("visit_id").agg(F.min("camera_id").alias("camera_id"))
    k = F.col("camera_id")
    facings = bursts.select("camera_id").distinct().select(
        "camera_id", F.when(k % 4 != 0, k * 40.0).alias("facing_deg"))
    return frames.headings(frames.crossings(bursts), owners, facings)


table_sql("shot", """SELECT vec_id AS photo_id, vec_id % 3 AS grp, vec_id % 3 || '-' || vec_id // 15 AS visit_id, camera_id,
  overlay_a || substr('0123456789abcdef', 1 + CAST(vec_id % 16 AS INT), 1) || overlay_b AS phash, base FROM (
  SELECT photo_id AS vec_id, camera_id, phash AS base, substr(phash, 1, 30) AS overlay_a, substr(phash, 32) AS overlay_b FROM hash)""",
          ("hash",))
table_sql("empties", """SELECT s.photo_id, s.visit_id, s.camera_id, CASE WHEN n.of >= 3 AND m.bits <= 12 THEN m.bits END AS bits,
  CASE WHEN n.of >= 3 AND m.bits <= 12 THEN n.of END AS of FROM shot s
LEFT JOIN (SELECT camera_id, count(*) AS of FROM shot WHERE grp = 0 GROUP BY 1) n ON n.camera_id = s.camera_id
LEFT JOIN (SELECT a.photo_id, min(list_sum(list_transform(range(16), lambda i: bit_count(xor(
    CAST('0x' || substr(a.phash, CAST(4 + 4 * i AS INT), 4) AS INT), CAST('0x' || substr(b.base, CAST(4 + 4 * i AS INT), 4) AS INT)))))) AS bits
  FROM shot a JOIN shot b ON b.camera_id = a.camera_id AND b.grp = 0 GROUP BY 1) m ON m.photo_id = s.photo_id""", ("shot",))


def _matched(b):
    h = b.hashes()
    v = F.col("photo_id")
    digit = F.lower(F.hex(v % 16))
    shots = h.select("photo_id", F.concat((v % 3).cast("string"), F.lit("-"), F.floor(v / 15).cast("string")).alias("visit_id"),
                     "camera_id", F.concat(F.substring("phash", 1, 30), digit, F.substring("phash", 32, 64)).alias("phash"))
    base = h.select("camera_id", F.when(v % 3 == 0, F.col("phash")).alias("phash"))
    return frames.empty_matches(shots, base)


@query("empty_scene_matches", needs=("empties",), sql="""
SELECT photo_id, camera_id, CAST(bits AS BIGINT) AS bits, of AS "of" FROM empties""")
def empty_scene_matches(b):
    return _matched(b).select("photo_id", "camera_id", F.col("bits").cast("bigint").alias("bits"), "of")


@query("visit_empty_verdicts", needs=("empties",), sql="""
SELECT visit_id, CASE WHEN bool_and(bits IS NOT NULL) THEN CAST(max(bits) AS BIGINT) END AS bits FROM empties GROUP BY 1""")
def visit_empty_verdicts(b):
    return frames.visit_matches(_matched(b)).withColumn("bits", F.col("bits").cast("bigint"))
