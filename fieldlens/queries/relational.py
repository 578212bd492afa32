"""Joins, counts and lists over the camera store."""

from __future__ import annotations

from pyspark.sql import functions as F

import fieldlens.queries.statistics  # noqa: F401  (visit table expression)
from fieldlens.functions import solar
from fieldlens.functions.compass import compass_point
from fieldlens.functions.num import round6
from fieldlens.operators import health, review
from fieldlens.operators.visits import assign_visits, grouping_counts, span_seconds, visits
from fieldlens.queries.registry import query, table_sql

US = "epoch_us"
table_sql("prop", "SELECT CAST(r_regionkey AS BIGINT) AS property_id, r_name AS property_name FROM region")
table_sql("vphoto", """SELECT *, sum(opens) OVER (PARTITION BY camera_id ORDER BY us, photo_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS visit_no
  FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY camera_id ORDER BY us, photo_id) <= 300000000
    THEN 0 ELSE 1 END AS opens FROM photo)""", ("photo",))
table_sql("rvisit", """SELECT *, CASE WHEN photo_count % 2 = 0 THEN e END AS reviewed_us FROM visit""", ("visit",))
table_sql("stand", """SELECT c_custkey AS stand_id, c_name AS stand_name,
  44e0 + CAST(c_custkey % 97 AS DOUBLE) * 0.01e0 AS lat, -90e0 - CAST(c_custkey % 89 AS DOUBLE) * 0.012e0 AS lng,
  CAST(c_nationkey % 7 AS BIGINT) AS property_id,
  ['stand', 'tripod', 'ground-blind', 'box-blind', 'saddle', 'other'][c_custkey % 6 + 1] AS "type" FROM customer""")
table_sql("fleet", """SELECT s_suppkey AS camera_id, s_name AS camera_name,
  44e0 + CAST(s_suppkey % 97 AS DOUBLE) * 0.01e0 AS lat, -90e0 - CAST(s_suppkey % 89 AS DOUBLE) * 0.012e0 AS lng,
  CAST(s_nationkey % 7 AS BIGINT) AS property_id,
  CASE WHEN s_suppkey % 9 <> 0 THEN CAST(floor(s_acctbal / 110e0) AS BIGINT) END AS battery,
  CASE WHEN s_suppkey % 8 <> 0 THEN (s_suppkey * 37) % 1001 END AS photo_count,
  CASE WHEN s_suppkey % 5 <> 0 THEN 1000 END AS photo_limit,
  epoch_us(TIMESTAMP '2024-01-01') + (s_suppkey % 20) * 86400000000 AS cycle_start,
  epoch_us(TIMESTAMP '2024-01-31') + (s_suppkey % 20) * 86400000000 AS cycle_end,
  CASE WHEN s_suppkey % 11 <> 0 THEN (1706227200 - (s_suppkey * 13 % 45) * 86400 - s_suppkey % 7 * 3600) * 1000000 END AS last_seen
  FROM supplier""")


def _reviewed(b):
    v = visits(b.photos())
    return v.withColumn("reviewed_at", F.when(F.col("photo_count") % 2 == 0, F.col("ended_at")))


@query("photo_visits", needs=("visit",), sql="""
SELECT camera_id, CAST(visit_no AS BIGINT) AS visit_no, s AS start_us, e AS end_us, photo_count,
  CAST(floor((e - s) / 1e6 + 0.5) AS BIGINT) AS span_s FROM visit""")
def photo_visits(b):
    return visits(b.photos()).select(
        "camera_id", "visit_no", F.unix_micros("started_at").alias("start_us"),
        F.unix_micros("ended_at").alias("end_us"), "photo_count",
        span_seconds(F.col("started_at"), F.col("ended_at")).alias("span_s"))


@query("photo_visit_assignment", needs=("vphoto",), sql="""
SELECT photo_id, camera_id, CAST(visit_no AS BIGINT) AS visit_no FROM vphoto""")
def photo_visit_assignment(b):
    return assign_visits(b.photos()).select("photo_id", "camera_id", "visit_no")


@query("visit_grouping_counts", needs=("visit", "photo"), sql="""
SELECT (SELECT count(*) FROM visit) AS visits, count(taken_at) AS grouped,
  count(*) - count(taken_at) AS ungrouped FROM photo""")
def visit_grouping_counts(b):
    return grouping_counts(b.photos())


@query("cameras_with_property", needs=("fleet", "prop"), sql="""
SELECT f.camera_id, f.camera_name, p.property_name FROM fleet f LEFT JOIN prop p ON p.property_id = f.property_id""")
def cameras_with_property(b):
    return b.fleet().join(b.properties(), "property_id", "left").select(
        "camera_id", "camera_name", "property_name")


@query("visits_with_camera", needs=("rvisit", "cam"), sql="""
SELECT v.camera_id, CAST(v.visit_no AS BIGINT) AS visit_no, v.photo_count, round(c.lat, 6) AS lat,
  v.reviewed_us IS NOT NULL AS reviewed FROM rvisit v JOIN cam c ON c.camera_id = v.camera_id""")
def visits_with_camera(b):
    return _reviewed(b).join(b.cameras(), "camera_id").select(
        "camera_id", "visit_no", "photo_count", round6("lat").alias("lat"),
        F.col("reviewed_at").isNotNull().alias("reviewed"))


@query("detections_with_names", needs=("det", "vphoto", "indiv"), sql="""
SELECT d.photo_id, p.camera_id, CAST(p.visit_no AS BIGINT) AS visit_no, d.species, d.n, i.individual_name
FROM det d JOIN vphoto p ON p.photo_id = d.photo_id LEFT JOIN indiv i ON i.individual_id = d.individual_id""")
def detections_with_names(b):
    return review.detections_named(b.detections(), assign_visits(b.photos()), b.individuals()).select(
        "photo_id", "camera_id", "visit_no", "species", "n", "individual_name")


@query("detections_with_weather", needs=("det", "photo", "cam", "wx"), sql="""
SELECT d.photo_id, p.camera_id, d.species, w.wind_dir, w.temp_f, round(w.pressure_inhg, 6) AS pressure_inhg,
  round(w.precip_in, 6) AS precip_in, w.cloud_pct
FROM det d JOIN photo p ON p.photo_id = d.photo_id JOIN cam c ON c.camera_id = p.camera_id
LEFT JOIN wx w ON w.location_id = c.location_id AND w.hour_utc = p.hour_utc WHERE d.confirmed""")
def detections_with_weather(b):
    return review.detections_with_weather(b.detections(), b.photos(), b.cameras(), b.weather()).select(
        "photo_id", "camera_id", "species", "wind_dir", "temp_f", round6("pressure_inhg").alias("pressure_inhg"),
        round6("precip_in").alias("precip_in"), "cloud_pct")


@query("empty_baseline_photos", needs=("vphoto", "rvisit", "det"), sql="""
SELECT p.photo_id, p.camera_id, CAST(p.visit_no AS BIGINT) AS visit_no FROM vphoto p
JOIN rvisit v ON v.camera_id = p.camera_id AND v.visit_no = p.visit_no AND v.reviewed_us IS NOT NULL
WHERE NOT EXISTS (SELECT 1 FROM det d JOIN vphoto q ON q.photo_id = d.photo_id
  WHERE d.confirmed AND q.camera_id = p.camera_id AND q.visit_no = p.visit_no)""")
def empty_baseline_photos(b):
    reviewed = _reviewed(b).where(F.col("reviewed_at").isNotNull())
    return review.empty_visits(assign_visits(b.photos()), reviewed, b.detections()).select(
        "photo_id", "camera_id", "visit_no")


@query("property_counts", needs=("prop", "fleet", "stand"), sql="""
SELECT p.property_id, p.property_name, (SELECT count(*) FROM fleet f WHERE f.property_id = p.property_id) AS cameras,
  (SELECT count(*) FROM stand s WHERE s.property_id = p.property_id) AS stands FROM prop p""")
def property_counts(b):
    return review.child_counts(b.properties(), "property_id", {"cameras": b.fleet(), "stands": b.stands()})


@query("photo_labels", needs=("photo", "det", "indiv"), sql="""
SELECT p.photo_id, p.camera_id, l.confirmed_labels, l.machine_claims FROM photo p LEFT JOIN (
  SELECT d.photo_id, string_agg(CASE WHEN d.confirmed THEN d.species || CASE WHEN i.individual_name IS NOT NULL
      THEN ' (' || i.individual_name || ')' ELSE '' END END, ', ' ORDER BY d.species) AS confirmed_labels,
    string_agg(DISTINCT CASE WHEN d.source = 'camera-ai' AND NOT d.confirmed THEN d.species END, ', ') AS machine_claims
  FROM det d LEFT JOIN indiv i ON i.individual_id = d.individual_id GROUP BY 1) l ON l.photo_id = p.photo_id""")
def photo_labels(b):
    return review.photo_labels(b.photos(), b.detections(), b.individuals()).select(
        "photo_id", "camera_id", "confirmed_labels", "machine_claims")


@query("recent_photos", needs=("photo",), sql="""
SELECT photo_id, camera_id, us FROM photo WHERE taken_at IS NOT NULL ORDER BY us DESC, photo_id LIMIT 200""")
def recent_photos(b):
    return (b.photos().where(F.col("taken_at").isNotNull())
            .select("photo_id", "camera_id", F.unix_micros("taken_at").alias("us"))
            .orderBy(F.col("us").desc(), "photo_id").limit(200))


@query("newest_photos_per_camera", needs=("photo",), sql="""
SELECT photo_id, camera_id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY camera_id
  ORDER BY us DESC, photo_id) AS rank FROM photo) WHERE rank <= 500""")
def newest_photos_per_camera(b):
    return review.newest_per_group(b.photos(), ["camera_id"], [F.col("taken_at").desc(), F.col("photo_id")],
                                   500).select("photo_id", "camera_id", "rank")


@query("visit_queue", needs=("rvisit", "cam"), sql="""
SELECT v.camera_id, CAST(v.visit_no AS BIGINT) AS visit_no, v.photo_count,
  CAST(floor((v.e - v.s) / 1e6 + 0.5) AS BIGINT) AS span_s FROM rvisit v JOIN cam c ON c.camera_id = v.camera_id
WHERE v.reviewed_us IS NULL ORDER BY v.s DESC, v.camera_id LIMIT 200""")
def visit_queue(b):
    return review.visit_queue(_reviewed(b), b.cameras(), unreviewed=True).select(
        "camera_id", "visit_no", "photo_count",
        span_seconds(F.col("started_at"), F.col("ended_at")).alias("span_s"))


@query("visit_nest", needs=("vphoto", "det"), sql="""
SELECT p.camera_id, CAST(p.visit_no AS BIGINT) AS visit_no, string_agg(CAST(p.photo_id AS VARCHAR), ',' ORDER BY p.photo_id) AS photos,
  string_agg(d.photo_id || ':' || d.species, ',' ORDER BY d.photo_id) AS detections
FROM vphoto p LEFT JOIN det d ON d.photo_id = p.photo_id GROUP BY 1, 2""")
def visit_nest(b):
    vp = assign_visits(b.photos())
    out = review.visit_nest(visits(b.photos()).select("camera_id", "visit_no"), vp, b.detections())
    return out.select("camera_id", "visit_no",
                      F.array_join(F.col("photos").cast("array<string>"), ",").alias("photos"),
                      F.array_join(F.transform("detections", lambda d: F.concat(
                          d["photo_id"].cast("string"), F.lit(":"), d["species"])), ",").alias("detections"))


table_sql("spoken", """SELECT photo_id, source, CASE species WHEN 'click' THEN 'Doe' WHEN 'view' THEN ' buck '
  WHEN 'signup' THEN 'Turkey' WHEN 'error' THEN 'vehicle' ELSE 'coyote' END AS word FROM det""", ("det",))


def _spoken(b):
    s = F.col("species")
    return b.detections().withColumn("species", F.when(s == "click", "Doe").when(s == "view", " buck ")
                                     .when(s == "signup", "Turkey").when(s == "error", "vehicle")
                                     .otherwise("coyote"))


HOUSE = ("CASE lower(trim({0})) WHEN 'deer' THEN 'deer' WHEN 'buck' THEN 'deer' WHEN 'doe' THEN 'deer'"
         " WHEN 'fawn' THEN 'deer' WHEN 'turkey' THEN 'turkey' WHEN 'bear' THEN 'bear'"
         " WHEN 'coyote' THEN 'coyote' WHEN 'raccoon' THEN 'raccoon' END")


@query("vendor_word_map", needs=("spoken",), sql=f"""
SELECT photo_id, {HOUSE.format("word")} AS species, word FROM spoken WHERE source = 'camera-ai'""")
def vendor_word_map(b):
    return _spoken(b).where(F.col("source") == "camera-ai").select(
        "photo_id", review.house_species(F.col("species")).alias("species"), F.col("species").alias("word"))


@query("claims_to_agree", needs=("spoken", "vphoto"), sql=f"""
WITH d AS (SELECT p.camera_id, p.visit_no, s.source, s.word FROM spoken s JOIN vphoto p ON p.photo_id = s.photo_id)
SELECT DISTINCT camera_id, CAST(visit_no AS BIGINT) AS visit_no, species FROM (
  SELECT camera_id, visit_no, {HOUSE.format("word")} AS species FROM d WHERE source = 'camera-ai') c
WHERE species IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d WHERE d.source <> 'camera-ai'
  AND d.camera_id = c.camera_id AND d.visit_no = c.visit_no AND d.word = c.species)""")
def claims_to_agree(b):
    return review.claims_to_agree(assign_visits(b.photos()), _spoken(b))


@query("confirmed_animals_recent", needs=("det", "photo"), sql="""
SELECT p.camera_id, CAST(sum(d.n) AS BIGINT) AS animals FROM det d JOIN photo p ON p.photo_id = d.photo_id
WHERE d.confirmed AND p.taken_at >= TIMESTAMP '2024-01-10' GROUP BY 1""")
def confirmed_animals_recent(b):
    return review.confirmed_counts(b.detections(), b.photos(), F.lit("2024-01-10").cast("timestamp"))


@query("individual_sightings", needs=("indiv", "det"), sql="""
SELECT i.individual_id, i.individual_name, count(d.photo_id) AS sightings FROM indiv i
LEFT JOIN det d ON d.individual_id = i.individual_id GROUP BY 1, 2""")
def individual_sightings(b):
    return review.individual_sightings(b.individuals(), b.detections())


@query("store_counts", needs=("prop", "cam", "photo", "det", "indiv", "wx"), sql="""
SELECT 'properties' AS "table", (SELECT count(*) FROM prop) AS "rows" UNION ALL SELECT 'cameras', (SELECT count(*) FROM cam)
UNION ALL SELECT 'photos', (SELECT count(*) FROM photo) UNION ALL SELECT 'detections', (SELECT count(*) FROM det)
UNION ALL SELECT 'individuals', (SELECT count(*) FROM indiv) UNION ALL SELECT 'weather_hours', (SELECT count(*) FROM wx)""")
def store_counts(b):
    return review.store_counts({"properties": b.properties(), "cameras": b.cameras(), "photos": b.photos(),
                                "detections": b.detections(), "individuals": b.individuals(),
                                "weather_hours": b.weather()})


@query("sits_with_stand", needs=("sit", "stand"), sql="""
SELECT s.sit_id, s.stand_id, t.stand_name, CAST(s.date AS VARCHAR) AS date, s."window", s.deer FROM sit s
LEFT JOIN stand t ON t.stand_id = s.stand_id""")
def sits_with_stand(b):
    return b.sits().join(b.stands().select("stand_id", "stand_name"), "stand_id", "left").select(
        "sit_id", "stand_id", "stand_name", F.col("date").cast("string").alias("date"), "window", "deer")


@query("routes_with_stand", needs=("stand",), sql="""
SELECT c_custkey AS route_id, c_custkey AS stand_id, t.stand_name, 6 AS points FROM customer LEFT JOIN stand t ON t.stand_id = c_custkey AND t.stand_id % 3 <> 0""")
def routes_with_stand(b):
    named = b.stands().where(F.col("stand_id") % 3 != 0).select("stand_id", "stand_name")
    return b.routes().join(named, "stand_id", "left").select("route_id", "stand_id", "stand_name", F.size("points").alias("points"))


@query("tracks_with_stand_and_route", needs=("stand",), sql="""
SELECT o_orderkey AS track_id, t.stand_name, r.c_name AS route_name FROM orders LEFT JOIN stand t ON t.stand_id = CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END
LEFT JOIN customer r ON r.c_custkey = o_custkey * 2""")
def tracks_with_stand_and_route(b):
    o = F.col("o_custkey")
    tracks = b.table("orders").select(F.col("o_orderkey").alias("track_id"), F.when(F.col("o_orderkey") % 5 != 0, o).alias("stand_id"), (o * 2).alias("route_id"))
    routes = b.table("customer").select(F.col("c_custkey").alias("route_id"), F.col("c_name").alias("route_name"))
    return (tracks.join(b.stands().select("stand_id", "stand_name"), "stand_id", "left").join(routes, "route_id", "left")
            .select("track_id", "stand_name", "route_name"))


@query("usable_sits", needs=("sit",), sql="""
SELECT sit_id, rating, deer FROM sit WHERE rating IS NOT NULL AND deer IS NOT NULL""")
def usable_sits(b):
    from fieldlens.operators.journal import usable
    return usable(b.sits()).select("sit_id", "rating", "deer")


@query("avoid_targets", needs=("stand",), sql="""
SELECT CAST(stand_id AS VARCHAR) AS target_id, 'stand' AS kind, round(lat, 6) AS lat, round(lng, 6) AS lng FROM stand
UNION ALL SELECT 'm' || p_partkey, CASE p_size % 8 WHEN 2 THEN 'bed' ELSE 'food-plot' END,
  round(44e0 + CAST(p_partkey % 97 AS DOUBLE) * 0.01e0, 6), round(-90e0 - CAST(p_partkey % 89 AS DOUBLE) * 0.012e0, 6)
FROM part WHERE ['rub','scrape','bed','trail','food-plot','water','access','other'][p_size % 8 + 1] IN ('bed', 'food-plot')""")
def avoid_targets(b):
    stands = b.stands().select(F.col("stand_id").cast("string").alias("target_id"),
                               F.lit("stand").alias("kind"), "lat", "lng")
    marks = b.markers().where(F.col("kind").isin("bed", "food-plot")).select(
        F.concat(F.lit("m"), F.col("marker_id").cast("string")).alias("target_id"), "kind", "lat", "lng")
    return stands.unionByName(marks).withColumns({"lat": round6("lat"), "lng": round6("lng")})


@query("marker_ages", sql="""
SELECT p_partkey AS marker_id, ['Rub','Scrape','Bed','Trail','Food plot','Water','Access route','Other'][p_size % 8 + 1] AS label,
  CASE WHEN p_partkey % 6 <> 0 THEN CAST(floor((epoch_us(TIMESTAMP '2024-01-26 12:00:00') - epoch_us(TIMESTAMP '2023-06-01')
    - (p_partkey % 200) * 86400000000 - (p_partkey % 24) * 3600000000) / 86400e6) AS BIGINT) END AS days_old FROM part""")
def marker_ages(b):
    from fieldlens.constants import MARKER_LABELS
    labels = F.create_map(*[F.lit(v) for kv in MARKER_LABELS.items() for v in kv])
    age = (F.unix_micros(F.lit("2024-01-26 12:00:00").cast("timestamp")) - F.unix_micros("found_at")) / 86_400_000_000
    return b.markers().select("marker_id", labels[F.col("kind")].alias("label"), F.floor(age).alias("days_old"))


NOW = "2024-01-26 12:00:00"


@query("camera_quota", needs=("fleet",), sql=f"""
WITH a AS (SELECT camera_id, photo_count AS used, photo_limit AS lim, greatest(0, photo_limit - photo_count) AS remaining,
  least(1e0, CAST(photo_count AS DOUBLE) / photo_limit) AS pct,
  CAST(greatest(0, floor((cycle_end - epoch_us(TIMESTAMP '{NOW}')) / 86400e6)) AS BIGINT) AS days_left,
  greatest(0e0, (epoch_us(TIMESTAMP '{NOW}') - cycle_start) / 86400e6) AS elapsed FROM fleet),
b AS (SELECT *, CASE WHEN used IS NOT NULL AND lim IS NOT NULL THEN TRUE END AS known,
  CASE WHEN remaining > 0 AND elapsed >= 1 AND used > 0 AND lim IS NOT NULL THEN used / elapsed END AS per_day FROM a),
c AS (SELECT *, remaining / per_day AS dry_in, CAST(greatest(0, floor(days_left - remaining / per_day)) AS BIGINT) AS early FROM b)
SELECT camera_id, CASE WHEN known THEN remaining END AS remaining, CASE WHEN known THEN round(pct, 6) END AS quota_pct,
  CASE WHEN known THEN days_left END AS days_left, round(per_day, 6) AS per_day,
  CASE WHEN per_day IS NOT NULL THEN early END AS days_early,
  CASE WHEN known AND remaining = 0 THEN 'bad' WHEN known AND pct >= 0.8 THEN 'warn'
    WHEN per_day IS NOT NULL AND days_left > 3 AND early > 0 THEN 'warn' ELSE 'ok' END AS quota_level FROM c""")
def camera_quota(b):
    return health.quota(b.fleet(), F.lit(NOW).cast("timestamp")).select(
        "camera_id", "remaining", round6("quota_pct").alias("quota_pct"), "days_left",
        round6("per_day").alias("per_day"), "days_early", "quota_level")


@query("camera_health", needs=("fleet",), sql=f"""
WITH a AS (SELECT camera_id, battery, CAST(floor((epoch_us(TIMESTAMP '{NOW}') - last_seen) / 86400e6) AS BIGINT) AS age,
  photo_count AS used, photo_limit AS lim, greatest(0, photo_limit - photo_count) AS remaining,
  floor((cycle_end - epoch_us(TIMESTAMP '{NOW}')) / 86400e6) AS dl,
  greatest(0e0, (epoch_us(TIMESTAMP '{NOW}') - cycle_start) / 86400e6) AS elapsed FROM fleet),
q AS (SELECT *, CASE WHEN used IS NULL OR lim IS NULL THEN 0 WHEN remaining = 0 THEN 2 WHEN used >= 0.8 * lim THEN 1
  WHEN elapsed >= 1 AND used > 0 AND dl > 3 AND floor(dl - remaining / (used / elapsed)) > 0 THEN 1 ELSE 0 END AS ql FROM a)
SELECT camera_id, age AS age_days, ['ok', 'warn', 'bad'][1 + greatest(ql, CASE WHEN age IS NULL THEN 1 WHEN age >= 30 THEN 2
    WHEN age >= 7 THEN 1 ELSE 0 END, CASE WHEN battery <= 10 THEN 2 WHEN battery <= 30 THEN 1 ELSE 0 END)] AS health,
  concat_ws('; ', CASE WHEN age IS NULL THEN 'never reported' WHEN age >= 30 THEN 'silent ' || age || ' days'
    WHEN age >= 7 THEN 'quiet ' || age || ' days' END, CASE WHEN battery <= 30 THEN 'battery ' || battery || '%' END,
    CASE ql WHEN 2 THEN 'quota spent' WHEN 1 THEN 'quota low' END) AS notes FROM q""")
def camera_health(b):
    now = F.lit(NOW).cast("timestamp")
    return health.health(health.quota(b.fleet(), now), now).select(
        "camera_id", "age_days", "health", F.array_join("notes", "; ").alias("notes"))


@query("camera_day_state", needs=("fleet",), sql=f"""
SELECT camera_id, CASE WHEN (epoch_us(TIMESTAMP '{NOW}') - last_seen) / 3600e6 > 48 THEN 'silent'
  WHEN last_seen IS NULL THEN 'unknown' WHEN photo_limit - photo_count <= 0 THEN 'quota-dark' ELSE 'live' END AS state FROM fleet""")
def camera_day_state(b):
    now = F.lit(NOW).cast("timestamp")
    return health.quota(b.fleet(), now).select(
        "camera_id", health.day_state(F.col("last_seen"), now, F.col("remaining")).alias("state"))


@query("fleet_quota_totals", needs=("fleet",), sql="""
SELECT CAST(sum(photo_count) AS BIGINT) AS used, CAST(sum(photo_limit) AS BIGINT) AS "limit" FROM fleet""")
def fleet_quota_totals(b):
    return health.fleet_quota(health.quota(b.fleet(), F.lit(NOW).cast("timestamp"))).drop("flagged")


@query("camera_placement", needs=("fleet",), sql="""
SELECT camera_id, round(CASE WHEN c THEN lat + 0.001e0 ELSE lat END, 6) AS lat, round(lng, 6) AS lng, c AS corrected,
  CASE WHEN c THEN CAST(floor(2 * 6371000e0 * asin(sqrt(pow(sin(radians(0.001e0) / 2), 2))) + 0.5) AS BIGINT) END AS from_fix_m
FROM (SELECT *, camera_id % 3 = 0 AS c FROM fleet)""")
def camera_placement(b):
    k = F.col("camera_id")
    placed = b.fleet().select("camera_id", "lat", "lng",
                              F.when(k % 3 == 0, F.col("lat") + 0.001).alias("placed_lat"),
                              F.when(k % 3 != 1, F.col("lng")).alias("placed_lng"))
    return health.placement_drift(placed).select("camera_id", round6("lat").alias("lat"),
                                                 round6("lng").alias("lng"), "corrected", "from_fix_m")


@query("camera_name_filter", needs=("fleet",), sql="""
SELECT camera_id, camera_name FROM fleet WHERE lower(camera_name) LIKE '%007%' OR lower(camera_name) LIKE '%er#00000009%'
  OR CAST(camera_id AS VARCHAR) LIKE '%007%'""")
def camera_name_filter(b):
    return b.fleet().where(health.name_filter(F.col("camera_name"), F.col("camera_id").cast("string"),
                                              ["007", "ER#00000009"])).select("camera_id", "camera_name")


@query("model_representatives", sql="""
SELECT coalesce(CASE WHEN p_size % 10 <> 0 THEN p_brand END, '(no model reported)') AS model,
  min(p_partkey) AS camera_id, count(*) AS cameras FROM part GROUP BY 1""")
def model_representatives(b):
    rows = b.table("part").select(F.col("p_partkey").alias("camera_id"),
                                  F.when(F.col("p_size") % 10 != 0, F.col("p_brand")).alias("model"))
    return health.one_per_model(rows, "camera_id")


@query("camera_rows_for_readers", needs=("fleet",), sql="""
SELECT camera_id, camera_id % 3 = 0 AS corrected, camera_id % 2 = 0 AS faces, CASE WHEN camera_id % 2 = 0 THEN 'N 0° · 111 m' END AS facing_text FROM fleet""")
def camera_rows_for_readers(b):
    k = F.col("camera_id")
    lat = F.when(k % 3 == 0, F.col("lat") + 0.5).otherwise(F.col("lat"))
    view = F.when(k % 2 == 0, F.struct(F.col("lng").alias("lng"), (lat + 0.001).alias("lat"), F.lit(None).cast("string").alias("label"),
                                       F.lit(30.0).alias("spread")))
    rows = b.fleet().select("camera_id", "lat", "lng", F.when(k % 3 == 0, lat).alias("placed_lat"), F.when(k % 3 == 0, F.col("lng")).alias("placed_lng"),
                            view.alias("view"))
    return health.camera_view_rows(rows).select("camera_id", "corrected", F.col("facing").isNotNull().alias("faces"), "facing_text")


@query("photo_cards", needs=("hash",), sql="""
SELECT photo_id, camera_id, photo_id % 4 <> 0 AS downloaded, photo_id % 5 <> 0 AS hashed FROM hash""")
def photo_cards(b):
    p = F.col("photo_id")
    rows = b.hashes().select("photo_id", "camera_id", F.lit("u").alias("url"), F.when(p % 4 != 0, "f").alias("file_path"),
                             F.when(p % 5 == 0, "none").otherwise(F.col("phash")).alias("phash"))
    return review.photo_cards(rows).drop("url")


@query("detection_cards", needs=("spoken",), sql=f"""
SELECT photo_id, source, CASE WHEN source = 'camera-ai' THEN {HOUSE.format("word")} END AS suggestion FROM spoken""")
def detection_cards(b):
    return review.detection_cards(_spoken(b)).select("photo_id", "source", "suggestion")


@query("stand_rows_unpacked", needs=("stand",), sql="""
SELECT stand_id, CASE WHEN stand_id % 4 <> 0 THEN len(list_distinct([stand_id % 5 * 3, stand_id % 3 * 4 + 1])) ELSE 0 END AS winds, CASE stand_id % 3 WHEN 0 THEN 0 ELSE 1 END AS lanes FROM stand""")
def stand_rows_unpacked(b):
    lanes = F.when(F.col("stand_id") % 3 != 0, '[{"lng":-90.0,"lat":44.0,"label":"a","spread":12}]')
    return review.stand_rows(b.stands().withColumn("lanes", lanes)).select(
        "stand_id", F.size("winds").cast("bigint").alias("winds"), F.size("lanes").alias("lanes"))


@query("visits_newest_first", needs=("visit",), sql="""
SELECT camera_id, CAST(visit_no AS BIGINT) AS visit_no, photo_count FROM visit WHERE camera_id = 2 ORDER BY s DESC LIMIT 50""")
def visits_newest_first(b):
    return review.visit_queue(_reviewed(b), b.cameras(), camera_id=2, limit=50).select("camera_id", "visit_no", "photo_count")


@query("pin_union", needs=("fleet", "stand"), sql="""
SELECT 'camera' AS kind, CAST(camera_id AS VARCHAR) AS id, round(lat, 6) AS lat FROM fleet UNION ALL SELECT 'stand', CAST(stand_id AS VARCHAR), round(lat, 6) FROM stand
UNION ALL SELECT 'marker', CAST(p_partkey AS VARCHAR), round(44e0 + CAST(p_partkey % 97 AS DOUBLE) * 0.01e0, 6) FROM part""")
def pin_union(b):
    from fieldlens.sources.store import union_all
    parts = [(b.fleet(), "camera"), (b.stands(), "stand"), (b.markers(), "marker")]
    return union_all([df.select(F.lit(k).alias("kind"), F.col(f"{k}_id").cast("string").alias("id"), round6("lat").alias("lat")) for df, k in parts])
