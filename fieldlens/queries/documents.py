"""Vendor documents, CSV roles and column-wise payloads derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

import fieldlens.queries.tables  # noqa: F401
from fieldlens.constants import RADAR_STALE_MINUTES
from fieldlens.functions.num import round6
from fieldlens.queries.registry import query
from fieldlens.sources import documents, telemetry


def camera_documents(b):
    """A vendor document per supplier: two fixes, the second newer for odd keys, some gaps."""
    k = F.col("s_suppkey")
    lat, lng = b.place(k)

    def fix(at, la, ln, hashcode):
        dms_lat = F.concat(F.lit("N "), F.floor(la).cast("string"), F.lit(" "), F.format_string("%.6f", (la - F.floor(la)) * 60))
        dms_lng = F.concat(F.lit("W "), F.floor(-ln).cast("string"), F.lit(" "), F.format_string("%.6f", (-ln - F.floor(-ln)) * 60))
        return F.struct(at.alias("dateTime"), dms_lat.alias("latitude"), dms_lng.alias("longitude"), hashcode.alias("geohash"),
                        F.struct(F.array(ln, la).alias("coordinates")).alias("position"))

    first = fix(F.lit("2024-01-10T00:00:00Z"), lat, lng, F.lit("9"))
    second = fix(F.when(k % 2 == 1, "2024-01-12T00:00:00Z").otherwise("2024-01-02T00:00:00Z"), lat + 0.01, lng,
                 F.when(k % 4 == 1, "d").otherwise("9"))
    fixes = F.when(k % 6 != 0, F.array(first, second))
    power = F.array(F.struct(F.when(k % 3 == 0, "UNK").otherwise("Lithium").alias("type"),
                             F.when(k % 5 != 0, (k % 100).cast("double")).alias("percentage"), F.lit("ok").alias("level")))
    sub = F.array(F.struct(F.struct(F.lit("Basic").alias("name"), F.lit(1000).alias("photoCountPerMonth")).alias("plan"),
                           (k * 3 % 900).alias("photoCount"), F.when(k % 4 != 0, F.lit(250)).alias("photoLimit")))
    status = F.struct(fixes.alias("coordinates"), power.alias("powerSources"), F.lit("X-1").alias("model"),
                      F.when(k % 7 != 0, "2024-01-20T10:00:00Z").alias("lastUpdate"))
    doc = F.struct(k.cast("string").alias("id"), F.struct(F.col("s_name").alias("name")).alias("config"), status.alias("status"),
                   sub.alias("subscriptions"), F.when(k % 7 == 0, F.struct(F.lit("2024-01-19 08:00:00").alias("heartbeat"))).alias("link"))
    return b.table("supplier").select(k.cast("string").alias("camera_id"), F.to_json(doc).alias("raw"))


@query("camera_ingest", sql="""
SELECT CAST(s_suppkey AS VARCHAR) AS camera_id, s_name AS name, CASE WHEN s_suppkey % 6 <> 0 THEN round(44e0 + CAST(s_suppkey % 97 AS DOUBLE) * 0.01e0
    + CASE WHEN s_suppkey % 2 = 1 THEN 0.01e0 ELSE 0e0 END, 6) END AS lat, CASE WHEN s_suppkey % 6 <> 0 THEN CASE WHEN s_suppkey % 2 = 1 THEN '2024-01-12T00:00:00Z' ELSE '2024-01-10T00:00:00Z' END END AS gps_fix,
  CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey % 100 AS DOUBLE) END AS battery, CASE WHEN s_suppkey % 3 <> 0 THEN 'Lithium' END AS battery_source,
  s_suppkey * 3 % 900 AS photo_count, CAST(CASE WHEN s_suppkey % 4 <> 0 THEN 250 ELSE 1000 END AS BIGINT) AS photo_limit FROM supplier""")
def camera_ingest(b):
    rows = documents.camera_rows(camera_documents(b))
    return rows.select("camera_id", "name", round6("lat").alias("lat"), "gps_fix", "battery", "battery_source", "photo_count", "photo_limit")


@query("document_leaves", sql="""
SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events""")
def document_leaves(b):
    docs = b.table("events").select("event_id", F.col("props").alias("raw"))
    return documents.leaf_table(docs, "event_id").select("event_id", "path", "value")


@query("document_blanks", sql="""
SELECT CAST(s_suppkey AS VARCHAR) AS camera_id, label, missing, candidates FROM (
  SELECT s_suppkey, 'position' AS label, 'lat,lng' AS missing, NULL AS candidates FROM supplier WHERE s_suppkey % 6 = 0
  UNION ALL SELECT s_suppkey, 'battery', 'battery', 'status.powerSources[0].type,status.powerSources[0].level' FROM supplier WHERE s_suppkey % 5 = 0
  UNION ALL SELECT s_suppkey, 'last contact', 'last_seen', 'link.heartbeat' FROM supplier WHERE s_suppkey % 7 = 0
  UNION ALL SELECT s_suppkey, 'signal', 'signal', NULL FROM supplier
  UNION ALL SELECT s_suppkey, 'temperature', 'temp_value', NULL FROM supplier
  UNION ALL SELECT s_suppkey, 'SD card', 'mem_used,mem_size', NULL FROM supplier
  UNION ALL SELECT s_suppkey, 'billing cycle', 'cycle_start,cycle_end', NULL FROM supplier)""")
def document_blanks(b):
    docs = camera_documents(b)
    out = documents.blank_fields(documents.camera_rows(docs), documents.leaf_table(docs, "camera_id"), "camera_id")
    return out.select("camera_id", "label", F.array_join("missing", ",").alias("missing"),
                      F.array_join("candidates", ",").alias("candidates"))


_SHOWN = """
WITH s AS (SELECT *, CAST(s_suppkey AS VARCHAR) AS k, s_suppkey % 6 <> 0 AS placed FROM supplier), f AS (SELECT s.*, i, 'status.coordinates[' || i || ']' AS spot,
  CASE WHEN i = 0 THEN '2024-01-10T00:00:00Z' WHEN s_suppkey % 2 = 1 THEN '2024-01-12T00:00:00Z' ELSE '2024-01-02T00:00:00Z' END AS t,
  CASE WHEN i = 1 AND s_suppkey % 4 = 1 THEN 'a' ELSE '#' END AS hash,
  44e0 + CAST(s_suppkey % 97 AS DOUBLE) * 0.01e0 + CASE WHEN i = 1 THEN 0.01e0 ELSE 0e0 END AS la, 90e0 + CAST(s_suppkey % 89 AS DOUBLE) * 0.012e0 AS lo
  FROM s, (SELECT unnest(range(2)) AS i) WHERE placed),
leaf AS (
  SELECT k, 'id' AS path, '"' || repeat('#', length(k)) || '"' AS shown FROM s
  UNION ALL SELECT k, 'config.name', '"' || s_name || '"' FROM s
  UNION ALL SELECT k, spot || '.dateTime', '"' || t || '"' FROM f
  UNION ALL SELECT k, spot || '.latitude', '"A ## ' || CASE WHEN (la - floor(la)) * 60 >= 10 THEN '##' ELSE '#' END || '.######"' FROM f
  UNION ALL SELECT k, spot || '.longitude', '"A ## ' || CASE WHEN (lo - floor(lo)) * 60 >= 10 THEN '##' ELSE '#' END || '.######"' FROM f
  UNION ALL SELECT k, spot || '.position.coordinates[0]', '<number ' || length(split_part(CAST(lo AS VARCHAR), '.', 2)) || 'dp>' FROM f
  UNION ALL SELECT k, spot || '.position.coordinates[1]', '<number ' || length(split_part(CAST(la AS VARCHAR), '.', 2)) || 'dp>' FROM f
  UNION ALL SELECT k, spot || '.geohash', '"' || hash || '"' FROM f
  UNION ALL SELECT k, spot || '.position.coordinates', '[<numbers>]' FROM f
  UNION ALL SELECT k, 'status.powerSources[0].type', CASE WHEN s_suppkey % 3 = 0 THEN '"UNK"' ELSE '"Lithium"' END FROM s
  UNION ALL SELECT k, 'status.powerSources[0].percentage', CAST(s_suppkey % 100 AS VARCHAR) || '.0' FROM s WHERE s_suppkey % 5 <> 0
  UNION ALL SELECT k, 'status.powerSources[0].level', '"ok"' FROM s
  UNION ALL SELECT k, 'status.model', '"X-1"' FROM s
  UNION ALL SELECT k, 'status.lastUpdate', '"2024-01-20T10:00:00Z"' FROM s WHERE s_suppkey % 7 <> 0
  UNION ALL SELECT k, 'subscriptions[0].plan.name', '"Basic"' FROM s
  UNION ALL SELECT k, 'subscriptions[0].plan.photoCountPerMonth', '1000' FROM s
  UNION ALL SELECT k, 'subscriptions[0].photoCount', CAST(s_suppkey * 3 % 900 AS VARCHAR) FROM s
  UNION ALL SELECT k, 'subscriptions[0].photoLimit', '250' FROM s WHERE s_suppkey % 4 <> 0
  UNION ALL SELECT k, 'link.heartbeat', '"2024-01-19 08:00:00"' FROM s WHERE s_suppkey % 7 = 0)
SELECT k AS camera_id, path, shown FROM leaf"""


@query("document_redaction", sql=f"""
SELECT camera_id, count(*) AS leaves, CAST(count(*) FILTER (WHERE regexp_matches(shown, '#|<number')) AS BIGINT) AS masked FROM ({_SHOWN}) GROUP BY 1""")
def document_redaction(b):
    """How many leaves each document has, and how many of them are masked."""
    return document_redaction_leaves(b).groupBy("camera_id").agg(
        F.count("*").alias("leaves"), F.count_if(F.col("shown").rlike("#|<number")).alias("masked"))


@query("document_redaction_leaves", sql=_SHOWN)
def document_redaction_leaves(b):
    """Every leaf of every document as it is shown."""
    leaves = documents.leaf_table(camera_documents(b), "camera_id")
    return leaves.select("camera_id", "path", documents.redacted(F.col("path"), F.col("value")).alias("shown"))


def photo_documents(b):
    e = F.col("event_id")
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    big = F.when(e % 4 != 0, F.struct(F.when(e % 3 == 0, "https://h.example/").otherwise("h.example").alias("host"), e.cast("string").alias("path")))
    doc = F.struct(e.cast("string").alias("id"), (F.col("user_id") % 5).cast("string").alias("camera"),
                   F.when(e % 5 != 0, iso).otherwise("not a date").alias("originDate"), F.when(e % 10 != 0, iso).alias("date"),
                   F.array(F.col("event_type")).alias("tag"), big.alias("large"),
                   F.struct(F.lit("s.example").alias("host"), F.lit("thumb").alias("path")).alias("small"))
    return b.table("events").select(F.to_json(doc).alias("raw"))


@query("photo_ingest", sql="""
SELECT CAST(event_id AS VARCHAR) AS photo_id, CAST(user_id % 5 AS VARCHAR) AS camera_id,
  CASE WHEN event_id % 10 <> 0 THEN CAST(epoch_us(date_trunc('second', ts)) AS BIGINT) END AS us,
  CASE WHEN event_id % 4 = 0 THEN 'https://s.example/thumb' ELSE 'https://h.example/' || event_id END AS url, event_type AS tags FROM events""")
def photo_ingest(b):
    return documents.photo_rows(photo_documents(b)).select(
        "photo_id", "camera_id", F.unix_micros("taken_at").alias("us"), "url", F.array_join("tags", ",").alias("tags"))


@query("machine_claims_from_tags", sql="""
SELECT CAST(event_id AS VARCHAR) AS photo_id, event_type AS species, 1 AS n, 'camera-ai' AS source, false AS confirmed FROM events""")
def machine_claims_from_tags(b):
    return documents.claims_from_tags(documents.photo_rows(photo_documents(b)))


@query("forecast_rows", needs=("wx",), sql="""
SELECT location_id, CAST(hour_no AS BIGINT) AS hour_no, temp_f, wind_mph FROM wx""")
def forecast_rows(b):
    w = b.weather().select("location_id", F.to_date("hour_utc").alias("day"), F.floor(F.unix_seconds("hour_utc") / 3600).alias("h"),
                           "temp_f", "wind_mph")
    packed = F.array_sort(F.collect_list(F.struct("h", "temp_f", "wind_mph")))
    docs = w.groupBy("location_id", "day").agg(packed.alias("p")).select(
        F.struct("location_id", "day").alias("key"), F.transform("p", lambda x: x["h"]).alias("time"),
        F.transform("p", lambda x: x["temp_f"]).alias("temp"), F.transform("p", lambda x: x["wind_mph"]).alias("wind"))
    out = documents.columns_to_rows(docs, "key", {"time": "hour_no", "temp": "temp_f", "wind": "wind_mph"})
    return out.select("key.location_id", "hour_no", "temp_f", "wind_mph")


@query("telemetry_typed", sql="""
SELECT count(*) AS total, count(*) FILTER (WHERE l_linenumber = 3 OR l_quantity = 7) AS skipped FROM lineitem""")
def telemetry_typed(b):
    q = F.col("l_quantity")
    rate = F.when(F.col("l_linenumber") == 3, "").when(q == 7, "-4.5").otherwise(F.col("l_extendedprice").cast("string"))
    raw = b.table("lineitem").select(
        F.col("l_suppkey").cast("string").alias("AnimalID"), F.col("l_returnflag").alias("Sex"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("Date"), (F.col("l_orderkey") % 24).cast("string").alias("Hour"),
        rate.alias("MoveRate"), q.cast("string").alias("TempC"))
    return telemetry.load_counts(telemetry.typed(raw))


@query("telemetry_times", sql="""
SELECT l_orderkey AS rec, l_linenumber AS line, epoch_us(l_shipdate) // 1000000 + (l_orderkey % 24) * 3600 AS at_s, CAST(l_orderkey % 24 AS BIGINT) AS hour FROM lineitem""")
def telemetry_times(b):
    raw = b.table("lineitem").select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("Date"),
                                     (F.col("l_orderkey") % 24).cast("string").alias("Hour"))
    at = telemetry.row_time({"date": F.col("Date"), "hour": F.col("Hour")})
    return raw.select(F.col("l_orderkey").alias("rec"), F.col("l_linenumber").alias("line"), F.unix_seconds(at).alias("at_s"),
                      F.hour(at).cast("bigint").alias("hour"))


def _frames(b):
    e = F.col("event_id")
    return b.table("events").select(
        F.when(e % 5 < 4, "past").otherwise("nowcast").alias("kind"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("time_s"),
        F.when(e % 9 != 0, F.concat(F.lit("/v2/radar/"), F.col("user_id").cast("string"))).otherwise("/").alias("path"))


@query("radar_frames", sql="""
SELECT frame_id, arg_min(kind, o) AS kind, arg_min(t, o) AS time_s FROM (SELECT CAST(user_id AS VARCHAR) AS frame_id, CASE WHEN event_id % 5 < 4 THEN 'past' ELSE 'nowcast' END AS kind,
  epoch_us(ts) // 1000000 AS t, CASE WHEN event_id % 5 < 4 THEN 0 ELSE 1 END * 100000000000 + epoch_us(ts) // 1000000 AS o FROM events WHERE event_id % 9 <> 0) GROUP BY 1""")
def radar_frames(b):
    return documents.frame_index(_frames(b)).select("frame_id", "kind", "time_s")


@query("radar_reel_age", sql="""
WITH f AS (SELECT user_id, CASE WHEN event_id % 5 < 4 THEN 0 ELSE 1 END AS k, epoch_us(ts) // 1000000 AS t FROM events WHERE event_id % 9 <> 0),
i AS (SELECT user_id, arg_min(t, k * 100000000000 + t) AS t, min(k) AS k FROM f GROUP BY 1)
SELECT count(*) AS frames, CAST(floor((1704153600 - coalesce(max(CASE WHEN k = 0 THEN t END), max(t))) / 60e0 + 0.5) AS BIGINT) AS age_min,
  (1704153600 - coalesce(max(CASE WHEN k = 0 THEN t END), max(t))) / 60e0 > 30 AS too_old FROM i""")
def radar_reel_age(b):
    return documents.reel_age(documents.frame_index(_frames(b)), F.lit(1704153600), RADAR_STALE_MINUTES)


@query("scene_projection", sql="""
SELECT 'S2_' || (10 + l_suppkey % 50) || 'TXY_' || l_orderkey || '_' || l_linenumber AS id, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date,
  round(l_discount * 700, 6) AS cloud, CAST(10 + l_suppkey % 50 AS INT) AS zone FROM lineitem""")
def scene_projection(b):
    tile = F.concat((F.col("l_suppkey") % 50 + 10).cast("string"), F.lit("TXY"))
    ident = F.concat_ws("_", F.lit("S2"), tile, F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    feats = b.table("lineitem").select(
        ident.alias("id"), F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("T17:00:00Z")).alias("datetime"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("MGRS-"), tile)).alias("grid_code"), (F.col("l_discount") * 700).alias("cloud"))
    return documents.scene_rows(feats).withColumn("cloud", round6("cloud"))


@query("position_audit", sql="""
SELECT CAST(s_suppkey AS VARCHAR) AS camera_id, CASE WHEN s_suppkey % 6 = 0 OR s_suppkey % 10 = 9 THEN NULL WHEN s_suppkey % 2 = 1 THEN CAST(1112 AS BIGINT) ELSE 0 END AS drift_m,
  CASE WHEN s_suppkey % 10 = 9 THEN 'not stored' WHEN s_suppkey % 6 = 0 THEN 'only the row has a position' WHEN s_suppkey % 2 = 1 THEN 'row is behind' ELSE 'agrees' END AS verdict FROM supplier""")
def position_audit(b):
    k = F.col("s_suppkey")
    lat, lng = b.place(k)
    stored = b.table("supplier").where(F.col("s_suppkey") % 10 != 9).select(
        k.cast("string").alias("camera_id"), lat, lng, F.lit("2024-01-10T00:00:00Z").alias("gps_fix"))
    return documents.position_audit(documents.camera_rows(camera_documents(b)), stored)
