"""Merges, patches, deletes and validation over the stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

import fieldlens.queries.relational  # noqa: F401
from fieldlens.constants import SIT_WINDOWS, SPECIES
from fieldlens.functions.compass import normal_winds
from fieldlens.queries.registry import query
from fieldlens.sources import store


def _held_and_sent(b):
    """Cameras on record and a newer vendor listing that overlaps them."""
    k = F.col("s_suppkey")
    held = b.table("supplier").select(k.alias("camera_id"), F.col("s_name").alias("name"), F.floor("s_acctbal").alias("battery"),
                                      F.concat(F.lit("p"), (k % 4).cast("string")).alias("property"), (k * 2).alias("first_seen"))
    c = F.col("c_custkey")
    sent = b.table("customer").select((c * 2).alias("camera_id"), F.col("c_name").alias("name"),
                                      F.when(c % 3 != 0, F.floor("c_acctbal")).alias("battery"))
    return held, sent


@query("merge_cameras", sql="""
SELECT coalesce(s.s_suppkey, c.c_custkey * 2) AS camera_id, CASE WHEN c.c_custkey IS NOT NULL THEN c.c_name ELSE s.s_name END AS name,
  CASE WHEN c.c_custkey IS NOT NULL THEN CASE WHEN c.c_custkey % 3 <> 0 THEN CAST(floor(c.c_acctbal) AS BIGINT) END ELSE CAST(floor(s.s_acctbal) AS BIGINT) END AS battery,
  'p' || CAST(s.s_suppkey % 4 AS VARCHAR) AS property, s.s_suppkey * 2 AS first_seen
FROM supplier s FULL OUTER JOIN customer c ON c.c_custkey * 2 = s.s_suppkey""")
def merge_cameras(b):
    held, sent = _held_and_sent(b)
    return store.merge_owned(held, sent, "camera_id", ["name", "battery"], ["property", "first_seen"])


@query("merge_photos", sql="""
SELECT coalesce(s.s_suppkey, c.c_custkey * 2) AS camera_id, CASE WHEN c.c_custkey IS NOT NULL THEN c.c_name ELSE s.s_name END AS name,
  coalesce(CASE WHEN c.c_custkey % 3 <> 0 THEN CAST(floor(c.c_acctbal) AS BIGINT) END, CAST(floor(s.s_acctbal) AS BIGINT)) AS battery
FROM supplier s FULL OUTER JOIN customer c ON c.c_custkey * 2 = s.s_suppkey""")
def merge_photos(b):
    held, sent = _held_and_sent(b)
    return store.merge_known(held, sent, "camera_id", ["name"], ["battery"])


@query("merge_camera_days", needs=("photo",), sql="""
SELECT camera_id, CAST(CAST(taken_at AS DATE) AS VARCHAR) AS day, arg_max(CASE photo_id % 3 WHEN 0 THEN 'live' WHEN 1 THEN 'silent' ELSE 'quota-dark' END, us) AS state,
  max(photo_id % 50) AS photos, max(us) AS observed_us FROM photo GROUP BY 1, 2""")
def merge_camera_days(b):
    p = F.col("photo_id")
    rows = b.photos().select("camera_id", F.to_date("taken_at").alias("day"),
                             F.when(p % 3 == 0, "live").when(p % 3 == 1, "silent").otherwise("quota-dark").alias("state"),
                             (p % 50).alias("photos"), F.col("taken_at").alias("observed_at"))
    return store.merge_camera_days(rows).select("camera_id", F.col("day").cast("string").alias("day"), "state", "photos",
                                                F.unix_micros("observed_at").alias("observed_us"))


@query("replace_latest", needs=("photo",), sql="""
SELECT camera_id, hour_utc_us, arg_max(photo_id, us) AS photo_id, max(us) AS us FROM (SELECT *, epoch_us(hour_utc) AS hour_utc_us FROM photo) GROUP BY 1, 2""")
def replace_latest(b):
    rows = b.photos().select("camera_id", F.unix_micros("hour_utc").alias("hour_utc_us"), "photo_id",
                             F.unix_micros("taken_at").alias("us"))
    return store.latest_by_key(rows, ["camera_id", "hour_utc_us"], "us")


@query("insert_new_names", sql="""
SELECT r_name AS name, CAST(r_regionkey AS BIGINT) AS id FROM region UNION ALL
SELECT p_type, arg_min(p_partkey, {'at': p_retailprice, 'k': p_partkey}) FROM part WHERE p_type NOT IN (SELECT r_name FROM region) GROUP BY 1""")
def insert_new_names(b):
    held = b.table("region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("bigint").alias("id"))
    sent = b.table("part").select(F.col("p_type").alias("name"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("sent_at"))
    return store.insert_new(held, sent, "name", "sent_at")


@query("apply_patches", sql="""
WITH p AS (SELECT l_suppkey AS k, l_orderkey * 8 + l_linenumber AS seq, l_linenumber, l_partkey FROM lineitem),
n AS (SELECT k, arg_max(CASE WHEN l_partkey % 9 <> 0 THEN 'name ' || l_partkey END, seq) AS v, max(seq) AS got,
    max_by(CASE WHEN l_partkey % 9 <> 0 THEN {'v': 'name ' || l_partkey} ELSE {'v': NULL} END, seq) AS s FROM p WHERE l_linenumber % 2 = 0 GROUP BY 1),
q AS (SELECT k, max_by(l_partkey * 2, seq) AS v, max(seq) AS got FROM p WHERE l_linenumber % 3 = 0 GROUP BY 1)
SELECT s_suppkey AS camera_id, CASE WHEN n.got IS NOT NULL THEN n.s.v ELSE s_name END AS name,
  CASE WHEN q.got IS NOT NULL THEN q.v ELSE CAST(floor(s_acctbal) AS BIGINT) END AS battery FROM supplier LEFT JOIN n ON n.k = s_suppkey LEFT JOIN q ON q.k = s_suppkey""")
def apply_patches(b):
    base = b.table("supplier").select(F.col("s_suppkey").alias("camera_id"), F.col("s_name").alias("name"),
                                      F.floor("s_acctbal").alias("battery"))
    n, part = F.col("l_linenumber"), F.col("l_partkey")
    name = F.when(n % 2 == 0, F.create_map(F.lit("name"), F.when(part % 9 != 0, F.concat(F.lit("name "), part.cast("string")))))
    battery = F.when(n % 3 == 0, F.create_map(F.lit("battery"), (part * 2).cast("string")))
    none = F.create_map().cast("map<string,string>")
    patches = b.table("lineitem").select(F.col("l_suppkey").alias("camera_id"), (F.col("l_orderkey") * 8 + n).alias("seq"),
                                         F.map_concat(F.coalesce(name, none), F.coalesce(battery, none)).alias("changes"))
    return store.apply_patches(base, patches, "camera_id", {"name": "string", "battery": "bigint"})


@query("delete_cascade", sql="SELECT o_orderkey AS sit_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def delete_cascade(b):
    gone = b.table("customer").where(F.col("c_acctbal") < 0).select("c_custkey")
    sits = b.table("orders").select(F.col("o_orderkey").alias("sit_id"), "o_custkey")
    return store.delete_cascade(sits, gone, "o_custkey", "c_custkey").select("sit_id")


@query("delete_set_null", sql="""
SELECT o_orderkey AS sit_id, CASE WHEN c.c_acctbal < 0 THEN NULL ELSE o_custkey END AS stand_id FROM orders LEFT JOIN customer c ON c.c_custkey = o_custkey""")
def delete_set_null(b):
    gone = b.table("customer").where(F.col("c_acctbal") < 0).select("c_custkey")
    sits = b.table("orders").select(F.col("o_orderkey").alias("sit_id"), F.col("o_custkey").alias("stand_id"))
    return store.delete_set_null(sits, gone, "stand_id", "c_custkey")


@query("assign_members", needs=("stand",), sql="""
SELECT stand_id, CASE WHEN stand_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 99 ELSE property_id END AS property_id,
  stand_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS changed FROM stand""")
def assign_members(b):
    ids = b.table("orders").where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("stand_id"))
    out = store.assign_members(b.stands().select("stand_id", "property_id"), ids, "stand_id", "property_id",
                               F.lit(99).cast("bigint"))
    return out.withColumnRenamed("_changed", "changed")


@query("incremental_photos", needs=("photo",), sql="""
SELECT photo_id, camera_id FROM (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY us DESC, photo_id) AS r FROM photo
  WHERE photo_id NOT IN (SELECT l_orderkey FROM lineitem)) WHERE r <= 300""")
def incremental_photos(b):
    landed = b.table("lineitem").select(F.col("l_orderkey").alias("photo_id")).distinct()
    return store.unseen(b.photos().select("photo_id", "camera_id", "taken_at"), landed, "photo_id", "camera_id",
                        [F.col("taken_at").desc(), F.col("photo_id")], 300).select("photo_id", "camera_id")


@query("repaired_paths", sql="""
SELECT p_partkey AS photo_id, CASE WHEN p_size % 2 = 0 THEN p_name || '.jpg' ELSE CASE WHEN p_size % 3 = 0 THEN 'photos/' ELSE '' END || 'cam/' || p_name || '.jpg' END AS path FROM part""")
def repaired_paths(b):
    name = F.concat(F.col("p_name"), F.lit(".jpg"))
    raw = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("photos/"), name)).when(
        F.col("p_size") % 3 == 0, F.concat(F.lit("photos/photos/cam/"), name)).otherwise(F.concat(F.lit("cam/"), name))
    return b.table("part").select(F.col("p_partkey").alias("photo_id"), store.repair_paths(raw).alias("path"))


@query("detection_violations", sql="""
SELECT event_id AS photo_id, concat_ws('; ', CASE WHEN event_id % 4 < 1 THEN 'counts at least one animal' END,
  CASE WHEN event_type IN ('error', 'signup') THEN 'unknown species' END,
  CASE WHEN event_id % 7 = 0 AND event_type NOT IN ('click') THEN 'a named animal is a deer' END) AS why FROM events""")
def detection_violations(b):
    e, t = F.col("photo_id"), F.col("species")
    rows = b.detections().select("photo_id", (e % 4).alias("n"), "individual_id", F.when(t == "click", "deer").when(
        t == "view", "bear").when(t == "purchase", "turkey").otherwise(t).alias("species"))
    out = store.with_violations(rows, store.detection_rules(SPECIES))
    return out.select("photo_id", F.array_join("violations", "; ").alias("why"))


@query("accepted_sits", needs=("sit", "stand"), sql="""
SELECT sit_id, stand_id FROM (SELECT o_orderkey AS sit_id, CASE WHEN o_orderkey % 6 <> 0 THEN o_custkey * 2 END AS stand_id,
    CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'noon' ELSE 'AM' END AS w, o_orderkey % 7 AS d FROM orders)
WHERE w = 'AM' AND d > 1 AND (stand_id IS NULL OR stand_id IN (SELECT stand_id FROM stand))""")
def accepted_sits(b):
    o = F.col("o_orderkey")
    rows = b.table("orders").select(
        o.alias("sit_id"), F.when(o % 6 != 0, F.col("o_custkey") * 2).alias("stand_id"),
        F.when(o % 5 == 0, None).when(o % 5 == 1, "noon").otherwise("AM").alias("window"),
        F.when(o % 7 == 0, None).when(o % 7 == 1, "2024-13-45").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"))
    good, _ = store.split_valid(rows, store.sit_rules(SIT_WINDOWS))
    return store.existing_parent(good, b.stands(), "stand_id", "stand_id").select("sit_id", "stand_id")


@query("track_violations", sql="""
SELECT p_partkey AS track_id, CASE WHEN p_partkey % 4 < 2 THEN 'a track needs at least 2 points' WHEN p_size = 50 THEN 'a track needs real coordinates' ELSE '' END AS why FROM part""")
def track_violations(b):
    k = F.col("p_partkey")
    point = F.struct(F.when((F.col("p_size") == 50) & (k % 4 >= 2), 181.0).otherwise(-90.0).alias("lng"), F.lit(44.0).alias("lat"))
    rows = b.table("part").select(k.alias("track_id"), F.array_repeat(point, (k % 4).cast("int")).alias("points"))
    out = store.with_violations(rows, store.track_rules())
    return out.select("track_id", F.array_join("violations", "; ").alias("why"))


@query("field_cut_dates", sql="""
SELECT o_orderkey AS field_id, CASE WHEN o_orderkey % 6 >= 3 THEN 'a cut needs a date' ELSE '' END AS why,
  CASE WHEN o_orderkey % 6 = 0 THEN strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%d') END AS cut_on FROM orders""")
def field_cut_dates(b):
    day, kind = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 6
    told = (F.when(kind == 0, F.concat(day, F.lit("T06:00:00Z"))).when(kind == 1, "").when(kind == 2, F.lit(None))
            .when(kind == 3, "2024-02-31").when(kind == 4, "last week").otherwise(F.substring(day, 1, 7)))
    rows = store.with_violations(b.table("orders").select(F.col("o_orderkey").alias("field_id"), told.alias("cut_at")), store.cut_date_rules("cut_at"))
    return rows.select("field_id", F.array_join("violations", "; ").alias("why"), store.cut_date(F.col("cut_at")).cast("string").alias("cut_on"))


@query("ring_violations", sql="""
SELECT p_partkey AS field_id, CASE WHEN p_partkey % 5 < 3 THEN 'a field needs at least 3 points' WHEN p_size = 50 THEN 'a field needs real coordinates' ELSE '' END AS why FROM part""")
def ring_violations(b):
    k = F.col("p_partkey")
    point = F.struct(F.lit(-90.0).alias("lng"), F.when((F.col("p_size") == 50) & (k % 5 >= 3), 95.0).otherwise(44.0).alias("lat"))
    rows = b.table("part").select(k.alias("field_id"), F.array_repeat(point, (k % 5).cast("int")).alias("points"))
    out = store.with_violations(rows, store.path_rules(3, "a field"))
    return out.select("field_id", F.array_join("violations", "; ").alias("why"))


@query("lane_violations", sql="""
SELECT p_partkey AS stand_id, concat_ws('; ', CASE WHEN p_size % 11 = 0 THEN 'each lane needs an endpoint' END,
  CASE WHEN p_size >= 45 THEN 'a spread lies between 0 and 90' END) AS why FROM part""")
def lane_violations(b):
    s = F.col("p_size")
    lane = F.struct(F.when(s % 11 != 0, F.lit(-90.0)).alias("lng"), F.lit(44.0).alias("lat"), (s * 2).cast("double").alias("spread"))
    rows = b.table("part").select(F.col("p_partkey").alias("stand_id"), F.array(lane).alias("lanes"))
    out = store.with_violations(rows, store.lane_rules())
    return out.select("stand_id", F.array_join("violations", "; ").alias("why"))


@query("normal_winds", sql="""
SELECT c_custkey AS stand_id, CASE c_custkey % 4 WHEN 0 THEN 'N,NW' WHEN 1 THEN 'SSW' WHEN 2 THEN NULL ELSE 'E,ENE' END AS winds FROM customer""")
def normal_winds_query(b):
    texts = F.array(*[F.lit(x) for x in (" n, NW ,n", "ssw,bogus", "up,,down", "E,ene, e")])
    return b.table("customer").select(F.col("c_custkey").alias("stand_id"), F.array_join(normal_winds(
        F.get(texts, (F.col("c_custkey") % 4).cast("int"))), ",").alias("winds"))


@query("typed_counts", sql="""
SELECT p_partkey AS sit_id, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(p_size AS BIGINT) WHEN 2 THEN 0 ELSE p_size + 1 END AS deer FROM part""")
def typed_counts(b):
    s = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, "").when(k == 1, s).when(k == 2, F.concat(F.lit("-"), s)).otherwise(F.concat(s, F.lit(".5")))
    return b.table("part").select(F.col("p_partkey").alias("sit_id"), store.count_or_null(text).alias("deer"))


@query("owner_placements", needs=("fleet",), sql="""
SELECT camera_id, CASE WHEN camera_id % 3 = 0 THEN 45e0 WHEN camera_id % 3 = 1 THEN NULL ELSE round(lat, 6) END AS placed_lat FROM fleet""")
def owner_placements(b):
    from fieldlens.functions.num import round6
    k = F.col("camera_id")
    held = b.fleet().select("camera_id", F.col("lat").alias("placed_lat"))
    patches = b.fleet().select("camera_id", F.lit(1).alias("seq"), F.when(k % 3 == 0, F.create_map(
        F.lit("placed_lat"), F.lit("45.0"))).when(k % 3 == 1, F.create_map(F.lit("placed_lat"), F.lit(None).cast("string")))
        .otherwise(F.create_map().cast("map<string,string>")).alias("changes"))
    return store.apply_patches(held, patches, "camera_id", {"placed_lat": "double"}).withColumn("placed_lat", round6("placed_lat"))
