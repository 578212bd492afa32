"""Camera, photo, imagery and forecast documents to typed rows.

Known paths are read natively from JSON text with a declared schema. Only documents of an
unknown shape go through the leaf flattener, the one place that parses JSON in Python, in
Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.constants import PHOTO_DATE_KEYS, UNKNOWN_WORDS
from fieldlens.functions import geo

CAMERA_SCHEMA = """id STRING, config STRUCT<name: STRING>, latitude DOUBLE, longitude DOUBLE, model STRING,
  status STRUCT<model: STRING, lastUpdate: STRING, batteries: ARRAY<DOUBLE>,
    coordinates: ARRAY<STRUCT<dateTime: STRING, latitude: STRING, longitude: STRING, geohash: STRING,
      position: STRUCT<coordinates: ARRAY<DOUBLE>>>>,
    powerSources: ARRAY<STRUCT<type: STRING, percentage: DOUBLE, level: STRING>>,
    signal: STRUCT<type: STRING, bar: INT, processed: STRUCT<percentage: DOUBLE, bar: INT, level: STRING>>,
    temperature: STRUCT<value: DOUBLE, unit: STRING>, memory: STRUCT<used: DOUBLE, size: DOUBLE>>,
  subscriptions: ARRAY<STRUCT<plan: STRUCT<name: STRING, photoCountPerMonth: BIGINT>, photoCount: BIGINT,
    photoLimit: BIGINT, startDateBillingCycle: STRING, endDateBillingCycle: STRING, monthEndBillingCycle: STRING>>"""


def known_word(x: Column) -> Column:
    """A vendor word, with blanks and the ways of saying unknown turned to null."""
    t = F.trim(x)
    return F.when((t != "") & ~F.lower(t).isin(UNKNOWN_WORDS), t)


def newest_fix(fixes: Column) -> Column:
    """The newest dated element; undated ones lose, the first wins a tie and when none is dated."""
    def later(best, x):
        t, bt = F.try_to_timestamp(x["dateTime"]), F.try_to_timestamp(best["dateTime"])
        return F.when(t.isNotNull() & (bt.isNull() | (t > bt)), x).otherwise(best)
    return F.when(F.size(fixes) > 0, F.aggregate(fixes, F.get(fixes, F.lit(0)), later))


def camera_rows(docs: DataFrame, raw: str = "raw") -> DataFrame:
    """One typed camera row per vendor document (JSON text)."""
    d = docs.withColumn("d", F.from_json(raw, f"STRUCT<{CAMERA_SCHEMA}>"))
    d = d.withColumn("fix", newest_fix(F.col("d.status.coordinates")))
    pos = F.col("fix.position.coordinates")
    placed = (F.size(pos) >= 2) & pos[0].isNotNull() & pos[1].isNotNull()
    power, sub, st = F.get("d.status.powerSources", F.lit(0)), F.get("d.subscriptions", F.lit(0)), "d.status."
    return d.select(
        F.col("d.id").alias("camera_id"), F.coalesce("d.config.name", "d.id").alias("name"),
        known_word(F.coalesce(st + "model", "d.model")).alias("model"),
        F.when(placed, pos[1]).otherwise(F.col("d.latitude")).alias("lat"),
        F.when(placed, pos[0]).otherwise(F.col("d.longitude")).alias("lng"), F.col("fix.dateTime").alias("gps_fix"),
        F.coalesce(power["percentage"], F.get(st + "batteries", F.lit(0))).alias("battery"),
        known_word(power["level"]).alias("battery_level"), known_word(power["type"]).alias("battery_source"),
        F.col(st + "signal.processed.percentage").alias("signal"),
        F.coalesce(st + "signal.processed.bar", st + "signal.bar").alias("signal_bars"),
        known_word(F.col(st + "signal.processed.level")).alias("signal_level"), known_word(F.col(st + "signal.type")).alias("signal_type"),
        F.col(st + "temperature.value").alias("temp_value"), known_word(F.col(st + "temperature.unit")).alias("temp_unit"),
        F.col(st + "memory.used").alias("mem_used"), F.col(st + "memory.size").alias("mem_size"),
        known_word(sub["plan"]["name"]).alias("plan"), sub["photoCount"].alias("photo_count"),
        F.coalesce(sub["photoLimit"], sub["plan"]["photoCountPerMonth"]).alias("photo_limit"),
        sub["startDateBillingCycle"].alias("cycle_start"),
        F.coalesce(sub["endDateBillingCycle"], sub["monthEndBillingCycle"]).alias("cycle_end"),
        F.col(st + "lastUpdate").alias("last_seen"), F.col("fix"), F.col(raw).alias("raw"))


# ---- documents of unknown shape -----------------------------------------------------

def _leaves(node, prefix: str):
    if isinstance(node, dict):
        for k, v in node.items():
            yield from _leaves(v, f"{prefix}.{k}" if prefix else k)
    elif isinstance(node, list):
        if prefix and node and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in node):
            yield prefix, node
        for i, v in enumerate(node):
            yield from _leaves(v, f"{prefix}[{i}]")
    elif prefix:
        yield prefix, node


def leaf_table(docs: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """Every leaf of every document: (key, pos, path, value as JSON text). Bad documents give none.

    A numeric list is a leaf as a whole and element by element.
    """
    kind = docs.schema[key].dataType.simpleString()

    def flatten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for ident, text in zip(batch[key], batch[raw]):
                try:
                    doc = json.loads(text)
                except (TypeError, ValueError):
                    continue
                rows += [(ident, i, p, json.dumps(v)) for i, (p, v) in enumerate(_leaves(doc, ""))]
            yield pd.DataFrame(rows, columns=[key, "pos", "path", "value"])

    return docs.select(key, raw).mapInPandas(flatten, f"{key} {kind}, pos int, path string, value string")


def leaf_key(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"\[\d+\]", ""), r"\."), -1)


LOCATION_WORDS = "(?i)lat|lon|lng|coord|geohash|position|gps"                          # fixed value
IDENTITY_WORDS = ("(?i)^(id|cameraid|userid|user|owner|ucid|sim|iccid|imei|serial|datamatrixkey"
                  "|token|email|phone|mac|address)$")                                   # fixed value

# fixed values: what to look for when a normal field came out blank: label, fields, words, needs a time
PROBES = [
    ("position", ["lat", "lng"], LOCATION_WORDS, False),
    ("battery", ["battery"], "(?i)batter|power|volt", False),
    ("signal", ["signal"], "(?i)signal|rssi|dbm|bar|reception|cellular|network|lte", False),
    ("last contact", ["last_seen"], "(?i)last|seen|contact|sync|update|heartbeat|check.?in|activ", True),
    ("model", ["model"], "(?i)model", False),
    ("temperature", ["temp_value"], "(?i)temp", False),
    ("SD card", ["mem_used", "mem_size"], "(?i)mem|storage|card|disk", False),
    ("photo quota", ["photo_count", "photo_limit"], "(?i)photo|quota|count|limit", False),
    ("billing cycle", ["cycle_start", "cycle_end"], "(?i)billing|cycle|period|renew|expir", True),
]


def redacted(path: Column, value: Column) -> Column:
    """A leaf's JSON text with positions and identities masked; instants stay readable."""
    secret = path.rlike(LOCATION_WORDS) | leaf_key(path).rlike(IDENTITY_WORDS)
    timed = value.rlike(r'^"\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}|"$)')
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"\d", "#"), "[a-z]", "a"), "[A-Z]", "A")
    number = F.concat(F.lit("<number "), F.length(F.regexp_extract(value, r"\.(\d+)", 1)).cast("string"), F.lit("dp>"))
    return (F.when(~secret | timed | (value == "null"), value).when(value.startswith('"'), shape)
            .when(value.startswith("["), "[<numbers>]").when(value.isin("true", "false"), "<boolean>").otherwise(number))


def blank_fields(rows: DataFrame, leaves: DataFrame, key: str) -> DataFrame:
    """Fields that came out blank although the document mentions them, with all candidates in order.

    rows: normal camera rows. One row per (document, probe) with something missing.
    """
    asked = F.array(*[F.struct(
        F.lit(label).alias("label"), F.lit(words).alias("words"), F.lit(timed).alias("timed"),
        F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields])).alias("missing"))
        for label, fields, words, timed in PROBES])
    probes = rows.select(key, F.explode(asked).alias("p")).select(key, "p.*").where(F.size("missing") > 0)
    v = F.col("value")
    number = v.try_cast("double")
    timeish = (number > 1e9) | F.try_to_timestamp(F.regexp_replace(v, '"', "")).isNotNull()
    usable = number.isNotNull() | (v.rlike(r'^".*\S.*"$')) | v.startswith("[")
    hits = (probes.join(leaves, key).where(F.rlike("path", F.col("words")) & F.when(
        F.col("timed"), F.coalesce(timeish, F.lit(False))).otherwise(usable)))
    found = hits.groupBy(key, "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "path"))),
                                                      lambda x: x["path"]).alias("candidates"))
    return probes.join(found, [key, "label"], "left").select(key, "label", "missing", "candidates")


# ---- photos -------------------------------------------------------------------------

PHOTO_SCHEMA = ("id STRING, camera STRING, " + ", ".join(f"{k} STRING" for k in PHOTO_DATE_KEYS)
                + ", tag ARRAY<STRING>, originName STRING, " + ", ".join(
                    f"{s} STRUCT<host: STRING, path: STRING>" for s in ("large", "medium", "small")))


def photo_rows(docs: DataFrame, raw: str = "raw", prefer: str = "large") -> DataFrame:
    """Photo documents: first date key that parses, best address, tags."""
    d = docs.withColumn("d", F.from_json(raw, f"STRUCT<{PHOTO_SCHEMA}>"))
    taken = F.coalesce(*[F.try_to_timestamp(F.col(f"d.{k}")) for k in PHOTO_DATE_KEYS])

    def address(size):
        s = F.col(f"d.{size}")
        host = F.when(F.contains(s["host"], F.lit("://")), F.regexp_replace(s["host"], "/$", "")).otherwise(
            F.concat(F.lit("https://"), s["host"]))
        return F.when((s["host"] != "") & (s["path"] != ""), F.concat(host, F.lit("/"), s["path"]))

    url = F.coalesce(*[address(s) for s in (prefer, "large", "medium", "small")])
    return d.select(F.col("d.id").alias("photo_id"), F.col("d.camera").alias("camera_id"), taken.alias("taken_at"),
                    F.date_trunc("hour", taken).alias("hour_utc"), url.alias("url"), F.col("d.tag").alias("tags"),
                    F.col("d.originName").alias("origin_name"))


def claims_from_tags(photos: DataFrame) -> DataFrame:
    """One unconfirmed machine claim per tag of a photo."""
    return photos.select("photo_id", F.explode("tags").alias("species")).select(
        "photo_id", "species", F.lit(1).alias("n"), F.lit("camera-ai").alias("source"), F.lit(False).alias("confirmed"))


# ---- column-wise documents ----------------------------------------------------------

def columns_to_rows(docs: DataFrame, key: str, arrays: dict[str, str]) -> DataFrame:
    """Parallel arrays to one row per position: arrays maps array column -> row column."""
    zipped = F.arrays_zip(*[F.col(a).alias(n) for a, n in arrays.items()])
    return docs.select(key, F.posexplode(zipped).alias("pos", "x")).select(key, "pos", *[f"x.{n}" for n in arrays.values()])


def frame_index(frames: DataFrame) -> DataFrame:
    """Radar frames (kind, time_s, path) once per id; past before forecast, unaddressable dropped."""
    ident = F.try_element_at(F.filter(F.split("path", "/"), lambda p: p != ""), F.lit(-1))
    rows = frames.withColumn("frame_id", ident).where(F.col("frame_id").rlike("^[A-Za-z0-9_-]+$") & F.col("time_s").isNotNull())
    order = F.struct(F.when(F.col("kind") == "past", 0).otherwise(1), "time_s")
    return rows.groupBy("frame_id").agg(F.min_by(F.struct("kind", "time_s", "path"), order).alias("f")).select(
        "frame_id", "f.kind", "f.time_s", "f.path")


def reel_age(index: DataFrame, now_s: Column, cutoff_min: int) -> DataFrame:
    """Age of the newest past frame (else the newest) and whether it is too old to draw."""
    newest = F.coalesce(F.max(F.when(F.col("kind") == "past", F.col("time_s"))), F.max("time_s"))
    age = (now_s - newest) / 60.0
    return index.agg(F.count("*").alias("frames"), F.floor(age + 0.5).alias("age_min"), (age > cutoff_min).alias("too_old"))


def scene_rows(features: DataFrame) -> DataFrame:
    """Imagery catalogue entries (id, datetime, grid_code, cloud) to date, cloud and UTM zone."""
    code = F.coalesce("grid_code", F.get(F.split("id", "_"), F.lit(1)), F.lit(""))
    zone = F.regexp_extract(F.regexp_replace(code, "^MGRS-", ""), r"(\d{1,2})[A-Z]{3}$", 1)
    return features.select("id", F.substring("datetime", 1, 10).alias("date"), "cloud", zone.try_cast("int").alias("zone"))


# ---- position audit -----------------------------------------------------------------

def position_audit(rows: DataFrame, stored: DataFrame, tolerance_m: float = 25.0) -> DataFrame:
    """Does the stored pin follow from the document, and do the document's own copies agree?

    rows: camera rows with `fix`; stored: camera_id, lat, lng, gps_fix.
    """
    s = stored.select("camera_id", F.col("lat").alias("s_lat"), F.col("lng").alias("s_lng"), F.col("gps_fix").alias("s_fix"),
                      F.lit(True).alias("held"))
    d_lat, d_lng = geo.dms_degrees(F.col("fix.latitude")), geo.dms_degrees(F.col("fix.longitude"))
    cell = geo.geohash_cell(F.col("fix.geohash"))
    j = rows.join(s, "camera_id", "left")
    mine, kept = F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.col("s_lat").isNotNull() & F.col("s_lng").isNotNull()
    drift = geo.haversine_m(F.col("lat"), F.col("lng"), F.col("s_lat"), F.col("s_lng"))
    doc_t, row_t = F.try_to_timestamp("gps_fix"), F.try_to_timestamp("s_fix")
    off = geo.haversine_m(F.col("lat"), F.col("lng"), d_lat, d_lng)
    copies = (F.when(off > tolerance_m, "degrees copy disagrees")
              .when(cell.isNotNull() & ~geo.cell_contains(cell, F.col("lat"), F.col("lng")), "geohash copy disagrees"))
    verdict = (F.when(F.col("held").isNull(), "not stored").when(~mine & ~kept, "no position anywhere")
               .when(~mine, "only the row has a position").when(~kept, "only the document has a position")
               .when((drift > tolerance_m) & (row_t > doc_t), "document is behind")
               .when((drift > tolerance_m) & (doc_t > row_t), "row is behind")
               .when(drift > tolerance_m, "row written by an older rule")
               .when(F.col("fix").isNull(), "position not from a fix").otherwise(F.coalesce(copies, F.lit("agrees"))))
    return j.select("camera_id", F.floor(drift + 0.5).alias("drift_m"), verdict.alias("verdict"))
