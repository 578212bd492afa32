"""Reading the store: photos, visits, detections and the people's claims about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldlens.constants import VENDOR_SPECIES


def house_species(word: Column) -> Column:
    """Machine tag to a house species, null for a word nobody mapped."""
    table = F.create_map(*[F.lit(v) for kv in VENDOR_SPECIES.items() for v in kv])
    return F.try_element_at(table, F.lower(F.trim(word)))


def detections_named(detections: DataFrame, photos: DataFrame, individuals: DataFrame) -> DataFrame:
    """Every detection with its photo's camera and visit columns and the individual's name."""
    return (detections.join(photos, "photo_id").join(individuals, "individual_id", "left"))


def detections_with_weather(detections: DataFrame, photos: DataFrame, cameras: DataFrame,
                            weather: DataFrame, species: str | None = None,
                            unconfirmed: bool = False) -> DataFrame:
    """Detections with the weather of their camera's location and hour; no weather stays."""
    d = detections if unconfirmed else detections.where("confirmed")
    d = d if species is None else d.where(F.col("species") == species)
    return (d.join(photos.select("photo_id", "camera_id", "taken_at", "hour_utc"), "photo_id")
            .join(cameras.select("camera_id", "location_id"), "camera_id")
            .join(weather, ["location_id", "hour_utc"], "left"))


def empty_visits(visit_photos: DataFrame, reviewed: DataFrame, detections: DataFrame) -> DataFrame:
    """Photos of reviewed visits without any confirmed detection: what empty looks like."""
    confirmed = (detections.where("confirmed").join(
        visit_photos.select("photo_id", "camera_id", "visit_no"), "photo_id")
        .select("camera_id", "visit_no").distinct())
    return (visit_photos.join(reviewed.select("camera_id", "visit_no"), ["camera_id", "visit_no"], "left_semi")
            .join(confirmed, ["camera_id", "visit_no"], "left_anti"))


def child_counts(parents: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """Counts of several child tables per parent, zero where there are none."""
    out = parents
    for name, child in children.items():
        counted = child.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(name))
        out = out.join(counted, key, "left")
    return out.na.fill(0, list(children))


def photo_labels(photos: DataFrame, detections: DataFrame, individuals: DataFrame) -> DataFrame:
    """Per photo: the confirmed labels (repeats kept) and the distinct machine claims."""
    label = F.concat("species", F.when(F.col("individual_name").isNotNull(),
                                       F.concat(F.lit(" ("), "individual_name", F.lit(")"))).otherwise(""))
    agg = (detections.join(individuals, "individual_id", "left").groupBy("photo_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("confirmed"), label))), ", ").alias("c"),
        F.array_join(F.array_sort(F.collect_set(F.when(
            (F.col("source") == "camera-ai") & ~F.col("confirmed"), F.col("species")))), ", ").alias("m")))
    return (photos.join(agg, "photo_id", "left")
            .withColumn("confirmed_labels", F.nullif(F.col("c"), F.lit("")))
            .withColumn("machine_claims", F.nullif(F.col("m"), F.lit(""))).drop("c", "m"))


def newest_per_group(df: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """Top-N per group. Spark limits each map task's groups to N before it shuffles."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def visit_queue(visits: DataFrame, cameras: DataFrame, unreviewed: bool = False,
                camera_id=None, limit: int = 200) -> DataFrame:
    """Newest visits first with their camera, optionally only those nobody reviewed."""
    v = visits.where(F.col("reviewed_at").isNull()) if unreviewed else visits
    v = v if camera_id is None else v.where(F.col("camera_id") == camera_id)
    return v.join(cameras, "camera_id").orderBy(F.col("started_at").desc(), "camera_id").limit(limit)


def visit_nest(visits: DataFrame, visit_photos: DataFrame, detections: DataFrame) -> DataFrame:
    """Each visit with photo and detection arrays, aggregated apart so neither multiplies the other."""
    key = ["camera_id", "visit_no"]
    p = visit_photos.groupBy(*key).agg(F.array_sort(F.collect_list("photo_id")).alias("photos"))
    d = (detections.join(visit_photos.select("photo_id", *key), "photo_id").groupBy(*key)
         .agg(F.array_sort(F.collect_list(F.struct("photo_id", "species"))).alias("detections")))
    return visits.join(p, key, "left").join(d, key, "left")


def claims_to_agree(visit_photos: DataFrame, detections: DataFrame) -> DataFrame:
    """(visit, species) the machine claims and no person has tagged; safe to run again."""
    key = ["camera_id", "visit_no", "species"]
    d = detections.join(visit_photos.select("photo_id", "camera_id", "visit_no"), "photo_id")
    claimed = (d.where(F.col("source") == "camera-ai").withColumn("species", house_species(F.col("species")))
               .where(F.col("species").isNotNull()).select(*key).distinct())
    tagged = d.where(F.col("source") != "camera-ai").select(*key).distinct()
    return claimed.join(tagged, key, "left_anti")


def confirmed_counts(detections: DataFrame, photos: DataFrame, since: Column,
                     species: str | None = None) -> DataFrame:
    """Animals (not rows) confirmed per camera since an instant."""
    d = detections.where("confirmed")
    d = d if species is None else d.where(F.col("species") == species)
    recent = photos.where(F.col("taken_at") >= since).select("photo_id", "camera_id")
    return d.join(recent, "photo_id").groupBy("camera_id").agg(F.sum("n").alias("animals"))


def individual_sightings(individuals: DataFrame, detections: DataFrame) -> DataFrame:
    counted = detections.where(F.col("individual_id").isNotNull()).groupBy("individual_id").agg(
        F.count("*").alias("sightings"))
    return individuals.join(counted, "individual_id", "left").na.fill(0, ["sightings"])


def store_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its number of rows."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


def photo_cards(photos: DataFrame) -> DataFrame:
    """Photos for review: address, whether the file is here and whether it is hashed."""
    from fieldlens.functions.hashes import is_hash
    return photos.select("photo_id", "camera_id", "url", F.col("file_path").isNotNull().alias("downloaded"),
                         is_hash(F.col("phash")).alias("hashed"))


def detection_cards(detections: DataFrame) -> DataFrame:
    """Detections for review: a machine claim carries the species it would mean, a person's row does not."""
    return detections.withColumn("suggestion", F.when(F.col("source") == "camera-ai", house_species(F.col("species"))))


def stand_rows(stands: DataFrame, lane_schema: str = "ARRAY<STRUCT<lng: DOUBLE, lat: DOUBLE, label: STRING, spread: DOUBLE>>") -> DataFrame:
    """Stored stands with their comma list and lane JSON unpacked."""
    none = F.array().cast("array<string>")
    return stands.withColumn("winds", F.when(F.col("good_winds").isNotNull(), F.split("good_winds", ",")).otherwise(none)).withColumn(
        "lanes", F.coalesce(F.from_json("lanes", lane_schema), F.array().cast(lane_schema)))
