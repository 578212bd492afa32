"""Land parcels: clean-up, who owns what a point is on, search by owner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.constants import PARCEL_CLASSES
from fieldlens.functions.num import half_up, half_up_to
from fieldlens.operators.spatial import points_in_polygons


def clean_text(x: Column) -> Column:
    """Trimmed text; blanks and the word None are unknown."""
    t = F.trim(x)
    return F.when((t != "") & (F.lower(t) != "none"), t)


def class_names(code: Column) -> Column:
    """Land-class codes to distinct names in order, unknown codes left out."""
    table = F.create_map(*[F.lit(v) for kv in PARCEL_CLASSES.items() for v in kv])
    words = F.transform(F.split(code, r"[,\s]+"), lambda w: F.try_element_at(table, w))
    return F.nullif(F.array_join(F.array_distinct(F.array_compact(words)), ", "), F.lit(""))


def normalise(raw: DataFrame) -> DataFrame:
    """parcel_id, owner_1, owner_2, acres, county, class_code -> clean columns."""
    owners = F.array_compact(F.array(clean_text(F.col("owner_1")), clean_text(F.col("owner_2"))))
    rest = [c for c in raw.columns if c not in ("owner_1", "owner_2", "acres", "county", "class_code", "parcel_id")]
    return raw.select(*rest, clean_text(F.col("parcel_id").cast("string")).alias("parcel_id"),
                      F.when(F.size(owners) > 0, F.concat_ws(" & ", owners)).alias("owner"),
                      half_up_to(F.col("acres"), 2).alias("acres"), clean_text(F.col("county")).alias("county"),
                      class_names(F.col("class_code")).alias("class_name"))


def owner_term(name: Column) -> Column:
    """Search text: upper case, odd characters to spaces, runs of spaces to one."""
    odd = F.regexp_replace(F.upper(name), r"[^A-Z0-9 &.,'-]+", " ")
    return F.trim(F.regexp_replace(odd, r"\s+", " "))


def by_owner(parcels: DataFrame, name: str) -> DataFrame:
    """All parcels whose owner contains the text, the largest first."""
    return (parcels.where(F.contains(F.upper("owner"), owner_term(F.lit(name))))
            .orderBy(F.col("acres").desc_nulls_last(), "parcel_id"))


def parcel_key(parcel_id: Column, owner: Column) -> Column:
    return F.coalesce(F.concat(F.lit("id:"), parcel_id), F.concat(F.lit("owner:"), owner))


def home_parcels(anchors: DataFrame, parcels: DataFrame, group: str, order: str,
                 step: float = 0.01) -> DataFrame:
    """The parcels under each group's anchors, with the key that tells them apart."""
    under = points_in_polygons(anchors.select(group, order, "lat", "lng"), parcels, step)
    key = parcel_key(F.col("parcel_id"), F.col("owner"))
    return under.withColumn("key", key)


def home_summary(under: DataFrame, group: str, order: str) -> DataFrame:
    """Per group: distinct parcels, their acres, the majority owner and the first county."""
    votes = (under.where(F.col("owner").isNotNull()).groupBy(group, "owner")
             .agg(F.count("*").alias("v"), F.min(order).alias("first")))
    majority = votes.groupBy(group).agg(F.max_by("owner", F.struct(F.col("v"), -F.col("first"))).alias("home_owner"))
    held = under.where(F.col("key").isNotNull()).groupBy(group, "key").agg(
        F.min(F.struct(order, "acres", "county")).alias("m"))
    sums = held.groupBy(group).agg(
        F.count("*").alias("parcels"), half_up(F.sum(F.coalesce("m.acres", F.lit(0.0)))).alias("acres"),
        F.min_by("m.county", F.when(F.col("m.county").isNotNull(), F.col(f"m.{order}"))).alias("county"))
    return sums.join(majority, group, "left")
