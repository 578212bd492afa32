"""Keyed merges over stored tables, as joins and aggregates that rewrite what they touch.

Every function returns the new contents; the caller overwrites the touched partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merge_owned(existing: DataFrame, incoming: DataFrame, key: str, provided: list[str],
                owned: list[str]) -> DataFrame:
    """Provider columns follow the newest document, even to null; owner columns never change.

    A row the provider stopped sending stays as it is.
    """
    e, i = existing.alias("e"), incoming.withColumn("_sent", F.lit(True)).alias("i")
    sent = F.coalesce(F.col("i._sent"), F.lit(False))
    return e.join(i, F.col(f"e.{key}") == F.col(f"i.{key}"), "full_outer").select(
        F.coalesce(f"e.{key}", f"i.{key}").alias(key),
        *[F.when(sent, F.col(f"i.{c}")).otherwise(F.col(f"e.{c}")).alias(c) for c in provided],
        *[F.col(f"e.{c}").alias(c) for c in owned])


def merge_known(existing: DataFrame, incoming: DataFrame, key: str, replaced: list[str],
                kept: list[str]) -> DataFrame:
    """Replaced columns follow the incoming row; kept ones survive an incoming null."""
    e, i = existing.alias("e"), incoming.withColumn("_sent", F.lit(True)).alias("i")
    sent = F.coalesce(F.col("i._sent"), F.lit(False))
    return e.join(i, F.col(f"e.{key}") == F.col(f"i.{key}"), "full_outer").select(
        F.coalesce(f"e.{key}", f"i.{key}").alias(key),
        *[F.when(sent, F.col(f"i.{c}")).otherwise(F.col(f"e.{c}")).alias(c) for c in replaced],
        *[F.coalesce(f"i.{c}", f"e.{c}").alias(c) for c in kept])


def merge_camera_days(rows: DataFrame) -> DataFrame:
    """One row per camera and day: the last observation's state, the most photos seen."""
    last = [c for c in rows.columns if c not in ("camera_id", "day", "photos", "observed_at")]
    agg = rows.groupBy("camera_id", "day").agg(
        F.max_by(F.struct(*last), F.struct("observed_at", *last)).alias("l"), F.max("photos").alias("photos"),
        F.max("observed_at").alias("observed_at"))
    return agg.select("camera_id", "day", *[F.col(f"l.{c}").alias(c) for c in last], "photos", "observed_at")


def latest_by_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keep the newest row of every key. A partial aggregate, so repeats of a hot key fold early."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(
        order, *[c for c in rest if c != order])).alias("l")).select(*keys, *[F.col(f"l.{c}").alias(c) for c in rest])


def insert_new(existing: DataFrame, incoming: DataFrame, key: str, arrival: str) -> DataFrame:
    """Append incoming keys the table does not hold, each as it arrived first.

    What is there stays untouched, and so does a key's first row when it is sent again.
    """
    rest = [c for c in incoming.columns if c != key]
    fresh_rows = (incoming.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(arrival, *rest)).alias("f"))
                  .select(key, *[F.col(f"f.{c}").alias(c) for c in rest if c in existing.columns]))
    return existing.unionByName(fresh_rows.join(existing.select(key), key, "left_anti"), allowMissingColumns=True)


def apply_patches(base: DataFrame, patches: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Partial updates in order: patches(key, seq, changes MAP<STRING, STRING>).

    Only named columns change, a name with a null value clears its column, and columns not
    listed in `columns` (name -> type) cannot be patched at all.
    """
    lasts = patches.groupBy(key).agg(*[
        F.max_by(F.when(F.map_contains_key("changes", F.lit(c)), F.struct(F.try_element_at("changes", F.lit(c)).alias("v"))),
                 F.when(F.map_contains_key("changes", F.lit(c)), F.col("seq"))).alias(f"_{c}") for c in columns])
    out = base.join(lasts, key, "left")
    for c, kind in columns.items():
        new = F.col(f"_{c}.v") if kind == "string" else F.col(f"_{c}.v").try_cast(kind)
        out = out.withColumn(c, F.when(F.col(f"_{c}").isNotNull(), new).otherwise(F.col(c)))
    return out.select(*base.columns)


def delete_cascade(child: DataFrame, parents_gone: DataFrame, foreign: str, key: str) -> DataFrame:
    """Children of deleted parents go with them."""
    return child.join(parents_gone.select(F.col(key).alias(foreign)), foreign, "left_anti").select(*child.columns)


def delete_set_null(child: DataFrame, parents_gone: DataFrame, foreign: str, key: str) -> DataFrame:
    """Children of deleted parents stay and forget them."""
    gone = parents_gone.select(F.col(key).alias(foreign), F.lit(True).alias("_gone"))
    return child.join(gone, foreign, "left").withColumn(
        foreign, F.when(F.col("_gone").isNull(), F.col(foreign))).select(*child.columns)


def assign_members(rows: DataFrame, ids: DataFrame, key: str, column: str, value: Column) -> DataFrame:
    """Set a column on the listed ids; `_changed` marks them for counting."""
    listed = ids.select(key).distinct().withColumn("_listed", F.lit(True))
    out = rows.join(listed, key, "left")
    changed = F.coalesce("_listed", F.lit(False))
    return out.withColumn(column, F.when(changed, value).otherwise(F.col(column))).withColumn(
        "_changed", changed).select(*rows.columns, "_changed")


def unseen(incoming: DataFrame, landed: DataFrame, key: str, group: str, order: list[Column],
           limit: int | None = None) -> DataFrame:
    """Rows not landed before, at most `limit` newest per group when a limit is asked for."""
    new = incoming.join(landed.select(key), key, "left_anti")
    if limit is None:
        return new
    return new.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(
        F.col("_r") <= limit).drop("_r")


def repair_paths(path: Column, wrong: str = "photos/") -> Column:
    """Strip a wrong prefix once."""
    return F.when(path.startswith(wrong), F.substr(path, F.lit(len(wrong) + 1))).otherwise(path)


def fresh(fetched_at: Column, now: Column, ttl_minutes: int) -> Column:
    age = F.unix_micros(now) - F.unix_micros(fetched_at)
    return F.coalesce(age <= ttl_minutes * 60_000_000, F.lit(False))


def split_valid(rows: DataFrame, rules: list[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): rules are (violated?, reason); rejected rows list every reason."""
    checked = with_violations(rows, rules)
    good = checked.where(F.size("violations") == 0).drop("violations")
    return good, checked.where(F.size("violations") > 0)


def with_violations(rows: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    return rows.withColumn("violations", F.array_compact(F.array(
        *[F.when(F.coalesce(bad, F.lit(False)), F.lit(why)) for bad, why in rules])))


def existing_parent(rows: DataFrame, parents: DataFrame, foreign: str, key: str) -> DataFrame:
    """Rows whose reference is null or exists."""
    known = parents.select(F.col(key).alias(foreign)).distinct().withColumn("_ok", F.lit(True))
    return rows.join(known, foreign, "left").where(F.col(foreign).isNull() | F.col("_ok")).select(*rows.columns)


# ---- what may be stored -------------------------------------------------------------

def bad_point(lat: Column, lng: Column) -> Column:
    return (lat.isNull() | lng.isNull() | F.isnan(lat) | F.isnan(lng)
            | ~lat.between(-90, 90) | ~lng.between(-180, 180))


def detection_rules(species: list[str]) -> list[tuple[Column, str]]:
    named = F.col("individual_id").isNotNull()
    return [(F.coalesce(F.col("n") < 1, F.lit(True)), "counts at least one animal"),
            (F.col("species").isNotNull() & ~F.col("species").isin(species), "unknown species"),
            (named & F.col("species").isNotNull() & (F.col("species") != "deer"), "a named animal is a deer")]


def point_rules() -> list[tuple[Column, str]]:
    return [(bad_point(F.col("lat"), F.col("lng")), "needs real coordinates")]


def path_rules(least: int, what: str) -> list[tuple[Column, str]]:
    odd = F.exists("points", lambda p: bad_point(p["lat"], p["lng"]))
    return [(F.col("points").isNull() | (F.size("points") < least), f"{what} needs at least {least} points"),
            (odd, f"{what} needs real coordinates")]


def track_rules() -> list[tuple[Column, str]]:
    return path_rules(2, "a track")


def cut_date(text: Column) -> Column:
    """The day a field was cut; blank is not recorded."""
    return F.try_to_date(F.substring(F.nullif(text, F.lit("")), 1, 10), "yyyy-MM-dd")


def cut_date_rules(column: str) -> list[tuple[Column, str]]:
    told = F.nullif(F.col(column), F.lit(""))
    shaped = F.substring(told, 1, 10).rlike(r"^\d{4}-\d{2}-\d{2}$")
    return [(told.isNotNull() & ~(shaped & cut_date(told).isNotNull()), "a cut needs a date")]


def sit_rules(windows: list[str]) -> list[tuple[Column, str]]:
    dated = F.col("date").cast("string").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(F.col("date").cast("string"), "yyyy-MM-dd").isNotNull()
    return [(~F.coalesce(dated, F.lit(False)), "needs a date"),
            (F.col("window").isNull() | ~F.col("window").isin(windows), "window must be AM or PM")]


def lane_rules() -> list[tuple[Column, str]]:
    far = F.exists("lanes", lambda x: bad_point(x["lat"], x["lng"]))
    wide = F.exists("lanes", lambda x: x["spread"].isNotNull() & ((x["spread"] <= 0) | (x["spread"] >= 90)))
    return [(far, "each lane needs an endpoint"), (wide, "a spread lies between 0 and 90")]


def count_or_null(text: Column) -> Column:
    """A whole, non-negative count; blank stays unknown."""
    v = text.try_cast("double")
    return F.when(v.isNotNull(), F.greatest(F.lit(0), F.floor(v + 0.5))).cast("bigint")


def number_or_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit("")).try_cast("double")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
