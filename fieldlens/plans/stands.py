"""Which stand for one sit: wind, thermal, own photographs, pressure and food, with reasons.

A sit is a handful of literals (window, wind, date), so ranking is one pass over the
stands and the facts around them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.constants import NEAR_CAMERA_M
from fieldlens.functions.compass import compass_point
from fieldlens.functions.num import clamp, half_up
from fieldlens.functions.score import thermal
from fieldlens.operators.spatial import nearest


def _part(points: Column, reason: str | Column, tier: str | Column) -> Column:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    tier = F.lit(tier) if isinstance(tier, str) else tier
    return F.struct(points.cast("int").alias("points"), reason.alias("reason"), tier.alias("tier"))


def rank_stands(stands: DataFrame, window: str, wind_deg: float | None, evidence: DataFrame,
                cameras: DataFrame, pressure: DataFrame, food: DataFrame) -> DataFrame:
    """Score every stand for one sit; higher is better.

    stands: stand_id, stand_name, lat, lng, winds, wind_source, ticked, slope, aspect.
    evidence: camera_id, hours, per100, enough for the sit's question. cameras: camera_id,
    lat, lng. pressure and food: per stand, from the context operators.
    """
    deg = F.lit(None).cast("double") if wind_deg is None else F.lit(float(wind_deg))
    point = compass_point(deg)
    huntable = F.when((F.col("wind_source") != "none") & point.isNotNull(), F.array_contains("winds", point))
    tier = F.when(F.col("wind_source") == "lanes", "Y").otherwise("C")
    wind = (F.when(deg.isNull(), _part(F.lit(0), "no wind forecast", "C"))
            .when(huntable.isNull(), _part(F.lit(0), "trace lanes or record winds", "C"))
            .when(huntable, _part(F.lit(30), "wind suits this stand", tier))
            .otherwise(_part(F.lit(-40), "wind carries scent down a lane", tier)))

    air = thermal(F.col("slope"), F.col("aspect"), F.lit(window))
    suits = F.array_contains("ticked", compass_point(F.col("air.from_deg")))
    rise = (F.when(F.col("air.weight") == 0, _part(F.lit(0), "no thermal", "B"))
            .when(F.coalesce(F.size("ticked"), F.lit(0)) <= 0, _part(F.lit(0), "thermal, no winds recorded", "B"))
            .when(suits, _part(half_up(F.col("air.weight") * 10.0), "thermal suits this stand", "B"))
            .otherwise(_part(half_up(F.col("air.weight") * -18.0), "thermal works against this stand", "B")))

    good = evidence.where(F.col("enough") & F.col("per100").isNotNull())
    seen = good.join(cameras.select("camera_id", "lat", "lng"), "camera_id")
    top = good.agg(F.max("per100").alias("top_rate"))
    near = nearest(stands.select("stand_id", "lat", "lng"), seen, "stand_id", "camera_id", NEAR_CAMERA_M).select(
        "stand_id", "camera_id").join(good.select("camera_id", "hours", "per100"), "camera_id", "left")
    share = F.when(F.col("top_rate") > 0, F.col("per100") / F.col("top_rate")).otherwise(0.0)
    own = F.when(F.col("per100").isNotNull(), _part(clamp(half_up(18.0 * (share - 0.5) * 2.0), -8, 18),
                                                    "own photographs", "Y")).otherwise(
        _part(F.lit(0), "no own photographs to rank on", "Y"))

    press = F.when(F.col("logged").isNull(), _part(F.lit(0), "log sits to know the pressure", "C")).otherwise(
        _part(F.col("pressure_points"), "recent pressure", "B"))
    feed = _part(F.coalesce("food_points", F.lit(0)), "food nearby", "C")

    rows = (stands.join(near, "stand_id", "left").join(F.broadcast(top))
            .join(pressure.select("stand_id", "logged", "pressure_points"), "stand_id", "left")
            .join(food.select("stand_id", "food_points"), "stand_id", "left")
            .withColumn("huntable", huntable).withColumn("air", air))
    scored = rows.withColumn("reasons", F.array(wind, rise, own, press, feed))
    return scored.withColumn("total", F.aggregate("reasons", F.lit(0), lambda a, p: a + p["points"])).select(
        "stand_id", "stand_name", "total", "huntable", "wind_source", F.col("air.strength").alias("thermal"),
        F.col("hours").alias("own_hours"), F.col("logged").isNotNull().alias("pressure_known"), "reasons")


def ordered(ranked: DataFrame) -> DataFrame:
    return ranked.orderBy(F.col("total").desc(), "stand_id")


def confidence(ranked: DataFrame) -> DataFrame:
    """Tier per stand; only the leader gains or loses by its margin over the next."""
    two = ordered(ranked).limit(2).agg(
        F.max_by("stand_id", F.struct("total", -F.col("stand_id"))).alias("leader"),
        F.max("total").alias("best"), F.min("total").alias("second"), F.count("*").alias("n"))
    gap = F.col("best") - F.col("second")
    leads = (F.col("stand_id") == F.col("leader")) & (F.col("n") == 2)
    score = (F.when(F.col("wind_source") == "lanes", 2).otherwise(1)
             + F.when(F.col("own_hours") >= 200, 2).when(F.col("own_hours").isNotNull(), 1).otherwise(0)
             + F.when(F.col("pressure_known"), 1).otherwise(0)
             + F.when(leads & (gap >= 15), 1).when(leads & (gap <= 3), -1).otherwise(0))
    known = F.col("huntable").isNotNull()
    out = ranked.join(F.broadcast(two)).withColumn("score", F.when(known, score).otherwise(0))
    tier = (F.when(~known, "none").when(F.col("score") >= 5, "high").when(F.col("score") >= 3, "moderate")
            .when(F.col("score") >= 1, "low").otherwise("none"))
    return out.withColumn("confidence", tier).drop("leader", "best", "second", "n")


def leading_reasons(reasons: Column, count: int = 5) -> Column:
    """The strongest reasons by size, either sign."""
    scored = F.filter(reasons, lambda p: p["points"] != 0)
    keyed = F.transform(scored, lambda p: F.struct((-F.abs(p["points"])).alias("k"), p["reason"].alias("reason"),
                                                   p["points"].alias("points")))
    return F.slice(F.array_sort(keyed), 1, count)


def to_do(reasons: Column) -> Column:
    """What would make the answer firmer: unscored reasons asking for a record."""
    return F.transform(F.filter(reasons, lambda p: (p["points"] == 0) & p["reason"].rlike("(?i)trace|log|draw|mark")),
                       lambda p: p["reason"])


def verdict(ranked: DataFrame) -> DataFrame:
    """One row: the pick (best huntable stand, else the best), reasons, to-do, counts."""
    pick = ranked.agg(
        F.count("*").alias("stands"), F.count_if(F.col("huntable")).alias("huntable_stands"),
        F.count_if(F.col("huntable").isNull()).alias("unknown_stands"),
        F.max_by(F.struct("stand_id", "stand_name", "total", "huntable", "reasons"), F.struct(
            F.when(F.col("huntable"), 1).otherwise(0), F.col("total"), -F.col("stand_id"))).alias("p"))
    said = (F.when(F.col("stands") == 0, "no stands yet")
            .when(F.col("unknown_stands") == F.col("stands"), "no stand has winds recorded")
            .when(F.col("huntable_stands") == 0, "no stand suits this wind")
            .otherwise(F.concat(F.col("p.stand_name"), F.lit(" suits the wind"))))
    return pick.select("stands", "huntable_stands", "unknown_stands", "p.stand_id", "p.total", "p.huntable",
                       leading_reasons(F.col("p.reasons")).alias("why"), to_do(F.col("p.reasons")).alias("todo"),
                       said.alias("summary"))
