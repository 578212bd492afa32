"""Walks: what scent reaches, which winds are clean, how a track followed its route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldlens.constants import COMPASS, CONE_HALF_ANGLE_DEG, CONE_REACH_M, STRAY_M
from fieldlens.functions import geo
from fieldlens.functions.num import half_up, half_up_to, wrap360
from fieldlens.operators.orderstat import order_statistic
from fieldlens.operators.spatial import near_pairs


def route_points(routes: DataFrame) -> DataFrame:
    """routes(route_id, points) -> one row per point with its position."""
    return routes.select("route_id", F.posexplode("points").alias("pos", "p")).select(
        "route_id", "pos", F.col("p.lat").alias("lat"), F.col("p.lng").alias("lng"))


def points_near_targets(routes: DataFrame, targets: DataFrame, reach_m: float = CONE_REACH_M) -> DataFrame:
    """Route points with every target in reach and the bearing to it: wind-free, reusable.

    Targets look up the cells around them, as a route has many points.
    """
    pairs = near_pairs(targets, route_points(routes), reach_m, ["target_id"], ["route_id", "pos"])
    pairs = pairs.select("route_id", "pos", F.col("r_lat").alias("l_lat"), F.col("r_lng").alias("l_lng"), "target_id",
                         F.col("l_lat").alias("r_lat"), F.col("l_lng").alias("r_lng"), "metres")
    return pairs.withColumn("to_target", geo.bearing_deg(F.col("l_lat"), F.col("l_lng"), F.col("r_lat"), F.col("r_lng")))


def scent_hits(near: DataFrame, winds: DataFrame, half_angle: float = CONE_HALF_ANGLE_DEG) -> DataFrame:
    """Closest point from which scent reaches a target on the route's wind.

    winds(route_id, wind_from_deg); an unknown wind answers nothing, not `clean`.
    """
    off = geo.angle_between(wrap360(F.col("wind_from_deg") + 180.0), F.col("to_target"))
    return (near.join(winds.where(F.col("wind_from_deg").isNotNull()), "route_id").withColumn("off", off)
            .where(F.col("off") <= half_angle).groupBy("route_id", "target_id")
            .agg(F.min(F.struct("metres", "pos", "off")).alias("m"))
            .select("route_id", "target_id", half_up(F.col("m.metres")).alias("metres"),
                    half_up(F.col("m.off")).alias("off_deg"), F.col("m.pos").alias("pos")))


def assess_routes(routes: DataFrame, hits: DataFrame, winds: DataFrame) -> DataFrame:
    """Per route: length, ok (null when it cannot be judged), closest approach, targets crossed.

    routes(route_id, stand_id, points); hits come from `scent_hits`.
    """
    mine = F.coalesce(F.col("target_id") == F.col("stand_id"), F.lit(False))
    met = hits.join(routes.select("route_id", "stand_id"), "route_id").groupBy("route_id").agg(
        F.min(F.when(mine, F.col("metres"))).alias("own_m"), F.count_if(~mine).alias("crossed"))
    judged = (F.size("points") >= 2) & F.col("stand_id").isNotNull() & F.col("wind_from_deg").isNotNull()
    return (routes.join(winds, "route_id", "left").join(met, "route_id", "left")
            .select("route_id", "stand_id", geo.route_length_m(F.col("points")).alias("length_m"),
                    F.when(judged, F.col("own_m").isNull()).alias("ok"), "own_m",
                    F.coalesce("crossed", F.lit(0)).alias("crossed")))


def route_winds(near: DataFrame, owners: DataFrame, half_angle: float = CONE_HALF_ANGLE_DEG) -> DataFrame:
    """Per route and its own target: the winds that carry scent onto it and those that do not."""
    winds = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("point"), F.lit(i * 22.5).alias("deg"))
                      for i, p in enumerate(COMPASS)])
    own = near.join(owners, ["route_id", "target_id"]).withColumn("w", F.explode(winds))
    off = geo.angle_between(wrap360(F.col("w.deg") + 180.0), F.col("to_target"))
    dirty = (own.where(off <= half_angle).groupBy("route_id").agg(
        F.transform(F.array_sort(F.collect_set(F.struct("w.i", "w.point"))), lambda x: x["point"]).alias("dirty")))
    every = F.array(*map(F.lit, COMPASS))
    none = F.array().cast("array<string>")
    return owners.join(dirty, "route_id", "left").select(
        "route_id", F.coalesce("dirty", none).alias("dirty"),
        F.array_except(every, F.coalesce("dirty", none)).alias("clean"))


def taints(lat: Column, lng: Column, t_lat: Column, t_lng: Column, wind_from: Column,
           half_angle: float = CONE_HALF_ANGLE_DEG, reach_m: float = CONE_REACH_M) -> Column:
    """Does scent from a point reach a target: in reach and in the cone, or standing on it."""
    d = geo.haversine_m(lat, lng, t_lat, t_lng)
    off = geo.angle_between(wrap360(wind_from + 180.0), geo.bearing_deg(lat, lng, t_lat, t_lng))
    return (d <= reach_m) & ((d < 1e-6) | (off <= half_angle))


def densify(points: Column, every_m: float) -> Column:
    """A path with extra points so no step is longer than `every_m`."""
    n = F.size(points)
    legs = F.arrays_zip(F.slice(points, 1, n - 1).alias("a"), F.slice(points, 2, n - 1).alias("b"))

    def fill(leg):
        m = geo.haversine_m(leg["a"]["lat"], leg["a"]["lng"], leg["b"]["lat"], leg["b"]["lng"])
        steps = F.greatest(F.lit(1), F.ceil(m / every_m)).cast("int")
        return F.transform(F.sequence(F.lit(1), steps), lambda s: F.struct(
            (leg["a"]["lng"] + (leg["b"]["lng"] - leg["a"]["lng"]) * s / steps).alias("lng"),
            (leg["a"]["lat"] + (leg["b"]["lat"] - leg["a"]["lat"]) * s / steps).alias("lat")))

    return F.when(n >= 2, F.concat(F.slice(points, 1, 1), F.flatten(F.transform(legs, fill)))).otherwise(points)


def best_walks(assessed: DataFrame) -> DataFrame:
    """Each stand's walk: the first clean one, else the first."""
    order = F.struct(F.when(F.coalesce("ok", F.lit(False)), 0).otherwise(1).alias("bad"), F.col("route_id"))
    return assessed.groupBy("stand_id").agg(F.min_by(F.struct("route_id", "ok", "length_m"), order).alias("w")).select(
        "stand_id", "w.route_id", "w.ok", "w.length_m")


def route_segments(routes: DataFrame) -> DataFrame:
    n = F.size("points")
    legs = F.arrays_zip(F.slice("points", 1, n - 1).alias("a"), F.slice("points", 2, n - 1).alias("b"))
    return routes.where(n >= 2).select("route_id", F.posexplode(legs).alias("seg", "s"))


def track_deviations(track_points: DataFrame, routes: DataFrame) -> DataFrame:
    """Distance of every walked point to its route's nearest segment."""
    d = geo.point_segment_m(F.col("lat"), F.col("lng"), F.col("s.a.lat"), F.col("s.a.lng"),
                            F.col("s.b.lat"), F.col("s.b.lng"))
    return (track_points.join(route_segments(routes), "route_id").withColumn("d", d)
            .groupBy("track_id", "pos").agg(F.min("d").alias("deviation")))


def compare_to_route(track_points: DataFrame, routes: DataFrame, stray_m: float = STRAY_M) -> DataFrame:
    """Per track: median and worst deviation and the share of points off the route.

    Tracks and routes need two points each; others are not comparable and vanish.
    """
    dev = track_deviations(track_points, routes)
    mid = order_statistic(dev, ["track_id"], "deviation", 0.5, "mid").drop("n")
    agg = dev.groupBy("track_id").agg(F.count("*").alias("points"), F.max("deviation").alias("worst"),
                                      F.count_if(F.col("deviation") > stray_m).alias("off"))
    return (agg.where(F.col("points") >= 2).join(mid, "track_id").select(
        "track_id", "points", half_up(F.col("mid")).alias("median_m"), half_up(F.col("worst")).alias("worst_m"),
        half_up_to(F.col("off") / F.col("points"), 2).alias("off_fraction"),
        (F.col("worst") <= stray_m).alias("followed")))
