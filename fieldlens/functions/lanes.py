"""Shooting lanes and camera views: wedges from a point along a bearing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldlens.constants import (CAMERA_REACH_M, CAMERA_SPREAD_DEG, COMPASS, CONE_HALF_ANGLE_DEG,
                                 LANE_SPREAD_DEG, MAX_LANE_SPREAD_DEG, MIN_LANE_REACH_M,
                                 MIN_LANE_SPREAD_DEG)
from fieldlens.functions.compass import compass_point
from fieldlens.functions.geo import angle_between, bearing_deg, haversine_m, offset_point
from fieldlens.functions.num import clamp, half_up, half_up_to, wrap360


def lane_spread(spread: Column, fallback: float = LANE_SPREAD_DEG) -> Column:
    return F.coalesce(clamp(spread, MIN_LANE_SPREAD_DEG, MAX_LANE_SPREAD_DEG), F.lit(fallback))


def lane_width_m(metres: Column, spread: Column) -> Column:
    return 2.0 * metres * F.tan(F.radians(spread))


def spread_for_width(metres: Column, width: Column) -> Column:
    """Half-angle that gives a width at a distance; null for a non-positive input."""
    deg = F.degrees(F.atan(width / (2.0 * metres)))
    return F.when((metres > 0) & (width > 0), half_up_to(
        clamp(deg, MIN_LANE_SPREAD_DEG, MAX_LANE_SPREAD_DEG), 1))


def lane_at_reach(lat: Column, lng: Column, to_lat: Column, to_lng: Column, metres: Column) -> Column:
    return offset_point(lat, lng, bearing_deg(lat, lng, to_lat, to_lng),
                        F.greatest(F.lit(MIN_LANE_REACH_M), metres))


def lane_geometry(lat: Column, lng: Column, lane: Column, fallback: float = LANE_SPREAD_DEG) -> Column:
    """A lane {lng, lat, label, spread} seen from its stand: bearing, point, metres, width."""
    deg = bearing_deg(lat, lng, lane["lat"], lane["lng"])
    metres = half_up(haversine_m(lat, lng, lane["lat"], lane["lng"]))
    spread = lane_spread(lane["spread"], fallback)
    return F.struct(lane["label"].alias("label"), half_up_to(deg, 1).alias("bearing"),
                    compass_point(deg).alias("point"), metres.alias("metres"), spread.alias("spread"),
                    half_up_to(lane_width_m(metres, spread), 1).alias("width_m"))


def _held(value: Column, use) -> Column:
    """use(value) with value worked out once, however often `use` and what a filter copies of it name it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blocked_winds(lanes: Column, half_angle: float = CONE_HALF_ANGLE_DEG) -> Column:
    """For each of the sixteen winds the lane it blows scent down, if any.

    Array of {point, blocked, off_deg, label}; the lane nearest the scent's axis is named.
    """
    winds = F.array(*[F.struct(F.lit(p).alias("point"), F.lit(i * 22.5).alias("deg"))
                      for i, p in enumerate(COMPASS)])

    def judge(held, w):
        down = wrap360(w["deg"] + 180.0)
        offs = F.transform(held, lambda g: F.struct(
            angle_between(down, g["bearing"]).alias("off"), g["label"].alias("label"), g["spread"].alias("spread")))
        return _held(F.array_min(F.filter(offs, lambda o: o["off"] <= half_angle + o["spread"])), lambda hit: F.struct(
            w["point"].alias("point"), hit.isNotNull().alias("blocked"), half_up(hit["off"]).alias("off_deg"), hit["label"].alias("label")))

    return _held(lanes, lambda held: F.transform(winds, lambda w: judge(held, w)))


def huntable_winds(lanes: Column, half_angle: float = CONE_HALF_ANGLE_DEG) -> Column:
    """Winds that keep scent out of every lane; null without lanes."""
    downs = F.array(*[F.struct(F.lit(p).alias("point"), F.lit((i * 22.5 + 180.0) % 360.0).alias("down")) for i, p in enumerate(COMPASS)])

    def clean(held):
        blocks = lambda w, g: F.coalesce(angle_between(w["down"], g["bearing"]) <= half_angle + g["spread"], F.lit(False))
        kept = F.filter(downs, lambda w: ~F.exists(held, lambda g: blocks(w, g)))
        return F.when(F.size(held) > 0, F.transform(kept, lambda w: w["point"]))
    return _held(lanes, clean)


def stand_winds(lanes: Column, ticked: Column) -> Column:
    """{winds, source}: from lanes when traced, else the ticked ones, else none."""
    derived = huntable_winds(lanes)
    has_ticks = F.coalesce(F.size(ticked) > 0, F.lit(False))
    return F.when(derived.isNotNull(), F.struct(derived.alias("winds"), F.lit("lanes").alias("source"))).when(
        has_ticks, F.struct(ticked.alias("winds"), F.lit("ticked").alias("source"))).otherwise(
        F.struct(F.array().cast("array<string>").alias("winds"), F.lit("none").alias("source")))


def winds_compared(derived: Column, ticked: Column) -> Column:
    """{agree, only_ticked, only_derived}; null when there is nothing to compare."""
    known = F.array(*map(F.lit, COMPASS))
    manual = F.filter(ticked, lambda w: F.array_contains(known, w))

    def compare(winds):
        a, b = F.array_except(manual, winds), F.array_except(winds, manual)
        return F.when(winds.isNotNull() & (F.size(manual) > 0), F.struct(
            ((F.size(a) == 0) & (F.size(b) == 0)).alias("agree"), a.alias("only_ticked"), b.alias("only_derived")))
    return _held(derived, compare)


def camera_view(lat: Column, lng: Column, view: Column) -> Column:
    return F.when(view.isNotNull() & lat.isNotNull() & lng.isNotNull(),
                  lane_geometry(lat, lng, view, CAMERA_SPREAD_DEG))


def view_from_bearing(lat: Column, lng: Column, bearing: Column, metres: Column) -> Column:
    reach = F.greatest(F.lit(1.0), F.coalesce(metres, F.lit(CAMERA_REACH_M)))
    return F.when(bearing.isNotNull(), offset_point(lat, lng, wrap360(bearing), reach))


def facing_line(view: Column) -> Column:
    return F.when(view.isNotNull(), F.concat(
        view["point"], F.lit(" "), half_up(view["bearing"]).cast("string"), F.lit("° · "),
        view["metres"].cast("string"), F.lit(" m")))
