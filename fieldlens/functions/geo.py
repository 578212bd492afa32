"""Distances, bearings, shapes and map projections as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldlens.constants import (FEET_PER_METRE, HAVERSINE_RADIUS_M, M2_PER_ACRE,
                                 MEAN_RADIUS_M)
from fieldlens.functions.num import at_most, finite, half_up, half_up_to, wrap360


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres; the square root is clamped so equal points give 0."""
    s_lat = F.sin(F.radians(lat2 - lat1) / 2)
    s_lng = F.sin(F.radians(lng2 - lng1) / 2)
    h = s_lat * s_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s_lng * s_lng
    return F.lit(2 * HAVERSINE_RADIUS_M) * F.asin(at_most(F.sqrt(h), 1.0))


def bearing_deg(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    d = F.radians(lng2 - lng1)
    a, b = F.radians(lat1), F.radians(lat2)
    y = F.sin(d) * F.cos(b)
    x = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return wrap360(F.degrees(F.atan2(y, x)) + 360.0)


def angle_between(a: Column, b: Column) -> Column:
    """Unsigned difference of two headings, 0..180."""
    return F.abs(wrap360(a - b + 180.0) - 180.0)


def offset_point(lat: Column, lng: Column, bearing: Column, metres: Column) -> Column:
    """The point `metres` away on a bearing, small-distance approximation."""
    b = F.radians(bearing)
    north = F.degrees(metres * F.cos(b) / MEAN_RADIUS_M)
    east = F.degrees(metres * F.sin(b) / (MEAN_RADIUS_M * F.cos(F.radians(lat))))
    return F.struct((lat + north).alias("lat"), (lng + east).alias("lng"))


def effective_point(placed_lat: Column, placed_lng: Column, lat: Column, lng: Column) -> Column:
    """The owner's corrected pin when both halves are real, else the reported fix."""
    placed = finite(placed_lat) & finite(placed_lng)
    return F.struct(F.when(placed, placed_lat).otherwise(lat).alias("lat"),
                    F.when(placed, placed_lng).otherwise(lng).alias("lng"),
                    F.coalesce(placed, F.lit(False)).alias("corrected"))


# ---- arrays of {lng, lat} -----------------------------------------------------------

def _steps(points: Column) -> Column:
    """Pairs (a, b) of consecutive points."""
    n = F.size(points)
    tail = F.when(n >= 2, F.slice(points, 2, n - 1)).otherwise(F.slice(points, 1, 0))
    head = F.when(n >= 2, F.slice(points, 1, n - 1)).otherwise(F.slice(points, 1, 0))
    return F.arrays_zip(head.alias("a"), tail.alias("b"))


def path_length_m(points: Column) -> Column:
    legs = F.transform(_steps(points), lambda s: haversine_m(
        s["a"]["lat"], s["a"]["lng"], s["b"]["lat"], s["b"]["lng"]))
    return F.aggregate(legs, F.lit(0.0), lambda acc, x: acc + x)


def route_length_m(points: Column) -> Column:
    return half_up(path_length_m(points))


def closed_ring(points: Column) -> Column:
    return F.concat(points, F.slice(points, 1, 1))


def ring_perimeter_m(points: Column) -> Column:
    return F.when(F.size(points) >= 3, path_length_m(closed_ring(points)))


def ring_area_m2(points: Column) -> Column:
    """Area of a ring on the sphere (trapezoid rule in sine of latitude)."""
    parts = F.transform(_steps(closed_ring(points)), lambda s: F.radians(
        s["b"]["lng"] - s["a"]["lng"]) * (2.0 + F.sin(F.radians(s["a"]["lat"]))
                                          + F.sin(F.radians(s["b"]["lat"]))))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(points) >= 3, F.abs(total * (MEAN_RADIUS_M * MEAN_RADIUS_M) / 2.0))


def ring_acres(points: Column) -> Column:
    return ring_area_m2(points) / M2_PER_ACRE


def ring_vertex_mean(points: Column) -> Column:
    """Mean of the vertices; the centre used for food and stands."""
    n = F.size(points)
    total = F.aggregate(points, F.struct(F.lit(0.0).alias("lat"), F.lit(0.0).alias("lng")),
                        lambda acc, p: F.struct((acc["lat"] + p["lat"]).alias("lat"),
                                                (acc["lng"] + p["lng"]).alias("lng")))
    return F.when(n > 0, F.struct((total["lat"] / n).alias("lat"), (total["lng"] / n).alias("lng")))


def ring_bounds(points: Column) -> Column:
    lats = F.transform(points, lambda p: p["lat"])
    lngs = F.transform(points, lambda p: p["lng"])
    return F.struct(F.array_min(lngs).alias("west"), F.array_max(lngs).alias("east"),
                    F.array_min(lats).alias("south"), F.array_max(lats).alias("north"))


def ring_box_centre(points: Column) -> Column:
    """Middle of the bounding box; the centre used for imagery and parcels."""
    b = ring_bounds(points)
    return F.struct(((b["south"] + b["north"]) / 2).alias("lat"),
                    ((b["west"] + b["east"]) / 2).alias("lng"))


def ring_edges(rings: Column) -> Column:
    """Every edge {a, b} of every ring in one array; compute it once per polygon."""
    return F.flatten(F.transform(rings, lambda r: _steps(closed_ring(r))))


def edges_contain(edges: Column, lng: Column, lat: Column) -> Column:
    """Even-odd rule: an odd number of edges lies east of the point.

    Parity over all rings together, so holes and islands need no special case.
    """
    crossed = F.filter(edges, lambda s: (
        (s["a"]["lat"] > lat) != (s["b"]["lat"] > lat))
        & (lng < (s["b"]["lng"] - s["a"]["lng"]) * (lat - s["a"]["lat"])
           / (s["b"]["lat"] - s["a"]["lat"]) + s["a"]["lng"]))
    return F.size(crossed) % 2 == 1


def rings_contain(rings: Column, lng: Column, lat: Column) -> Column:
    return edges_contain(ring_edges(rings), lng, lat)


def point_segment_m(p_lat: Column, p_lng: Column, a_lat: Column, a_lng: Column,
                    b_lat: Column, b_lng: Column) -> Column:
    """Metres from a point to a segment on a local flat grid anchored at a."""
    r = F.radians(a_lat)
    m_lat = F.lit(111132.92) - 559.82 * F.cos(2 * r)
    m_lng = 111412.84 * F.cos(r) - 93.5 * F.cos(3 * r)
    x, y = (p_lng - a_lng) * m_lng, (p_lat - a_lat) * m_lat
    bx, by = (b_lng - a_lng) * m_lng, (b_lat - a_lat) * m_lat
    len2 = bx * bx + by * by
    t = F.when(len2 == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x * bx + y * by) / len2)))
    dx, dy = x - t * bx, y - t * by
    return F.sqrt(dx * dx + dy * dy)


# ---- keys and grids -----------------------------------------------------------------

def location_key(lat: Column, lng: Column) -> Column:
    return F.struct(half_up_to(lat, 4).alias("lat"), half_up_to(lng, 4).alias("lng"))


def climate_key(lat: Column, lng: Column) -> Column:
    return F.struct(half_up_to(lat, 2).alias("lat"), half_up_to(lng, 2).alias("lng"))


def tile_x(lng: Column, zoom) -> Column:
    return F.floor((lng + 180.0) / 360.0 * F.pow(F.lit(2.0), F.lit(zoom)))


def tile_y(lat: Column, zoom) -> Column:
    r = F.radians(lat)
    return F.floor((1.0 - F.log(F.tan(r) + 1.0 / F.cos(r)) / math.pi) / 2.0
                   * F.pow(F.lit(2.0), F.lit(zoom)))


def tile_cover(west: Column, south: Column, east: Column, north: Column, zoom) -> Column:
    """Every (x, y) tile touching a box, as an array of structs."""
    xs = F.sequence(tile_x(west, zoom), tile_x(east, zoom))
    ys = F.sequence(tile_y(north, zoom), tile_y(south, zoom))
    return F.flatten(F.transform(xs, lambda x: F.transform(
        ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def tile_bounds_3857(x: Column, y: Column, zoom) -> Column:
    half = math.pi * 6378137.0
    size = F.lit(2 * half) / F.pow(F.lit(2.0), F.lit(zoom))
    return F.struct((x * size - half).alias("west"), (F.lit(half) - (y + 1) * size).alias("south"),
                    ((x + 1) * size - half).alias("east"), (F.lit(half) - y * size).alias("north"))


def feet(metres: Column) -> Column:
    return metres * FEET_PER_METRE


# ---- projections --------------------------------------------------------------------

def utm_zone(lng: Column) -> Column:
    return F.floor(wrap360(lng + 180.0) / 6.0) + 1


def to_utm(lat: Column, lng: Column, zone: Column) -> Column:
    """Transverse Mercator easting and northing, WGS84, series to sixth order."""
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi = F.radians(lat)
    lam0 = F.radians((zone - 1) * 6.0 - 177.0)
    raw = F.radians(lng) - lam0
    dl = F.pmod(raw + math.pi, F.lit(2 * math.pi)) - math.pi
    s, c, t = F.sin(phi), F.cos(phi), F.tan(phi)
    nu = F.lit(a) / F.sqrt(1.0 - e2 * s * s)
    tt, cc, aa = t * t, ep2 * c * c, dl * c
    m = a * ((1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256) * phi
             - (3 * e2 / 8 + 3 * e2 ** 2 / 32 + 45 * e2 ** 3 / 1024) * F.sin(2 * phi)
             + (15 * e2 ** 2 / 256 + 45 * e2 ** 3 / 1024) * F.sin(4 * phi)
             - (35 * e2 ** 3 / 3072) * F.sin(6 * phi))
    a2 = aa * aa
    a3, a4, a5, a6 = a2 * aa, a2 * a2, a2 * a2 * aa, a2 * a2 * a2
    x = 0.9996 * nu * (aa + (1.0 - tt + cc) * a3 / 6
                       + (5.0 - 18 * tt + tt * tt + 72 * cc - 58 * ep2) * a5 / 120) + 500000.0
    y = 0.9996 * (m + nu * t * (a2 / 2 + (5.0 - tt + 9 * cc + 4 * cc * cc) * a4 / 24
                                + (61.0 - 58 * tt + tt * tt + 600 * cc - 330 * ep2) * a6 / 720))
    return F.struct(x.alias("x"), F.when(lat < 0, y + 10000000.0).otherwise(y).alias("y"))


def to_albers(lat: Column, lng: Column) -> Column:
    """Albers equal-area conic, CONUS parameters (EPSG:5070)."""
    a, e2 = 6378137.0, 0.00669438002290
    e = math.sqrt(e2)
    lat0, lng0, sp1, sp2 = (math.radians(v) for v in (23.0, -96.0, 29.5, 45.5))

    def q_num(p):
        s = math.sin(p)
        return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    def m_num(p):
        return math.cos(p) / math.sqrt(1 - e2 * math.sin(p) ** 2)

    n = (m_num(sp1) ** 2 - m_num(sp2) ** 2) / (q_num(sp2) - q_num(sp1))
    c = m_num(sp1) ** 2 + n * q_num(sp1)
    rho0 = a * math.sqrt(c - n * q_num(lat0)) / n
    s = F.sin(F.radians(lat))
    q = (1 - e2) * (s / (1.0 - e2 * s * s) - F.log((1.0 - e * s) / (1.0 + e * s)) / (2 * e))
    rho = a * F.sqrt(c - n * q) / n
    theta = n * (F.radians(lng) - lng0)
    return F.struct((rho * F.sin(theta)).alias("x"), (rho0 - rho * F.cos(theta)).alias("y"))


# ---- vendor position texts ----------------------------------------------------------

GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"      # fixed value


def dms_degrees(text: Column) -> Column:
    """`N44 7.407360` to signed degrees; out-of-range or odd text is null."""
    pattern = r"^([NSEW])\s*(\d{1,3})\s+(\d{1,3}(?:\.\d+)?)$"
    t = F.trim(text)
    hemi = F.regexp_extract(t, pattern, 1)
    minutes = F.regexp_extract(t, pattern, 3).try_cast("double")
    deg = F.regexp_extract(t, pattern, 2).try_cast("double") + minutes / 60.0
    limit = F.when(hemi.isin("N", "S"), 90.0).otherwise(180.0)
    signed = F.when(hemi.isin("S", "W"), -deg).otherwise(deg)
    return F.when((hemi != "") & (minutes < 60) & (deg <= limit), signed)


def geohash_cell(code: Column) -> Column:
    """Bounds of a geohash cell; null for empty text or a letter outside the alphabet."""
    low = F.lower(code)
    n = F.length(low)
    valid = low.rlike(f"^[{GEOHASH_ALPHABET}]+$")
    bits = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.transform(
        F.array(*[F.lit(k) for k in (16, 8, 4, 2, 1)]),
        lambda m: (F.instr(F.lit(GEOHASH_ALPHABET), F.substring(low, i, F.lit(1))) - 1)
        .bitwiseAND(m) > 0)))
    start = F.struct(F.lit(True).alias("lng_turn"), F.lit(-90.0).alias("south"),
                     F.lit(90.0).alias("north"), F.lit(-180.0).alias("west"),
                     F.lit(180.0).alias("east"))

    def halve(b, upper):
        mid_lng, mid_lat = (b["west"] + b["east"]) / 2, (b["south"] + b["north"]) / 2
        t = b["lng_turn"]
        return F.struct((~t).alias("lng_turn"),
                        F.when(~t & upper, mid_lat).otherwise(b["south"]).alias("south"),
                        F.when(~t & ~upper, mid_lat).otherwise(b["north"]).alias("north"),
                        F.when(t & upper, mid_lng).otherwise(b["west"]).alias("west"),
                        F.when(t & ~upper, mid_lng).otherwise(b["east"]).alias("east"))

    cell = F.aggregate(bits, start, halve)
    return F.when(valid, F.struct(cell["south"].alias("south"), cell["north"].alias("north"),
                                  cell["west"].alias("west"), cell["east"].alias("east")))


def cell_contains(cell: Column, lat: Column, lng: Column) -> Column:
    return (cell.isNotNull() & (lat >= cell["south"]) & (lat <= cell["north"])
            & (lng >= cell["west"]) & (lng <= cell["east"]))
