"""Pieces of ground: proximity clusters of pins and which one a point is on."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.constants import GROUND_GAP_M, WEATHER_RADIUS_M
from fieldlens.functions import geo
from fieldlens.operators.iterate import connected_components
from fieldlens.operators.spatial import M_PER_DEGREE, near_pairs, points_in_boxes
from fieldlens.session import cut_lineage

PARTS = 8                       # sub-cells per side of a cell


def _tight_cell(lat: Column, lng: Column, size_m: float) -> Column:
    """Cell id such that any two points of a cell are at most size_m apart."""
    side = size_m * 0.99 / math.sqrt(2) / M_PER_DEGREE
    row = F.floor(lat / side)
    # the row edge nearest the equator has the widest degrees, so it bounds the cell
    edge = F.when(row >= 0, row * side).otherwise((row + 1) * side)
    return F.concat_ws(":", row, F.floor(lng / side * F.cos(F.radians(edge))))


def _reach_m(lat_gap: Column, lng_gap: Column, lat_near_equator: Column) -> Column:
    """Upper bound in metres for a lat/lng difference."""
    x = lng_gap * F.cos(F.radians(lat_near_equator))
    return F.sqrt(lat_gap * lat_gap + x * x) * (M_PER_DEGREE * 1.0001)


def cell_links(spots: DataFrame, gap_m: float) -> DataFrame:
    """Pairs of cells holding two points within the gap of each other.

    spots(lat, lng, cell, part) are distinct coordinates. Boxes around sub-cells settle
    most pairs; only sub-cells at just about the gap are compared point by point.
    """
    boxes = spots.groupBy("cell", "part").agg(
        F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lng").alias("w"), F.max("lng").alias("e"))
    mid = boxes.withColumns({"lat": (F.col("s") + F.col("n")) / 2, "lng": (F.col("w") + F.col("e")) / 2})
    names = ["cell", "part", "s", "n", "w", "e"]
    left = mid.select("lat", "lng", *[F.col(c).alias(f"{c}1") for c in names])
    right = mid.select("lat", "lng", *[F.col(c).alias(f"{c}2") for c in names])
    slack = gap_m * (1 + 1.05 / PARTS)
    pairs = near_pairs(left, right, slack, [f"{c}1" for c in names], [f"{c}2" for c in names]).where(
        F.col("cell1") < F.col("cell2"))
    lat_gap = F.greatest(F.col("n1") - F.col("s2"), F.col("n2") - F.col("s1"))
    lng_gap = F.greatest(F.col("e1") - F.col("w2"), F.col("e2") - F.col("w1"))
    equator = F.least(F.abs("s1"), F.abs("s2"), F.abs("n1"), F.abs("n2"))
    pairs = pairs.withColumn("sure", _reach_m(lat_gap, lng_gap, equator) <= gap_m)
    sure = pairs.where("sure").select("cell1", "cell2").distinct()
    open_ = pairs.where(~F.col("sure")).select("cell1", "part1", "cell2", "part2").join(
        sure, ["cell1", "cell2"], "left_anti")
    a = spots.select(F.col("cell").alias("cell1"), F.col("part").alias("part1"),
                     F.col("lat").alias("lat1"), F.col("lng").alias("lng1"))
    b = spots.select(F.col("cell").alias("cell2"), F.col("part").alias("part2"),
                     F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))
    checked = (open_.join(a, ["cell1", "part1"]).join(b, ["cell2", "part2"])
               .where(geo.haversine_m(F.col("lat1"), F.col("lng1"), F.col("lat2"), F.col("lng2")) <= gap_m)
               .select("cell1", "cell2").distinct())
    return sure.unionByName(checked)


def cluster_pins(pins: DataFrame, key: str, gap_m: float = GROUND_GAP_M) -> DataFrame:
    """Single-linkage clusters: adds `ground_id`, the least key of the cluster.

    Points sharing a tight cell are linked by definition, so the graph has cells for
    nodes however many pins a place holds.
    """
    placed = pins.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).withColumns({
        "cell": _tight_cell(F.col("lat"), F.col("lng"), gap_m),
        "part": _tight_cell(F.col("lat"), F.col("lng"), gap_m / PARTS)})
    spots = cut_lineage(placed.select("lat", "lng", "cell", "part").distinct())
    links = cell_links(spots, gap_m).select(F.col("cell1").alias("src"), F.col("cell2").alias("dst"))
    comps = connected_components(spots.select(F.col("cell").alias("id")).distinct(), links)
    joined = placed.join(comps.withColumnRenamed("id", "cell"), "cell").drop("cell", "part")
    named = joined.groupBy("component").agg(F.min(key).alias("ground_id"))
    return joined.join(named, "component").drop("component")


def grounds(clustered: DataFrame) -> DataFrame:
    """One row per ground: bounds, centre, counts by kind, size and majority name."""
    box = clustered.groupBy("ground_id").agg(
        F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lng").alias("west"),
        F.max("lng").alias("east"), F.count("*").alias("size"),
        *[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("camera", "stand", "marker")])
    votes = (clustered.where(F.col("property").isNotNull()).groupBy("ground_id", "property")
             .agg(F.count("*").alias("v")).withColumn("first", F.col("property")))
    name = votes.groupBy("ground_id").agg(F.min(F.struct((-F.col("v")).alias("v"), "property")).alias("m"))
    return (box.join(name, "ground_id", "left").withColumn("name", F.col("m.property")).drop("m")
            .withColumns({"lat": (F.col("south") + F.col("north")) / 2, "lng": (F.col("west") + F.col("east")) / 2}))


def ground_label(cameras: Column, stands: Column, markers: Column) -> Column:
    """`2 cameras, 1 stand`, or `nothing placed`."""
    def part(n, word):
        return F.when(n > 0, F.concat(n.cast("string"), F.lit(" " + word), F.when(n == 1, "").otherwise("s")))
    text = F.concat_ws(", ", part(cameras, "camera"), part(stands, "stand"), part(markers, "marker"))
    return F.when(text == "", "nothing placed").otherwise(text)


def ground_at(points: DataFrame, ground: DataFrame, gap_m: float = GROUND_GAP_M,
              step: float = 0.05) -> DataFrame:
    """The ground each point is on: inside bounds wins, nearest centre decides; else within the gap."""
    spots = points.select("lat", "lng").distinct()
    keyed = spots.withColumns({"p_lat": F.col("lat"), "p_lng": F.col("lng")})
    boxes = ground.select("ground_id", "west", "south", "east", "north", F.col("lat").alias("c_lat"),
                          F.col("lng").alias("c_lng"))
    inside = points_in_boxes(keyed, boxes, step).select(
        "p_lat", "p_lng", F.lit(0).alias("order"), geo.haversine_m(
            F.col("p_lat"), F.col("p_lng"), F.col("c_lat"), F.col("c_lng")).alias("metres"), "ground_id")
    near = near_pairs(keyed, ground.select("ground_id", "lat", "lng"), gap_m, ["p_lat", "p_lng"], ["ground_id"]).select(
        "p_lat", "p_lng", F.lit(1).alias("order"), "metres", "ground_id")
    best = (inside.unionByName(near).groupBy("p_lat", "p_lng")
            .agg(F.min(F.struct("order", "metres", "ground_id")).alias("b"))
            .select(F.col("p_lat").alias("lat"), F.col("p_lng").alias("lng"), F.col("b.ground_id").alias("ground_id")))
    return points.join(best, ["lat", "lng"], "left")


def leader_locations(points: DataFrame, order: str, radius_m: float = WEATHER_RADIUS_M) -> DataFrame:
    """Weather locations by first come: a point joins the nearest earlier location in reach, else founds one.

    Adds loc_order, loc_lat, loc_lng. Founders are found in rounds: of each tight cell only
    its earliest undecided point can found, and it does when nobody earlier is in reach.
    Every point meets at most the founders-to-be of the cells around it.
    """
    k = geo.location_key(F.col("lat"), F.col("lng"))
    keyed = points.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).select(
        F.col(order).alias("o"), k["lat"].alias("lat"), k["lng"].alias("lng"))
    undecided = cut_lineage(keyed.groupBy("lat", "lng").agg(F.min("o").alias("o")).withColumn(
        "cell", _tight_cell(F.col("lat"), F.col("lng"), radius_m)))
    founders = None
    while True:
        first = undecided.groupBy("cell").agg(F.min(F.struct("o", "lat", "lng")).alias("m")).select(
            F.col("m.o").alias("o"), F.col("m.lat").alias("lat"), F.col("m.lng").alias("lng"))
        rivals = near_pairs(first.withColumnRenamed("o", "mine"), undecided, radius_m, ["mine"], ["o"])
        beaten = rivals.where(F.col("o") < F.col("mine")).select(F.col("mine").alias("o")).distinct()
        new = cut_lineage(first.join(beaten, "o", "left_anti"))
        founders = new if founders is None else founders.unionByName(new)
        taken = near_pairs(new.withColumnRenamed("o", "f"), undecided, radius_m, ["f"], ["o"]).select("o").distinct()
        undecided = cut_lineage(undecided.join(taken, "o", "left_anti"))
        if undecided.isEmpty():
            break
    reach = near_pairs(keyed, founders.select(F.col("o").alias("loc_order"), "lat", "lng",
                                              F.col("lat").alias("f_lat"), F.col("lng").alias("f_lng")),
                       radius_m, ["o"], ["loc_order", "f_lat", "f_lng"])
    pick = (reach.where(F.col("loc_order") <= F.col("o")).groupBy("o")
            .agg(F.min(F.struct("metres", "loc_order", "f_lat", "f_lng")).alias("b"))
            .select(F.col("o").alias(order), F.col("b.loc_order").alias("loc_order"),
                    F.col("b.f_lat").alias("loc_lat"), F.col("b.f_lng").alias("loc_lng")))
    return points.join(pick, order, "left")
