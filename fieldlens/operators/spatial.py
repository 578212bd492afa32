"""Joins in space, rewritten as equi joins on grid cells.

A distance join buckets one side into cells at least as wide as the radius and looks
each point of the other side up in the few cells its radius can reach, so Spark sees
an ordinary hash-partitioned equi join with a residual distance test. Cell width
follows latitude and wraps the antimeridian; no candidate is lost or seen twice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldlens.constants import HAVERSINE_RADIUS_M
from fieldlens.functions import geo

M_PER_DEGREE = HAVERSINE_RADIUS_M * math.pi / 180.0
HALF_EARTH_M = HAVERSINE_RADIUS_M * math.pi


def _band(lat: Column, radius_m: float) -> Column:
    return F.floor((lat + 90.0) / (radius_m / M_PER_DEGREE))


def _columns_in_band(band: Column, radius_m: float) -> Column:
    """How many equal longitude cells, each at least one radius wide, fit a band."""
    height = radius_m / M_PER_DEGREE
    far = F.greatest(F.abs(band * height - 90.0), F.abs((band + 1) * height - 90.0))
    width = F.lit(height) / F.greatest(F.cos(F.radians(F.least(far, F.lit(90.0)))), F.lit(1e-9))
    return F.greatest(F.lit(1), F.floor(360.0 / width)).cast("bigint")


def _cell(band: Column, column: Column) -> Column:
    return F.struct(band.cast("bigint").alias("b"), column.cast("bigint").alias("c"))


def home_cell(lat: Column, lng: Column, radius_m: float) -> Column:
    band = _band(lat, radius_m)
    n = _columns_in_band(band, radius_m)
    return _cell(band, F.pmod(F.floor((lng + 180.0) / 360.0 * n), n))


def reachable_cells(lat: Column, lng: Column, radius_m: float) -> Column:
    """Every cell a circle of the radius around a point can touch."""
    delta = radius_m / HAVERSINE_RADIUS_M
    reach = F.when(F.abs(F.radians(lat)) + delta >= math.pi / 2, F.lit(180.0)).otherwise(
        F.degrees(F.asin(F.least(F.lit(1.0), math.sin(min(delta, math.pi / 2)) / F.cos(F.radians(lat))))))
    reach = reach * (1 + 1e-9) + 1e-9
    band = _band(lat, radius_m)

    def row(b):
        n = _columns_in_band(b, radius_m)
        low = F.floor((lng - reach + 180.0) / 360.0 * n)
        high = F.least(F.floor((lng + reach + 180.0) / 360.0 * n), low + n - 1)
        return F.transform(F.sequence(low, high), lambda c: _cell(b, F.pmod(c, n)))

    return F.array_distinct(F.flatten(F.transform(F.sequence(band - 1, band + 1), row)))


def near_pairs(left: DataFrame, right: DataFrame, radius_m: float,
               keep_left: list[str], keep_right: list[str]) -> DataFrame:
    """Pairs within the radius. Inputs carry lat, lng; kept columns must not clash.

    The result is as large as the number of true pairs: reduce copies at equal
    coordinates first when only counts or the nearest are wanted. Spark's size check does not see
    that a row becomes one a cell, so the join is told to shuffle: no side goes whole to a task.
    """
    a = (left.select(*keep_left, F.col("lat").alias("l_lat"), F.col("lng").alias("l_lng"))
         .where(F.col("l_lat").isNotNull() & F.col("l_lng").isNotNull())
         .withColumn("cell", F.explode(reachable_cells(F.col("l_lat"), F.col("l_lng"), radius_m))))
    b = (right.select(*keep_right, F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"))
         .where(F.col("r_lat").isNotNull() & F.col("r_lng").isNotNull())
         .withColumn("cell", home_cell(F.col("r_lat"), F.col("r_lng"), radius_m)))
    metres = geo.haversine_m(F.col("l_lat"), F.col("l_lng"), F.col("r_lat"), F.col("r_lng"))
    return a.join(b.hint("merge"), "cell").drop("cell").withColumn("metres", metres).where(F.col("metres") <= radius_m)


def sites(points: DataFrame, key: str, *by: str) -> DataFrame:
    """Distinct coordinates with how many rows share them and the least key."""
    return points.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).groupBy(
        "lat", "lng", *by).agg(F.count("*").alias("at_site"), F.min(key).alias(key))


def nearest(left: DataFrame, right: DataFrame, key: str, candidate: str,
            radius_m: float) -> DataFrame:
    """Nearest right row within the radius; ties go to the lesser candidate key.

    Copies at one coordinate are reduced on both sides before pairing.
    """
    spots = left.select("lat", "lng").where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).distinct()
    best = (near_pairs(spots.withColumns({"s_lat": F.col("lat"), "s_lng": F.col("lng")}),
                       sites(right, candidate), radius_m, ["s_lat", "s_lng"], [candidate])
            .groupBy("s_lat", "s_lng").agg(F.min(F.struct("metres", candidate)).alias("m"))
            .select(F.col("s_lat").alias("lat"), F.col("s_lng").alias("lng"),
                    F.col(f"m.{candidate}").alias(candidate), F.col("m.metres").alias("metres")))
    return left.join(best, ["lat", "lng"], "left")


def k_nearest(left: DataFrame, right: DataFrame, candidate: str, k: int, radius_m: float,
              carry: list[str]) -> DataFrame:
    """The k nearest right rows within the radius of each distinct left coordinate.

    Ties go to the lesser key, so of the rows sharing one coordinate only the k least can
    matter; both sides shrink to that before pairing. Returns lat, lng, rank, metres, the
    candidate key and carried columns; join it to the left rows on lat, lng.
    """
    w = W.partitionBy("lat", "lng").orderBy(candidate)
    top = (right.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
           .withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= k))
    spots = left.select("lat", "lng").where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).distinct()
    pairs = near_pairs(spots.withColumns({"s_lat": F.col("lat"), "s_lng": F.col("lng")}), top, radius_m,
                       ["s_lat", "s_lng"], [candidate, *carry])
    rank = F.row_number().over(W.partitionBy("s_lat", "s_lng").orderBy("metres", candidate))
    return (pairs.withColumn("rank", rank).where(F.col("rank") <= k)
            .select(F.col("s_lat").alias("lat"), F.col("s_lng").alias("lng"), "rank", "metres",
                    candidate, *carry))


def nearby_summary(left: DataFrame, right: DataFrame, candidate: str, radius_m: float) -> DataFrame:
    """Per left row: how many right rows lie within the radius, and the nearest of them."""
    spots = left.select("lat", "lng").where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).distinct()
    pairs = near_pairs(spots.withColumns({"s_lat": F.col("lat"), "s_lng": F.col("lng")}),
                       sites(right, candidate), radius_m, ["s_lat", "s_lng"], [candidate, "at_site"])
    agg = (pairs.groupBy("s_lat", "s_lng")
           .agg(F.sum("at_site").alias("nearby"), F.min(F.struct("metres", candidate)).alias("m"))
           .select(F.col("s_lat").alias("lat"), F.col("s_lng").alias("lng"), "nearby",
                   F.col(f"m.{candidate}").alias(candidate), F.col("m.metres").alias("metres")))
    return left.join(agg, ["lat", "lng"], "left").na.fill(0, ["nearby"])


def nearest_any(left: DataFrame, right: DataFrame, candidate: str,
                start_radius_m: float = 2000.0) -> DataFrame:
    """Nearest right row at any distance: widen the radius only for unresolved spots."""
    from fieldlens.session import cut_lineage

    spots = cut_lineage(left.select("lat", "lng").where(
        F.col("lat").isNotNull() & F.col("lng").isNotNull()).distinct())
    target = cut_lineage(sites(right, candidate))
    radius, found = start_radius_m, None
    while True:
        step = cut_lineage(nearest(spots, target, candidate, candidate, radius))
        done = step.where(F.col(candidate).isNotNull())
        found = done if found is None else found.unionByName(done)
        spots = step.where(F.col(candidate).isNull()).select("lat", "lng")
        if radius >= HALF_EARTH_M or spots.isEmpty():
            break
        radius = min(radius * 8, HALF_EARTH_M)
    return left.join(found, ["lat", "lng"], "left")


# ---- counts in a circle -----------------------------------------------------------------

#: Cells across a radius, and levels of a row's pyramid: a cell of level k is 2^k columns wide.
ACROSS, LEVELS = 16, 5


def _runs(first: Column, last: Column, n: Column) -> Column:
    """Columns first to last of a row of n that closes on itself, as one or two runs (a, b) inside it."""
    size = F.least(last - first + 1, n)
    a = F.pmod(first, n)
    run = lambda x, y: F.struct(x.cast("long").alias("a"), y.cast("long").alias("b"))
    return (F.when(size <= 0, F.array().cast("array<struct<a:bigint,b:bigint>>")).when(a + size <= n, F.array(run(a, a + size - 1)))
            .otherwise(F.array(run(a, n - 1), run(F.lit(0), a + size - 1 - n))))


def _dyadic(a: Column, b: Column) -> Column:
    """Pyramid cells (level, i) that make up columns a to b, a few a level: what the next level leaves at either end."""
    none = F.array().cast("array<struct<level:int,i:bigint>>")
    ends = [(F.floor((a + (1 << k) - 1) / (1 << k)), F.floor((b + 1) / (1 << k))) for k in range(LEVELS + 1)]

    def cells(k, x, y):
        return F.when(x < y, F.transform(F.sequence(x, y - 1), lambda i: F.struct(F.lit(k).alias("level"), i.cast("long").alias("i")))).otherwise(none)
    out = [cells(LEVELS, *ends[LEVELS])]
    for k in range(LEVELS):
        (low, high), (up, down) = ends[k], ends[k + 1]
        out.append(F.when(up < down, F.concat(cells(k, low, 2 * up), cells(k, 2 * down, high))).otherwise(cells(k, low, high)))
    return F.concat(*out)


def counts_within(spots: DataFrame, points: DataFrame, radius_m: float, weight: str, by: list[str]) -> DataFrame:
    """(lat, lng, *by, n): how much weight of points(lat, lng, weight, *by) lies within the radius of each of spots(lat, lng).

    The globe is cut into rows of cells about a sixteenth of the radius high. In each row a circle
    holds a run of whole cells, whose counts come from the row's pyramid, a few rows a run however many
    points they hold; only points of the cells its line crosses are measured one by one. The distance to a cell is
    greatest at a corner, which says what is whole. Spots with nothing near give no row.
    """
    step = radius_m / ACROSS
    height, reach = step / M_PER_DEGREE, radius_m / HAVERSINE_RADIUS_M
    slack = 1e-9                                           # degrees of longitude: far above rounding
    lat, lng = F.col("lat"), F.col("lng")
    band = _band(lat, step)
    held = points.where(lat.isNotNull() & lng.isNotNull()).withColumn("band", band.cast("long"))
    held = held.withColumn("col", F.pmod(F.floor((lng + 180.0) / 360.0 * _columns_in_band(F.col("band"), step)), _columns_in_band(F.col("band"), step)).cast("long"))
    pyramid = (held.select(*by, "band", "col", weight, F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level"))
               .groupBy(*by, "band", "level", F.expr("shiftright(col, level)").alias("i")).agg(F.sum(weight).alias("w")))

    rows = spots.select("lat", "lng").where(lat.isNotNull() & lng.isNotNull()).distinct()
    tall = math.degrees(reach) * (1 + 1e-9) + 1e-12
    rows = rows.withColumn("band", F.explode(F.sequence(F.floor((F.greatest(lat - tall, F.lit(-90.0)) + 90.0) / height), F.floor((F.least(lat + tall, F.lit(90.0)) + 90.0) / height))))
    p, low, high = F.radians("lat"), F.radians(F.greatest(F.col("band") * height - 90.0, F.lit(-90.0))), F.radians(F.least((F.col("band") + 1) * height - 90.0, F.lit(90.0)))

    def half_width(edge: Column) -> Column:
        """Degrees of longitude to either side at which a parallel meets the circle; null where it does not."""
        room = math.sin(reach / 2) ** 2 - F.pow(F.sin((edge - p) / 2), 2)
        s = room / F.greatest(F.cos(p) * F.cos(edge), F.lit(1e-15))
        return F.when(room >= 0, F.when(s >= 1, 180.0).otherwise(2 * F.degrees(F.asin(F.sqrt(F.least(s, F.lit(1.0)))))))
    pole = F.abs(p) + reach >= math.pi / 2 - 1e-9
    widest = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(p) / math.cos(reach))))
    bulge = F.degrees(F.asin(F.least(F.lit(1.0), math.sin(reach) / F.greatest(F.cos(p), F.lit(1e-15)))))
    rows = rows.withColumns({"n": _columns_in_band(F.col("band"), step), "w0": half_width(low), "w1": half_width(high)}).withColumns({
        "out": F.when(pole, 180.0).otherwise(F.greatest(F.coalesce("w0", F.lit(0.0)), F.coalesce("w1", F.lit(0.0)), F.when(
            (widest >= low - 1e-9) & (widest <= high + 1e-9), bulge).otherwise(0.0))) + slack,
        "ins": F.when(~pole, F.least(F.when(F.col("w0").isNotNull(), F.col("w1")), F.col("w0")) - slack)})
    at = lambda x: (x + 180.0) / 360.0 * F.col("n")
    rows = rows.withColumns({"o1": F.floor(at(lng - F.col("out"))), "o2": F.floor(at(lng + F.col("out"))),
                             "i1": F.ceil(at(lng - F.col("ins"))), "i2": F.floor(at(lng + F.col("ins"))) - 1})
    # outside and inside runs of a row narrower than its circle; else all its columns are measured
    whole = F.col("ins").isNotNull() & (F.col("w0").isNotNull() & F.col("w1").isNotNull()) & (F.col("i1") <= F.col("i2")) & (F.col("o2") - F.col("o1") + 1 <= F.col("n"))
    rows = rows.withColumn("whole", whole)
    inside = rows.where("whole").select("lat", "lng", "band", F.explode(_runs(F.col("i1"), F.col("i2"), F.col("n"))).alias("r"))
    inside = inside.select("lat", "lng", "band", F.explode(_dyadic(F.col("r.a"), F.col("r.b"))).alias("c")).select("lat", "lng", "band", "c.level", "c.i")
    summed = inside.join(pyramid, ["band", "level", "i"]).groupBy("lat", "lng", *by).agg(F.sum("w").alias("n"))
    line = F.when(F.col("whole"), F.concat(_runs(F.col("o1"), F.col("i1") - 1, F.col("n")), _runs(F.col("i2") + 1, F.col("o2"), F.col("n")))).otherwise(
        _runs(F.col("o1"), F.col("o2"), F.col("n")))
    line = rows.select("lat", "lng", "band", F.explode(line).alias("r")).select("lat", "lng", "band", F.explode(F.sequence("r.a", "r.b")).alias("col"))
    near = line.join(held.select(*by, "band", "col", F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), F.col(weight).alias("_w")), ["band", "col"])
    near = near.where(geo.haversine_m(lat, lng, F.col("_lat"), F.col("_lng")) <= radius_m)
    measured = near.groupBy("lat", "lng", *by).agg(F.sum("_w").alias("n"))
    return summed.unionByName(measured).groupBy("lat", "lng", *by).agg(F.sum("n").alias("n"))


# ---- boxes and polygons -------------------------------------------------------------

def box_cells(west: Column, south: Column, east: Column, north: Column, step: float) -> Column:
    xs = F.sequence(F.floor(west / step), F.floor(east / step))
    ys = F.sequence(F.floor(south / step), F.floor(north / step))
    return F.flatten(F.transform(xs, lambda x: F.transform(
        ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def point_box_cell(lat: Column, lng: Column, step: float) -> Column:
    return F.struct(F.floor(lng / step).alias("x"), F.floor(lat / step).alias("y"))


def points_in_boxes(points: DataFrame, boxes: DataFrame, step: float) -> DataFrame:
    """Points joined to every box (west, south, east, north) that holds them."""
    b = boxes.withColumn("cell", F.explode(box_cells(
        F.col("west"), F.col("south"), F.col("east"), F.col("north"), step)))
    p = points.withColumn("cell", point_box_cell(F.col("lat"), F.col("lng"), step))
    return p.join(b, "cell").drop("cell").where(
        F.col("lng").between(F.col("west"), F.col("east"))
        & F.col("lat").between(F.col("south"), F.col("north")))


#: Slack in degrees of a cell's borders: far above rounding, far below any cell.
CELL_SLACK = 1e-9


def _ring_corners(rings: Column) -> Column:
    """Every edge a-b of every ring with the corner before a and the one after b."""
    def of(ring):
        open_ = F.when((F.size(ring) > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1)), F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)
        n = F.size(open_)
        at = lambda i: F.element_at(open_, (F.pmod(i, n) + 1).cast("int"))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
            at(i - 1).alias("before"), at(i).alias("a"), at(i + 1).alias("b"), at(i + 2).alias("after"))))
    return F.flatten(F.filter(F.transform(rings, of), lambda x: x.isNotNull()))


def polygon_cells(polygons: DataFrame, step: float) -> DataFrame:
    """Cells that polygons(rings, ...) cover wholly or in part, each with what decides the points in it.

    One row a polygon and cell: its columns but rings, cell, near, flips, base. A point of the cell is
    inside if base, the near edges that lie east of it at its latitude, and the flips above it are
    odd together. near holds the edges that touch the cell; all others of its row of cells lie
    wholly to one side. Those to the east cross the latitude of a point once for every end above it,
    and ends cancel where two of them meet, so all that is left of them is base, the ends above
    the row, and flips, the ends where one meets a near edge. Corners are only compared, never
    computed with, so the answer is that of testing every edge. A cell no edge touches has neither
    and is there only if it is inside.
    """
    keys = [c for c in polygons.columns if c != "rings"]
    # a polygon is dealt to one task before it becomes many rows: no task holds what a file's reader saw, and nothing is grouped twice
    rows = polygons.select(F.monotonically_increasing_id().alias("_poly"), F.struct(*keys).alias("_row"), "rings").repartition("_poly")
    rows = rows.select("_poly", "_row", F.explode(_ring_corners(F.col("rings"))).alias("e"))
    low, high = F.least("e.a.lat", "e.b.lat"), F.greatest("e.a.lat", "e.b.lat")
    bands = F.sequence(F.floor((low - CELL_SLACK) / step), F.floor((high + CELL_SLACK) / step))
    rows = rows.select("_poly", "_row", "e", F.explode(bands).alias("y"))
    south, north = F.col("y") * step - CELL_SLACK, (F.col("y") + 1) * step + CELL_SLACK

    def reach(p, q):
        """Least and greatest longitude of the edge p-q inside the row of cells."""
        rise = q["lat"] - p["lat"]
        at = lambda lat: F.when(rise == 0, p["lng"]).otherwise(p["lng"] + (q["lng"] - p["lng"]) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (lat - p["lat"]) / rise)))
        one, other = F.when(rise == 0, p["lng"]).otherwise(at(south)), F.when(rise == 0, q["lng"]).otherwise(at(north))
        return F.floor((F.least(one, other) - CELL_SLACK) / step), F.floor((F.greatest(one, other) + CELL_SLACK) / step)
    in_row = lambda p: (p["lat"] >= south) & (p["lat"] <= north)
    e = F.col("e")
    first, last = reach(e["a"], e["b"])
    rows = rows.withColumns({"first": first, "last": last,
                             "from_a": F.when(in_row(e["a"]), reach(e["before"], e["a"])[0]),       # where the edge that meets a begins, if a lies in the row
                             "from_b": F.when(in_row(e["b"]), reach(e["b"], e["after"])[0]),
                             "above": (e["a"]["lat"] > north).cast("int") + (e["b"]["lat"] > north).cast("int")})
    rows = rows.withColumn("x", F.explode(F.sequence("first", "last")))
    x = F.col("x")
    flip = lambda end, start: F.when(start > x, e[end]["lat"])
    cells = rows.groupBy("_poly", "y", "x").agg(
        F.first("_row").alias("_row"), F.collect_list(F.struct(e["a"].alias("a"), e["b"].alias("b"))).alias("near"),
        F.flatten(F.collect_list(F.array_compact(F.array(flip("a", F.col("from_a")), flip("b", F.col("from_b")))))).alias("flips"),
        F.sum(F.when(F.col("first") == x, F.col("above")).otherwise(0)).alias("t"))
    eastward = W.partitionBy("_poly", "y").orderBy(F.desc("x"))
    cells = cells.withColumns({"base": F.coalesce(F.sum("t").over(eastward.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) % 2,
                               "next": F.lag("x").over(eastward)})
    border = cells.select("_row.*", F.struct(F.col("x"), F.col("y")).alias("cell"), "near", "flips", F.col("base").cast("int").alias("base"))
    none = F.lit(None)
    whole = (cells.where((F.col("next") > x + 1) & (F.col("base") == 1))
             .select("_row", "y", F.explode(F.sequence(x + 1, F.col("next") - 1)).alias("x"))
             .select("_row.*", F.struct(F.col("x"), F.col("y")).alias("cell"), none.cast(border.schema["near"].dataType).alias("near"),
                     none.cast("array<double>").alias("flips"), F.lit(1).alias("base")))
    return border.unionByName(whole)


def points_in_polygons(points: DataFrame, polygons: DataFrame, step: float) -> DataFrame:
    """Points joined to the polygons (`rings`) that contain them, even-odd rule; all columns but rings.

    A point meets the edges that touch its own cell only, and none in a cell that lies inside. The join is
    told to shuffle: no side goes whole to a task.
    """
    cells = polygon_cells(polygons, step)
    lat, lng = F.col("lat"), F.col("lng")
    east = lambda s: ((s["a"]["lat"] > lat) != (s["b"]["lat"] > lat)) & (
        lng < (s["b"]["lng"] - s["a"]["lng"]) * (lat - s["a"]["lat"]) / (s["b"]["lat"] - s["a"]["lat"]) + s["a"]["lng"])
    odd = F.col("base") + F.size(F.filter("near", east)) + F.size(F.filter("flips", lambda v: v > lat))
    inside = F.when(F.col("near").isNull(), True).otherwise(odd % 2 == 1)
    return (points.withColumn("cell", point_box_cell(lat, lng, step)).join(cells.hint("merge"), "cell").where(inside)
            .drop("cell", "near", "flips", "base"))
