"""Elevation grids: packed arrays to cells, and which grid covers a place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.operators.spatial import points_in_boxes

M_PER_DEG_LAT = 110540.0                   # fixed value of the grid planner
M_PER_DEG_LNG = 111320.0                   # fixed value, times the cosine of latitude


def plan_grids(bounds: DataFrame) -> DataFrame:
    """Rows and columns for boxes (west, south, east, north, spacing_m); row 0 is the south edge."""
    mid = F.radians((F.col("north") + F.col("south")) / 2)
    d_lat = F.col("spacing_m") / M_PER_DEG_LAT
    d_lng = F.col("spacing_m") / (M_PER_DEG_LNG * F.cos(mid))
    rows = F.greatest(F.lit(2), F.floor((F.col("north") - F.col("south")) / d_lat + 0.5) + 1)
    cols = F.greatest(F.lit(2), F.floor((F.col("east") - F.col("west")) / d_lng + 0.5) + 1)
    sane = (F.col("east") > F.col("west")) & (F.col("north") > F.col("south")) & (F.col("spacing_m") > 0)
    return bounds.where(sane).withColumns({"d_lat": d_lat, "d_lng": d_lng, "rows": rows, "cols": cols})


def parse_elevation(text):
    """A service's answer to metres; blanks and impossible heights are no data."""
    v = text.try_cast("double")
    return F.when(v.between(-500, 9000), v)


def explode_grids(grids: DataFrame) -> DataFrame:
    """grids(grid_id, cols, z array) -> one row per cell; NaN becomes null."""
    cell = grids.select("grid_id", "cols", F.posexplode("z").alias("pos", "z"))
    return cell.select("grid_id", (F.col("pos") % F.col("cols")).cast("int").alias("c"),
                       F.floor(F.col("pos") / F.col("cols")).cast("int").alias("r"),
                       F.when(~F.isnan("z"), F.col("z")).alias("z"))


def pack_rows(cells: DataFrame, grids: DataFrame) -> DataFrame:
    """Cells to one array per grid row: (grid_id, r, z), a null for every cell that is absent.

    grids(grid_id, cols, rows) says how large a grid is, so absent columns and rows at its edges
    are there too. An array is as long as its grid is wide; a grid of any size is spread over its rows.
    """
    spine = (grids.select("grid_id", "cols", F.explode(F.sequence(F.lit(0), F.col("rows").cast("int") - 1)).alias("r"))
             .select("grid_id", "r", F.explode(F.sequence(F.lit(0), F.col("cols").cast("int") - 1)).alias("c")))
    full = spine.join(cells.select("grid_id", "r", "c", "z"), ["grid_id", "r", "c"], "left")
    return full.groupBy("grid_id", "r").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("c", "z"))), lambda x: x["z"]).alias("z"))


def explode_rows(rows: DataFrame) -> DataFrame:
    """Packed rows back to one row per cell."""
    return rows.select("grid_id", "r", F.posexplode("z").alias("c", "z"))


def grid_bounds(grids: DataFrame) -> DataFrame:
    return grids.withColumns({"east": F.col("west") + (F.col("cols") - 1) * F.col("d_lng"),
                              "north": F.col("south") + (F.col("rows") - 1) * F.col("d_lat")})


def finest_grid_at(points: DataFrame, boxes: DataFrame, step: float = 0.05) -> DataFrame:
    """The finest grid whose box holds each point. Equal boxes and equal points are reduced first."""
    best = boxes.groupBy("west", "south", "east", "north").agg(F.min(F.struct("spacing_m", "grid_id")).alias("g"))
    spots = points.select("lat", "lng").distinct().withColumns({"p_lat": F.col("lat"), "p_lng": F.col("lng")})
    pick = (points_in_boxes(spots, best, step).groupBy("p_lat", "p_lng").agg(F.min("g").alias("g"))
            .select(F.col("p_lat").alias("lat"), F.col("p_lng").alias("lng"), F.col("g.grid_id").alias("grid_id"),
                    F.col("g.spacing_m").alias("spacing_m")))
    return points.join(pick, ["lat", "lng"], "left")


def grid_covering(wanted: DataFrame, boxes: DataFrame, step: float = 0.05) -> DataFrame:
    """The finest stored grid, no coarser than asked, that covers each wanted box whole.

    Equal boxes and equal wishes are reduced first; a box keeps its finest grid only, which is no coarser
    than asked wherever any of its grids is. So pairs grow with the distinct places, not with the rows.
    """
    asked = ["west", "south", "east", "north", "spacing_m"]
    ask = wanted.where(F.col("west").isNotNull() & F.col("south").isNotNull()).select(
        F.col("west").alias("w1"), F.col("south").alias("s1"), F.col("east").alias("e1"), F.col("north").alias("n1"), F.col("spacing_m").alias("ask_m")
    ).distinct().withColumns({"lat": F.col("s1"), "lng": F.col("w1")})
    best = boxes.groupBy("west", "south", "east", "north").agg(F.min(F.struct("spacing_m", "grid_id")).alias("g"))
    held = points_in_boxes(ask, best, step).where(
        (F.col("east") >= F.col("e1")) & (F.col("north") >= F.col("n1")) & (F.col("g.spacing_m") <= F.col("ask_m")))
    pick = held.groupBy("w1", "s1", "e1", "n1", "ask_m").agg(F.min("g").alias("g")).select(
        F.col("w1").alias("west"), F.col("s1").alias("south"), F.col("e1").alias("east"), F.col("n1").alias("north"),
        F.col("ask_m").alias("spacing_m"), F.col("g.grid_id").alias("grid_id"))
    return wanted.join(pick, asked, "left").select(*wanted.columns, "grid_id")
