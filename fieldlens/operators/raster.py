"""Terrain from elevation cells: cells(grid_id, c, r, z), row 0 at the south edge.

Neighbourhood work cuts grids into tiles of TILE x TILE cells. A tile also gets the cells
just outside its edge, a few per cent of all, so each cell crosses the shuffle about once,
meets its neighbours inside a tile and comes back from there with its own value. No grid is gathered in a task, so one huge grid spreads
like many small ones. `grids` carries west, south, d_lng, d_lat, cols, rows, spacing_m per grid_id.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldlens.constants import CONTOUR_STEPS_FT, FEET_PER_METRE
from fieldlens.functions.num import half_up, half_up_to, wrap360
from fieldlens.operators.iterate import accumulate_downstream, connected_components, local_stars
from fieldlens.operators.orderstat import nearest_rank, order_statistic
from fieldlens.session import cut_lineage

CELL = ["grid_id", "c", "r"]


TILE = 128


def tiled(cells: DataFrame, value: str, halo: int, names: list[str], work: Callable[[np.ndarray, dict], list[np.ndarray]],
          per_grid: DataFrame | None = None) -> DataFrame:
    """Each cell with its own value and the arrays `work` gives for its tile: (grid_id, c, r, value, *names as doubles).

    work gets a tile's values with `halo` cells around it, NaN where nothing is known, and a dict of
    the tile's west and south cell and the per_grid columns; it returns one TILE x TILE array a name.
    Cells come back from the tile they belong to, so they cross the shuffle once and are not joined again.
    """
    def reach(x: str) -> Column:
        return F.explode(F.array_distinct(F.array(*[F.floor((F.col(x) + d) / TILE).cast("int") for d in (-halo, 0, halo)])))

    own = cells.select("grid_id", F.col("c").cast("int").alias("c"), F.col("r").cast("int").alias("r"), F.col(value).cast("double").alias("v"))
    info = [] if per_grid is None else [n for n in per_grid.columns if n != "grid_id"]
    if per_grid is not None:
        own = own.join(per_grid, "grid_id")
    spread = own.withColumn("tc", reach("c")).withColumn("tr", reach("r"))
    grid_type = own.schema["grid_id"].dataType.simpleString()
    wide = TILE + 2 * halo

    def run(key, table):
        west, south = key[1].as_py() * TILE, key[2].as_py() * TILE
        z = np.full((wide, wide), np.nan)
        c, r, v = (table[n].to_numpy() for n in ("c", "r", "v"))
        z[r - south + halo, c - west + halo] = v
        made = work(z, {"west": west, "south": south} | {n: table[n][0].as_py() for n in info})
        home = (c >= west) & (c < west + TILE) & (r >= south) & (r < south + TILE)
        c, r = c[home], r[home]
        columns = [pa.array(m[r - south, c - west], pa.float64(), from_pandas=True) for m in (z[halo:halo + TILE, halo:halo + TILE], *made)]
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(r), table["grid_id"].type), pa.array(c), pa.array(r), *columns],
                                    ["grid_id", "c", "r", value, *names])
    return spread.groupBy("grid_id", "tc", "tr").applyInArrow(
        run, f"grid_id {grid_type}, c int, r int, {value} double" + "".join(f", {n} double" for n in names))


def neighbours(cells: DataFrame, pairs: list[tuple[int, int]], value: str = "z") -> DataFrame:
    """Each cell with the values at the given offsets, n0, n1 and so on; null where not known."""
    halo = max(max(abs(dc), abs(dr)) for dc, dr in pairs)

    def work(z: np.ndarray, at: dict) -> list[np.ndarray]:
        return [z[halo + dr:halo + dr + TILE, halo + dc:halo + dc + TILE] for dc, dr in pairs]
    return tiled(cells, value, halo, [f"n{i}" for i in range(len(pairs))], work)


# north-west, north, north-east, west, east, south-west, south, south-east
EIGHT = [(-1, 1), (0, 1), (1, 1), (-1, 0), (1, 0), (-1, -1), (0, -1), (1, -1)]


def _gradient(df: DataFrame, scale: Column | float = 1.0) -> DataFrame:
    n = [F.col(f"n{i}") for i in range(8)]
    run = F.col("spacing_m") * 8.0
    dx = ((n[2] + 2 * n[4] + n[7]) - (n[0] + 2 * n[3] + n[5])) * scale / run
    dy = ((n[0] + 2 * n[1] + n[2]) - (n[5] + 2 * n[6] + n[7])) * scale / run
    return df.withColumns({"dx": dx, "dy": dy})


def slope_aspect(cells: DataFrame, grids: DataFrame) -> DataFrame:
    """Horn slope and aspect in degrees; null at edges and holes, flat ground has no aspect."""
    around = neighbours(cells, EIGHT).join(grids.select("grid_id", "spacing_m"), "grid_id")
    g = _gradient(around).withColumn("rise", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    aspect = wrap360(F.degrees(F.atan2(-F.col("dx"), -F.col("dy"))) + 360.0)
    return g.select(*CELL, F.degrees(F.atan("rise")).alias("slope"), F.when(F.col("rise") >= 1e-9, aspect).alias("aspect"))


def slope_at(points: DataFrame, slopes: DataFrame, grids: DataFrame) -> DataFrame:
    """Slope and aspect of the cell nearest each point: points(grid_id, lat, lng)."""
    c = F.floor((F.col("lng") - F.col("west")) / F.col("d_lng") + 0.5).cast("int")
    r = F.floor((F.col("lat") - F.col("south")) / F.col("d_lat") + 0.5).cast("int")
    keyed = points.join(grids.select("grid_id", "west", "south", "d_lng", "d_lat"), "grid_id").withColumns({"c": c, "r": r})
    return keyed.join(slopes, CELL, "left").drop("west", "south", "d_lng", "d_lat", "c", "r")


def elevation_at(points: DataFrame, cells: DataFrame, grids: DataFrame) -> DataFrame:
    """Bilinear height of each point, null outside the grid or beside a hole."""
    fc = (F.col("lng") - F.col("west")) / F.col("d_lng")
    fr = (F.col("lat") - F.col("south")) / F.col("d_lat")
    keyed = (points.join(grids.select("grid_id", "west", "south", "d_lng", "d_lat"), "grid_id")
             .withColumns({"fc": fc, "fr": fr})
             .withColumns({"c": F.floor("fc").cast("int"), "r": F.floor("fr").cast("int")}))
    corners = neighbours(cells, [(0, 0), (1, 0), (0, 1), (1, 1)])
    tx, ty = F.col("fc") - F.col("c"), F.col("fr") - F.col("r")
    z = (F.col("n0") * (1 - tx) * (1 - ty) + F.col("n1") * tx * (1 - ty)
         + F.col("n2") * (1 - tx) * ty + F.col("n3") * tx * ty)
    return keyed.join(corners, CELL, "left").withColumn("elevation", z).select(*points.columns, "elevation")


def grid_stats(cells: DataFrame) -> DataFrame:
    """Per grid: count, extremes, mean, relief, 5th and 95th nearest-rank heights."""
    known = cells.where(F.col("z").isNotNull())
    base = known.groupBy("grid_id").agg(F.count("*").alias("count"), F.min("z").alias("min"), F.max("z").alias("max"),
                                        F.avg("z").alias("mean"))
    p5 = nearest_rank(known, ["grid_id"], "z", 0.05, "p5").drop("n")
    p95 = nearest_rank(known, ["grid_id"], "z", 0.95, "p95").drop("n")
    return (base.join(p5, "grid_id").join(p95, "grid_id")
            .withColumns({"relief": F.col("max") - F.col("min"), "typical_relief": F.col("p95") - F.col("p5")}))


def smoothed(cells: DataFrame) -> DataFrame:
    """Mean of the known cells of each 3x3 block; holes stay holes."""
    def work(z: np.ndarray, at: dict) -> list[np.ndarray]:
        parts = [z[1 + dr:1 + dr + TILE, 1 + dc:1 + dc + TILE] for dc, dr in EIGHT + [(0, 0)]]
        seen = sum((~np.isnan(p)).astype(float) for p in parts)
        with np.errstate(invalid="ignore"):
            return [sum(np.nan_to_num(p) for p in parts) / np.where(seen > 0, seen, np.nan)]
    return tiled(cells, "z", 1, ["mean"], work).select(*CELL, F.when(F.col("z").isNotNull(), F.col("mean")).alias("z"))


# ---- water --------------------------------------------------------------------------

# east, west, north, south, then the diagonals: the first steepest wins a tie
FLOW = [(1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1)]


def cell_id(c: Column, r: Column) -> Column:
    """One BIGINT per cell that sorts by row, then column."""
    return r.cast("bigint") * F.lit(1 << 32) + c.cast("bigint")


def flow_directions(cells: DataFrame, invert: bool = False) -> DataFrame:
    """Where each cell drains: the steepest lower neighbour of eight (ridges: invert)."""
    z = -F.col("z") if invert else F.col("z")
    known = cells.where(F.col("z").isNotNull()).select(*CELL, z.alias("z"))
    around = neighbours(known, FLOW)
    options = F.array(*[F.struct(
        ((F.col("z") - F.col(f"n{i}")) / (1.0 if i < 4 else math.sqrt(2))).alias("drop"), F.lit(-i).alias("first"),
        F.lit(dc).alias("dc"), F.lit(dr).alias("dr")) for i, (dc, dr) in enumerate(FLOW)])
    best = F.array_max(F.filter(options, lambda o: o["drop"] > 0))
    to = F.when(best.isNotNull(), cell_id(F.col("c") + best["dc"], F.col("r") + best["dr"]))
    return around.select(*CELL, cell_id(F.col("c"), F.col("r")).alias("id"), to.alias("next"))


def flow_accumulation(flow: DataFrame) -> DataFrame:
    """How many cells drain through each cell, itself included."""
    ones = flow.select("grid_id", "id", "next", F.lit(1).cast("bigint").alias("acc"))
    return flow.join(accumulate_downstream(ones, ["grid_id"], "acc", "sum"), ["grid_id", "id"])


def channel_cells(cells: DataFrame, grids: DataFrame, invert: bool = False, min_area: float = 0.01,
                  smooth: bool = True) -> DataFrame:
    """Channel cells with the path they belong to: (grid, c, r, id, next, acc, head, z).

    Paths start at channel heads in cell order and stop where an earlier path already
    runs. A cell therefore belongs to the least head upstream of it, which is a minimum
    carried down the flow. Along one path the accumulation only rises, so it gives the order.
    """
    work = smoothed(cells) if smooth else cells
    acc = flow_accumulation(flow_directions(work, invert))
    floor = F.greatest(F.lit(8.0), F.col("cols") * F.col("rows") * min_area)
    on = (acc.join(grids.select("grid_id", "cols", "rows"), "grid_id").where(F.col("acc") >= floor)
          .select("grid_id", "c", "r", "id", "next", "acc"))
    kept = on.select("grid_id", F.col("id").alias("next"), F.lit(True).alias("runs_on"))
    on = on.join(kept, ["grid_id", "next"], "left").withColumn(
        "next", F.when(F.col("runs_on"), F.col("next"))).drop("runs_on")
    fed = on.where(F.col("next").isNotNull()).select("grid_id", F.col("next").alias("id")).distinct()
    heads = on.join(fed, ["grid_id", "id"], "left_anti").select("grid_id", "id", F.col("id").alias("head"))
    big = F.lit((1 << 62)).cast("bigint")
    seeded = on.join(heads, ["grid_id", "id"], "left").withColumn("head", F.coalesce("head", big))
    owner = accumulate_downstream(seeded.select("grid_id", "id", "next", "head"), ["grid_id"], "head", "min")
    return on.join(owner, ["grid_id", "id"]).join(work, CELL)


def channels(cells: DataFrame, grids: DataFrame, invert: bool = False, min_area: float = 0.01,
             min_cells: int = 6, min_drop_ft: float = 1.0, smooth: bool = True) -> DataFrame:
    """Drainages (or ridges): one row per traced path with its length, drop and catchment.

    The cell where a path meets an earlier one closes it.
    """
    owned = cut_lineage(channel_cells(cells, grids, invert, min_area, smooth))
    ends = owned.select("grid_id", F.col("id").alias("next"), F.col("head").alias("next_head"),
                        F.col("z").alias("next_z"), F.col("acc").alias("next_acc"))
    tail = owned.join(ends, ["grid_id", "next"], "left").withColumn(
        "joins", F.col("next_head").isNotNull() & (F.col("next_head") != F.col("head")))
    last = F.max_by(F.struct("joins", "z", "acc", "next_z", "next_acc"), F.col("acc"))
    paths = tail.groupBy("grid_id", "head").agg(
        F.count("*").alias("n"), F.min_by("z", F.col("acc")).alias("first_z"), last.alias("e"))
    drop = F.abs(F.col("first_z") - F.when(F.col("e.joins"), F.col("e.next_z")).otherwise(F.col("e.z")))
    return (paths.withColumn("path_cells", F.col("n") + F.col("e.joins").cast("int")).withColumn("drop", drop)
            .where((F.col("path_cells") >= min_cells) & (F.col("drop") >= min_drop_ft / FEET_PER_METRE))
            .select("grid_id", "head", "path_cells", half_up_to(F.col("drop") * FEET_PER_METRE, 1).alias("drop_ft"),
                    F.when(F.col("e.joins"), F.col("e.next_acc")).otherwise(F.col("e.acc")).alias("drains")))


# ---- landforms ----------------------------------------------------------------------

#: Cells of a thinning tile each way.
SPACED_TILE = 512


def spaced(found: DataFrame, apart: int, tile: int = SPACED_TILE) -> DataFrame:
    """Greedy thinning in cell order: nothing kept lies within `apart` cells of an earlier kept one.

    Order is by row, then column, and distance the larger of the two offsets. A round settles
    what it can of every tile in that order, knowing its neighbours' cells near the border as far as they are
    settled; a cell waits only for earlier undecided ones beside it. What a round needs is the
    tiles that still wait, so rounds follow the tiles that a chain of dense candidates crosses.
    """
    near = apart - 1
    grid_type = found.schema["grid_id"].dataType.simpleString()
    state = cut_lineage(found.select("grid_id", F.col("c").cast("int").alias("c"), F.col("r").cast("int").alias("r"), F.lit(2).cast("byte").alias("s")).distinct())
    tile_of = lambda x, d=0: F.floor((F.col(x) + d) / tile).cast("int")
    reach = lambda x: F.explode(F.array_distinct(F.array(*[tile_of(x, d) for d in (-near, 0, near)])))

    def run(key, table):
        west, south = key[1].as_py() * tile, key[2].as_py() * tile
        c, r, s = (table[n].to_numpy() for n in ("c", "r", "s"))
        at = np.zeros((tile + 2 * near, tile + 2 * near), np.int8)
        y, x = r - south + near, c - west + near
        at[y, x] = s
        home = (c >= west) & (c < west + tile) & (r >= south) & (r < south + tile)
        todo = np.flatnonzero(home & (s == 2))
        for i in todo[np.lexsort((x[todo], y[todo]))].tolist():
            j, k = y[i], x[i]
            before = at[max(j - near, 0):j, max(k - near, 0):k + near + 1]
            beside = at[j, max(k - near, 0):k]
            if (before == 1).any() or (beside == 1).any():
                at[j, k] = 0
            elif not ((before == 2).any() or (beside == 2).any()):
                at[j, k] = 1
        c, r = c[home], r[home]
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(c), table["grid_id"].type), pa.array(c), pa.array(r),
                                     pa.array(at[r - south + near, c - west + near])], ["grid_id", "c", "r", "s"])
    settled = None
    while True:
        spread = state.withColumn("tc", reach("c")).withColumn("tr", reach("r"))
        state = cut_lineage(spread.groupBy("grid_id", "tc", "tr").applyInArrow(run, f"grid_id {grid_type}, c int, r int, s byte").where("s > 0"))
        waits = state.where("s = 2").select("grid_id", tile_of("c").alias("tc"), tile_of("r").alias("tr")).distinct()
        waits = cut_lineage(waits)
        if waits.isEmpty():
            break
        # settled cells whose tile and neighbours wait for nothing are done with
        around = waits.select("grid_id", F.explode(F.array(*[F.col("tc") + d for d in (-1, 0, 1)])).alias("tc"), "tr").select(
            "grid_id", "tc", F.explode(F.array(*[F.col("tr") + d for d in (-1, 0, 1)])).alias("tr")).distinct()
        placed = state.withColumns({"tc": tile_of("c"), "tr": tile_of("r")})
        done = placed.join(around, ["grid_id", "tc", "tr"], "left_anti").select("grid_id", "c", "r")
        settled = done if settled is None else settled.unionByName(done)
        state = placed.join(around, ["grid_id", "tc", "tr"], "left_semi").select("grid_id", "c", "r", "s")
    kept = state.select("grid_id", "c", "r")
    return found.join(kept if settled is None else kept.unionByName(settled), CELL, "left_semi")


def saddle_cells(cells: DataFrame, grids: DataFrame, radius: int = 3, min_relief_m: float = 1.5) -> DataFrame:
    """All cells with exactly two rising and two falling sectors around them."""
    ring = [(int(math.floor(math.cos(s / 16 * 2 * math.pi) * radius + 0.5)),
             int(math.floor(math.sin(s / 16 * 2 * math.pi) * radius + 0.5))) for s in range(16)]
    diff = F.array(*[F.col(f"n{i}") - F.col("z") for i in range(16)])
    inside = (F.col("c").between(F.lit(radius), F.col("cols") - radius - 1)
              & F.col("r").between(F.lit(radius), F.col("rows") - radius - 1))
    full = neighbours(cells, ring).where(F.col("z").isNotNull()).join(grids.select("grid_id", "cols", "rows"), "grid_id").where(inside)
    full = full.withColumn("d", diff).where(~F.exists("d", lambda x: x.isNull()))
    turns = sum(((F.col("d")[i] > 0) != (F.col("d")[(i + 1) % 16] > 0)).cast("int") for i in range(16))
    up, down = F.array_max("d"), -F.array_min("d")
    return full.where((up >= min_relief_m) & (down >= min_relief_m) & (turns == 4)).select(
        *CELL, half_up_to(F.least(up, down) * FEET_PER_METRE, 1).alias("relief_ft"))


def saddles(cells: DataFrame, grids: DataFrame, radius: int = 3, min_relief_m: float = 1.5) -> DataFrame:
    """Saddle cells, thinned: none within twice the radius of an earlier one."""
    return spaced(saddle_cells(cells, grids, radius, min_relief_m), radius * 2)


def bench_cells(slopes: DataFrame, grids: DataFrame, max_slope: float = 4.0, steep: float = 8.0,
                radius: int = 4, min_share: float = 0.35) -> DataFrame:
    """All flat cells with steep ground around them. A cell's window is counted, not collected."""
    def work(slope: np.ndarray, at: dict) -> list[np.ndarray]:
        out = []
        for a in (~np.isnan(slope), np.nan_to_num(slope, nan=-1.0) >= steep):   # sums over squares by running sums
            total = np.pad(np.cumsum(np.cumsum(a.astype(float), 0), 1), ((1, 0), (1, 0)))
            far, side = 2 * radius + 1, slice(0, TILE)
            out.append(total[far:far + TILE, far:far + TILE] - total[side, far:far + TILE] - total[far:far + TILE, side] + total[side, side])
        return [np.where(out[0] > 0, x, np.nan) for x in out]
    inside = (F.col("c").between(F.lit(radius), F.col("cols") - radius - 1)
              & F.col("r").between(F.lit(radius), F.col("rows") - radius - 1))
    return (tiled(slopes, "slope", radius, ["seen", "steep"], work).where(F.col("slope") <= max_slope)
            .join(grids.select("grid_id", "cols", "rows"), "grid_id").where(inside).where(F.col("steep") / F.col("seen") >= min_share)
            .select(*CELL, half_up_to(F.col("slope"), 1).alias("slope_deg"),
                    half_up(100.0 * F.col("steep") / F.col("seen")).alias("steep_around")))


def benches(slopes: DataFrame, grids: DataFrame, max_slope: float = 4.0, steep: float = 8.0,
            radius: int = 4, min_share: float = 0.35) -> DataFrame:
    """Bench cells, thinned: none within twice the radius of an earlier one."""
    return spaced(bench_cells(slopes, grids, max_slope, steep, radius, min_share), radius * 2)


def terrain_summary(cells: DataFrame, slopes: DataFrame) -> DataFrame:
    """Per grid: heights in feet, median and steepest slope, whether it is steep enough to read."""
    s = slopes.groupBy("grid_id").agg(F.max("slope").alias("max_slope"))
    mid = order_statistic(slopes, ["grid_id"], "slope", 0.5, "median_slope").drop("n")
    ft = FEET_PER_METRE
    heights = cells.groupBy("grid_id").agg(F.count("z").alias("count"), F.min("z").alias("lo"), F.max("z").alias("hi"))
    return heights.join(s, "grid_id", "left").join(mid, "grid_id", "left").select(
        "grid_id", (F.col("count") > 0).alias("covered"), half_up_to(F.col("lo") * ft, 1).alias("min_ft"),
        half_up_to(F.col("hi") * ft, 1).alias("max_ft"), half_up_to((F.col("hi") - F.col("lo")) * ft, 1).alias("relief_ft"),
        half_up_to(F.col("median_slope"), 1).alias("median_slope"), half_up_to(F.col("max_slope"), 1).alias("max_slope"),
        F.coalesce(F.col("max_slope") >= 8, F.lit(False)).alias("steep_enough"))


def hillshade(cells: DataFrame, grids: DataFrame, azimuth: float = 315.0, altitude: float = 45.0,
              z_factor: float | None = None) -> DataFrame:
    """0..255 shade per cell; edge cells borrow the gradient of the cell just inside."""
    def work(z: np.ndarray, at: dict) -> list[np.ndarray]:
        def shifted(dc: int, dr: int) -> np.ndarray:              # the tile and one cell around it
            return z[1 + dr:z.shape[0] - 1 + dr, 1 + dc:z.shape[1] - 1 + dc]
        nw, n, ne, w, e, sw, s, se = (shifted(*o) for o in EIGHT)
        gx, gy = (ne + 2 * e + se) - (nw + 2 * w + sw), (nw + 2 * n + ne) - (sw + 2 * s + se)
        c, r = at["west"] + np.arange(TILE), at["south"] + np.arange(TILE)
        c = np.clip(np.minimum(at["cols"] - 2, np.maximum(1, c)) - at["west"] + 1, 0, TILE + 1)
        r = np.clip(np.minimum(at["rows"] - 2, np.maximum(1, r)) - at["south"] + 1, 0, TILE + 1)
        return [g[np.ix_(r, c)] for g in (gx, gy)]
    stats = cells.groupBy("grid_id").agg((F.max("z") - F.min("z")).alias("relief"))
    auto = F.when(F.col("relief") > 0, F.greatest(F.lit(1.0), F.least(
        F.lit(60.0), 0.15 * (F.col("cols") - 1) * F.col("spacing_m") / F.col("relief")))).otherwise(1.0)
    zf = auto if z_factor is None else F.lit(float(z_factor))
    info = grids.select("grid_id", "cols", "rows", "spacing_m").join(stats, "grid_id").select("grid_id", "spacing_m", zf.alias("zf"))
    g = tiled(cells, "z", 2, ["gx", "gy"], work, grids.select("grid_id", "cols", "rows")).join(info, "grid_id")
    run = F.col("spacing_m") * 8.0
    g = g.withColumns({"dx": F.col("gx") * F.col("zf") / run, "dy": F.col("gy") * F.col("zf") / run})
    alt, az = math.radians(altitude), math.radians(azimuth)
    lx, ly, lz = math.sin(az) * math.cos(alt), math.cos(az) * math.cos(alt), math.sin(alt)
    v = (-F.col("dx") * lx - F.col("dy") * ly + lz) / F.sqrt(
        F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + 1.0)
    return g.select(*CELL, half_up(255.0 * F.when(v > 0, v).when(v.isNotNull(), 0.0)).alias("shade"))


# ---- contours -----------------------------------------------------------------------

def contour_steps(cells: DataFrame, target: int = 12, max_levels: int = 60) -> DataFrame:
    """Per grid the contour interval in feet, from its typical relief.

    An interval giving more than `max_levels` lines gives way to a coarser one; beyond the
    fixed steps the ladder goes on by 2, 5 and 10 hundreds, thousands and so on, never cut.
    """
    s = grid_stats(cells).where(F.col("relief") > 0)
    base = F.when(F.col("typical_relief") > 0, F.col("typical_relief")).otherwise(F.col("relief"))
    ideal = base * FEET_PER_METRE / target
    ladder = CONTOUR_STEPS_FT + [m * CONTOUR_STEPS_FT[-1] * 10 ** e for e in range(5) for m in (2, 5, 10)]
    steps = F.array(*[F.lit(x) for x in ladder])
    first = F.least(F.coalesce(F.get(F.filter(steps, lambda x: x >= ideal), F.lit(0)), F.lit(ladder[-1])), F.lit(CONTOUR_STEPS_FT[-1]))
    fits = F.filter(steps, lambda x: (x >= F.col("first")) & (F.ceil(F.col("relief") * FEET_PER_METRE / x) <= max_levels))
    return s.withColumn("first", first).select("grid_id", "min", "max", F.coalesce(
        F.get(fits, F.lit(0)), F.lit(ladder[-1])).alias("step_ft"))


def contour_segments(cells: DataFrame, steps: DataFrame) -> DataFrame:
    """Line pieces crossing each cell: (grid, level, cell, piece, ends in grid units).

    Only the levels between a cell's lowest and highest corner are tried for it.
    """
    corners = neighbours(cells, [(0, 0), (1, 0), (1, 1), (0, 1)]).where(
        F.col("n0").isNotNull() & F.col("n1").isNotNull() & F.col("n2").isNotNull() & F.col("n3").isNotNull())
    step = F.col("step_ft") / FEET_PER_METRE
    lo, hi = F.least("n0", "n1", "n2", "n3"), F.greatest("n0", "n1", "n2", "n3")
    first = F.ceil(F.col("min") / step)
    k0 = F.greatest(first, F.floor(lo / step))
    k1 = F.ceil(hi / step)
    lev = (corners.join(steps, "grid_id").where(k0 <= k1).withColumn("k", F.explode(F.sequence(k0, k1)))
           .withColumn("level", F.col("k") * step).where(F.col("level") <= F.col("max")))
    z = [F.col(f"n{i}") for i in range(4)]
    code = sum(((z[i] > F.col("level")).cast("int") * (1 << i) for i in range(1, 4)),
               (z[0] > F.col("level")).cast("int"))

    def cut(a, b):
        return (F.col("level") - a) / (b - a)

    c, r = F.col("c").cast("double"), F.col("r").cast("double")
    edge = {"S": F.struct((c + cut(z[0], z[1])).alias("x"), r.alias("y")),
            "E": F.struct((c + 1).alias("x"), (r + cut(z[1], z[2])).alias("y")),
            "N": F.struct((c + cut(z[3], z[2])).alias("x"), (r + 1).alias("y")),
            "W": F.struct(c.alias("x"), (r + cut(z[0], z[3])).alias("y"))}

    def piece(p):
        return F.struct(edge[p[0]].alias("a"), edge[p[1]].alias("b"))

    high = (z[0] + z[1] + z[2] + z[3]) / 4 > F.col("level")
    k = F.col("code")
    pieces = (F.when(k.isin(1, 14), F.array(piece("WS"))).when(k.isin(2, 13), F.array(piece("SE")))
              .when(k.isin(3, 12), F.array(piece("WE"))).when(k.isin(4, 11), F.array(piece("EN")))
              .when(k.isin(6, 9), F.array(piece("SN"))).when(k.isin(7, 8), F.array(piece("WN")))
              .when((k == 5) & high, F.array(piece("WN"), piece("SE")))
              .when(k == 5, F.array(piece("WS"), piece("EN")))
              .when(high, F.array(piece("WS"), piece("EN"))).otherwise(F.array(piece("WN"), piece("SE"))))
    return (lev.withColumn("code", code).where((k > 0) & (k < 15))
            .select("grid_id", "level", "c", "r", F.posexplode(pieces).alias("piece", "s"))
            .select("grid_id", "level", "c", "r", "piece", F.col("s.a").alias("a"), F.col("s.b").alias("b")))


#: Cells along a side of the tiles whose links are joined first.
CONTOUR_TILE = 64
#: More than a line has pieces.
CHOSEN = 1 << 50


def contour_lines(segments: DataFrame) -> DataFrame:
    """Pieces joined end to end: adds `line_id`, the `position` of a piece in its line from 1, and whether it runs from b to a there.

    Ends meet on seven decimals, two and two in cell order where more than two do. A line starts at the lesser
    of its open ends; a closed one is cut at its least end. Places come from ranking the chain of pieces in
    both directions by pointer doubling, so a line may be of any length.
    """
    def spot(p):
        return F.concat_ws("/", F.col("grid_id").cast("string"), F.format_string("%.7f", F.col("level")),
                           F.format_string("%.7f", p["x"]), F.format_string("%.7f", p["y"]))

    pid = F.concat_ws("/", F.col("grid_id").cast("string"), F.format_string("%.7f", F.col("level")), F.format_string("%09d", F.col("r").cast("long")),
                      F.format_string("%09d", F.col("c").cast("long")), F.col("piece").cast("string"))
    # n numbers the pieces of one written table, so joins and rounds carry longs; order among pieces is that of pid
    pieces = cut_lineage(segments.withColumns({"pid": pid, "ka": spot(F.col("a")), "kb": spot(F.col("b"))}).withColumn("n", F.monotonically_increasing_id()))
    tile = [F.floor(F.col(x) / CONTOUR_TILE).alias(f"tile_{x}") for x in ("c", "r")]
    ends = pieces.select("pid", "n", "grid_id", *tile, F.posexplode(F.array("ka", "kb")).alias("side", "key"))
    slot = F.floor((F.row_number().over(W.partitionBy("key").orderBy("pid", "side")) - 1) / 2)
    met = (ends.withColumn("slot", slot).groupBy("key", "slot").agg(F.sort_array(F.collect_list(F.struct("pid", "side", "n", "grid_id", "tile_c", "tile_r"))).alias("e")).where(F.size("e") == 2))
    links = cut_lineage(met.select("key", F.col("e")[0].alias("p"), F.col("e")[1].alias("q")))
    # links of a tile become stars at once; rounds are for lines that cross tiles
    stars = local_stars(links.select(F.col("p.grid_id"), F.col("p.tile_c"), F.col("p.tile_r"), F.col("p.n").alias("src"), F.col("q.n").alias("dst")), ["grid_id", "tile_c", "tile_r"])
    found = connected_components(pieces.select(F.col("n").alias("id")), stars)
    found = cut_lineage(found.select(F.col("id").alias("n"), "component").join(pieces.select("n", "pid"), "n"))
    names = cut_lineage(found.groupBy("component").agg(F.min("pid").alias("line_id"), F.count("*").alias("many")))
    linked = links.withColumn("n", F.col("p.n")).join(found.select("n", "component"), "n").drop("n")
    closed = linked.groupBy("component").agg(F.count("*").alias("m"), F.min("key").alias("cut")).join(names, "component").where("m = many")
    first = linked.join(closed.select("component", "cut"), "component").where(F.col("key") == F.col("cut")).groupBy("component").agg(
        F.min(F.struct("p", "q")).alias("x")).select(F.col("x.p.n").alias("n"), F.col("x.p.side").alias("side"))
    held = links.select(F.col("p.n").alias("n"), F.col("p.side").alias("side"), F.col("q.n").alias("qn"), F.col("q.side").alias("qside")).join(first, ["n", "side"], "left_anti")

    # an arc is a piece walked one way: 0 from a to b, 1 back; it goes on where the next piece is entered
    arc = lambda n, way: 2 * F.col(n) + way
    onward = held.select(F.explode(F.array(F.struct(arc("n", 1 - F.col("side")).alias("id"), arc("qn", F.col("qside")).alias("next")),
                                           F.struct(arc("qn", 1 - F.col("qside")).alias("id"), arc("n", F.col("side")).alias("next")))).alias("x")).select("x.*")
    onward = cut_lineage(onward)
    arcs = pieces.select("n", F.explode(F.array(F.lit(0), F.lit(1))).alias("way"))
    arcs = cut_lineage(arcs.select(arc("n", F.col("way")).alias("id")).join(onward, "id", "left"))
    starts = arcs.join(onward.select(F.col("next").alias("id")), "id", "left_anti").select("id", F.floor(F.col("id") / 2).alias("n"), (F.col("id") % 2).alias("way"))
    starts = starts.join(pieces.select("n", "ka", "kb"), "n").join(found, "n").select(
        "id", "component", F.when(F.col("way") == 0, F.col("ka")).otherwise(F.col("kb")).alias("from"), F.concat_ws("#", "pid", F.col("way").cast("string")).alias("arc"))
    chosen = starts.groupBy("component").agg(F.min_by("id", F.struct("from", "arc")).alias("id")).select("id", F.lit(CHOSEN).alias("s"))
    # one walk tells both: an arc has its place in its chain, and CHOSEN on top in the chain of a chosen start
    begun = arcs.join(chosen, "id", "left").select("id", "next", (F.coalesce("s", F.lit(0)) + 1).alias("position"))
    place = accumulate_downstream(begun, [], "position", "sum").where(F.col("position") > CHOSEN)
    place = place.select(F.floor(F.col("id") / 2).alias("n"), (F.col("position") - CHOSEN).alias("position"), (F.col("id") % 2 == 1).alias("turned"))
    lines = found.join(names.select("component", "line_id"), "component").select("n", "line_id")
    return pieces.join(lines, "n").join(place, "n").drop("n", "pid", "ka", "kb")


def line_summary(lines: DataFrame) -> DataFrame:
    size = F.sqrt((F.col("a.x") - F.col("b.x")) * (F.col("a.x") - F.col("b.x"))
                  + (F.col("a.y") - F.col("b.y")) * (F.col("a.y") - F.col("b.y")))
    return lines.withColumn("len", size).groupBy("grid_id", "level", "line_id").agg(
        F.count("*").alias("pieces"), F.sum("len").alias("cells_long"))


def undo_predictor(rows: DataFrame, bits: int) -> DataFrame:
    """Undo horizontal differencing: rows(row_id, values) -> running sums modulo 2^bits."""
    modulus = F.lit(1 << bits).cast("bigint")
    acc = F.aggregate("values", F.array().cast("array<bigint>"), lambda a, x: F.array_append(
        a, F.pmod(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("bigint")) + x, modulus)))
    return rows.withColumn("values", acc)
