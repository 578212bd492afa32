"""Wind climatology in the hours people sit, and how well stands cover it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.constants import COMPASS, SEASON_MONTHS, SIT_WINDOW_HOURS
from fieldlens.functions.compass import compass_point
from fieldlens.functions.num import half_up_to
from fieldlens.operators.orderstat import order_statistic


def sit_window(hour, sunrise_h, sunset_h):
    """AM / PM for a local hour near the sun, null otherwise; AM wins an overlap."""
    (_, a0, a1), (_, p0, p1) = SIT_WINDOW_HOURS["AM"], SIT_WINDOW_HOURS["PM"]
    return (F.when(hour.between(sunrise_h + a0, sunrise_h + a1), "AM")
            .when(hour.between(sunset_h + p0, sunset_h + p1), "PM"))


def window_hours(hourly: DataFrame, daily: DataFrame, months: list[int] = SEASON_MONTHS) -> DataFrame:
    """hourly(site, day, hour, wind_dir, wind_mph) kept where it falls in a sit window.

    daily(site, day, sunrise_h, sunset_h) in local hours; only the season's months count.
    """
    season = daily.where(F.month("day").isin(months) & F.col("sunrise_h").isNotNull()
                         & F.col("sunset_h").isNotNull())
    return (hourly.where(F.col("wind_dir").isNotNull()).join(season, ["site", "day"])
            .withColumn("window", sit_window(F.col("hour").cast("double"), F.col("sunrise_h"),
                                             F.col("sunset_h")))
            .where(F.col("window").isNotNull())
            .withColumn("point", compass_point(F.col("wind_dir"))))


def climatology(kept: DataFrame) -> DataFrame:
    """Percentage of window hours per point, for `all`, AM and PM, every point a row.

    One pass over grouping sets gives the pooled and the per-window tables together.
    """
    counts = (kept.groupBy("site", "point", "window").agg(F.count("*").alias("n")))
    pooled = (counts.rollup("site", "point", "window").agg(F.sum("n").alias("n"),
                                                           F.grouping_id().alias("g"))
              .where(F.col("g").isin(0, 1))
              .select("site", F.coalesce("window", F.lit("all")).alias("window"), "point", "n"))
    totals = pooled.groupBy("site", "window").agg(F.sum("n").alias("total"))
    spine = (kept.select("site").distinct()
             .withColumn("window", F.explode(F.array(*map(F.lit, ["all", "AM", "PM"]))))
             .withColumn("point", F.explode(F.array(*map(F.lit, COMPASS)))))
    return (spine.join(totals, ["site", "window"], "left").join(pooled, ["site", "window", "point"], "left")
            .na.fill(0, ["n"]).withColumn("pct", F.coalesce(half_up_to(
                100.0 * F.col("n") / F.col("total"), 1), F.lit(0.0)))
            .select("site", "window", "point", "n", "pct"))


def median_speed(kept: DataFrame) -> DataFrame:
    """Hours, and the upper median of the speeds in them, per site."""
    return order_statistic(kept, ["site"], "wind_mph", 0.5, "median_mph").withColumnRenamed("n", "hours")


def stand_coverage(stand_winds: DataFrame, clim: DataFrame) -> DataFrame:
    """stand_winds(site, stand_id, winds): summed season share of each stand's winds."""
    wide = clim.groupBy("site", "point").agg(*[
        F.max(F.when(F.col("window") == w, F.col("pct"))).alias(f"{w.lower()}_p") for w in ("all", "AM", "PM")])
    each = stand_winds.select("site", "stand_id", F.explode_outer(F.array_distinct("winds")).alias("point"))
    return (each.join(wide, ["site", "point"], "left").groupBy("site", "stand_id")
            .agg(*[half_up_to(F.sum(f"{w}_p"), 1).alias(n)
                   for w, n in (("all", "pct"), ("am", "am_pct"), ("pm", "pm_pct"))]))


def coverage_gaps(stand_winds: DataFrame, clim: DataFrame, top: int = 4) -> DataFrame:
    """The most frequent winds no stand covers: a top-k report per site."""
    from pyspark.sql import Window as W
    covered = stand_winds.select("site", F.explode("winds").alias("point")).distinct()
    order = {p: i for i, p in enumerate(COMPASS)}
    pos = F.create_map(*[F.lit(v) for kv in order.items() for v in kv])
    open_ = (clim.where((F.col("window") == "all") & (F.col("pct") > 0))
             .join(covered, ["site", "point"], "left_anti"))
    w = W.partitionBy("site").orderBy(F.col("pct").desc(), pos[F.col("point")])
    return (open_.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
            .select("site", "point", "pct", "rank"))


def season_covered(stand_winds: DataFrame, clim: DataFrame) -> DataFrame:
    covered = stand_winds.select("site", F.explode("winds").alias("point")).distinct()
    return (clim.where(F.col("window") == "all").join(covered, ["site", "point"])
            .groupBy("site").agg(half_up_to(F.sum("pct"), 1).alias("season_covered")))
