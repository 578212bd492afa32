"""What the sit journal can and cannot say about the ratings and forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldlens.constants import MIN_PER_BUCKET, MIN_SITS, RATING_ORDER
from fieldlens.functions.compass import point_index, points_apart
from fieldlens.functions.num import half_up, half_up_to


def rating_rank(rating: Column) -> Column:
    pos = F.array_position(F.array(*map(F.lit, RATING_ORDER)), F.lower(rating))
    return F.when(pos > 0, (pos - 1).cast("int"))


def usable(sits: DataFrame) -> DataFrame:
    """Sits with a known rating and a counted number of animals."""
    return sits.withColumn("x", rating_rank(F.col("rating"))).where(
        F.col("x").isNotNull() & F.col("deer").isNotNull())


def contingency(sits: DataFrame) -> DataFrame:
    """How often each (rating rank, count) pair occurs: rank statistics need no more."""
    return usable(sits).groupBy("x", F.col("deer").alias("y")).agg(F.count("*").alias("m"))


def _mid_ranks(table: DataFrame, col: str) -> DataFrame:
    """Average rank of each distinct value; ties share the middle of their run."""
    margin = table.groupBy(col).agg(F.sum("m").alias("k"))
    below = F.coalesce(F.sum("k").over(W.orderBy(col).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return margin.select(col, (below + (F.col("k") + 1) / 2.0).alias(f"r{col}"))


def spearman(table: DataFrame) -> DataFrame:
    """rho over a contingency table (x, y, m): one row {n, rho}, null without variation."""
    t = table.join(_mid_ranks(table, "x"), "x").join(_mid_ranks(table, "y"), "y")
    m, a, b = F.col("m"), F.col("rx"), F.col("ry")
    s = t.agg(F.sum("m").alias("n"), F.sum(m * a).alias("sa"), F.sum(m * b).alias("sb"),
              F.sum(m * a * a).alias("saa"), F.sum(m * b * b).alias("sbb"), F.sum(m * a * b).alias("sab"))
    n = F.col("n")
    dx = F.col("saa") - F.col("sa") * F.col("sa") / n
    dy = F.col("sbb") - F.col("sb") * F.col("sb") / n
    num = F.col("sab") - F.col("sa") * F.col("sb") / n
    return s.select("n", F.when((n >= 3) & (dx > 0) & (dy > 0), num / F.sqrt(dx * dy)).alias("rho"))


def rating_means(sits: DataFrame) -> DataFrame:
    return (usable(sits).groupBy("x", F.lower("rating").alias("rating"))
            .agg(F.count("*").alias("sits"), half_up_to(F.avg("deer"), 2).alias("deer_per_sit")))


def calibration(sits: DataFrame, p_values: DataFrame | None = None) -> DataFrame:
    """One row: sizes, rho and the verdict; refuses on thin or one-class journals.

    p_values is an optional one-row frame {p} from the permutation test.
    """
    table = contingency(sits)
    by = table.groupBy("x").agg(F.sum("m").alias("sits"))
    sizes = by.agg(F.coalesce(F.sum("sits"), F.lit(0)).alias("usable"), F.count("*").alias("ratings"),
                   F.count_if(F.col("sits") >= MIN_PER_BUCKET).alias("spread"))
    total = sits.agg(F.count("*").alias("sits"), F.count_if(F.col("deer").isNull()).alias("uncounted"))
    out = total.join(F.broadcast(sizes)).join(F.broadcast(spearman(table).select("rho")))
    out = out.join(F.broadcast(p_values.select("p"))) if p_values is not None else out.withColumn(
        "p", F.lit(None).cast("double"))
    refused = (F.when(F.col("usable") < MIN_SITS, "not enough sits")
               .when(F.col("spread") < 2, "no comparison group")
               .when(F.col("rho").isNull(), "no variation"))
    size = F.abs("rho")
    strength = (F.when(size < 0.2, "no relationship worth acting on")
                .when(size < 0.4, "a weak relationship").when(size < 0.6, "a moderate relationship")
                .otherwise("a strong relationship"))
    verdict = F.coalesce(refused, F.when(F.col("p").isNull(), "not tested")
                         .when(F.col("p") <= 0.05, strength)
                         .otherwise("not distinguishable from chance"))
    keep = refused.isNull()
    return out.select("sits", "usable", "uncounted", "ratings", "spread",
                      F.when(keep, half_up_to(F.col("rho"), 2)).alias("rho"),
                      F.when(keep, half_up_to(F.col("p"), 4)).alias("p"), verdict.alias("verdict"))


def wind_accuracy(sits: DataFrame, within_points: int = 1) -> DataFrame:
    """sits(predicted_wind, wind_from): share named exactly and within some points."""
    rows = sits.where(F.col("predicted_wind").isNotNull() & F.col("wind_from").isNotNull())
    gap = points_apart(F.col("predicted_wind"), F.col("wind_from"))
    agg = rows.agg(F.count("*").alias("sits"), F.count(gap).alias("scored"),
                   F.count_if(gap == 0).alias("e"), F.count_if(gap <= within_points).alias("c"))
    scored = F.col("scored")
    return agg.select("sits", "scored", (F.col("sits") - scored).alias("skipped"),
                      F.when(scored > 0, half_up(100.0 * F.col("e") / scored)).alias("exact"),
                      F.when(scored > 0, half_up(100.0 * F.col("c") / scored)).alias("close"))


def stand_performance(sits: DataFrame, min_sits: int = 4) -> DataFrame:
    """Per stand, the sits without a stand being a group of their own."""
    counted = F.count("deer")
    return sits.groupBy("stand_id").agg(
        F.count("*").alias("sits"), counted.alias("counted"),
        (F.count("*") - counted).alias("uncounted"), F.sum("deer").alias("deer"),
        F.when(counted > 0, half_up_to(F.avg("deer"), 2)).alias("deer_per_sit"),
        F.coalesce(F.sum("bucks"), F.lit(0)).alias("bucks"), (counted >= min_sits).alias("enough"))


def summary(sits: DataFrame) -> DataFrame:
    """Journal totals; a sit's hours count only between 0 and 24."""
    h = (F.unix_micros("ended_at") - F.unix_micros("started_at")) / 3_600_000_000
    hours = F.coalesce(F.sum(F.when((h > 0) & (h < 24), h)), F.lit(0.0))
    counted, deer = F.count("deer"), F.sum("deer")
    return sits.agg(
        F.count("*").alias("sits"), counted.alias("counted"),
        (F.count("*") - counted).alias("uncounted"), half_up_to(hours, 1).alias("hours"),
        deer.alias("deer"), F.when(counted > 0, half_up_to(F.avg("deer"), 2)).alias("deer_per_sit"),
        F.when((hours > 0) & (counted > 0), half_up_to(deer / hours, 2)).alias("deer_per_hour"),
        F.coalesce(F.sum("bucks"), F.lit(0)).alias("bucks"), F.count_if("shot").alias("shots"),
        F.count_if("harvested").alias("harvests"), F.count_if(F.col("deer") == 0).alias("blank_sits"))
