"""Movement rates from telemetry, controlled for the hour of day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.functions.num import half_up_to
from fieldlens.operators.orderstat import order_statistic


def base_rate(records: DataFrame) -> DataFrame:
    return order_statistic(records, [], "rate", 0.5, "base")


def by_hour(records: DataFrame, sex: str | None = None) -> DataFrame:
    """24 rows: count and median rate relative to the overall median."""
    use = records if sex is None else records.where(F.col("sex") == sex)
    base = base_rate(use).select("base")
    hourly = order_statistic(use, ["hour"], "rate", 0.5, "median", few=True)
    spine = base.withColumn("hour", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(23).cast("bigint"))))
    return (spine.join(hourly, "hour", "left").na.fill(0, ["n"])
            .select("hour", "n", F.when(F.col("base") != 0, half_up_to(
                F.col("median") / F.col("base"), 2)).alias("ratio"), "base"))


def bucket_of(value: Column, edges: list[float]) -> Column:
    """Index of the half-open bucket [lo, hi) holding a value, null outside all."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        out = F.when((value >= edges[i]) & (value < edges[i + 1]), i).otherwise(out)
    return out


def by_bucket(records: DataFrame, value: Column, edges: list[float],
              control_for_hour: bool = True) -> DataFrame:
    """Per bucket: count, median and mean of the rate divided by its hour's median.

    Every bucket is a row. Rates in an hour without a usable median are left out.
    """
    rows = records.withColumn("_bucket_value", value.cast("double"))
    if control_for_hour:
        hourly = order_statistic(records, ["hour"], "rate", 0.5, "base", few=True).select("hour", "base")
        rows = rows.join(F.broadcast(hourly), "hour")      # 24 rows
    else:
        rows = rows.join(F.broadcast(base_rate(records).select("base")))
    rows = (rows.withColumn("norm", F.when(F.col("base") != 0, F.col("rate") / F.col("base")))
            .withColumn("bucket", bucket_of(F.col("_bucket_value"), edges))
            .where(F.col("norm").isNotNull() & F.col("bucket").isNotNull()))
    med = order_statistic(rows, ["bucket"], "norm", 0.5, "median", few=True).select("bucket", "median")
    agg = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("norm").alias("mean"))
    bounds = F.array(*[F.struct(F.lit(i).alias("bucket"), F.lit(float(edges[i])).alias("lo"),
                                F.lit(float(edges[i + 1])).alias("hi")) for i in range(len(edges) - 1)])
    spine = records.sparkSession.range(1).select(F.explode(bounds).alias("b")).select("b.*")
    return (spine.join(agg, "bucket", "left").join(med, "bucket", "left").na.fill(0, ["n"])
            .select("lo", "hi", "n", half_up_to(F.col("median"), 2).alias("ratio"),
                    half_up_to(F.col("mean"), 2).alias("mean")))


def study_extent(records: DataFrame) -> DataFrame:
    """Rounded centre of the fixes and the dates they span."""
    both = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    return records.agg(half_up_to(F.avg(F.when(both, F.col("lat"))), 1).alias("lat"),
                       half_up_to(F.avg(F.when(both, F.col("lng"))), 1).alias("lng"),
                       F.count_if(both).alias("n"), F.to_date(F.min("at")).alias("from_day"),
                       F.to_date(F.max("at")).alias("to_day"))
