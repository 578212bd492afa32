"""Ordered steps over long groups, cut into chunks that run in parallel.

A window over a whole camera puts its entire history into one task. Here the window
covers one (group, chunk), and what crosses a chunk border is carried by a table with
one row per chunk, which is small enough for an ordinary window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_previous(df: DataFrame, keys: list[str], chunk: str, order: list[str],
                  values: dict[str, str]) -> DataFrame:
    """Add the previous row's columns: values maps source column -> new column.

    `chunk` must never decrease along `order` within a group.
    """
    group = keys + [chunk]
    payload = F.struct(*[F.col(c) for c in values])
    inside = F.lag(payload).over(W.partitionBy(*group).orderBy(*order))
    tails = df.groupBy(*group).agg(F.max_by(payload, F.struct(*order)).alias("_tail"))
    carried = tails.select(*group, F.lag("_tail").over(
        W.partitionBy(*keys).orderBy(chunk)).alias("_carried"))
    prev = F.coalesce(F.col("_inside"), F.col("_carried"))
    return (df.withColumn("_inside", inside).join(carried, group)
            .withColumn("_prev", prev)
            .select(*df.columns, *[F.col(f"_prev.{c}").alias(n) for c, n in values.items()]))


def with_running_sum(df: DataFrame, keys: list[str], chunk: str, order: list[str],
                     value: str, name: str) -> DataFrame:
    """Add the running sum of a column along `order`, first row included."""
    group = keys + [chunk]
    totals = df.groupBy(*group).agg(F.sum(value).alias("_t"))
    before = totals.select(*group, F.coalesce(F.sum("_t").over(
        W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)),
        F.lit(0)).alias("_before"))
    inside = F.sum(value).over(W.partitionBy(*group).orderBy(*order)
                               .rowsBetween(W.unboundedPreceding, 0))
    return (df.withColumn("_inside", inside).join(before, group)
            .withColumn(name, F.col("_before") + F.col("_inside")).drop("_inside", "_before"))


def day_chunk(ts: Column) -> Column:
    return F.to_date(ts)
