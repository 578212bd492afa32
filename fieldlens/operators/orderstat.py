"""Exact order statistics for groups of any size.

`percentile` keeps every distinct value of a group in one buffer, which a hot group cannot
afford. Here groups of at most ORDERED rows are ordered as they are. For larger ones a mergeable
sketch brackets the wanted rank and rows outside the bracket are only counted; what is left is
cut again and again into PARTS parts of about as many distinct values, the rows of every part are
counted exactly and only the part that holds the rank is kept, until at most ORDERED distinct
values are left to order. Sketches decide where to cut, never what to return: a rank that falls
outside the first bracket stops the job instead of giving a wrong value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldlens.session import cut_lineage

ACCURACY = 10000
#: Values of a group that one task orders at most.
ORDERED = 20_000
#: Parts a group's values are cut into in a round.
PARTS = 64


def _met(rows: DataFrame, told: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """rows with their key's row of told. Without keys it is one row; `few` keys may go to all tasks."""
    if not keys:
        return rows.join(F.broadcast(told))
    return rows.join(F.broadcast(told) if few else told, keys)


def _bracketed(rows: DataFrame, keys: list[str], q: float, few: bool) -> DataFrame:
    """(keys, n, _v, _m, _below): the values near rank q with how many rows have them, and how many rows lie below the bracket."""
    margin = 20.0 / ACCURACY
    low, high = max(0.0, q - margin), min(1.0, q + margin)
    sketch = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.approx_percentile("_v", F.array(F.lit(low), F.lit(high)), F.lit(ACCURACY)).alias("_b"))
    bracket = cut_lineage(sketch.select(*keys, "n", (F.col("_min") if low == 0.0 else F.col("_b")[0]).alias("_lo"),
                                        (F.col("_max") if high == 1.0 else F.col("_b")[1]).alias("_hi")))
    tagged = _met(rows, bracket, keys, few)
    below, above = F.col("_v") < F.col("_lo"), F.col("_v") > F.col("_hi")
    counts = cut_lineage(tagged.groupBy(*keys, "n", above.alias("_above"), F.when(~below & ~above, F.col("_v")).alias("_c")).agg(F.count("*").alias("_m")))
    least = counts.where(~F.col("_above") & F.col("_c").isNull()).select(*keys, F.col("_m").alias("_below"))
    inside = counts.where(F.col("_c").isNotNull()).select(*keys, "n", F.col("_c").alias("_v"), "_m")
    if not keys:
        return inside.join(F.broadcast(least.groupBy().agg(F.coalesce(F.max("_below"), F.lit(0)).alias("_below"))))
    return inside.join(least, keys, "left").select(*keys, "n", "_v", "_m", F.coalesce("_below", F.lit(0)).alias("_below"))


def _narrowed(left: DataFrame, keys: list[str], lower: Column, upper: Column, few: bool) -> DataFrame:
    """`left` cut down to the parts that hold the ranks, until no group has more than ORDERED values."""
    while True:
        left = cut_lineage(left)
        sizes = left.groupBy(*keys).agg(F.count("*").alias("_d"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        if (sizes.agg(F.max("_d")).first()[0] or 0) <= ORDERED:
            return left
        shares = F.array(*[F.lit(k / PARTS) for k in range(1, PARTS)])
        cuts = left.groupBy(*keys).agg(F.approx_percentile("_v", shares, F.lit(ACCURACY)).alias("_cuts"))
        part = F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_part")
        dealt = cut_lineage(_met(left, cuts, keys, few).select(*keys, "n", "_v", "_m", "_below", part))
        sums = dealt.groupBy(*keys, "n", "_below", "_part").agg(F.sum("_m").alias("_rows"))
        upto = F.sum("_rows").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) + F.col("_below")
        held = (sums.withColumn("_upto", upto).where((F.col("_upto") > lower) & (F.col("_upto") - F.col("_rows") <= upper))
                .groupBy(*keys).agg(F.min(F.col("_upto") - F.col("_rows")).alias("_now"), F.min("_part").alias("_from"), F.max("_part").alias("_to")))
        left = (_met(dealt, held, keys, few).where(F.col("_part").between(F.col("_from"), F.col("_to")))
                .select(*keys, "n", "_v", "_m", F.col("_now").alias("_below")))


def _at_ranks(df: DataFrame, keys: list[str], value: str, q: float, lower: Callable[[Column], Column], upper: Callable[[Column], Column], few: bool) -> DataFrame:
    """(keys, n, _lower, _upper): the elements at the two ranks of each group's ascending values, counted from 0."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    n = F.col("n")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    large = cut_lineage(sizes.where(n > ORDERED))
    some = not large.isEmpty()
    counted = lambda part: part.groupBy(*keys, "_v").agg(F.count("*").alias("_m"))
    ordered = W.partitionBy(*keys).orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys)
    if not some:
        left = counted(rows).select(*keys, F.sum("_m").over(whole).alias("n"), "_v", "_m", F.lit(0).cast("long").alias("_below"))
    elif not keys:
        left = _narrowed(_bracketed(rows, keys, q, few), keys, lower(n), upper(n), few)
    else:
        told = F.broadcast(large.select(*keys)) if few else large.select(*keys)
        small = counted(rows.join(told, keys, "left_anti")).select(*keys, F.sum("_m").over(whole).alias("n"), "_v", "_m", F.lit(0).cast("long").alias("_below"))
        left = small.unionByName(_narrowed(_bracketed(rows.join(told, keys, "left_semi"), keys, q, few), keys, lower(n), upper(n), few))
    upto = left.withColumn("_upto", F.sum("_m").over(ordered) + F.col("_below"))
    first_past = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_v")))
    missed = (F.min(F.col("_upto") - F.col("_m")) > F.min(lower(n))) | (F.max("_upto") <= F.max(upper(n)))
    at = lambda rank: F.when(missed, F.raise_error(F.lit("rank outside its bracket"))).otherwise(first_past(rank))
    return upto.groupBy(*keys, "n").agg(at(lower(n)).alias("_lower"), at(upper(n)).alias("_upper"))


def order_statistic(df: DataFrame, keys: list[str], value: str, q: float = 0.5,
                    name: str = "stat", few: bool = False) -> DataFrame:
    """Per group: the element at index floor(n * q) of the ascending values, and n.

    q = 0.5 is the upper median. Null values and null keys are ignored; groups without values vanish.
    few: the keys have few values by construction (hours of a day, buckets), so a row a key may be
    sent to all tasks instead of all rows to a few keys.
    """
    rank = lambda n: F.least(F.floor(n * q), n - 1)
    return _at_ranks(df, keys, value, q, rank, rank, few).select(*keys, "n", F.col("_lower").alias(name))


def exact_median(df: DataFrame, keys: list[str], value: str, name: str = "median", few: bool = False) -> DataFrame:
    """Per group: the mean of the two middle values (the middle one for odd n), and n."""
    found = _at_ranks(df, keys, value, 0.5, lambda n: F.floor((n - 1) / 2), lambda n: F.floor(n / 2), few)
    return found.select(*keys, "n", ((F.col("_lower") + F.col("_upper")) / 2).alias(name))


def nearest_rank(df: DataFrame, keys: list[str], value: str, q: float, name: str, few: bool = False) -> DataFrame:
    """Per group: the element at index round(q * (n - 1)), halves rounded up."""
    rank = lambda n: F.floor(F.lit(q) * (n - 1) + 0.5)
    return _at_ranks(df, keys, value, q, rank, rank, few).select(*keys, "n", F.col("_lower").alias(name))
