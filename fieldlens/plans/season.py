"""A field's season in one row: harvest state and, when it can be told, the crop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def field_scans(harvest: DataFrame, verdicts: DataFrame, key: str = "field_id") -> DataFrame:
    top = verdicts.where(F.col("rank") == 1).select(key, "verdict", "why", F.lit(True).alias("tried"))
    why = F.coalesce("why", F.when(F.col("tried").isNull(), F.lit("not enough cloud-free looks")))
    return harvest.join(top, key, "left").withColumn("verdict_why", why).drop("why", "tried")
