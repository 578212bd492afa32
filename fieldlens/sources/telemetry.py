"""Movement telemetry CSV of unknown columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: which header means what, first match wins
COLUMN_ROLES = [
    ("rate", r"^(mov(e|ement)?[_ ]?rate|rate[_ ]?of[_ ]?mov|speed|step[_ ]?length|dist(ance)?[_ ]?m|displacement)"),
    ("timestamp", r"^(timestamp|date[_ ]?time|datetime|acquisition|fix[_ ]?time|gmt|utc|t)$|date.?time"),
    ("date", r"^(date|day|localdate)$"),
    ("hour", r"^(hour|hr|time[_ ]?of[_ ]?day|tod)$"),
    ("animal", r"^(animal|deer|individual|id|collar|tag|animalid|deerid)"),
    ("sex", r"^(sex|gender|m_f)$"),
    ("lat", r"^(lat|latitude|y)$"),
    ("lng", r"^(lon|lng|long|longitude|x)$"),
    ("temp", r"^(temp|temperature|tempc|tempf|air[_ ]?temp)"),
]


def detect_roles(header: list[str]) -> tuple[dict[str, str], list[str]]:
    """Role -> column name, and the columns nothing claimed. Looks at the header only."""
    roles: dict[str, str] = {}
    rest = []
    for name in header:
        role = next((r for r, pattern in COLUMN_ROLES if re.search(pattern, name, re.I)), None)
        if role is not None and role not in roles:
            roles[role] = name
        else:
            rest.append(name)
    return roles, rest


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text; typing happens by role, not by inference."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def row_time(columns: dict[str, Column]) -> Column:
    """The timestamp column when it parses, else date plus whole hour."""
    stamp = F.try_to_timestamp(columns["timestamp"]) if "timestamp" in columns else F.lit(None).cast("timestamp")
    if "date" not in columns:
        return stamp
    hour = F.coalesce(columns["hour"].try_cast("double"), F.lit(0.0)) if "hour" in columns else F.lit(0.0)
    day = F.try_to_timestamp(columns["date"])
    return F.coalesce(stamp, F.timestamp_seconds(F.unix_seconds(F.date_trunc("day", day)) + F.floor(hour) * 3600))


def typed(raw: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    """Records with a `usable` flag: a rate that is a number of zero or more, and a time.

    A blank rate is missing, never zero.
    """
    use = roles or detect_roles(raw.columns)[0]
    if "rate" not in use:
        raise ValueError("no movement-rate column found; name one with roles={'rate': ...}")
    col = {r: F.col(f"`{c}`") for r, c in use.items()}

    def number(role):
        return F.nullif(F.trim(col[role]), F.lit("")).try_cast("double") if role in col else F.lit(None).cast("double")

    at, rate = row_time(col), number("rate")
    sex = F.upper(F.substring(F.trim(col["sex"]), 1, 1)) if "sex" in col else F.lit(None).cast("string")
    out = raw.select(rate.alias("rate"), at.alias("at"), F.hour(at).cast("bigint").alias("hour"), F.month(at).alias("month"),
                     F.nullif(sex, F.lit("")).alias("sex"),
                     (col["animal"] if "animal" in col else F.lit(None).cast("string")).alias("animal"),
                     number("lat").alias("lat"), number("lng").alias("lng"), number("temp").alias("temp"))
    good = F.col("rate").isNotNull() & ~F.isnan("rate") & (F.col("rate") >= 0) & F.col("at").isNotNull()
    return out.withColumn("usable", good)


def inspect(raw: DataFrame, sample: int = 3) -> dict:
    """What a file holds: columns, roles, unclaimed columns, missing roles, a few rows."""
    roles, rest = detect_roles(raw.columns)
    return {"columns": raw.columns, "roles": roles, "unmatched": rest, "missing": [r for r in ("rate",) if r not in roles],
            "can_timestamp": "timestamp" in roles or "date" in roles,
            "sample": [r.asDict() for r in raw.limit(sample).collect()]}


def load_counts(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("total"), F.count_if(~F.col("usable")).alias("skipped"))
