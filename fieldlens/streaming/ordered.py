"""Jobs on rows in event order, micro-batch by micro-batch, with one carried row a key.

A step gets the rows of a trigger that are due and what earlier triggers handed on, and orders
them with Spark (chunked windows, sorted partitions), so a busy key or a large trigger is never
gathered in one task. Rows newer than the newest instant less the lateness allowed wait in files,
so files that arrive out of order within it change nothing.

Every trigger writes its own version of answers, carried rows and waiting rows below the target,
reads the version before it, and marks itself done last: a replayed trigger writes the same again,
and a lost executor or driver leaves the last finished version readable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Step = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]
#: The version that releases what still waits.
LAST = (1 << 62)


def _held(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as nothing:
        if nothing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


class OrderedBatches:
    """A foreachBatch writer: step(rows, carried) gives answers and the rows to carry, one a key.

    keys and time name a row's key and event-time columns; rows without either never wait and
    come to the step at once. late_seconds: how much older than the newest instant seen a row may be.
    """

    def __init__(self, target: str, step: Step, keys: list[str], time: str, carry_schema: str, late_seconds: int = 0) -> None:
        self.target, self.step, self.keys, self.time = target, step, keys, time
        self.carry_schema, self.late_seconds = carry_schema, late_seconds

    def _version(self, spark: SparkSession, name: str, version: int | None, schema) -> DataFrame:
        held = None if version is None else _held(spark, f"{self.target}/{name}")
        if held is None or "version" not in held.columns:
            return spark.createDataFrame([], schema)
        fresh = held.where(F.col("version") == version).drop("version")
        wanted = spark.createDataFrame([], schema).columns
        return fresh.select(*wanted)

    def _write(self, df: DataFrame, name: str, version: int) -> None:
        df.withColumn("version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(
            f"{self.target}/{name}")

    def _before(self, spark: SparkSession, version: int) -> tuple[int | None, object]:
        """The last finished version and the newest instant up to it."""
        held = _held(spark, f"{self.target}/done")
        row = None if held is None else held.where(F.col("version") < version).agg(F.max_by(F.struct("version", "newest"), "version").alias("r")).first()
        return (None, None) if row is None or row.r is None else (row.r.version, row.r.newest)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self._run(batch, batch_id, release=False)

    def finish(self, spark: SparkSession, schema) -> None:
        """Release the rows that still wait; schema is that of the stream."""
        self._run(spark.createDataFrame([], schema), LAST, release=True)

    def _run(self, batch: DataFrame, version: int, release: bool) -> None:
        spark = batch.sparkSession
        before, newest = self._before(spark, version)
        rows = batch.unionByName(self._version(spark, "waiting", before, batch.schema))
        seen = batch.agg(F.max(self.time)).first()[0]
        newest = max((x for x in (newest, seen) if x is not None), default=None)
        due = F.lit(True)
        if not release and newest is not None and self.late_seconds:
            due = F.coalesce(F.col(self.time) <= F.lit(newest) - F.expr(f"INTERVAL {self.late_seconds} SECONDS"), F.lit(True))
        carried = self._version(spark, "carried", before, self.carry_schema)
        answers, carry = self.step(rows.where(due), carried)
        untouched = carried.join(carry.select(*self.keys).distinct(), self.keys, "left_anti")
        self._write(answers, "answers", version)
        self._write(carry.unionByName(untouched), "carried", version)
        self._write(rows.where(~due), "waiting", version)
        kind = batch.schema[self.time].dataType
        done = spark.range(1).select(F.lit(newest).cast(kind).alias("newest"))
        self._write(done, "done", version)


def answers(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """What all finished versions answered."""
    held = _held(spark, f"{target}/answers")
    if held is None or "version" not in held.columns:
        return spark.createDataFrame([], schema)
    done = spark.read.parquet(f"{target}/done").select("version")
    names = spark.createDataFrame([], schema).columns
    return held.join(done, "version", "left_semi").select(*names)
