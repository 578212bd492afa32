"""Small helpers the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.session import ensure_checkpoint_dir

#: Rows a task turns into Python objects at a time; bounds memory, not results.
SLICE = 512
#: With it, Spark removes the shuffle files of a query at its end, not when the driver next collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(key: Column, folds: int = 5) -> Column:
    """crc32 of the key's text modulo the number of folds; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the shared checkpoint folder, removed when the session's JVM ends."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark._jsc.sc().getCheckpointDir().get()}/{label}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a derived table to the shared folder and go on from its files.

    Later stages reread files that outlive any executor instead of repeating the work, so the
    shuffle files of the write go with it. `discard` removes the files when nothing reads them any more.
    """
    spark, folder = df.sparkSession, shared_folder(df.sparkSession, label)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(folder)
    table.stored_folder = folder
    return table


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables that `stored` returned and that nothing reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.stored_folder)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """From now on no Arrow batch of the session holds more than `size` of rows, whatever their length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def text_slices(batches: Iterator[pa.RecordBatch], column: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices that hold at most `size` bytes of a text column, or one row."""
    for part in slices(batches):
        cost = pc.fill_null(pc.binary_length(part.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(cost.tolist()):
            if i > start and held + n > size:
                yield part.slice(start, i - start)
                start, held = i, 0
            held += n
        if part.num_rows:
            yield part.slice(start)


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema) -> DataFrame:
    """Apply a function of Arrow slices; `make` runs once a task and returns the function."""
    def run(batches):
        work = make()
        for part in slices(batches):
            yield work(part)
    return df.mapInArrow(run, schema)
