"""What the operators need from the Spark session."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from feedweave.operators.components import cut as cut
from feedweave.operators.components import shared_folder


def small_batches(spark: SparkSession) -> None:
    """Give Python fewer rows at once than Spark's default, which whole documents make
    tens of megabytes on both sides; a number that was set stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "2000")


def release(spark: SparkSession) -> None:
    """Collect the driver's garbage now: Spark deletes the files of shuffles and checkpoints
    that nothing refers to only when the driver's JVM has collected them.  The JVM hears from
    a thread of Python's what Python has let go, so that gets a moment first."""
    gc.collect()
    time.sleep(0.5)
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read one table and keep `columns` only, so extra columns can't clash."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the session's shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
