"""Shared tables between jobs, and the bound on Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from capspark.sources.shared import shared_dir

#: Bytes of one Arrow batch to Python, so that long texts do not meet in one batch of 10,000 rows.
ARROW_BYTES = 4 << 20

_written: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"
    _written.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage ends in files that
    outlive any executor, and the next plan knows their size."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes, besides the row count that Spark limits already."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def give_back() -> None:
    """What Arrow keeps of earlier batches goes back to the machine: a worker lives for many tasks."""
    pa.default_memory_pool().release_unused()


def release(spark: SparkSession) -> None:
    """Delete the tables that written() has made; call it when their results have been used."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop().rpartition("/")[0])
        path.getFileSystem(conf).delete(path, True)


@atexit.register
def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        with contextlib.suppress(Exception):  # the JVM may have gone first
            release(spark)
