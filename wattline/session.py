"""Session helpers: local sessions for tests and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_runs: list[list[str]] = []


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "12g", scratch: str | None = None) -> SparkSession:
    """A single-JVM session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("wattline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if scratch:
        builder = builder.config("spark.checkpoint.dir", scratch)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` as the cluster names it.

    Where that is unset, intermediate tables go below the warehouse, which all executors share as well.
    """
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def _file(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, never reused, so a rerun overwrites nothing.

    It is deleted when the driver's JVM ends, or with the ``scratch_run`` it belongs to.
    """
    path = f"{shared_dir(spark)}/wattline/{label}-{uuid.uuid4().hex}"
    where, fs = _file(spark, path)
    fs.deleteOnExit(where)
    if _runs:
        _runs[-1].append(path)
    return path


@contextmanager
def scratch_run(spark: SparkSession) -> Iterator[None]:
    """Deletes the intermediate tables made inside it; results must be written or collected before it ends."""
    _runs.append([])
    try:
        yield
    finally:
        for path in _runs.pop():
            where, fs = _file(spark, path)
            fs.delete(where, True)


def materialize(df, label: str, partition_by=()):
    """Write ``df`` to the shared folder and read it back.

    Used where a later step reads a costly result more than once; the written table survives
    the loss of executors, unlike a cached or locally checkpointed one.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
