"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        folder = _local_folder()
    return folder.rstrip("/")


@cache
def _local_folder() -> str:
    """Of local mode, in which driver and executors are one process."""
    folder = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


@contextmanager
def _shuffles_dropped(spark: SparkSession):
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage (a lost executor costs a reread, not a recomputation) and
    frees the shuffle files of the job that made it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store_apart(df: DataFrame, condition: Column, name: str) -> tuple[DataFrame, DataFrame]:
    """``store``, the rows where ``condition`` holds as one table and the others as another, by one job."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.withColumn("_holds", condition).write.option("compression", "zstd").partitionBy("_holds").parquet(path)
    parts = [f"{path}/_holds={value}" for value in ("true", "false")]
    for part in parts:
        folder = spark._jvm.org.apache.hadoop.fs.Path(part)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    yes, no = (spark.read.schema(df.schema).parquet(part) for part in parts)
    return yes, no


def discard(df: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file.rsplit("/", 1)[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
