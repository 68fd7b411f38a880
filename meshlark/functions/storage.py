"""Where state is kept between jobs: the checkpoint folder, which all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where Spark runs in one JVM."""
    named, held = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.getCheckpointDir()
    if held is None:
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return named or spark.sparkContext.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A new path in the folder, deleted when the driver ends."""
    path = f"{folder(spark)}/scratch-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder, from which any executor can read it again."""
    folder(df.sparkSession)
    return df.checkpoint()


def free(spark: SparkSession) -> None:
    """Has files of shuffles deleted that no table needs any more: they go when the driver's JVM collects its garbage.

    They go a little later, and not surely: once isn't always enough.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()


def few(df: DataFrame, rows: int = 1 << 16) -> DataFrame:
    """df, written once, to be broadcast if it has no more rows than that; else joined by a shuffle."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    held = df.sparkSession.read.parquet(path)
    return F.broadcast(held) if held.count() <= rows else held
