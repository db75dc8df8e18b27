"""Lineage cuts through the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle and checkpoint files of what is no longer referenced.

    Its cleaner acts when the driver's JVM collects garbage, which a driver with little to do puts off for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; without it, a folder of this machine in local mode only."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="tideline-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back; its shuffles may then go."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    out = df.checkpoint()
    del df
    release(spark)
    return out


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables, wherever Spark can reach it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
