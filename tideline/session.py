"""Spark session with the settings the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC instants, ANSI arithmetic (a bad cast raises; coercing operators use try_*), adaptive plans.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(name: str = "tideline", cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine; on a cluster, use its own session and `configure`."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name).config("spark.ui.enabled", "false").config("spark.driver.memory", memory)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.ui.showConsoleProgress", "false")
    spark = builder.config(map=CONF).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime settings on an existing session."""
    for key, value in CONF.items():
        spark.conf.set(key, value)
    return spark
