"""Session settings this library relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Runtime SQL settings; all may be set on a running session.
SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even where a later operator must shuffle again.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app: str = "fleetlens", master: str | None = None, cpus: int | None = None) -> SparkSession:
    """Create a session; on a cluster leave ``master`` unset and let spark-submit decide."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        builder = builder.config("spark.sql.shuffle.partitions", str(cpus or os.cpu_count() or 8))
        builder = builder.config("spark.driver.memory", os.environ.get("FLEETLENS_DRIVER_MEMORY", "12g"))
        builder = builder.config("spark.ui.enabled", "false")
    for key, value in SQL_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
