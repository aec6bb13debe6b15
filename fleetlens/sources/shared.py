"""Folders that every executor can reach."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``.

    A local session without that setting (tests) gets a temporary folder; on a
    cluster the setting is required, as a machine-local path would be lost with its node.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="fleetlens-")
    return os.path.join(base, f"{purpose}-{uuid.uuid4().hex}")


def _fs(spark: SparkSession, target: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def path_exists(spark: SparkSession, target: str) -> bool:
    fs, path = _fs(spark, target)
    return fs.exists(path)


def delete_path(spark: SparkSession, target: str) -> bool:
    """Delete a folder; returns whether it existed."""
    fs, path = _fs(spark, target)
    return bool(fs.delete(path, True))


def list_names(spark: SparkSession, target: str) -> list[str]:
    fs, path = _fs(spark, target)
    return [status.getPath().getName() for status in fs.listStatus(path)]
