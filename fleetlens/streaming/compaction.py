"""Folding of the many small folders of a stream's batches into few, while readers go on.

A table is the sum of its folds and of the batches after them. The list of folds and the last batch they hold stand in
numbered markers that are never rewritten; the highest complete one counts. Folding writes a new folder and then a new marker. Folds of
one level merge when there are ``FAN`` of them, so there are few of them after any number of batches and a row is rewritten
once per level. Folders that a marker no longer names go ``MARKERS_KEPT`` markers later, so a reader that has started can finish.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from fleetlens.sources.shared import delete_path, list_names, path_exists
from fleetlens.sources.tables import markers

FAN = 4
MARKERS_KEPT = 2


def _state(spark: SparkSession, path: str, folder: str | None = None) -> tuple[int, list[tuple[int, str]]]:
    """Last folded batch and the folds (level, folder) of a marker, by default the current one."""
    found = markers(spark, os.path.join(path, "folds"))
    if folder is None and not found:
        return -1, []
    rows = spark.read.schema("upto bigint, level int, folder string").parquet(folder or found[-1][1]).collect()  # a few rows
    return rows[0]["upto"], [(r["level"], r["folder"]) for r in rows if r["folder"] is not None]


def _batches(spark: SparkSession, path: str) -> list[int]:
    if not path_exists(spark, path):
        return []
    return sorted(int(n.removeprefix("batch_id=")) for n in list_names(spark, path) if n.startswith("batch_id="))


def read_folded(spark: SparkSession, path: str, schema: StructType, but: int | None = None) -> DataFrame:
    """All rows of the table at this moment, without those of the batch ``but``; ``schema`` is that of a batch without its id."""
    upto, folds = _state(spark, path)
    rows = spark.createDataFrame([], schema)
    for _, folder in folds:
        rows = rows.unionByName(spark.read.schema(schema).parquet(os.path.join(path, "folds", folder)))
    later = [b for b in _batches(spark, path) if b > upto and b != but]
    if later:
        typed = StructType(list(schema.fields)).add("batch_id", LongType())
        open_ = spark.read.schema(typed).option("basePath", path).parquet(*(os.path.join(path, f"batch_id={b}") for b in later))
        rows = rows.unionByName(open_.drop("batch_id"))
    return rows


def fold(spark: SparkSession, path: str, schema: StructType, upto: int, by: str) -> int:
    """Fold the batches up to ``upto``, which must be complete; returns how many folders now hold the table.

    ``by`` is the partition column of the folds (the day). A row is never in two folders that a marker names.
    """
    folds_path = os.path.join(path, "folds")
    done, folds = _state(spark, path)
    new = [b for b in _batches(spark, path) if done < b <= upto]
    if not new:
        return len(folds) + len([b for b in _batches(spark, path) if b > done])
    typed = StructType(list(schema.fields)).add("batch_id", LongType())
    rows = spark.read.schema(typed).option("basePath", path).parquet(*(os.path.join(path, f"batch_id={b}") for b in new)).drop("batch_id")
    level, kept = 0, list(folds)
    while True:
        peers = [f for lv, f in kept if lv == level]
        if len(peers) < FAN - 1:
            break
        for folder in peers:
            rows = rows.unionByName(spark.read.schema(schema).parquet(os.path.join(folds_path, folder)))
        kept = [(lv, f) for lv, f in kept if lv != level]
        level += 1
    name = f"fold={uuid.uuid4().hex}"
    # One task per day and as many as it takes for a large one.
    rows.hint("rebalance", F.col(by)).write.mode("error").partitionBy(by).parquet(os.path.join(folds_path, name))
    kept.append((level, name))
    older = markers(spark, folds_path)
    number = older[-1][0] + 1 if older else 1
    marker = spark.createDataFrame([(upto, lv, f) for lv, f in kept], "upto bigint, level int, folder string")
    marker.coalesce(1).write.mode("error").parquet(os.path.join(folds_path, f"marker={number:08d}"))
    _clean(spark, path)
    return len(kept) + len([b for b in _batches(spark, path) if b > upto])


def _clean(spark: SparkSession, path: str) -> None:
    """Remove markers before the last ``MARKERS_KEPT``, and folds and batches that none of those left needs."""
    folds_path = os.path.join(path, "folds")
    found = markers(spark, folds_path)
    for _, folder in found[:-MARKERS_KEPT]:
        delete_path(spark, folder)
    states = [_state(spark, path, folder) for _, folder in found[-MARKERS_KEPT:]]
    named = {f for _, folds in states for _, f in folds}
    for name in list_names(spark, folds_path):
        if name.startswith("fold=") and name not in named:
            delete_path(spark, os.path.join(folds_path, name))
    if len(found) >= MARKERS_KEPT:
        for batch in _batches(spark, path):
            if batch <= min(upto for upto, _ in states):
                delete_path(spark, os.path.join(path, f"batch_id={batch}"))
