"""Throttled collection of log errors, one slice of time after the other, with stored marks.

Every machine has a mark up to which its log is collected. A round takes the next slice of every machine in one job, writes the
errors under the round's number and then the advanced marks, which commits the round. A run that stops after any round, or
fails within one, goes on from the last committed marks; a repeated round replaces its own folder.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.columns import ts_lit
from fleetlens.operators import feeds
from fleetlens.sources.shared import delete_path, list_names, path_exists

SLICE_HOURS, FLOOR_HOURS = 1, 30  # fixed values: one hour a slice, and no look further back
ROUNDS_KEPT = 3
TAIL = ("LineNo", "LogDate", "Text")


def _hours(n: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(n))


def _rounds(spark: SparkSession, root: str) -> list[int]:
    """Committed rounds, oldest first."""
    folder = os.path.join(root, "marks")
    if not path_exists(spark, folder):
        return []
    names = [n for n in list_names(spark, folder) if n.startswith("round=") and path_exists(spark, os.path.join(folder, n, "_SUCCESS"))]
    return sorted(int(n.removeprefix("round=")) for n in names)


def stored_marks(spark: SparkSession, root: str) -> DataFrame | None:
    """``SQLInstanceID, LastDateTimeCaptured`` and the last line read, as of the last committed round."""
    done = _rounds(spark, root)
    return spark.read.parquet(os.path.join(root, "marks", f"round={done[-1]}")) if done else None


def due(instances: DataFrame, marks: DataFrame | None, now: Column, slice_hours: int, floor_hours: int) -> DataFrame:
    """``SQLInstanceID, start, stop`` and the last line of each machine; it is forgotten where the floor skips lines after it.

    A machine without a mark starts at the floor. One that has less than a slice left until ``now`` stays where it is (``stop`` = ``start``).
    """
    rows = instances.select("SQLInstanceID").distinct()
    if marks is None:
        rows = rows.select("SQLInstanceID", *(F.lit(None).cast(t).alias(c) for c, t in (
            ("LastDateTimeCaptured", "timestamp_ntz"), ("LineNo", "bigint"), ("LogDate", "timestamp_ntz"), ("Text", "string"))))
    else:
        rows = rows.join(marks, "SQLInstanceID", "left")
    floor, mark = now - _hours(floor_hours), F.col("LastDateTimeCaptured")
    start = F.greatest(F.coalesce(mark, floor), floor)
    rows = rows.withColumns({"start": start} | {c: F.when(mark >= floor, F.col(c)) for c in TAIL})
    stop = F.col("start") + _hours(slice_hours)
    return rows.select("SQLInstanceID", "start", F.when(stop <= now, stop).otherwise(F.col("start")).alias("stop"), *TAIL)


def collect_slice(lines: DataFrame, todo: DataFrame, low, high) -> tuple[DataFrame, DataFrame]:
    """Errors of one round and the marks after it; ``low`` and ``high`` bound the round, so that the scan skips all other lines."""
    window = lines.select("SQLInstanceID", *TAIL).filter((F.col("LogDate") > F.lit(low)) & (F.col("LogDate") <= F.lit(high)))
    spans = todo.select("SQLInstanceID", "start", "stop")
    mine = window.join(spans, "SQLInstanceID").filter((F.col("LogDate") > F.col("start")) & (F.col("LogDate") <= F.col("stop")))
    before = todo.filter("LineNo is not null and stop > start").select("SQLInstanceID", *TAIL)
    rows = mine.select("SQLInstanceID", *TAIL, F.lit(False).alias("carried")).unionByName(before.withColumn("carried", F.lit(True)))
    errors = feeds.extract_errors(rows, keep=("carried",)).filter(~F.col("carried")).drop("carried")
    line = F.struct(*TAIL)
    last = mine.groupBy("SQLInstanceID").agg(F.max_by(line, F.struct("LogDate", "LineNo")).alias("t"))
    marks = todo.join(last, "SQLInstanceID", "left").select(
        "SQLInstanceID", F.col("stop").alias("LastDateTimeCaptured"), *(F.coalesce(f"t.{c}", c).alias(c) for c in TAIL))
    return errors, marks


def backfill_errors(
    lines: DataFrame, instances: DataFrame, root: str, now: str, slice_hours: int = SLICE_HOURS, floor_hours: int = FLOOR_HOURS, rounds: int | None = None,
) -> int:
    """Collect until every machine has less than a slice left before ``now``, or ``rounds`` are done; returns the rounds done.

    Errors go to ``<root>/errors``, read them through :func:`collected`. Lines older than the floor are skipped, as are
    lines later than ``now``.
    """
    spark, done = lines.sparkSession, 0
    while rounds is None or done < rounds:
        todo = due(instances, stored_marks(spark, root), ts_lit(now), slice_hours, floor_hours)
        span = todo.filter("stop > start").agg(F.min("start").alias("low"), F.max("stop").alias("high")).first()
        if span["low"] is None:
            break
        number = (_rounds(spark, root) or [0])[-1] + 1
        errors, marks = collect_slice(lines, todo, span["low"], span["high"])
        errors.write.mode("overwrite").parquet(os.path.join(root, "errors", f"round={number}"))
        marks.write.mode("overwrite").parquet(os.path.join(root, "marks", f"round={number}"))
        for old in _rounds(spark, root)[:-ROUNDS_KEPT]:
            delete_path(spark, os.path.join(root, "marks", f"round={old}"))
        done += 1
    return done


def collected(spark: SparkSession, root: str) -> DataFrame:
    """Errors of all committed rounds."""
    done = _rounds(spark, root)
    rows = spark.read.schema("SQLInstanceID bigint, DateTimeCaptured timestamp_ntz, Message string, round int").parquet(os.path.join(root, "errors"))
    return rows.filter(F.col("round") <= (done[-1] if done else 0)).drop("round")
