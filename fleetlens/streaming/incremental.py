"""Micro-batch ingestion of log lines and job runs.

Each batch writes under its own ``batch_id`` partition, so a batch that is retried after a
failure replaces its own output and nothing else.  State that the next batch needs is one
small row per machine, kept per batch id for the same reason.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from fleetlens.operators import feeds, merges
from fleetlens.sources.shared import delete_path, list_names, path_exists
from fleetlens.streaming.compaction import fold, read_folded

LATE_AFTER = "30 hours"  # fixed value: older lines are never fetched
SLICE = "1 hour"
STATES_KEPT = 100  # like spark.sql.streaming.minBatchesToRetain: no older batch can be repeated from the checkpoint


def event_time(ts_col: str) -> Column:
    """A watermark column from a zone-less time, read as UTC whatever the session zone is."""
    ts = F.col(ts_col)
    return F.make_timestamp_ltz(
        F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts), F.extract(F.lit("SECOND"), ts), F.lit("UTC"))


def drop_late(lines: DataFrame, ts_col: str = "LogDate", keys: tuple[str, ...] = ("SQLInstanceID", "LineNo")) -> DataFrame:
    """Discard lines behind the watermark and repeated deliveries; state is bounded by the watermark."""
    timed = lines.withColumn("_event_time", event_time(ts_col)).withWatermark("_event_time", LATE_AFTER)
    return timed.dropDuplicates([*keys, "_event_time"]).drop("_event_time")


def hour_start(ts: Column) -> Column:
    return F.to_date(ts).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour(ts))


def hourly_counts(events: DataFrame, ts_col: str = "LogDate", key: str = "SQLInstanceID") -> DataFrame:
    """Rows per machine and tumbling hour; an hour is final once the watermark passes its end.

    In append mode only final hours appear: those that end in the last ``LATE_AFTER`` of the stream do not. ``with_open_hours`` adds them.
    """
    timed = events.withColumn("_event_time", event_time(ts_col)).withWatermark("_event_time", LATE_AFTER)
    hours = timed.groupBy(F.window("_event_time", SLICE), key).agg(
        F.min(ts_col).alias("_first"), F.count(F.lit(1)).alias("LineCount"))
    hours = hours.withColumn("HourStart", hour_start(F.col("_first")))
    return hours.select(key, "HourStart", (F.col("HourStart") + F.expr("interval 1 hour")).alias("HourEnd"), "LineCount")


def with_open_hours(final: DataFrame, lines: DataFrame, ts_col: str = "LogDate", key: str = "SQLInstanceID") -> DataFrame:
    """All hours: the stream's final ones as they are, every other one counted from the stored lines."""
    counted = lines.filter(F.col(ts_col).isNotNull()).groupBy(key, hour_start(F.col(ts_col)).alias("HourStart")).agg(F.count(F.lit(1)).alias("LineCount"))
    done = final.select(F.col(key).alias("_key"), F.col("HourStart").alias("_start"))
    still_open = counted.join(done, F.col(key).eqNullSafe(F.col("_key")) & (F.col("HourStart") == F.col("_start")), "left_anti")
    return final.select(key, "HourStart", "HourEnd", "LineCount").unionByName(
        still_open.select(key, "HourStart", (F.col("HourStart") + F.expr("interval 1 hour")).alias("HourEnd"), "LineCount"))


def _once(work):
    """Run one batch's writes over a kept copy, so its source is computed a single time."""
    def run(df: DataFrame, batch_id: int) -> None:
        df.persist()
        try:
            work(df, batch_id)
        finally:
            df.unpersist()

    return run


def _write_batch(df: DataFrame, path: str, batch_id: int, *partition_by: str) -> None:
    df.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("batch_id", *partition_by).parquet(path)


def _state(spark: SparkSession, root: str, name: str, batch_id: int) -> DataFrame | None:
    path = os.path.join(root, "state", name, f"batch={batch_id}")
    return spark.read.parquet(path) if path_exists(spark, path) else None


def _save_state(df: DataFrame, root: str, name: str, batch_id: int, kept: int = STATES_KEPT) -> None:
    """Write this batch's state; older ones stay long enough for any batch that may be repeated."""
    folder = os.path.join(root, "state", name)
    df.write.mode("overwrite").parquet(os.path.join(folder, f"batch={batch_id}"))
    kept = max(kept, int(df.sparkSession.conf.get("spark.sql.streaming.minBatchesToRetain", str(kept))))
    if batch_id >= kept:
        delete_path(df.sparkSession, os.path.join(folder, f"batch={batch_id - kept}"))


def error_batch(batch: DataFrame, batch_id: int, root: str) -> None:
    """Extract errors of one batch, pairing its first line with the last line of earlier batches.

    Agrees with the batch job when each machine's lines arrive in order.
    """
    spark = batch.sparkSession
    lines = batch.select("SQLInstanceID", "LineNo", "LogDate", "Text").withColumn("carried", F.lit(False))
    before = _state(spark, root, "tail", batch_id - 1)
    if before is not None:
        lines = lines.unionByName(before.withColumn("carried", F.lit(True)))
    errors = feeds.extract_errors(lines, keep=("carried",)).filter(~F.col("carried")).drop("carried")
    _write_batch(errors, os.path.join(root, "errors"), batch_id)

    line = F.struct("LineNo", "LogDate", "Text")
    tail = lines.groupBy("SQLInstanceID").agg(F.max_by(line, F.struct("LogDate", "LineNo")).alias("t")).select("SQLInstanceID", "t.*")
    _save_state(tail, root, "tail", batch_id)
    marks = merges.high_water_marks(lines, "LogDate")
    _save_state(marks, root, "error_marks", batch_id)


def incremental_errors(lines: DataFrame, root: str) -> StreamingQuery:
    """Continuous error extraction from a stream of log lines into ``<root>/errors``."""
    return (
        drop_late(lines).writeStream.foreachBatch(_once(lambda df, i: error_batch(df, i, root)))
        .option("checkpointLocation", os.path.join(root, "checkpoint-errors")).trigger(availableNow=True).start())


def job_batch(batch: DataFrame, batch_id: int, root: str, jobs: DataFrame) -> None:
    """Add runs keyed by (job, start); a run stored by an earlier batch is not doubled.

    Only the days that the batch touches are read back from the stored history.
    """
    spark = batch.sparkSession
    target = os.path.join(root, "job_history")
    rows = batch.join(
        jobs.select("SQLInstanceID", F.col("SQLJobName").alias("JobName"), "SQLJobID"), ["SQLInstanceID", "JobName"]
    ).groupBy("SQLJobID", "ExecutionDateTime").agg(F.max(F.struct("Duration", "JobStatus")).alias("r")).select(
        "SQLJobID", "ExecutionDateTime", "r.*").withColumn("run_date", F.to_date("ExecutionDateTime"))
    if path_exists(spark, target):
        days = [r[0] for r in [batch.agg(F.to_date(F.min("ExecutionDateTime"))).first()] if r[0] is not None]
        stored = job_history(spark, root, but=batch_id)
        if days:
            stored = stored.filter(F.col("run_date") >= F.lit(days[0]))
        rows = rows.join(stored.select("SQLJobID", "ExecutionDateTime"), ["SQLJobID", "ExecutionDateTime"], "left_anti")
    _write_batch(rows, target, batch_id, "run_date")
    new = merges.high_water_marks(batch, "ExecutionDateTime")
    before = _state(spark, root, "job_marks", batch_id - 1)
    _save_state(merges.advance_marks(before, new) if before is not None else new, root, "job_marks", batch_id)


RUNS = "SQLJobID bigint, ExecutionDateTime timestamp_ntz, Duration int, JobStatus string, run_date date"


def job_history(spark: SparkSession, root: str, but: int | None = None) -> DataFrame:
    """The stored runs, folded or not."""
    return read_folded(spark, os.path.join(root, "job_history"), StructType.fromDDL(RUNS), but)


def fold_jobs(spark: SparkSession, root: str) -> int:
    """Fold all batches but the last, which may be repeated; returns how many folders hold the runs."""
    folder = os.path.join(root, "state", "job_marks")
    done = [int(n.removeprefix("batch=")) for n in list_names(spark, folder) if n.startswith("batch=")] if path_exists(spark, folder) else []
    return fold(spark, os.path.join(root, "job_history"), StructType.fromDDL(RUNS), max(done) - 1, "run_date") if len(done) > 1 else len(done)


def incremental_jobs(runs: DataFrame, root: str, jobs: DataFrame) -> StreamingQuery:
    """Continuous load of job runs into ``<root>/job_history``."""
    return (
        runs.writeStream.foreachBatch(_once(lambda df, i: job_batch(df, i, root, jobs)))
        .option("checkpointLocation", os.path.join(root, "checkpoint-jobs")).trigger(availableNow=True).start())


def write_hourly_counts(events: DataFrame, root: str, ts_col: str = "LogDate") -> StreamingQuery:
    """Final hours into ``<root>/hours``."""
    return (
        hourly_counts(events, ts_col).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", os.path.join(root, "checkpoint-hours")).option("path", os.path.join(root, "hours"))
        .trigger(availableNow=True).start())
