"""Error extraction from lines that arrive late, repeated or in any order.

Arriving lines are put into a buffer of blocks of ``BLOCK_HOURS`` clock hours. A block is final once the newest line seen is ``LATE_HOURS``
past its end; then its lines are read once, without repeats and in the order of their times, and paired with the last final line of their
machine. A line of a block that is already final is late and dropped. Each batch writes its own folders under its batch
id, so a batch that is retried after a failure replaces its own output and nothing else; a line is written once and read once.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetlens.functions.windows import hour_slice
from fleetlens.operators import feeds
from fleetlens.sources.shared import delete_path, list_names, path_exists
from fleetlens.streaming.incremental import _once, _save_state, _state, _write_batch

LATE_HOURS = 30  # fixed value: older lines are never fetched
BLOCK_HOURS = 6
LINE = ("SQLInstanceID", "LineNo", "LogDate", "Text")
_EPOCH = dt.datetime(1970, 1, 1)


def _block_no(ts: dt.datetime) -> int:
    return int((ts - _EPOCH).total_seconds() // (3600 * BLOCK_HOURS))


def _buffered(spark: SparkSession, root: str, schema, low: int | None, high: int | None) -> DataFrame:
    """Lines of the buffered blocks ``low .. high - 1``, each once; the filters prune folders."""
    rows = spark.read.schema(schema).parquet(os.path.join(root, "buffer"))
    rows = rows if low is None else rows.filter(F.col("block_no") >= low)
    rows = rows if high is None else rows.filter(F.col("block_no") < high)
    return rows.dropDuplicates(["SQLInstanceID", "LineNo", "LogDate"]).select(*LINE)


def _errors_of(lines: DataFrame, tail: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Errors of ``lines``, the first of each machine paired with its ``tail``; and all lines for the next tail."""
    rows = lines.withColumn("carried", F.lit(False))
    if tail is not None:
        rows = rows.unionByName(tail.select(*LINE).withColumn("carried", F.lit(True)))
    return feeds.extract_errors(rows, keep=("carried",)).filter(~F.col("carried")).drop("carried"), rows


def last_lines(rows: DataFrame) -> DataFrame:
    line = F.struct("LineNo", "LogDate", "Text")
    return rows.groupBy("SQLInstanceID").agg(F.max_by(line, F.struct("LogDate", "LineNo")).alias("t")).select("SQLInstanceID", "t.*")


def ordered_batch(batch: DataFrame, batch_id: int, root: str) -> None:
    spark = batch.sparkSession
    clock = _state(spark, root, "clock", batch_id - 1)
    before = clock.first() if clock is not None else None  # one row
    low = before["cut"] if before else None
    lines = batch.select(*LINE).filter("LogDate is not null").withColumn("block_no", F.floor(hour_slice(F.col("LogDate")) / BLOCK_HOURS).cast("int"))
    lines = lines if low is None else lines.filter(F.col("block_no") >= low)
    schema = lines.withColumn("batch_id", F.lit(0).cast("bigint")).schema
    lines.withColumn("batch_id", F.lit(batch_id).cast("bigint")).hint("rebalance", F.col("block_no")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("block_no", "batch_id").parquet(os.path.join(root, "buffer"))
    newest = max((m for m in (lines.agg(F.max("LogDate")).first()[0], before["mark"] if before else None) if m is not None), default=None)
    tail = _state(spark, root, "ordered_tail", batch_id - 1)
    if newest is None:
        return
    high = max(_block_no(newest - dt.timedelta(hours=LATE_HOURS)), low if low is not None else -(1 << 31))
    errors, rows = _errors_of(_buffered(spark, root, schema, low, high), tail)
    _write_batch(errors, os.path.join(root, "errors"), batch_id)
    _save_state(last_lines(rows), root, "ordered_tail", batch_id)
    _save_state(spark.createDataFrame([(newest, high)], "mark timestamp_ntz, cut int"), root, "clock", batch_id)
    if low is not None:  # what was final before this batch is never read again
        for name in list_names(spark, os.path.join(root, "buffer")):
            if name.startswith("block_no=") and int(name.removeprefix("block_no=")) < low:
                delete_path(spark, os.path.join(root, "buffer", name))


def ordered_errors(lines: DataFrame, root: str) -> StreamingQuery:
    """Continuous extraction into ``<root>/errors``; a line's error appears once its block is final."""
    return (
        lines.writeStream.foreachBatch(_once(lambda df, i: ordered_batch(df, i, root)))
        .option("checkpointLocation", os.path.join(root, "checkpoint-ordered")).trigger(availableNow=True).start())


def open_errors(spark: SparkSession, root: str) -> DataFrame | None:
    """Errors of the blocks that are not final yet, as far as their lines have arrived; None before the first batch."""
    folder = os.path.join(root, "state", "clock")
    if not path_exists(spark, folder):
        return None
    last = max(int(n.removeprefix("batch=")) for n in list_names(spark, folder) if n.startswith("batch="))
    cut = _state(spark, root, "clock", last).first()["cut"]
    tail = _state(spark, root, "ordered_tail", last)
    schema = tail.select(*LINE).withColumn("block_no", F.lit(0)).withColumn("batch_id", F.lit(0).cast("bigint")).schema
    return _errors_of(_buffered(spark, root, schema, cut, None), tail)[0]
