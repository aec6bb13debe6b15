"""Global places of rows in an order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.native import Scratch, stored


def ranked(rows: DataFrame, group: str, *order: Column, scratch: Scratch | None = None) -> DataFrame:
    """Adds ``rank``, the 0-based place of each row in ``order`` within its ``group``, and ``size``, the rows of the group.

    ``group`` is a column without nulls. Rows are dealt by ranges of (group, order), so a group of any size is spread over
    tasks; the only window runs over one row per group and range. Rows should be narrow and stored, as ranges are sampled.
    With ``scratch`` the stored ranges go with its tables.
    """
    keys = [F.col(group), *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    dealt = (scratch.stored if scratch else stored)(dealt.withColumn("_range", F.shiftright("_at", 33)), "ranges")
    runs = dealt.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(group, "_range", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("size"))
    return dealt.join(runs, [group, "_range"]).withColumn("rank", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")
