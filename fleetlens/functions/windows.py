"""Previous-row access that stays balanced when one key owns much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hour_slice(ts: Column) -> Column:
    """Number of the clock hour of a zone-less time; independent of the session zone."""
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")) * 24 + F.hour(ts)


def month_slice(ts: Column) -> Column:
    return F.year(ts) * 12 + F.month(ts)


def sliced_lag(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_of: Column,
    carry: dict[str, Column],
) -> DataFrame:
    """Add ``name = previous row's value`` columns for each ``carry`` entry.

    A plain window over ``keys`` puts a whole key on one task.  Here the window
    runs over ``(keys, slice)``; ``slice_of`` must be monotone in ``order`` (for
    example the day of the timestamp), so only the first row of each slice
    needs its predecessor from elsewhere.  That row is the last one of the
    previous non-empty slice, found from one pre-aggregated row per slice.
    The result is exact, also across empty slices.
    """
    sliced = df.withColumn("_slice", slice_of)
    packed = F.struct(*[value.alias(name) for name, value in carry.items()])
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)

    tails = sliced.groupBy(*keys, "_slice").agg(F.max_by(packed, F.struct(*order)).alias("_tail"))
    before = tails.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_slice").alias("_k_slice"),
        F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_slice")).alias("_before"),
    ).filter(F.col("_before").isNotNull())

    local = sliced.withColumn("_prev", F.lag(packed).over(inside))
    on = [F.col(k) == F.col(f"_k_{k}") for k in keys] + [F.col("_slice") == F.col("_k_slice")]
    joined = local.join(before, on, "left")
    prev = F.coalesce(F.col("_prev"), F.col("_before"))
    return joined.select(*df.columns, *[prev[name].alias(name) for name in carry])


def latest_by(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """One row per key: the values at the largest ``order``; combines on the map side.

    ``order`` is unique per key (one capture a day), so separate picks agree, and fixed-width
    values stay in a hash aggregation.
    """
    return df.groupBy(*keys).agg(*[F.max_by(v, order).alias(v) for v in values])
