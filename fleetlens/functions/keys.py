"""Surrogate keys of new rows: numbers after the stored ones, given out without a global sort or a count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that number their rows side by side.
RANGES = 256
#: Reserved for the Unknown member.
RESERVED = 1


def allocate(new: DataFrame, keys: Sequence[Column], stored: DataFrame, id_col: str) -> DataFrame:
    """``new`` (one row per key, none of them stored) with ``id_col``, a number above the largest stored one.

    Rows are dealt into ``RANGES`` by a hash of their key, each range counts its rows in the order of their keys, and the
    counts interleave: row ``n`` of range ``r`` is number ``n * RANGES + r``. So no two rows get one id, none gets a stored
    one or the reserved one, the same tables give the same ids on any number of tasks, and a load of ``n`` rows takes about
    ``n + RANGES`` numbers. A number that the column's type cannot hold is an error.
    """
    kind = stored.schema[id_col].dataType
    last = stored.agg(F.greatest(F.coalesce(F.max(id_col), F.lit(0)).cast("bigint"), F.lit(RESERVED).cast("bigint")).alias("last")).scalar()
    dealt = new.withColumn("_range", F.pmod(F.xxhash64(*keys), F.lit(RANGES)))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    return dealt.select(*[c for c in new.columns if c != id_col], (last + (place - 1) * RANGES + F.col("_range") + 1).cast(kind).alias(id_col))
