"""Shuffles whose tasks stay small in memory."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by a hash of ``keys`` into as many parts as the session shuffles into.

    For an aggregation over nearly distinct rows. Over dealt rows Spark needs no aggregation before the shuffle,
    which would sort or hash a whole input split for nothing. The number is given, so adaptive execution does not
    join parts: it goes by compressed bytes, of which 64 MB are millions of narrow rows in a sort or hash table.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
