"""Monthly roll-ups, trend counts, growth and size-change classes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.columns import avg_big, date_lit, idiv, like_ci, ratio4, yyyymm
from fleetlens.functions.windows import latest_by

UNKNOWN_ID = 1  # fixed value: reserved key of the Unknown member of every seeded dimension
TREND_WINDOW_DAYS = 30

# fixed values: lower bound in GB (exclusive), label, ordinal
SIZE_CHANGE_BANDS = (
    (50, "50GB+ Change", 1),
    (25, "25GB to 50GB Change", 2),
    (15, "15GB to 25GB Change", 3),
    (10, "10GB to 15GB Change", 4),
    (5, "5GB to 10GB Change", 5),
)
SMALL_CHANGE = ("Less Than 5GB Change", 6)


def _month_slice(df: DataFrame, year: int | None, month: int | None) -> DataFrame:
    """Keep one calendar month with a range predicate the scan can use; all months when unset."""
    if year is None or month is None:
        return df
    first = dt.date(year, month, 1)
    after = dt.date(year + month // 12, month % 12 + 1, 1)
    return df.filter((F.col("DateCaptured") >= date_lit(first)) & (F.col("DateCaptured") < date_lit(after)))


def _skip_loaded(df: DataFrame, existing: DataFrame | None) -> DataFrame:
    """Leave out periods that the target already holds (one row per loaded month)."""
    if existing is None:
        return df
    return df.join(existing.select("YearMonth").distinct(), "YearMonth", "left_anti")


def monthly_database_size(
    size: DataFrame, year: int | None = None, month: int | None = None, existing: DataFrame | None = None,
) -> DataFrame:
    rows = _month_slice(size, year, month).withColumn("YearMonth", yyyymm("DateCaptured"))
    return _skip_loaded(rows, existing).groupBy("DatabaseID", "YearMonth", "FileType").agg(
        avg_big("FileSize_mb").alias("FileSize_mb"))


def monthly_volume_space(
    space: DataFrame, year: int | None = None, month: int | None = None, existing: DataFrame | None = None,
) -> DataFrame:
    rows = _month_slice(space, year, month).withColumn("YearMonth", yyyymm("DateCaptured"))
    return _skip_loaded(rows, existing).groupBy("DiskVolumeID", "YearMonth").agg(
        avg_big("SpaceUsed_mb").alias("SpaceUsed_mb"), avg_big("TotalSpace_mb").alias("TotalSpace_mb"))


def month_sums(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Mergeable form of a monthly average: ``keys``, YearMonth, ``Days`` and the sum of each value; sums of parts add up to those of the whole."""
    return rows.groupBy(*keys, yyyymm("DateCaptured").alias("YearMonth")).agg(
        F.count(F.lit(1)).alias("Days"), *(F.sum(v).alias(v) for v in values))


def changed_sums(sums: DataFrame, before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Stored sums after some days came late or were corrected: ``before`` are the stored rows of those days, ``after`` the new ones.

    Only the days that change are read, not their months. A key without any day left goes.
    """
    added, gone = month_sums(after, keys, values), month_sums(before, keys, values)
    less = gone.select(*keys, "YearMonth", *((-F.col(c)).alias(c) for c in ("Days", *values)))
    merged = sums.unionByName(added).unionByName(less).groupBy(*keys, "YearMonth").agg(*(F.sum(c).alias(c) for c in ("Days", *values)))
    return merged.filter("Days > 0")


def averages(sums: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return sums.select(*keys, "YearMonth", *(idiv(F.col(v), F.col("Days")).alias(v) for v in values))


def _alive(df: DataFrame, as_of: str) -> DataFrame:
    day = date_lit(as_of)
    return df.filter((F.col("DiscoveryOn") <= day) & (F.col("LastUpdated") >= F.date_sub(day, TREND_WINDOW_DAYS)))


def _period(as_of: str) -> Column:
    return yyyymm(date_lit(as_of)).alias("YearMonth")


def trend_servers(servers: DataFrame, os: DataFrame, as_of: str) -> DataFrame:
    known = os.filter(F.col("OperatingSystemID") != UNKNOWN_ID).select("OperatingSystemID")
    counts = _alive(servers, as_of).groupBy("OperatingSystemID").agg(F.count(F.lit(1)).alias("ServerCount"))
    return counts.join(known, "OperatingSystemID").select(_period(as_of), "OperatingSystemID", "ServerCount")


def trend_instances(instances: DataFrame, versions: DataFrame, as_of: str) -> DataFrame:
    counts = _alive(instances, as_of).groupBy("SQLInstanceVersionID", "SQLInstanceEnviornment").agg(
        F.count(F.lit(1)).alias("InstanceCount"))
    known = versions.select(F.col("SQLVersionID").alias("ServerVersionID"))
    return counts.join(known, counts["SQLInstanceVersionID"] == known["ServerVersionID"]).select(
        _period(as_of), "ServerVersionID", F.col("SQLInstanceEnviornment").alias("Environment"), "InstanceCount")


def first_replicas(ag_instances: DataFrame) -> DataFrame:
    """Lowest instance id of every availability group."""
    return ag_instances.groupBy("AGID").agg(F.min("SQLInstanceID").alias("SQLInstanceID"))


def latest_database_total(size: DataFrame) -> DataFrame:
    """Total size of each database on its own last captured day, in two partial aggregations."""
    per_day = size.groupBy("DatabaseID", "DateCaptured").agg(F.sum("FileSize_mb").alias("TotalSize"))
    return latest_by(per_day, ["DatabaseID"], "DateCaptured", ["TotalSize"])


def trend_databases(
    databases: DataFrame, instances: DataFrame, versions: DataFrame, size: DataFrame,
    ag_instances: DataFrame, ag_databases: DataFrame, as_of: str,
) -> DataFrame:
    """Count and latest size by version and environment; a grouped database counts once."""
    in_group = ag_databases.select("DatabaseID").distinct().withColumn("_in_group", F.lit(True))
    first = first_replicas(ag_instances).select("SQLInstanceID").distinct().withColumn("_first", F.lit(True))
    alive = _alive(databases.filter("IsMonitored"), as_of).select("DatabaseID", "SQLInstanceID")
    counted = (
        alive.join(in_group, "DatabaseID", "left").join(first, "SQLInstanceID", "left")
        .filter(F.col("_in_group").isNull() | F.col("_first").isNotNull())
        .join(latest_database_total(size), "DatabaseID")
    )
    inst = instances.select("SQLInstanceID", F.col("SQLInstanceVersionID").alias("SQLVersionID"), "SQLInstanceEnviornment")
    return (
        counted.join(inst, "SQLInstanceID").join(versions.select("SQLVersionID"), "SQLVersionID")
        .groupBy("SQLVersionID", F.col("SQLInstanceEnviornment").alias("Environment"))
        .agg(F.count(F.lit(1)).alias("DatabaseCount"), F.sum("TotalSize").alias("DatabaseTotalSize"))
        .select(_period(as_of), "SQLVersionID", "Environment", "DatabaseCount", "DatabaseTotalSize")
    )


def growth_percent(
    df: DataFrame, keys: list[str], order_col: str, size_col: str,
    growth_name: str = "GrowthInPercent", change_name: str | None = None,
) -> DataFrame:
    """Change against the previous capture of the same key: ``1 - previous / current``.

    The fact holds one row per key and period, so a key's window is bounded by
    the number of calendar days; no key can outgrow it however skewed the fleet is.
    """
    w = Window.partitionBy(*keys).orderBy(order_col)
    rows = df.withColumn("_prev", F.lag(size_col).over(w))
    change = F.col(size_col) - F.col("_prev")
    if change_name:
        rows = rows.withColumn(change_name, change)
    return rows.withColumn(growth_name, ratio4(change, F.col(size_col))).drop("_prev")


def size_change_band(change_gb: Column) -> Column:
    out = F.lit(SMALL_CHANGE[0])
    for floor, label, _ in reversed(SIZE_CHANGE_BANDS):
        out = F.when(change_gb > floor, F.lit(label)).otherwise(out)
    return out


def size_change_order(label: Column) -> Column:
    out = F.lit(SMALL_CHANGE[1])
    for _, name, key in SIZE_CHANGE_BANDS:
        out = F.when(label == name, F.lit(key)).otherwise(out)
    return out


def size_change_category(
    instance_view: DataFrame, databases: DataFrame, size: DataFrame, as_of: str,
) -> DataFrame:
    """Absolute day-over-day size change per instance, put into bands; no change is left out.

    Reads two day partitions of the size fact and sums per database before any join.
    """
    today = date_lit(as_of)
    yesterday = F.date_sub(today, 1)
    two_days = size.filter((F.col("DateCaptured") >= yesterday) & (F.col("DateCaptured") <= today))

    def on(day: Column) -> Column:
        return F.sum(F.when(F.col("DateCaptured") == day, F.col("FileSize_mb")))

    per_db = two_days.groupBy("DatabaseID").agg(on(yesterday).alias("_before"), on(today).alias("_now"))
    per_instance = (
        per_db.join(databases.select("DatabaseID", "SQLInstanceID"), "DatabaseID")
        .groupBy("SQLInstanceID")
        .agg(F.sum("_before").alias("_before"), F.sum("_now").alias("_now"))
        .filter(F.col("_before").isNotNull() & F.col("_now").isNotNull() & (F.col("_before") != F.col("_now")))
        .withColumn("ChangeDoD_GB", F.abs(F.col("_now") - F.col("_before")) / F.lit(1024.0))
    )
    names = instance_view.select("SQLInstanceID", "ComputerName", "SQLInstanceName")
    return per_instance.join(names, "SQLInstanceID").select(
        size_change_band(F.col("ChangeDoD_GB")).alias("VolumeOfChangeCategory"),
        "SQLInstanceID", "ComputerName", "SQLInstanceName", "ChangeDoD_GB")
