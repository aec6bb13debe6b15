"""Conformed views over the inventory and the server-group hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.columns import (
    apply_filters, ci_eq, date_lit, idiv, instance_label, like_ci, percent_text,
)
from fleetlens.sources.shared import delete_path, shared_dir

NEVER_FULL = 99999.0  # fixed value: days-until-full of a volume that does not grow
GROUP_PATH_CHARS = 75  # fixed value: stored length of a group path


def with_owner(df: DataFrame, servers: DataFrame, clusters: DataFrame, *extra: str, entity: str) -> DataFrame:
    """Add ``ComputerName`` (and ``extra`` server columns) of the server or cluster that owns each row.

    Exactly one of ``ServerID`` / ``SQLClusterID`` is expected; a row with both or neither
    gets a null owner.  Rows that cannot match get a join key from ``entity``, a column that
    varies by row: null keys would all meet in one task when the dimension is too big to broadcast.
    """
    s = servers.select(
        F.col("ServerID").alias("_server_id"), F.col("ServerName").alias("_server_name"), *extra)
    c = clusters.select(F.col("SQLClusterID").alias("_cluster_id"), F.col("SQLClusterName").alias("_cluster_name"))
    on_server = F.col("ServerID").isNotNull() & F.col("SQLClusterID").isNull()
    on_cluster = F.col("SQLClusterID").isNotNull() & F.col("ServerID").isNull()
    spread = F.hash(entity)
    server_key = F.when(on_server, F.col("ServerID")).otherwise(spread.cast("bigint"))
    cluster_key = F.when(on_cluster, F.col("SQLClusterID")).otherwise(spread)
    return (
        df.join(s, (server_key == F.col("_server_id")) & on_server, "left")
        .join(c, (cluster_key == F.col("_cluster_id")) & on_cluster, "left")
        .withColumn("ComputerName", F.coalesce("_server_name", "_cluster_name"))
        .drop("_server_id", "_server_name", "_cluster_id", "_cluster_name")
    )


def instance_view(instances: DataFrame, versions: DataFrame, servers: DataFrame, clusters: DataFrame) -> DataFrame:
    """Instances with version attributes, owner and the ``Computer\\Instance`` label."""
    v = versions.select(
        F.col("SQLVersionID").alias("SQLInstanceVersionID"), "SQLVersion", "SQLMajorVersion", "SQLMinorVersion")
    owned = with_owner(instances.join(v, "SQLInstanceVersionID"), servers, clusters, entity="SQLInstanceID")
    return owned.select(
        "SQLInstanceID",
        instance_label("ComputerName", "SQLInstanceName").alias("ServerInstance"),
        "ComputerName", "SQLInstanceName", "SQLInstanceVersionID", "SQLVersion",
        "SQLMajorVersion", "SQLMinorVersion", "SQLInstanceBuild", "SQLInstanceEdition",
        "SQLInstanceType", "SQLInstanceEnviornment", "IsMonitored", "DiscoveryOn", "LastUpdated",
    )


def volume_forecast(space: DataFrame, volumes: DataFrame, servers: DataFrame, clusters: DataFrame) -> DataFrame:
    """Disk runway per monitored volume from its first and last snapshot.

    One aggregation pass over the daily fact replaces two self-joins; the joins
    to the dimensions run on one row per volume.
    """
    # Fixed-width buffers keep this a hash aggregation; a struct or text value would need a sort.
    span = space.groupBy("DiskVolumeID").agg(
        F.min_by("SpaceUsed_mb", "DateCaptured").alias("first_used"),
        F.max_by("SpaceUsed_mb", "DateCaptured").alias("last_used"),
        F.max_by("TotalSpace_mb", "DateCaptured").alias("last_total"),
        F.min("DateCaptured").alias("first_date"),
        F.max("DateCaptured").alias("last_date"),
        F.count(F.lit(1)).alias("DaysHistory"),
    )
    monitored = volumes.filter("IsMonitored").select("DiskVolumeID", "DiskVolumeName", "ServerID", "SQLClusterID")
    rows = with_owner(monitored.join(span, "DiskVolumeID"), servers, clusters, "IsPhysical", entity="DiskVolumeID")

    used, total = F.col("last_used"), F.col("last_total")
    days = F.datediff("last_date", "first_date") + 1
    change = (used - F.col("first_used") + 1).cast("double") / days
    gb = F.lit(1024.0)
    return rows.withColumn("Daily_AvgChange_mb", change).select(
        "ComputerName", "ServerID", "SQLClusterID", "DiskVolumeID", "IsPhysical", "DiskVolumeName",
        (total / gb).alias("TotalSpace_gb"),
        (used / gb).alias("SpaceUsed_gb"),
        ((total - used) / gb).alias("FreeSpace_gb"),
        percent_text(used + 1, total + 1).alias("SpaceUsed_Percent"),
        "Daily_AvgChange_mb", "DaysHistory",
        (F.col("Daily_AvgChange_mb") * 90 / gb).alias("Est_90Days_gb"),
        (F.col("Daily_AvgChange_mb") * 180 / gb).alias("Est_180Days_gb"),
        F.when(F.col("Daily_AvgChange_mb") <= 0, F.lit(NEVER_FULL))
        .otherwise((total - used) / F.col("Daily_AvgChange_mb")).alias("DaysUntil_OutOfSpace"),
    )


def walk_up(groups: DataFrame, own: Column, chars: int | None = None) -> DataFrame:
    """``node, text, level`` of every group below a root: ``own`` of all groups from the root down to it, joined, and their number.

    Path doubling: each row knows the ancestor it has been traced to and the text in between. A round joins the rows with each other,
    which doubles all distances, so a tree of depth ``d`` takes ``log2(d)`` rounds, whatever its shape. Rounds are written tables, so
    no plan grows. Groups under a parent that does not exist, or on a cycle, never reach a root and are left out; the
    number of groups bounds the rounds. With ``chars`` only so many characters are kept, and at no time more.
    """
    spark = groups.sparkSession
    cut = (lambda text: F.substring(text, 1, chars)) if chars else (lambda text: text)
    state = groups.select(F.col("server_group_id").alias("node"), F.col("parent_id").alias("up"), cut(own).alias("text"), F.lit(1).alias("level"))
    left, last = max(1, groups.count()).bit_length() + 1, None
    while left:
        path = shared_dir(spark, "walk")
        state.write.parquet(path)
        if last:
            delete_path(spark, last)
        state, last = spark.read.schema(state.schema).parquet(path), path
        traced, going = state.filter("up is null"), state.filter("up is not null")
        if going.isEmpty():
            break
        over = state.select(F.col("node").alias("_node"), F.col("up").alias("_up"), F.col("text").alias("_text"), F.col("level").alias("_level"))
        state = traced.unionByName(going.join(over, F.col("up") == F.col("_node")).select(
            "node", F.col("_up").alias("up"), cut(F.concat("_text", "text")).alias("text"), (F.col("level") + F.col("_level")).alias("level")))
        left -= 1
    return state.filter("up is null").drop("up")


def group_paths(groups: DataFrame, path_chars: int = GROUP_PATH_CHARS) -> DataFrame:
    """``Root\\Child\\...`` path of every group, cut to ``path_chars``, by default the stored path length.

    Two long paths can become equal by the cut; joins therefore go by ``GroupID``.
    """
    own = F.when(F.col("parent_id").isNull(), F.col("name")).otherwise(F.concat(F.lit("\\"), F.col("name")))
    return walk_up(groups, own, int(path_chars)).select(F.col("node").alias("GroupID"), F.col("text").alias("GroupName"))


def group_tree(groups: DataFrame) -> DataFrame:
    """Groups with level, indented name and a sort path; the root is shown as ALL."""
    top = F.col("parent_id").isNull()
    walked = walk_up(groups, F.when(top, "ALL").otherwise(F.concat(F.lit(" | "), F.col("name"))))
    rows = groups.select("parent_id", "server_group_id", "name").join(walked, F.col("server_group_id") == F.col("node"))
    return rows.select(
        "parent_id", "server_group_id", F.when(top, "ALL").otherwise(F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.col("name"))).alias("GroupName"),
        F.col("level").alias("GroupLevel"), F.col("text").alias("Sort"), F.when(top, "").otherwise(F.col("name")).alias("GroupValue"))


def group_list(paths: DataFrame, monitored: DataFrame, name_like: str | None = None) -> DataFrame:
    """Registered groups with their monitoring flag, monitored ones first."""
    rows = paths.join(monitored.select("GroupID", "IsMonitored"), "GroupID")
    rows = apply_filters(rows, like_ci("GroupName", f"%{name_like}%") if name_like else None)
    return rows.select("GroupID", "GroupName", "IsMonitored").orderBy(F.desc("IsMonitored"), "GroupName")


def monitored_instances(
    paths: DataFrame, monitored: DataFrame, registered: DataFrame,
    server: str | None = None, group_like: str | None = None,
) -> DataFrame:
    """Registered instances in monitored groups, names in lower case.

    ``registered`` has ``server_group_id``, ``ServerInstance`` and optionally
    ``ServerInstanceConnectionString`` (defaults to the name).
    """
    if "ServerInstanceConnectionString" not in registered.columns:
        registered = registered.withColumn("ServerInstanceConnectionString", F.col("ServerInstance"))
    watched = monitored.filter("IsMonitored").select("GroupID")
    groups = apply_filters(
        paths.join(watched, "GroupID"), like_ci("GroupName", f"%{group_like}%") if group_like else None)
    rows = registered.join(groups, registered["server_group_id"] == groups["GroupID"])
    rows = apply_filters(rows, F.lower("ServerInstance") == server.lower() if server else None)
    return rows.select(
        "GroupName", F.lower("ServerInstance").alias("ServerInstance"),
        F.lower("ServerInstanceConnectionString").alias("ServerInstanceConnectionString"),
    )


def group_instances(paths: DataFrame, registered: DataFrame, group: str = "", group_id: int | None = None) -> DataFrame:
    """Instances of one group, or of every group.

    ``group_id`` names a group for certain; a path may stand for several long ones, as it is cut, and compares without case.
    """
    chosen = F.col("GroupID") == group_id if group_id is not None else ci_eq("GroupName", group) if group else None
    paths = apply_filters(paths, chosen)
    return registered.join(paths, registered["server_group_id"] == paths["GroupID"]).select(
        F.col("ServerInstance").alias("server_name"), "GroupName")
