"""State maintenance: one merge per dimension and fact, all returning the full new target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.columns import ci, ci_eq, date_lit
from fleetlens.functions.keys import allocate
from fleetlens.operators.rollup import UNKNOWN_ID
from fleetlens.operators.upsert import archive_upsert, insert_missing, join_ci, missing_rows, upsert


def _new_row(as_of: str, **extra: Column) -> dict[str, Column]:
    return {"DiscoveryOn": date_lit(as_of), "IsMonitored": F.lit(True), **extra}


# ---- applications and databases -------------------------------------------------

def merge_applications(applications: DataFrame, feed: DataFrame) -> DataFrame:
    return upsert(applications, feed, ["ApplicationName"], ["ApplicationOwner"], id_col="ApplicationID")


def merge_databases(databases: DataFrame, feed: DataFrame, applications: DataFrame, as_of: str) -> DataFrame:
    named = join_ci(
        feed.select("SQLInstanceID", "DatabaseName", "DatabaseState", "ApplicationName").distinct(),
        applications.select("ApplicationName", "ApplicationID"), ["ApplicationName"])
    return upsert(
        databases, named, ["SQLInstanceID", "DatabaseName"], ["DatabaseState", "ApplicationID", "ApplicationName"],
        _new_row(as_of), as_of, id_col="DatabaseID")


def merge_database_size(size: DataFrame, feed: DataFrame, databases: DataFrame, as_of: str) -> DataFrame:
    """Sizes of monitored databases for the day; only that day's partition of the target is rewritten."""
    day = date_lit(as_of)
    known = databases.filter("IsMonitored").select("DatabaseID", "SQLInstanceID", "DatabaseName")
    rows = join_ci(
        feed.select("SQLInstanceID", "DatabaseName", "FileType", "FileSize_mb"), known, ["SQLInstanceID", "DatabaseName"]).withColumn("DateCaptured", day)
    today = size.filter(F.col("DateCaptured") == day)
    merged = upsert(today, rows, ["DatabaseID", "DateCaptured", "FileType"], ["FileSize_mb"])
    return size.filter(F.col("DateCaptured") != day).unionByName(merged)


def merge_ag_databases(
    links: DataFrame, feed: DataFrame, databases: DataFrame, groups: DataFrame, ag_instances: DataFrame, as_of: str,
) -> DataFrame:
    known = databases.filter("IsMonitored").select("DatabaseID", "SQLInstanceID", "DatabaseName")
    data = feed.filter(ci_eq("FileType", "Data")).select("SQLInstanceID", "DatabaseName", "AGGuid")
    rows = (
        join_ci(join_ci(data, known, ["SQLInstanceID", "DatabaseName"]), groups.select("AGGuid", "AGID"), ["AGGuid"])
        .join(ag_instances.select("AGID", "SQLInstanceID", "AGInstanceID"), ["AGID", "SQLInstanceID"])
        .select("AGInstanceID", "DatabaseID").distinct())
    return upsert(links, rows, ["AGInstanceID", "DatabaseID"], (), _new_row(as_of), as_of)


# ---- availability groups ---------------------------------------------------------

def merge_availability_groups(groups: DataFrame, feed: DataFrame, as_of: str) -> DataFrame:
    return upsert(groups, feed.select("AGName", "AGGuid").distinct(), ["AGName", "AGGuid"], (), _new_row(as_of), as_of, id_col="AGID")


def resolve_replicas(feed: DataFrame, groups: DataFrame, servers: DataFrame, instances: DataFrame) -> DataFrame:
    """Instance id of every replica: looked up by host and instance name, else the reporting instance."""
    reported = F.when(ci_eq("InstanceName", "mssqlserver"), F.col("ComputerName")).otherwise(
        F.concat("ComputerName", F.lit("\\"), "InstanceName"))
    hosts = servers.select("ServerID", ci("ServerName").alias("_host"))
    names = instances.filter(F.col("ServerID").isNotNull()).select(
        F.col("SQLInstanceID").alias("_other_id"), "ServerID", ci("SQLInstanceName").alias("_inst"))
    others = hosts.join(names, "ServerID").select("_host", "_inst", "_other_id")
    is_other = ci("ServerInstance") != ci(reported)
    # Null out the key of the reporting replica itself so that it keeps its own id.
    keyed = feed.withColumn("_h", F.when(is_other, ci("ComputerName"))).withColumn("_i", F.when(is_other, ci("InstanceName")))
    rows = join_ci(
        keyed.join(others, (F.col("_h") == F.col("_host")) & (F.col("_i") == F.col("_inst")), "left"),
        groups.select("AGGuid", "AGName", "AGID"), ["AGGuid", "AGName"], "left")
    return rows.select("AGID", F.coalesce("_other_id", "SQLInstanceID").alias("SQLInstanceID"), "ReplicaRole")


def merge_ag_replicas(
    ag_instances: DataFrame, feed: DataFrame, groups: DataFrame, servers: DataFrame, instances: DataFrame, as_of: str,
) -> DataFrame:
    rows = resolve_replicas(feed, groups, servers, instances)
    return upsert(ag_instances, rows, ["AGID", "SQLInstanceID"], ["ReplicaRole"], _new_row(as_of), as_of, id_col="AGInstanceID")


# ---- jobs, errors, services, properties ------------------------------------------

def merge_job_categories(categories: DataFrame, feed: DataFrame) -> DataFrame:
    return insert_missing(categories, feed.select(F.col("CategoryName").alias("SQLJobCategoryName")), ["SQLJobCategoryName"], id_col="SQLJobCategoryID")


def merge_jobs(jobs: DataFrame, feed: DataFrame, categories: DataFrame, as_of: str) -> DataFrame:
    rows = join_ci(
        feed.select("SQLInstanceID", "JobName", "CategoryName").distinct(),
        categories.select(F.col("SQLJobCategoryName").alias("CategoryName"), "SQLJobCategoryID"), ["CategoryName"])
    rows = rows.select("SQLInstanceID", F.col("JobName").alias("SQLJobName"), "SQLJobCategoryID")
    return upsert(jobs, rows, ["SQLInstanceID", "SQLJobName"], ["SQLJobCategoryID"], _new_row(as_of), as_of, id_col="SQLJobID")


def append_job_history(history: DataFrame, feed: DataFrame, jobs: DataFrame, dedupe: bool = True) -> DataFrame:
    """Runs of the feed joined to their job and added; a run already stored is not doubled."""
    rows = job_runs(feed, jobs)
    return history.unionByName(new_job_runs(history, rows) if dedupe else rows)


def job_runs(feed: DataFrame, jobs: DataFrame) -> DataFrame:
    return join_ci(
        feed, jobs.select("SQLInstanceID", F.col("SQLJobName").alias("JobName"), "SQLJobID"), ["SQLInstanceID", "JobName"]
    ).select("SQLJobID", "ExecutionDateTime", "Duration", "JobStatus")


def new_job_runs(history: DataFrame, rows: DataFrame) -> DataFrame:
    """Runs that are not stored yet; only the days of the batch are compared, so stored partitions prune."""
    days = rows.agg(F.min("ExecutionDateTime").alias("low"), F.max("ExecutionDateTime").alias("high")).first()
    near = history.filter(F.col("ExecutionDateTime").between(F.lit(days["low"]), F.lit(days["high"])))
    return missing_rows(near, rows, ["SQLJobID", "ExecutionDateTime"])


def append_error_log(log: DataFrame, errors: DataFrame) -> DataFrame:
    """Plain append of extracted messages."""
    rows = errors.select("SQLInstanceID", F.col("DateTimeCaptured").alias("DateTime"), F.col("Message").alias("ErrorMsg"))
    return log.select("SQLInstanceID", "DateTime", "ErrorMsg").unionByName(rows)


def merge_services(services: DataFrame, feed: DataFrame, servers: DataFrame, as_of: str) -> DataFrame:
    rows = join_ci(feed.drop("ServerID"), servers.select("ServerName", "ServerID"), ["ServerName"])
    return upsert(
        services, rows, ["ServerID", "ServiceName"],
        ["ServiceAccount", "ServiceVersion", "ServiceBuild", "Status", "StartMode"], _new_row(as_of), as_of, id_col="SQLServiceID")


def merge_property_names(properties: DataFrame, feed: DataFrame) -> DataFrame:
    return insert_missing(properties, feed.select(F.col("PropertyName").alias("ExtendedPropertyName")), ["ExtendedPropertyName"], id_col="ExtendedPropertyID")


def merge_property_values(values: DataFrame, feed: DataFrame, properties: DataFrame, as_of: str) -> DataFrame:
    named = feed.select(
        "SQLInstanceID", F.col("PropertyName").alias("ExtendedPropertyName"), F.col("PropertyValue").alias("ExtendedPropertyValue"))
    rows = join_ci(named, properties.select("ExtendedPropertyName", "ExtendedPropertyID"), ["ExtendedPropertyName"])
    return upsert(
        values, rows, ["SQLInstanceID", "ExtendedPropertyID"], ["ExtendedPropertyValue"], _new_row(as_of), as_of)


# ---- security --------------------------------------------------------------------

def merge_principals(principals: DataFrame, feed: DataFrame, name_col: str, type_col: str) -> DataFrame:
    """Insert-only by (name, type); used for roles and members, server and database level."""
    named = feed.select(F.col(name_col).alias("PrincipalName"), F.col(type_col).alias("PrincipalType")).filter(
        F.col("PrincipalName").isNotNull())
    return insert_missing(principals, named, ["PrincipalName", "PrincipalType"], id_col="PrincipalID")


def resolve_principal(feed: DataFrame, principals: DataFrame, name: str, kind: Column, out: str) -> DataFrame:
    """Add the id of the principal called ``name`` of type ``kind`` (null when unknown)."""
    ids = principals.groupBy(ci("PrincipalName").alias("_pn"), ci("PrincipalType").alias("_pt")).agg(
        F.min("PrincipalID").alias(out))
    return feed.join(ids, (ci(name) == F.col("_pn")) & (ci(kind) == F.col("_pt")), "left").drop("_pn", "_pt")


def merge_server_memberships(
    target: DataFrame, feed: DataFrame, principals: DataFrame, as_of: str, scoped: bool = True,
) -> DataFrame:
    """Touch, insert, then archive.  ``scoped=False`` also archives instances that were not collected."""
    rows = resolve_principal(feed, principals, "RoleName", F.lit("SERVER_ROLE"), "ServerRoleID")
    rows = resolve_principal(rows, principals, "LoginName", F.col("LoginType"), "ServerLoginID")
    keys = ["SQLInstanceID", "ServerRoleID", "ServerLoginID"]
    return archive_upsert(target, rows.select(*keys), keys, as_of, feed.select("SQLInstanceID") if scoped else None, id_col="MembershipID")


def merge_database_memberships(target: DataFrame, feed: DataFrame, principals: DataFrame, as_of: str) -> DataFrame:
    """As the server form, with the orphan flag; only databases that returned rows are archived.

    ``feed`` carries ``DatabaseID``; placeholder rows with a null role are ignored.
    """
    read = feed.filter(F.col("RoleName").isNotNull())
    rows = resolve_principal(read, principals, "RoleName", F.lit("DATABASE_ROLE"), "DatabaseRoleID")
    rows = resolve_principal(rows, principals, "UserName", F.col("UserType"), "DatabaseUserID")
    keys = ["DatabaseID", "DatabaseRoleID", "DatabaseUserID"]
    return archive_upsert(target, rows.select(*keys, "IsOrphaned"), keys, as_of, read.select("DatabaseID"), ["IsOrphaned"], id_col="MembershipID")


SERVER_GRANT_KEYS = ["SQLInstanceID", "GranteeID", "GrantorID", "ObjectType", "ObjectID", "Access", "PermissionName"]
DATABASE_GRANT_KEYS = ["DatabaseID", "GranteeID", "GrantorID", "ObjectType", "ObjectName", "Access", "PermissionName"]


def resolve_grants(feed: DataFrame, principals: DataFrame) -> DataFrame:
    """Grantee and grantor ids, each by its own name and type."""
    rows = resolve_principal(feed, principals, "GranteeName", F.col("GranteeType"), "GranteeID")
    return resolve_principal(rows, principals, "GrantorName", F.col("GrantorType"), "GrantorID")


def merge_server_permissions(target: DataFrame, feed: DataFrame, as_of: str, scoped: bool = True) -> DataFrame:
    """``feed`` has resolved ids (see :func:`resolve_grants`); seven-column match."""
    return archive_upsert(
        target, feed.select(*SERVER_GRANT_KEYS), SERVER_GRANT_KEYS, as_of, feed.select("SQLInstanceID") if scoped else None, id_col="PermissionID")


def merge_database_permissions(target: DataFrame, feed: DataFrame, as_of: str) -> DataFrame:
    return archive_upsert(target, feed.select(*DATABASE_GRANT_KEYS), DATABASE_GRANT_KEYS, as_of, feed.select("DatabaseID"), id_col="PermissionID")


# ---- groups, servers, clusters, instances ----------------------------------------

def merge_group_registry(registry: DataFrame, groups: DataFrame) -> DataFrame:
    """New groups start unmonitored (inferred rule)."""
    return insert_missing(
        registry, groups.select(F.col("server_group_id").alias("GroupID")), ["GroupID"], {"IsMonitored": F.lit(False)})


def set_group_monitoring(registry: DataFrame, paths: DataFrame, group_name: str, monitored: bool) -> DataFrame:
    chosen = paths.filter(ci_eq("GroupName", group_name)).select("GroupID", F.lit(monitored).alias("_flag"))
    return registry.join(chosen, "GroupID", "left").select(
        "GroupID", F.coalesce("_flag", "IsMonitored").alias("IsMonitored"))


def add_operating_systems(os: DataFrame, feed: DataFrame) -> DataFrame:
    """Operating systems that the dimension lacks, with a short name without the word Server."""
    names = feed.filter(F.col("OperatingSystemName").isNotNull()).select(
        "OperatingSystemName",
        F.replace(F.col("OperatingSystemName"), F.lit("Windows Server "), F.lit("Windows ")).alias("OperatingSystemShortName"))
    return insert_missing(os, names, ["OperatingSystemName"], id_col="OperatingSystemID")


def merge_servers(servers: DataFrame, feed: DataFrame, os: DataFrame, as_of: str) -> DataFrame:
    """Name-keyed add or update; an unknown operating system maps to the Unknown member."""
    rows = join_ci(feed, os.select("OperatingSystemName", "OperatingSystemID"), ["OperatingSystemName"], "left").withColumn(
        "OperatingSystemID", F.coalesce("OperatingSystemID", F.lit(UNKNOWN_ID)))
    return upsert(
        servers, rows, ["ServerName"],
        ["OperatingSystemID", "ProcessorName", "NumberOfCores", "NumberOfLogicalCores", "Memory_mb", "PageFile_mb", "IsPhysical"],
        _new_row(as_of), as_of, id_col="ServerID")


def merge_clusters(clusters: DataFrame, feed: DataFrame, as_of: str) -> DataFrame:
    return upsert(clusters, feed.select("SQLClusterName"), ["SQLClusterName"], (), _new_row(as_of), as_of, id_col="SQLClusterID")


def merge_cluster_nodes(nodes: DataFrame, feed: DataFrame) -> DataFrame:
    """``feed``: SQLClusterID, SQLNodeID, IsActiveNode."""
    return upsert(nodes, feed, ["SQLClusterID", "SQLNodeID"], ["IsActiveNode"], {})


def resolve_version(instances: DataFrame, versions: DataFrame, match: str = "number") -> DataFrame:
    """As-of lookup: the version row with the highest build not above the instance's build, else Unknown.

    ``match="number"`` compares major and minor numbers; ``match="label"`` compares the
    product label (``SQLVersion`` of the instance) with the part of the version name it must start with.
    Versions become half-open build ranges, so an instance meets exactly one of them
    and no candidate pairs are produced.
    """
    if match == "number":
        keys = ["SQLBuild_Major", "SQLBuild_Minor"]
        dim = versions.select(
            "SQLVersionID", F.col("SQLMajorVersion").alias(keys[0]), F.col("SQLMinorVersion").alias(keys[1]), "SQLBuild")
    elif match == "label":
        # Every word-boundary prefix of a version name is a label that would match it.
        keys = ["SQLVersion"]
        words = F.split(F.col("SQLVersion"), " ")
        prefixes = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, 1, i), " "))
        dim = versions.select("SQLVersionID", "SQLBuild", F.explode(prefixes).alias("SQLVersion"))
    else:
        raise ValueError(f"match must be 'number' or 'label', not {match!r}")
    by_build = dim.groupBy(*keys, "SQLBuild").agg(F.max("SQLVersionID").alias("_version_id"))
    w = Window.partitionBy(*keys).orderBy("SQLBuild")
    ranges = by_build.withColumn("_next", F.lead("SQLBuild").over(w)).select(
        *[F.col(k).alias(f"_v_{k}") for k in keys], F.col("SQLBuild").alias("_from"), "_next", "_version_id")
    on = [F.col(k) == F.col(f"_v_{k}") for k in keys]
    on += [F.col("SQLBuild_Build") >= F.col("_from"), F.col("_next").isNull() | (F.col("SQLBuild_Build") < F.col("_next"))]
    return instances.join(ranges, on, "left").select(
        *instances.columns, F.coalesce("_version_id", F.lit(UNKNOWN_ID)).alias("SQLInstanceVersionID"))


def merge_instances(instances: DataFrame, feed: DataFrame, as_of: str) -> DataFrame:
    """Keyed by owner and name; ``feed`` has a resolved version (see :func:`resolve_version`)."""
    owner = ["SQLInstanceName", "_server", "_cluster"]

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("_server", F.coalesce(F.col("ServerID"), F.lit(-1))).withColumn(
            "_cluster", F.coalesce(F.col("SQLClusterID"), F.lit(-1)))

    return upsert(
        keyed(instances), keyed(feed), owner,
        ["SQLInstanceVersionID", "SQLInstanceBuild", "SQLInstanceEdition", "SQLInstanceType", "SQLInstanceEnviornment"],
        _new_row(as_of), as_of, id_col="SQLInstanceID").drop("_server", "_cluster")


def set_monitoring(df: DataFrame, key: str, value, monitored: bool) -> DataFrame:
    """Switch the monitoring flag of one entity; names compare without case and padding."""
    same = ci_eq(key, value) if isinstance(value, str) else F.col(key) == value
    return df.withColumn("IsMonitored", F.when(same, F.lit(monitored)).otherwise(F.col("IsMonitored")))


# ---- volumes ---------------------------------------------------------------------

SERVER_ONLY_VOLUMES = ("c:", "d:")  # fixed values: always owned by the server


def volume_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"\\$", "")


def attribute_volumes(feed: DataFrame, volumes: DataFrame, nodes: DataFrame, folders: DataFrame) -> DataFrame:
    """Decide the owner of every reported volume.

    ``feed``: ServerID, SQLClusterID (0 when not clustered), Name.  ``folders``:
    SQLClusterID, FolderName of data and backup folders.  A folder lies on a
    volume when the volume is one of the folder's leading path segments; those
    segments are joined by equality, so no folder is compared with every volume.
    Clusters are looked up only for the volumes that clustered servers report, so no
    table of every cluster volume on every node arises, and the volume name that all
    servers share (C:) is no join key with the cluster.
    ``Action`` is one of keep_server, keep_cluster, insert_server,
    insert_cluster, reparent, drop_server_copy or skip.
    """
    rows = feed.withColumn("DiskVolumeName", volume_name(F.col("Name")))
    named = volumes.withColumn("_vol", F.lower("DiskVolumeName"))

    def flag(df: DataFrame, name: str, **cols: str) -> DataFrame:
        return df.select(*[F.col(c).alias(alias) for alias, c in cols.items()]).distinct().withColumn(name, F.lit(True))

    on_server = flag(named.filter(F.col("ServerID").isNotNull()), "_on_server", DiskVolumeName="_vol", ServerID="ServerID")
    owned = named.filter(F.col("SQLClusterID").isNotNull())
    on_cluster = flag(owned, "_on_cluster", DiskVolumeName="_vol", SQLClusterID="SQLClusterID")
    parts = F.split(F.lower("FolderName"), r"\\")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "\\"))
    in_folder = flag(
        folders.select("SQLClusterID", F.explode(prefixes).alias("_vol")), "_in_folder", SQLClusterID="SQLClusterID", DiskVolumeName="_vol")

    clustered = F.col("SQLClusterID") != 0
    judged = F.coalesce(clustered & ~F.col("DiskVolumeName").isin(*SERVER_ONLY_VOLUMES), F.lit(False))
    # Other clusters of the reporting server that own a volume of the same name, without a server.
    member = nodes.select(F.col("SQLNodeID").alias("ServerID"), F.col("SQLClusterID").alias("_other")).distinct()
    theirs = flag(owned.filter(F.col("ServerID").isNull()), "_owns", DiskVolumeName="_vol", _other="SQLClusterID")
    claims = rows.filter(judged).select("DiskVolumeName", "ServerID", "SQLClusterID").distinct()
    elsewhere = flag(
        claims.join(member, "ServerID").filter(F.col("_other") != F.col("SQLClusterID")).join(theirs, ["DiskVolumeName", "_other"]),
        "_elsewhere", DiskVolumeName="DiskVolumeName", ServerID="ServerID", SQLClusterID="SQLClusterID")

    rows = rows.join(on_server, ["DiskVolumeName", "ServerID"], "left")
    near = (
        rows.filter(judged)
        .join(elsewhere, ["DiskVolumeName", "ServerID", "SQLClusterID"], "left")
        .join(on_cluster, ["DiskVolumeName", "SQLClusterID"], "left")
        .join(in_folder, ["DiskVolumeName", "SQLClusterID"], "left"))
    rows = near.unionByName(rows.filter(~judged), allowMissingColumns=True)
    server = F.col("_on_server").isNotNull()
    cluster = F.col("_on_cluster").isNotNull() & clustered
    folder = F.col("_in_folder").isNotNull() & clustered
    other = F.col("_elsewhere").isNotNull()
    action = (
        F.when(F.col("DiskVolumeName").isin(*SERVER_ONLY_VOLUMES), F.when(server, "keep_server").otherwise("insert_server"))
        .when(other, "skip")
        .when(server & cluster, "drop_server_copy")
        .when(cluster, "keep_cluster")
        .when(server, F.when(folder, "reparent").otherwise("keep_server"))
        .otherwise(F.when(folder, "insert_cluster").otherwise("insert_server")))
    # Of several nodes that report the same shared volume only the first hands its row over; the
    # others drop theirs.  Rows with another action get a group of their own, so a window group is
    # at most the nodes of one cluster, never all servers that have a C: volume.
    rows = rows.withColumn("Action", action)
    alone = F.when(F.col("Action") != "reparent", F.col("ServerID"))
    shared = Window.partitionBy("DiskVolumeName", "SQLClusterID", alone)
    first = F.min(F.when(F.col("Action") == "reparent", F.col("ServerID"))).over(shared)
    final = F.when((F.col("Action") == "reparent") & (F.col("ServerID") != first), "drop_server_copy").otherwise(F.col("Action"))
    return rows.select(*[c for c in feed.columns if c != "Name"], "DiskVolumeName", final.alias("Action"))


def dropped_volumes(volumes: DataFrame, decisions: DataFrame) -> DataFrame:
    """Ids of server copies to remove, for the purge of their space history."""
    gone = decisions.filter(F.col("Action") == "drop_server_copy").select(
        F.col("DiskVolumeName").alias("_vol"), "ServerID").distinct()
    return volumes.withColumn("_vol", F.lower("DiskVolumeName")).join(gone, ["_vol", "ServerID"], "left_semi").select("DiskVolumeID")


def drop_volume_rows(df: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of a volume, daily space or monthly space table without the dropped volumes."""
    return df.join(dropped.distinct(), "DiskVolumeID", "left_anti")


def apply_volume_decisions(volumes: DataFrame, decisions: DataFrame, as_of: str) -> DataFrame:
    """The volume dimension after drops, re-parenting, inserts and touches.

    Each decision becomes one effect on the row it names, (volume, server) or (volume, cluster);
    the effects meet the dimension in a single join.
    """
    day = date_lit(as_of)
    action, none = F.col("Action"), F.lit(-1).cast("bigint")
    on_cluster = action.isin("keep_cluster", "insert_cluster")
    effects = decisions.filter(action != "skip").groupBy(
        F.col("DiskVolumeName").alias("_vol"),
        F.when(on_cluster, none).otherwise(F.col("ServerID").cast("bigint")).alias("_srv"),
        F.when(on_cluster, F.col("SQLClusterID").cast("bigint")).otherwise(none).alias("_clu"),
    ).agg(
        F.max(action.isin("keep_server", "insert_server") | on_cluster).alias("_seen"),
        F.max(action == "drop_server_copy").alias("_drop"),
        F.min(F.when(action == "reparent", F.col("SQLClusterID"))).alias("_to_cluster"))
    keyed = volumes.withColumns({
        "_vol": F.lower("DiskVolumeName"), "_srv": F.coalesce(F.col("ServerID").cast("bigint"), none),
        "_clu": F.coalesce(F.col("SQLClusterID").cast("bigint"), none), "_old": F.lit(True)})
    key = ["_vol", "_srv", "_clu"]
    if "DiskVolumeID" in volumes.columns:
        fresh = effects.filter("_seen and not _drop").join(keyed, key, "left_anti")
        ids = allocate(fresh.select(*key), [F.col(k) for k in key], volumes, "DiskVolumeID").withColumnRenamed("DiskVolumeID", "_new_id")
        effects = effects.join(ids, key, "left")
    rows = keyed.join(effects, key, "full_outer")
    is_new, moved = F.col("_old").isNull(), F.col("_to_cluster").isNotNull()
    rows = rows.filter(~F.coalesce("_drop", F.lit(False)) & (F.col("_old").isNotNull() | F.coalesce("_seen", F.lit(False))))
    monitored = F.coalesce("IsMonitored", F.lit(True))
    touched = (F.coalesce("_seen", F.lit(False)) | moved) & monitored
    values = {
        "DiskVolumeID": F.when(is_new, F.col("_new_id")).otherwise(F.col("DiskVolumeID")) if "DiskVolumeID" in volumes.columns else None,
        "DiskVolumeName": F.coalesce("DiskVolumeName", "_vol"),
        "ServerID": F.when(is_new & (F.col("_srv") != none), F.col("_srv")).when(~moved, F.col("ServerID")),
        "SQLClusterID": F.when(is_new & (F.col("_clu") != none), F.col("_clu")).otherwise(F.coalesce("_to_cluster", "SQLClusterID")),
        "IsMonitored": monitored,
        "DiscoveryOn": F.coalesce("DiscoveryOn", day),
        "LastUpdated": F.when(touched, day).otherwise(F.col("LastUpdated")),
    }
    types = {f.name: f.dataType for f in volumes.schema.fields}
    return rows.select(*[values.get(c, F.col(c)).cast(types[c]).alias(c) for c in volumes.columns])


MB = 1024.0 * 1024.0


def volume_space_daily(space: DataFrame, readings: DataFrame, as_of: str) -> DataFrame:
    """Readings (DiskVolumeID, Capacity, FreeSpace in bytes) as MB of the day.

    The first reading of a day is stored, a later one is averaged with the stored value.
    """
    day = date_lit(as_of)
    one = readings.groupBy("DiskVolumeID").agg(F.max(F.struct("Capacity", "FreeSpace")).alias("r"))
    new = one.select(
        "DiskVolumeID", day.alias("DateCaptured"),
        ((F.col("r.Capacity") - F.col("r.FreeSpace")) / F.lit(MB)).alias("_used"), (F.col("r.Capacity") / F.lit(MB)).alias("_total"))
    today = space.filter(F.col("DateCaptured") == day)
    both = today.join(new, ["DiskVolumeID", "DateCaptured"], "full_outer")

    def blend(old: str, reading: str) -> Column:
        mean = (F.col(old) + F.col(reading)) / 2
        return F.coalesce(mean, F.col(reading), F.col(old)).cast("bigint").alias(old)

    merged = both.select("DiskVolumeID", "DateCaptured", blend("SpaceUsed_mb", "_used"), blend("TotalSpace_mb", "_total"))
    return space.filter(F.col("DateCaptured") != day).unionByName(merged)


def new_errors(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Errors of ``batch`` (SQLInstanceID, DateTime, ErrorMsg and more) beyond those that ``stored`` has.

    If a machine has logged one message ``n`` times at one time and ``m`` are stored, ``n - m`` are added. Stored ones are counted, so only
    one row per error meets the batch.
    """
    error = ["SQLInstanceID", "DateTime", "ErrorMsg"]
    known = stored.groupBy(*error).agg(F.count(F.lit(1)).alias("_stored"))
    numbered = batch.withColumn("_n", F.row_number().over(Window.partitionBy(*error).orderBy(F.lit(0))))
    return numbered.join(known, error, "left").filter(F.col("_n") > F.coalesce("_stored", F.lit(0))).select(*batch.columns)


# ---- high-water marks ------------------------------------------------------------

def high_water_marks(facts: DataFrame, ts_col: str, key: str = "SQLInstanceID") -> DataFrame:
    return facts.groupBy(key).agg(F.max(ts_col).alias("LastDateTimeCaptured"))


def advance_marks(marks: DataFrame, new: DataFrame, key: str = "SQLInstanceID") -> DataFrame:
    """Later of the stored and the new mark for every instance."""
    return marks.unionByName(new).groupBy(key).agg(F.max("LastDateTimeCaptured").alias("LastDateTimeCaptured"))
