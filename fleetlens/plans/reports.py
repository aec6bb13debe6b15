"""Report datasets.  ``t`` is any object with the warehouse tables as attributes.

A filter argument left at ``None`` (or ``"ALL"``) adds no predicate, so pushdown and
pruning see only the conditions that are set.  Row order is left to the reader
except where a rank is the point of the report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.columns import (
    apply_filters, ci_eq, date_lit, edition_label, like_ci, ts_lit, unless_all, version_family, yyyymm,
)
from fleetlens.functions.shuffles import dealt
from fleetlens.functions.windows import latest_by
from fleetlens.operators import rollup, views
from fleetlens.operators.licence import license_details

MOUNT_POINT_PREFIX = "\\\\?\\"  # fixed value: hidden mount-point volumes
ALL = "ALL"


def instance_view(t) -> DataFrame:
    return views.instance_view(t.sql_instances, t.sql_versions, t.servers, t.sql_clusters)


def _seen_last_day(as_of: str) -> Column:
    return F.col("LastUpdated") >= F.date_sub(date_lit(as_of), 1)


def _union_all_value(df: DataFrame, *values: tuple) -> DataFrame:
    return df.union(df.sparkSession.createDataFrame(list(values), df.schema))


# ---- applications ----------------------------------------------------------------

def report_applications(t) -> DataFrame:
    """Database count by application, owner and environment."""
    inst = instance_view(t).select("SQLInstanceID", "SQLInstanceEnviornment")
    counts = (
        t.databases.select("SQLInstanceID", "ApplicationID").groupBy("SQLInstanceID", "ApplicationID").agg(F.count(F.lit(1)).alias("n"))
        .join(inst, "SQLInstanceID").groupBy("ApplicationID", "SQLInstanceEnviornment").agg(F.sum("n").alias("DatabaseCount")))
    apps = t.application.select("ApplicationID", "ApplicationName", "ApplicationOwner")
    return apps.join(counts, "ApplicationID").select(
        "ApplicationID", "ApplicationName", "ApplicationOwner", "SQLInstanceEnviornment", "DatabaseCount")


def report_application_detail(t, *, application: str | None = None) -> DataFrame:
    """Size of each database on its last captured day."""
    apps = apply_filters(t.application.select("ApplicationID", "ApplicationName", "ApplicationOwner"), unless_all("ApplicationName", application))
    inst = instance_view(t).select("SQLInstanceID", "ServerInstance", "SQLInstanceEnviornment")
    rows = (
        t.databases.select("DatabaseID", "SQLInstanceID", "DatabaseName", "ApplicationID").join(apps, "ApplicationID")
        .join(rollup.latest_database_total(t.database_size), "DatabaseID").join(inst, "SQLInstanceID"))
    return rows.groupBy("ServerInstance", "SQLInstanceEnviornment", "ApplicationName", "ApplicationOwner", "DatabaseName").agg(
        F.sum("TotalSize").alias("TotalDBSize_mb"))


def report_application_totals(detail: DataFrame) -> DataFrame:
    return detail.agg(F.count(F.lit(1)).alias("DatabaseCount"), F.sum("TotalDBSize_mb").alias("TotalDBSize_mb"))


# ---- configuration health ----------------------------------------------------------

#: Characters at the start of a pattern by which results find it.
PREFIX = 6


def _without_exclusions(summary: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Drop results whose server and object match an exclusion pattern of the same policy.

    Patterns are indexed by how they start: one whose server, else whose object, begins with ``PREFIX`` plain characters is
    found by equality of policy and start, so a result meets only patterns that can match. Only patterns that
    start with a wildcard on both sides meet every result of their policy.
    """
    def start(pattern: str) -> Column:
        return F.substring(F.regexp_extract(F.lower(pattern), r"^([^%_\[]*)", 1), 1, PREFIX)

    x = exclusions.select(
        F.col("Policy_ID").alias("_x_policy"), F.col("EvaluatedServer").alias("_x_server"), F.col("ObjectName").alias("_x_object"),
        start("EvaluatedServer").alias("_x_by_server"), start("ObjectName").alias("_x_by_object"))
    by_server, by_object = F.length("_x_by_server") == PREFIX, F.length("_x_by_object") == PREFIX
    rows = summary
    for own, column, key in (
        (by_server, "EvaluatedServer", "_x_by_server"), (~by_server & by_object, "ObjectName", "_x_by_object"), (~by_server & ~by_object, None, None)):
        same = F.col("Policy_id") == F.col("_x_policy")
        same = same & (F.substring(F.lower(column), 1, PREFIX) == F.col(key)) if column else same
        rows = rows.join(x.filter(own), same & like_ci("EvaluatedServer", F.col("_x_server")) & like_ci("ObjectName", F.col("_x_object")), "left_anti")
    return rows


def report_config_health(
    summary: DataFrame, policies: DataFrame, exclusions: DataFrame, *, policy: str | None = None,
    result: str | None = None, category: str | None = None,
) -> DataFrame:
    """Policy results less pattern exclusions; ``category`` and ``result`` match as suffixes."""
    def suffix(column: str, wanted: str | None) -> Column | None:
        return None if wanted in (None, ALL) else F.col(column).endswith(wanted)

    rows = apply_filters(summary, suffix("PolicyResult", result), suffix("CategoryName", category))
    names = apply_filters(policies.select(F.col("policy_id").alias("Policy_id"), "Policy_ShortName"), unless_all("Policy_ShortName", policy))
    return _without_exclusions(rows, exclusions).join(names, "Policy_id").select(
        "CategoryName", "Policy_id", "Policy_ShortName", "PolicyName", "EvaluatedServer", "ObjectName", "EvaluationDateTime", "PolicyResult")


def report_config_health_counts(health: DataFrame) -> DataFrame:
    return health.groupBy("CategoryName", "Policy_ShortName", "PolicyResult").agg(F.count(F.lit(1)).alias("ObjCount"))


def report_value_list(df: DataFrame, column: str, *extra: str) -> DataFrame:
    """Distinct values plus the catch-all entries of a parameter list."""
    return _union_all_value(df.select(column).distinct(), *[(v,) for v in (extra or (ALL,))])


NO_HELP = "No help text is recorded for this policy."


def report_policy_info(policies: DataFrame, *, policy_id: int | None = None) -> DataFrame:
    rows = apply_filters(policies, unless_all("policy_id", policy_id))
    helped = F.when(F.length(F.trim(F.coalesce("help_text", F.lit("")))) == 0, F.lit(NO_HELP)).otherwise(F.col("help_text"))
    return rows.select("policy_id", "CategoryName", "PolicyName", "description", helped.alias("help_text"))


# ---- growth --------------------------------------------------------------------------

def report_database_growth_daily(t, *, database_id: int | None = None, file_type: str | None = None) -> DataFrame:
    size = apply_filters(t.database_size, unless_all("DatabaseID", database_id), unless_all("FileType", file_type))
    grown = rollup.growth_percent(size, ["DatabaseID", "FileType"], "DateCaptured", "FileSize_mb")
    return grown.join(t.databases.select("DatabaseID"), "DatabaseID").select(
        "DatabaseID", "DateCaptured", "FileType", "FileSize_mb", F.coalesce("GrowthInPercent", F.lit(0.0)).alias("GrowthInPercent"))


def report_database_growth_monthly(
    monthly: DataFrame, databases: DataFrame, *, database_id: int | None = None, file_type: str | None = None,
) -> DataFrame:
    rows = apply_filters(monthly, unless_all("DatabaseID", database_id), unless_all("FileType", file_type))
    grown = rollup.growth_percent(rows, ["DatabaseID", "FileType"], "YearMonth", "FileSize_mb")
    return grown.join(databases.select("DatabaseID"), "DatabaseID").select(
        "DatabaseID", "YearMonth", "FileType", "FileSize_mb", "GrowthInPercent")


def pivot_file_types(growth: DataFrame, period: str) -> DataFrame:
    """Data and log size side by side per database and period.

    Sums by condition: ``pivot`` would first aggregate per file type too, in hash tables of nearly every row.
    There is about one row per file type and group, so rows are dealt before the sum.
    """
    def total(kind: str) -> Column:
        return F.sum(F.when(F.col("FileType") == kind, F.col("FileSize_mb"))).alias(kind)

    return dealt(growth, "DatabaseID", period).groupBy("DatabaseID", period).agg(total("Data"), total("Log"))


def report_database_info(t, *, database_id: int | None = None) -> DataFrame:
    dbs = apply_filters(t.databases.select("DatabaseID", "DatabaseName", "SQLInstanceID"), unless_all("DatabaseID", database_id))
    return dbs.join(instance_view(t).select("SQLInstanceID", "ServerInstance"), "SQLInstanceID").select(
        "ServerInstance", "DatabaseID", "DatabaseName")


def _volume_growth(t, facts: DataFrame, period: str, volume_id: int | None) -> DataFrame:
    facts = apply_filters(facts, unless_all("DiskVolumeID", volume_id))
    grown = rollup.growth_percent(facts, ["DiskVolumeID"], period, "SpaceUsed_mb", change_name="UsedSpaceChange_mb")
    names = views.with_owner(
        t.disk_volumes.select("DiskVolumeID", "DiskVolumeName", "ServerID", "SQLClusterID"), t.servers, t.sql_clusters, entity="DiskVolumeID")
    return grown.join(names.select("DiskVolumeID", "DiskVolumeName", "ComputerName"), "DiskVolumeID").select(
        "DiskVolumeID", "ComputerName", "DiskVolumeName", period, "SpaceUsed_mb", "TotalSpace_mb", "UsedSpaceChange_mb",
        "GrowthInPercent", (F.col("TotalSpace_mb") - F.col("SpaceUsed_mb")).alias("FreeSpace_mb"))


def report_volume_growth_daily(t, *, volume_id: int | None = None) -> DataFrame:
    return _volume_growth(t, t.disk_volume_space, "DateCaptured", volume_id)


def report_volume_growth_monthly(t, monthly: DataFrame, *, volume_id: int | None = None) -> DataFrame:
    return _volume_growth(t, monthly, "YearMonth", volume_id)


def report_volume_info(t, *, volume_id: int | None = None) -> DataFrame:
    rows = apply_filters(
        t.disk_volumes.select("DiskVolumeID", "DiskVolumeName", "ServerID", "SQLClusterID", "DiscoveryOn", "LastUpdated"),
        unless_all("DiskVolumeID", volume_id))
    return views.with_owner(rows, t.servers, t.sql_clusters, entity="DiskVolumeID").select(
        "ComputerName", "DiskVolumeID", "DiskVolumeName", "DiscoveryOn", "LastUpdated",
        F.concat(F.lit("Computer: "), "ComputerName", F.lit(" Volume: "), "DiskVolumeName").alias("ReportTitle"))


# ---- security --------------------------------------------------------------------------

def _status(status: str) -> Column | None:
    """Audit = archived only, Active = current only, Both = no filter."""
    return {"Audit": F.col("IsArchived"), "Active": ~F.col("IsArchived"), "Both": None}[status]


def _principal(principals: DataFrame, key: str, **outputs: str) -> DataFrame:
    return principals.select(F.col("PrincipalID").alias(key), *[F.col(c).alias(alias) for alias, c in outputs.items()])


def _located_databases(t) -> DataFrame:
    inst = instance_view(t).select("SQLInstanceID", "ServerInstance")
    return t.databases.select("DatabaseID", "DatabaseName", "SQLInstanceID").join(inst, "SQLInstanceID", "left")


def report_database_memberships(
    t, *, status: str = "Both", database_id: int | None = None, instance_id: int | None = None, user_like: str | None = None,
) -> DataFrame:
    """Role members; ``dbo``, ``guest`` and members without a known principal are left out."""
    facts = apply_filters(t.database_principal_membership, unless_all("DatabaseID", database_id), _status(status))
    users = _principal(t.database_principals, "DatabaseUserID", DatabaseUserName="PrincipalName", DatabaseUserType="PrincipalType")
    users = apply_filters(
        users.filter(~F.lower("DatabaseUserName").isin("dbo", "guest")), like_ci("DatabaseUserName", user_like) if user_like else None)
    rows = facts.join(users, "DatabaseUserID").join(
        _principal(t.database_principals, "DatabaseRoleID", DatabaseRoleName="PrincipalName"), "DatabaseRoleID", "left")
    rows = rows.join(_located_databases(t), "DatabaseID", "left")
    return apply_filters(rows, unless_all("SQLInstanceID", instance_id)).select(
        "ServerInstance", "DatabaseName", "DatabaseRoleName", "DatabaseUserName", "DatabaseUserType",
        "IsOrphaned", "IsArchived", "DiscoveryOn", "LastUpdated")


def report_database_permissions(
    t, *, status: str = "Both", database_id: int | None = None, instance_id: int | None = None, user_like: str | None = None,
) -> DataFrame:
    facts = apply_filters(t.database_permission, unless_all("DatabaseID", database_id), _status(status))
    grantee = _principal(t.database_principals, "GranteeID", GranteeName="PrincipalName")
    rows = facts.join(grantee, "GranteeID", "left").join(_located_databases(t), "DatabaseID", "left")
    rows = apply_filters(rows, unless_all("SQLInstanceID", instance_id), like_ci("GranteeName", user_like) if user_like else None)
    return rows.select(
        "ServerInstance", F.col("GranteeName").alias("DatabaseUserName"), "GranteeName", "DatabaseName", "ObjectName",
        "Access", "PermissionName", "IsArchived", "DiscoveryOn", "LastUpdated")


def report_server_memberships(
    t, *, status: str = "Both", instance_id: int | None = None, login_like: str | None = None,
) -> DataFrame:
    """Server role members; ``sa`` and members without a known principal are left out."""
    facts = apply_filters(t.server_principal_membership, _status(status), unless_all("SQLInstanceID", instance_id))
    logins = _principal(t.server_principals, "ServerLoginID", ServerLoginName="PrincipalName", ServerLoginType="PrincipalType")
    logins = apply_filters(
        logins.filter(F.lower("ServerLoginName") != "sa"), like_ci("ServerLoginName", login_like) if login_like else None)
    rows = facts.join(logins, "ServerLoginID").join(
        _principal(t.server_principals, "ServerRoleID", ServerRoleName="PrincipalName"), "ServerRoleID", "left")
    return rows.join(instance_view(t).select("SQLInstanceID", "ServerInstance"), "SQLInstanceID", "left").select(
        "ServerInstance", "ServerRoleName", "ServerLoginName", "ServerLoginType", "IsArchived", "DiscoveryOn", "LastUpdated")


def report_server_permissions(
    t, *, status: str = "Both", instance_id: int | None = None, login_like: str | None = None,
) -> DataFrame:
    facts = apply_filters(t.server_permission, _status(status), unless_all("SQLInstanceID", instance_id))
    rows = facts.join(_principal(t.server_principals, "GranteeID", GranteeName="PrincipalName"), "GranteeID", "left")
    rows = apply_filters(rows, like_ci("GranteeName", login_like) if login_like else None)
    return rows.join(instance_view(t).select("SQLInstanceID", "ServerInstance"), "SQLInstanceID", "left").select(
        "ServerInstance", F.col("GranteeName").alias("DatabaseUserName"), "GranteeName", "ObjectID", "ObjectType",
        "Access", "PermissionName", "IsArchived", "DiscoveryOn", "LastUpdated")


def report_instance_choices(t) -> DataFrame:
    """Instances for a picker, with the catch-all entry."""
    return _union_all_value(instance_view(t).select("SQLInstanceID", "ServerInstance"), (0, "<ALL>"))


# ---- databases ---------------------------------------------------------------------------

def _last_two_sizes(size: DataFrame) -> DataFrame:
    """Data and log size of the last and the previous collection, one row per database.

    The rank filter is pushed below the shuffle, so each task sends at most two
    rows per database and file type.
    """
    w = Window.partitionBy("DatabaseID", "FileType").orderBy(F.desc("DateCaptured"))
    last = size.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= 2)

    def pick(kind: str, n: int, name: str) -> Column:
        return F.max(F.when((F.rtrim("FileType") == kind) & (F.col("_n") == n), F.col("FileSize_mb"))).alias(name)

    return last.groupBy("DatabaseID").agg(
        pick("Data", 1, "DataFileSize_mb"), pick("Log", 1, "LogFileSize_mb"),
        pick("Data", 2, "pDataFileSize_mb"), pick("Log", 2, "pLogFileSize_mb"))


def report_databases(
    t, *, state: str | None = None, version: str | None = None, environment: str | None = None,
    instance_id: int | None = None, seen_since: str | None = None,
) -> DataFrame:
    """Every database with current and previous sizes, application and availability group.

    ``seen_since`` keeps databases refreshed on or after the day before that date.
    """
    dbs = t.databases.select(
        "DatabaseID", "SQLInstanceID", "DatabaseName", "DatabaseState", "ApplicationID", "DiscoveryOn", "LastUpdated")
    dbs = apply_filters(
        dbs, ci_eq("DatabaseState", state) if state not in (None, ALL) else None, unless_all("SQLInstanceID", instance_id),
        _seen_last_day(seen_since) if seen_since else None)
    inst = instance_view(t).select("SQLInstanceID", "ServerInstance", "SQLInstanceEnviornment", "SQLInstanceVersionID")
    inst = apply_filters(inst, unless_all("SQLInstanceEnviornment", environment))
    vers = t.sql_versions.select(F.col("SQLVersionID").alias("SQLInstanceVersionID"), F.col("SQLVersionShortName").alias("SQLVersion"))
    vers = apply_filters(vers, unless_all("SQLVersion", version))
    groups = (
        t.ag_databases.select("DatabaseID", "AGInstanceID").join(t.ag_instances.select("AGInstanceID", "AGID"), "AGInstanceID", "left")
        .join(t.availability_groups.select("AGID", F.col("AGName").alias("AvailabilityGroupName")), "AGID", "left"))
    zero = F.lit(0).cast("bigint")
    sizes = ["DataFileSize_mb", "LogFileSize_mb", "pDataFileSize_mb", "pLogFileSize_mb"]
    rows = (
        dbs.join(t.databases_exclusions.select("DatabaseID", "SQLInstanceID", "DatabaseName"), ["DatabaseID", "SQLInstanceID", "DatabaseName"], "left_anti")
        .join(inst, "SQLInstanceID").join(vers, "SQLInstanceVersionID")
        .join(_last_two_sizes(t.database_size), "DatabaseID", "left")
        .join(t.application.select("ApplicationID", "ApplicationName"), "ApplicationID", "left")
        .join(groups.select("DatabaseID", "AGID", "AvailabilityGroupName"), "DatabaseID", "left"))
    rows = rows.withColumns({c: F.coalesce(c, zero) for c in sizes})
    total = F.col("DataFileSize_mb") + F.col("LogFileSize_mb")
    return rows.select(
        "ServerInstance", "SQLInstanceEnviornment", "SQLVersion", "SQLInstanceID", "ApplicationID", "ApplicationName", "DatabaseID",
        "DatabaseName", "DatabaseState", *sizes, "AGID", "AvailabilityGroupName", "DiscoveryOn", "LastUpdated",
        total.alias("TotalSize_mb"), (total - F.col("pDataFileSize_mb") - F.col("pLogFileSize_mb")).alias("SizeChange_mb"))


# ---- error log -----------------------------------------------------------------------------

def report_error_detail(t, *, since: str, instance_id: int | None = None) -> DataFrame:
    """First, last and total occurrence of each message that was seen since a time."""
    log = apply_filters(t.sql_error_log, unless_all("SQLInstanceID", instance_id))
    per = log.groupBy("SQLInstanceID", "ErrorMsg").agg(
        F.min("DateTime").alias("FirstOccurance"), F.max("DateTime").alias("LastOccurance"), F.count(F.lit(1)).alias("NumberOfErrors"),
        F.count(F.when(F.col("DateTime") >= ts_lit(since), 1)).alias("NumberOfErrorsLast30Hours"),
    ).filter(F.col("NumberOfErrorsLast30Hours") > 0)
    names = instance_view(t).select("SQLInstanceID", F.col("ServerInstance").alias("SQLInstanceName"))
    return per.join(names, "SQLInstanceID").select(
        "SQLInstanceName", "SQLInstanceID", "ErrorMsg", "FirstOccurance", "LastOccurance", "NumberOfErrors", "NumberOfErrorsLast30Hours")


def default_error_since(as_of: Column | str) -> Column:
    """Midnight of the day before: the default start of the error report."""
    return F.date_sub(date_lit(as_of), 1)


def report_error_summary(
    t, *, as_of: str, environment: str | None = None, with_errors: bool | None = None, marks: DataFrame | None = None,
) -> DataFrame:
    """Error count since yesterday midnight for every instance; ``with_errors`` picks one side."""
    start = F.date_sub(date_lit(as_of), 1).cast("timestamp_ntz")
    counts = t.sql_error_log.filter(F.col("DateTime") >= start).groupBy("SQLInstanceID").agg(F.count(F.lit(1)).alias("_n"))
    inst = instance_view(t).select("SQLInstanceID", F.col("ServerInstance").alias("SQLInstanceName"), "SQLInstanceEnviornment")
    inst = apply_filters(inst, unless_all("SQLInstanceEnviornment", environment))
    rows = inst.join(counts, "SQLInstanceID", "left")
    if with_errors is not None:
        rows = rows.filter(F.col("_n").isNotNull() if with_errors else F.col("_n").isNull())
    if marks is not None:
        rows = rows.join(marks.select("SQLInstanceID", F.col("LastDateTimeCaptured").alias("LastUpdate")), "SQLInstanceID", "left")
    else:
        rows = rows.withColumn("LastUpdate", F.lit(None).cast("timestamp_ntz"))
    return rows.select(
        "SQLInstanceName", "SQLInstanceEnviornment", "SQLInstanceID",
        F.coalesce("_n", F.lit(0).cast("bigint")).alias("ErrorLogCount"), "LastUpdate")


# ---- extended properties ---------------------------------------------------------------------

def report_properties(properties: DataFrame) -> DataFrame:
    return properties.select("ExtendedPropertyID", "ExtendedPropertyName")


def report_property_values(
    t, properties: DataFrame, values: DataFrame, *, property_id: int | None = None, instance_id: int | None = None,
) -> DataFrame:
    rows = apply_filters(values, unless_all("ExtendedPropertyID", property_id), unless_all("SQLInstanceID", instance_id))
    return rows.join(report_properties(properties), "ExtendedPropertyID").join(
        instance_view(t).select("SQLInstanceID", "ServerInstance"), "SQLInstanceID").select(
        "SQLInstanceID", "ServerInstance", "ExtendedPropertyID", "ExtendedPropertyName", "ExtendedPropertyValue", "DiscoveryOn", "LastUpdated")


# ---- size change and trends --------------------------------------------------------------------

def report_size_change(t, *, as_of: str, category: str | None = None) -> DataFrame:
    rows = rollup.size_change_category(instance_view(t), t.databases, t.database_size, as_of)
    return apply_filters(rows, unless_all("VolumeOfChangeCategory", category))


def _last_year(as_of: str) -> Column:
    return F.col("YearMonth") >= yyyymm(F.add_months(date_lit(as_of), -12))


def report_trend_servers(t, *, as_of: str) -> DataFrame:
    known = t.operating_systems.filter(F.col("OperatingSystemName") != "Unknown").select("OperatingSystemID", "OperatingSystemName")
    return t.trending_servers.filter(_last_year(as_of)).join(known, "OperatingSystemID").select(
        "OperatingSystemName", "YearMonth", "ServerCount")


def last_months(as_of: str, count: int = 12) -> list[int]:
    """``yyyymm`` of the month of ``as_of`` and the ones before it, oldest first."""
    year, month = int(as_of[:4]), int(as_of[5:7])
    index = [year * 12 + month - 1 - back for back in range(count - 1, -1, -1)]
    return [i // 12 * 100 + i % 12 + 1 for i in index]


def report_trend_servers_matrix(trend: DataFrame, months: list[int]) -> DataFrame:
    """One column per month; the month list is given so no extra pass looks for it."""
    return trend.groupBy("OperatingSystemName").pivot("YearMonth", months).agg(F.sum("ServerCount"))


def _families(versions: DataFrame) -> DataFrame:
    return versions.filter(F.col("SQLVersion") != "Unknown").select(
        F.col("SQLVersionID").alias("_version_id"), version_family("SQLVersion").alias("SQLVersion"))


def report_trend_instances(t, *, as_of: str) -> DataFrame:
    rows = t.trending_instances.filter(_last_year(as_of))
    return rows.join(_families(t.sql_versions), F.col("ServerVersionID") == F.col("_version_id")).groupBy(
        "SQLVersion", "Environment", "YearMonth").agg(F.sum("InstanceCount").alias("InstanceCount"))


def report_trend_databases(t, *, as_of: str) -> DataFrame:
    rows = t.trending_databases.filter(_last_year(as_of))
    return rows.join(_families(t.sql_versions), F.col("SQLVersionID") == F.col("_version_id")).groupBy(
        "SQLVersion", "Environment", "YearMonth").agg(
        F.sum("DatabaseCount").alias("DatabaseCount"), F.sum("DatabaseTotalSize").alias("DatabaseTotalSize_mb"))


# ---- infrastructure overview ---------------------------------------------------------------------

def _version_names(t, family: bool = False) -> DataFrame:
    name = version_family("SQLVersion") if family else F.col("SQLVersionShortName")
    return t.sql_versions.select(F.col("SQLVersionID").alias("SQLInstanceVersionID"), name.alias("SQLVersion"))


def report_instance_summary(t, *, as_of: str, include_unknown: bool = False) -> DataFrame:
    counts = t.sql_instances.filter(_seen_last_day(as_of)).groupBy("SQLInstanceEnviornment", "SQLInstanceVersionID").agg(
        F.count(F.lit(1)).alias("n"))
    names = _version_names(t)
    if not include_unknown:
        names = names.filter(F.col("SQLVersion") != "Unknown")
    return counts.join(names, "SQLInstanceVersionID").groupBy("SQLInstanceEnviornment", "SQLVersion").agg(F.sum("n").alias("InstanceCount"))


def support_dates(t) -> DataFrame:
    """Instance count per exact version with the support end of the build and of the version.

    An instance of a cluster counts once per active node, as each runs a copy of the build.
    """
    major_minor = F.col("SQLMajorVersion") * 100 + F.col("SQLMinorVersion")
    versions = t.sql_versions.withColumn("_mm", major_minor).withColumn(
        "SortKey", F.col("SQLMajorVersion") * 1000000 + F.col("SQLMinorVersion") * 10000 + F.col("SQLBuild"))
    version_end = versions.groupBy("_mm").agg(F.max("SQLVersionSupportEndDate").alias("SQLVersionSupportEndDate"))

    inst = t.sql_instances.select("SQLInstanceVersionID", "ServerID", "SQLClusterID")
    alone = inst.filter(F.col("SQLClusterID").isNull()).join(t.servers.select("ServerID"), "ServerID", "left_semi").select("SQLInstanceVersionID")
    active = (
        t.sql_cluster_nodes.filter("IsActiveNode").join(t.servers.select(F.col("ServerID").alias("SQLNodeID")), "SQLNodeID")
        .join(t.sql_clusters.select("SQLClusterID"), "SQLClusterID").groupBy("SQLClusterID").agg(F.count(F.lit(1)).alias("_nodes")))
    clustered = (
        inst.filter(F.col("ServerID").isNull() & F.col("SQLClusterID").isNotNull())
        .groupBy("SQLClusterID", "SQLInstanceVersionID").agg(F.count(F.lit(1)).alias("n"))
        .join(active, "SQLClusterID").select("SQLInstanceVersionID", (F.col("n") * F.col("_nodes")).alias("n")))
    counts = alone.groupBy("SQLInstanceVersionID").agg(F.count(F.lit(1)).alias("n")).unionByName(clustered)
    per_version = counts.groupBy("SQLInstanceVersionID").agg(F.sum("n").alias("n"))

    named = per_version.join(
        versions.filter(F.col("SQLVersion") != "Unknown"), per_version["SQLInstanceVersionID"] == versions["SQLVersionID"])
    builds = named.groupBy("SQLVersion", "_mm", "SortKey").agg(
        F.max("SQLVersionSupportEndDate").alias("BuildSupportEndDate"), F.sum("n").alias("InstCount"))
    return builds.join(version_end, "_mm").select(
        "SQLVersion", "InstCount", "BuildSupportEndDate", "SQLVersionSupportEndDate", "SortKey")


def report_out_of_support(t, *, as_of: str) -> DataFrame:
    day = date_lit(as_of)
    return support_dates(t).filter((F.col("BuildSupportEndDate") <= day) & (F.col("SQLVersionSupportEndDate") <= day))


def report_support_life_cycle(t, *, as_of: str) -> DataFrame:
    """All versions with a status: Expired (version and build past), BuildExpired or Supported."""
    day = date_lit(as_of)
    build, version = F.col("BuildSupportEndDate") <= day, F.col("SQLVersionSupportEndDate") <= day
    return support_dates(t).withColumn(
        "SupportStatus", F.when(build & version, "Expired").when(build, "BuildExpired").otherwise("Supported"))


def _without_secondaries(t, databases: DataFrame) -> DataFrame:
    """Databases less those hosted by any but the first replica of a group."""
    first = rollup.first_replicas(t.ag_instances).select("AGID", F.col("SQLInstanceID").alias("_first"))
    later = t.ag_instances.select("AGID", "AGInstanceID", "SQLInstanceID").join(first, "AGID").filter(F.col("SQLInstanceID") > F.col("_first"))
    copies = t.ag_databases.select("AGInstanceID", "DatabaseID").join(later.select("AGInstanceID"), "AGInstanceID").select("DatabaseID")
    return databases.join(copies.distinct(), "DatabaseID", "left_anti")


def _counted_instances(t, as_of: str) -> DataFrame:
    return t.sql_instances.filter(_seen_last_day(as_of) & ~F.col("SQLInstanceEdition").startswith("Express Edition")).select(
        "SQLInstanceID", "SQLInstanceEnviornment", "SQLInstanceEdition", "SQLInstanceVersionID")


def report_database_summary(t, *, as_of: str, family: bool = False) -> DataFrame:
    """Online databases by environment, edition and version.

    Grouped by the full edition text, so a shortened label can occur on several rows.
    """
    dbs = t.databases.filter(_seen_last_day(as_of) & ci_eq("DatabaseState", "Online")).select("DatabaseID", "SQLInstanceID", "DatabaseState")
    counts = _without_secondaries(t, dbs).groupBy("SQLInstanceID", "DatabaseState").agg(F.count(F.lit(1)).alias("n"))
    rows = _counted_instances(t, as_of).join(counts, "SQLInstanceID").join(_version_names(t, family), "SQLInstanceVersionID", "left")
    return rows.groupBy("SQLInstanceEnviornment", "SQLInstanceEdition", "SQLVersion", "DatabaseState").agg(F.sum("n").alias("DBCount")).select(
        "SQLInstanceEnviornment", edition_label("SQLInstanceEdition").alias("SQLEdition"), "SQLVersion", "DatabaseState", "DBCount")


def report_database_size_summary(t, *, as_of: str, seen_as_of: str | None = None, family: bool = False) -> DataFrame:
    """Terabytes captured on ``as_of`` by environment and version; ``seen_as_of`` dates the freshness test."""
    seen = seen_as_of or as_of
    day_size = t.database_size.filter(F.col("DateCaptured") == date_lit(as_of)).groupBy("DatabaseID").agg(F.sum("FileSize_mb").alias("mb"))
    dbs = _without_secondaries(t, t.databases.filter(_seen_last_day(seen)).select("DatabaseID", "SQLInstanceID"))
    per_instance = day_size.join(dbs, "DatabaseID").groupBy("SQLInstanceID").agg(F.sum("mb").alias("mb"))
    rows = _counted_instances(t, seen).join(per_instance, "SQLInstanceID").join(_version_names(t, family), "SQLInstanceVersionID", "left")
    return rows.groupBy("SQLInstanceEnviornment", "SQLVersion").agg(F.sum("mb").alias("mb")).select(
        "SQLInstanceEnviornment", "SQLVersion", (F.col("mb") / F.lit(1024.0) / F.lit(1024.0)).alias("DBSize_tb"))


def report_server_summary(t) -> DataFrame:
    counts = t.servers.groupBy("OperatingSystemID").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(t.operating_systems.select("OperatingSystemID", F.col("OperatingSystemShortName").alias("OSName")), "OperatingSystemID").groupBy(
        "OSName").agg(F.sum("n").alias("ServerCount"))


CLUSTER_TYPES = ("Microsoft Clustering", "Veritas Clustering")
GROUP_TYPE = "AlwaysOn Availiability Group"  # fixed value: label as published
STAND_ALONE = "Stand Alone"


def report_instance_types(t, *, as_of: str) -> DataFrame:
    """Instances per kind, including kinds with none; one pass with conditional counts."""
    inst = t.sql_instances.filter(_seen_last_day(as_of)).select("SQLInstanceID", "SQLClusterID", "SQLInstanceType")
    member = t.ag_instances.select("SQLInstanceID").distinct().withColumn("_ag", F.lit(True))
    cluster = t.sql_clusters.select("SQLClusterID", F.lit(True).alias("_cluster"))
    rows = inst.join(member, "SQLInstanceID", "left").join(cluster, "SQLClusterID", "left")
    clustered = F.col("SQLInstanceType").isin(*CLUSTER_TYPES)
    totals = rows.agg(
        *[F.count(F.when((F.col("SQLInstanceType") == c) & F.col("_cluster").isNotNull(), 1)).alias(c) for c in CLUSTER_TYPES],
        F.count(F.when(F.col("_ag").isNotNull(), 1)).alias(GROUP_TYPE),
        F.count(F.when(~clustered & F.col("_ag").isNull(), 1)).alias(STAND_ALONE))
    kinds = [*CLUSTER_TYPES, GROUP_TYPE, STAND_ALONE]
    return totals.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("SQLInstanceType"), F.col(f"`{k}`").alias("SQLInstanceCount")) for k in kinds])).alias("r")).select("r.*")


def report_cluster_summary(t) -> DataFrame:
    """Clusters by operating system of their first node (superseded variant)."""
    first = t.sql_cluster_nodes.groupBy("SQLClusterID").agg(F.min("SQLNodeID").alias("ServerID"))
    return (
        first.join(t.sql_clusters.select("SQLClusterID"), "SQLClusterID").join(t.servers.select("ServerID", "OperatingSystemID"), "ServerID")
        .join(t.operating_systems.select("OperatingSystemID", F.col("OperatingSystemShortName").alias("OSName")), "OperatingSystemID")
        .groupBy("OSName").agg(F.count(F.lit(1)).alias("ClusterCount")))


# ---- instances, jobs, licences, services -----------------------------------------------------------

def report_instances(t, *, computer: str | None = None, version: str | None = None, environment: str | None = None) -> DataFrame:
    vers = t.sql_versions.select(F.col("SQLVersionID").alias("SQLInstanceVersionID"), "SQLVersionShortName", "SQLVersionSupportEndDate")
    rows = instance_view(t).join(vers, "SQLInstanceVersionID")
    return apply_filters(
        rows, ci_eq("ComputerName", computer) if computer else None, unless_all("SQLVersionShortName", version),
        unless_all("SQLInstanceEnviornment", environment),
    ).select(
        "SQLInstanceID", "ComputerName", "ServerInstance", "SQLInstanceName", "SQLInstanceEnviornment", "SQLVersion",
        "SQLVersionSupportEndDate", "SQLInstanceBuild", "SQLInstanceEdition", "DiscoveryOn", "LastUpdated")


REPORT_SERVER_CATEGORY = 10  # fixed value: category of subscription jobs, left out


def report_job_history(t, *, as_of: str, status: str | None = None, instance_id: int | None = None) -> DataFrame:
    """Latest run of each job if within the last seven days; runs that tie are all kept."""
    recent = t.sql_job_history.filter(F.col("ExecutionDateTime") >= ts_lit(as_of) - F.make_dt_interval(F.lit(7)))
    # A job's latest run overall is in the window exactly when it has any run in the window,
    # so the older history is never read.
    w = Window.partitionBy("SQLJobID").orderBy(F.desc("ExecutionDateTime"))
    last = recent.withColumn("_r", F.rank().over(w)).filter(F.col("_r") == 1).drop("_r")
    jobs = apply_filters(t.sql_jobs.filter(F.col("SQLJobCategoryID") != REPORT_SERVER_CATEGORY), unless_all("SQLInstanceID", instance_id))
    named = jobs.join(t.sql_job_categories, "SQLJobCategoryID").join(instance_view(t).select("SQLInstanceID", "ServerInstance"), "SQLInstanceID")
    rows = apply_filters(last.join(named, "SQLJobID"), unless_all("JobStatus", status))
    return rows.select(
        "SQLInstanceID", "ServerInstance", "SQLJobID", "SQLJobCategoryName", "SQLJobName", "JobStatus", "Duration", "ExecutionDateTime")


def report_licences(t, *, as_of: str, environment: str | None = None, edition: str | None = None) -> DataFrame:
    rows = license_details(t.servers, t.sql_clusters, t.sql_cluster_nodes, instance_view(t), t.ag_instances, as_of)
    return apply_filters(rows, unless_all("Enviornment", environment), unless_all("Edition", edition))


def report_services(
    services: DataFrame, servers: DataFrame, *, as_of: str, server: str | None = None, service_type: str | None = None,
    start_mode: str | None = None, status: str | None = None,
) -> DataFrame:
    """Services seen in the last day; status ``Unknown`` selects a null status."""
    by_status = F.col("Status").isNull() if status == "Unknown" else unless_all("Status", status)
    rows = apply_filters(services.filter(_seen_last_day(as_of)), unless_all("ServiceType", service_type), unless_all("StartMode", start_mode), by_status)
    names = apply_filters(servers.select("ServerID", "ServerName"), unless_all("ServerName", server))
    return rows.drop("ServerName").join(names, "ServerID").select(
        "ServerName", "DisplayName", "FilePath", "ServiceType", "StartMode", "Status", "ServiceAccount", "ServiceBuild", "DiscoveryOn", "LastUpdated")


# ---- run log ----------------------------------------------------------------------------------------

def report_run_log(log: DataFrame, *, day: str, unless_like: str | None = None) -> DataFrame:
    """Rows of one day, optionally without a description pattern."""
    start = ts_lit(day)
    rows = log.filter(
        (F.col("DateTimeCaptured") >= start) & (F.col("DateTimeCaptured") < start + F.make_dt_interval(F.lit(1))))
    return apply_filters(rows, ~like_ci("Description", unless_like) if unless_like else None)


def report_run_log_dates(newest: DataFrame, column: str, days: int = 14) -> DataFrame:
    """The last ``days`` dates, newest first, counted back from a one-row date."""
    last = F.to_date(column)
    return newest.select(F.explode(F.sequence(last, F.date_sub(last, days - 1), F.expr("interval -1 day"))).alias("DateValue"))


# ---- servers and volumes -----------------------------------------------------------------------------

def report_servers(t, *, computer: str | None = None, os_name: str | None = None) -> DataFrame:
    os = apply_filters(t.operating_systems, unless_all("OperatingSystemShortName", os_name)).select("OperatingSystemID", "OperatingSystemName")
    rows = apply_filters(t.servers, ci_eq("ServerName", computer) if computer else None)
    return rows.join(os, "OperatingSystemID").select(
        "ServerName", "OperatingSystemName", "ProcessorName", "NumberOfCores", "NumberOfLogicalCores", "Memory_mb", "PageFile_mb",
        "DiscoveryOn", "LastUpdated")


def _visible(name: Column | str = "DiskVolumeName") -> Column:
    name = F.col(name) if isinstance(name, str) else name
    return ~name.startswith(MOUNT_POINT_PREFIX)


def report_server_volumes(t, *, computer: str | None = None) -> DataFrame:
    """Latest space of the volumes a server owns; mount points are hidden."""
    servers = apply_filters(t.servers.select("ServerID", "ServerName"), ci_eq("ServerName", computer) if computer else None)
    last = latest_by(t.disk_volume_space, ["DiskVolumeID"], "DateCaptured", ["SpaceUsed_mb", "TotalSpace_mb"])
    return t.disk_volumes.filter(_visible()).join(servers, "ServerID").join(last, "DiskVolumeID").select(
        "ServerName", "DiskVolumeID", "DiskVolumeName", "SpaceUsed_mb", "TotalSpace_mb", "DiscoveryOn", "LastUpdated")


def report_server_instances(t, *, computer: str | None = None) -> DataFrame:
    servers = apply_filters(t.servers.select("ServerName"), ci_eq("ServerName", computer) if computer else None)
    return instance_view(t).join(servers, ci_eq("ComputerName", F.col("ServerName"))).select(
        "ServerName", "SQLInstanceID", "SQLInstanceName", "SQLVersion", "SQLInstanceBuild", "SQLInstanceEdition", "SQLInstanceType",
        "SQLInstanceEnviornment", "DiscoveryOn", "LastUpdated")


def report_server_services(services: DataFrame, servers: DataFrame, *, computer: str | None = None) -> DataFrame:
    names = apply_filters(servers.select("ServerID", "ServerName"), ci_eq("ServerName", computer) if computer else None)
    return services.drop("ServerName").join(names, "ServerID").select(
        "ServerName", "ServiceType", "DisplayName", "StartMode", "Status", "ServiceAccount", "DiscoveryOn", "LastUpdated")


def report_volumes(t, *, computer: str | None = None, volume_id: int | None = None) -> DataFrame:
    """Disk runway of every visible volume with projected use, soonest to fill first."""
    volumes = apply_filters(t.disk_volumes.filter(_visible()), unless_all("DiskVolumeID", volume_id))
    rows = views.volume_forecast(t.disk_volume_space, volumes, t.servers, t.sql_clusters)
    rows = apply_filters(rows, unless_all("ComputerName", computer, "<ALL>"))
    used90, used180 = (F.col("SpaceUsed_gb") + F.col(f"Est_{d}Days_gb") for d in (90, 180))

    def overflow(used: Column) -> Column:
        return F.greatest(used - F.col("TotalSpace_gb"), F.lit(0.0))

    return rows.select(
        "*", used90.alias("Est_90Days_UsedSpace_gb"), used180.alias("Est_180Days_UsedSpace_gb"),
        overflow(used90).alias("Overflow_90Days_gb"), overflow(used180).alias("Overflow_180Days_gb"),
        F.when(F.col("DaysUntil_OutOfSpace") == views.NEVER_FULL, "INF")
        .otherwise(F.ceil("DaysUntil_OutOfSpace").cast("string")).alias("DaysLabel"),
    ).orderBy("DaysUntil_OutOfSpace", "ComputerName", "DiskVolumeName")


def report_computer_choices(t) -> DataFrame:
    """Computers that host an instance, with the catch-all entry."""
    names = views.with_owner(t.sql_instances.select("SQLInstanceID", "ServerID", "SQLClusterID"), t.servers, t.sql_clusters, entity="SQLInstanceID")
    return report_value_list(names, "ComputerName", "<ALL>")


def report_volume_choices(t, *, computer: str | None = None) -> DataFrame:
    names = views.with_owner(
        t.disk_volumes.filter(_visible()).select("DiskVolumeID", "DiskVolumeName", "ServerID", "SQLClusterID"), t.servers, t.sql_clusters,
        entity="DiskVolumeID")
    names = apply_filters(names, unless_all("ComputerName", computer, "<ALL>"))
    return _union_all_value(names.select("ComputerName", "DiskVolumeID", "DiskVolumeName"), ("Default", 0, "<ALL>"))


# ---- listings and look-ups ------------------------------------------------------------------------------

def report_job_listing(t, *, instance_id: int | None = None) -> DataFrame:
    jobs = apply_filters(t.sql_jobs, unless_all("SQLInstanceID", instance_id))
    named = jobs.join(t.sql_job_categories, "SQLJobCategoryID").join(instance_view(t).select("SQLInstanceID", "ServerInstance"), "SQLInstanceID")
    return t.sql_job_history.join(named, "SQLJobID").select(
        "ServerInstance", "SQLJobName", "SQLJobCategoryName", "ExecutionDateTime", F.col("Duration").alias("Duration_s"), "JobStatus")


def report_availability_groups(t, *, group: str | None = None) -> DataFrame:
    """Replicas of every group, the primary first."""
    groups = apply_filters(t.availability_groups, unless_all("AGName", group)).select(
        "AGID", F.col("AGName").alias("AvailabilityGroupName"), F.col("AGGuid").alias("AvailabilityGroupGUID"),
        F.col("DiscoveryOn").alias("AvailabilityGroupDiscoveryDate"), F.col("LastUpdated").alias("AvailabilityGroupLastUpdateDate"))
    replicas = t.ag_instances.select(
        "AGID", "SQLInstanceID", "ReplicaRole", F.col("DiscoveryOn").alias("ReplicaDiscoveryDate"), F.col("LastUpdated").alias("ReplicaLastUpdateDate"))
    rows = groups.join(replicas, "AGID").join(
        instance_view(t).select("SQLInstanceID", F.col("ServerInstance").alias("ReplicaName")), "SQLInstanceID")
    return rows.select(
        "AGID", "AvailabilityGroupName", "AvailabilityGroupGUID", "ReplicaName", "ReplicaRole", "AvailabilityGroupDiscoveryDate",
        "AvailabilityGroupLastUpdateDate", "ReplicaDiscoveryDate", "ReplicaLastUpdateDate",
    ).orderBy("AvailabilityGroupName", F.when(ci_eq("ReplicaRole", "PRIMARY"), 1).otherwise(2), "ReplicaRole")


LOOKUPS = {
    "server": lambda t: report_servers(t),
    "cluster": lambda t: t.sql_clusters,
    "cluster_node": lambda t: t.sql_cluster_nodes.join(t.sql_clusters.select("SQLClusterID", "SQLClusterName"), "SQLClusterID").join(
        t.servers.select(F.col("ServerID").alias("SQLNodeID"), F.col("ServerName").alias("NodeName")), "SQLNodeID"),
    "instance": instance_view,
    "operating_system": lambda t: t.operating_systems,
    "service": lambda t: t.sql_services.join(t.servers.select("ServerID", "ServerName"), "ServerID"),
    "property": lambda t: report_property_values(t, t.extended_properties, t.extended_property_values),
    "setting": lambda t: t.settings,
    "error_log_mark": lambda t: _marks(t.sql_error_log, "DateTime"),
    "job_mark": lambda t: _marks(t.sql_job_history.join(t.sql_jobs.select("SQLJobID", "SQLInstanceID"), "SQLJobID"), "ExecutionDateTime"),
}


def _marks(facts: DataFrame, ts_col: str) -> DataFrame:
    return facts.groupBy("SQLInstanceID").agg(F.max(ts_col).alias("LastDateTimeCaptured"))


def lookup(t, entity: str, **filters) -> DataFrame:
    """Rows of one entity; text filters compare without regard to case."""
    rows = LOOKUPS[entity](t)
    for column, wanted in filters.items():
        if wanted is not None:
            rows = rows.filter(ci_eq(column, wanted) if isinstance(wanted, str) else F.col(column) == wanted)
    return rows
