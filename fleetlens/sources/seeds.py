"""Reference data that a new warehouse starts with, and its idempotent loading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.upsert import insert_missing, upsert

# fixed values: operating systems (full name, short name)
OPERATING_SYSTEMS = (
    ("Windows Server 2000", "Windows 2000"),
    ("Windows Server 2003", "Windows 2003"),
    ("Windows Server 2008", "Windows 2008"),
    ("Windows Server 2008 R2", "Windows 2008 R2"),
    ("Windows Server 2012", "Windows 2012"),
    ("Windows Server 2012 R2", "Windows 2012 R2"),
    ("Windows Server 2016", "Windows 2016"),
    ("Windows Server 2019", "Windows 2019"),
)

# fixed values: product versions (name, short name, major, minor, build, support end)
SQL_VERSIONS = (
    ("Microsoft SQL Server 2000 RTM", "SQL 2000", 8, 0, 194, "2002-07-11"),
    ("Microsoft SQL Server 2000 Service Pack 1", "SQL 2000", 8, 0, 384, "2002-02-28"),
    ("Microsoft SQL Server 2000 Service Pack 2", "SQL 2000", 8, 0, 532, "2003-04-07"),
    ("Microsoft SQL Server 2000 Service Pack 3a", "SQL 2000", 8, 0, 760, "2007-07-10"),
    ("Microsoft SQL Server 2000 Service Pack 4", "SQL 2000", 8, 0, 2039, "2013-04-09"),
    ("Microsoft SQL Server 2005 RTM", "SQL 2005", 9, 0, 1399, "2007-07-10"),
    ("Microsoft SQL Server 2005 Service Pack 1", "SQL 2005", 9, 0, 2047, "2008-04-08"),
    ("Microsoft SQL Server 2005 Service Pack 2", "SQL 2005", 9, 0, 3042, "2010-01-12"),
    ("Microsoft SQL Server 2005 Service Pack 3", "SQL 2005", 9, 0, 4035, "2012-01-10"),
    ("Microsoft SQL Server 2005 Service Pack 4", "SQL 2005", 9, 0, 5000, "2016-04-12"),
    ("Microsoft SQL Server 2008 R2 RTM", "SQL 2008 R2", 10, 50, 1600, "2012-07-10"),
    ("Microsoft SQL Server 2008 R2 Service Pack 1", "SQL 2008 R2", 10, 50, 2500, "2013-10-08"),
    ("Microsoft SQL Server 2008 R2 Service Pack 2", "SQL 2008 R2", 10, 50, 4000, "2015-10-13"),
    ("Microsoft SQL Server 2008 R2 Service Pack 3", "SQL 2008 R2", 10, 50, 6000, "2019-07-09"),
    ("Microsoft SQL Server 2008 RTM", "SQL 2008", 10, 0, 1600, "2010-04-13"),
    ("Microsoft SQL Server 2008 Service Pack 1", "SQL 2008", 10, 0, 2531, "2011-10-11"),
    ("Microsoft SQL Server 2008 Service Pack 2", "SQL 2008", 10, 0, 4000, "2012-10-09"),
    ("Microsoft SQL Server 2008 Service Pack 3", "SQL 2008", 10, 0, 5500, "2015-10-13"),
    ("Microsoft SQL Server 2008 Service Pack 4", "SQL 2008", 10, 0, 6000, "2019-07-09"),
    ("Microsoft SQL Server 2012 RTM", "SQL 2012", 11, 0, 2100, "2014-01-14"),
    ("Microsoft SQL Server 2012 Service Pack 1", "SQL 2012", 11, 0, 3000, "2015-07-14"),
    ("Microsoft SQL Server 2012 Service Pack 2", "SQL 2012", 11, 0, 5058, "2017-01-10"),
    ("Microsoft SQL Server 2014 RTM", "SQL 2014", 12, 0, 2000, "2016-07-12"),
    ("Microsoft SQL Server 2014 Service Pack 1", "SQL 2014", 12, 0, 4100, "2017-10-10"),
    ("Microsoft SQL Server 6.5 RTM-SP5a", "SQL 6.5", 6, 50, 0, "2004-03-31"),
    ("Microsoft SQL Server 7.0 RTM-SP4", "SQL 7", 7, 0, 0, "2011-01-11"),
    ("Microsoft SQL Server 2012 Service Pack 3", "SQL 2012", 11, 0, 6020, "2022-07-12"),
    ("Microsoft SQL Server 2014 Service Pack 2", "SQL 2014", 12, 0, 5000, "2020-01-14"),
    ("Microsoft SQL Server 2016 RTM", "SQL 2016", 13, 0, 1601, "2018-01-19"),
    ("Microsoft SQL Server 2016 Service Pack 1", "SQL 2016", 13, 0, 4001, "2026-07-14"),
    ("Microsoft SQL Server 2017 RTM", "SQL 2017", 14, 0, 1000, "2027-10-12"),
    ("Microsoft SQL Server 2012 Service Pack 4", "SQL 2012", 11, 0, 7001, "2022-07-12"),
    ("Microsoft SQL Server 2016 Service Pack 2", "SQL 2016", 13, 0, 5026, "2022-10-11"),
    ("Microsoft SQL Server 2019 RTM", "SQL 2019", 15, 0, 1000, "2030-01-08"),
    ("Microsoft SQL Server 2016 Service Pack 3", "SQL 2016", 13, 0, 6300, "2026-07-14"),
    # The 2022 row carries major version 15 in the published list; kept as published.
    ("Microsoft SQL Server 2022 RTM", "SQL 2022", 15, 0, 1000, "2030-01-08"),
    ("Microsoft SQL Server 2014 Service Pack 3", "SQL 2014", 12, 0, 6024, "2024-07-09"),
)

# fixed values: settings of a new warehouse
SETTINGS = {
    "DebugMode_Enabled": "1",
    "DebugMode_WriteToDB": "0",
    "DebugMode_OutputTSQL": "0",
    "RunLog_Enabled": "1",
    "RunLog_CleanUp_Enabled": "1",
    "RunLog_CleanUp_Retention_Days": "180",
    "Expired_Objects_Enabled": "1",
    "Expired_Objects_CleanUp_Retention_Days": "91",
    "Trend_Creation_Enabled": "1",
    "Trend_Creation_CleanUp_Enabled": "1",
    "Trend_Creation_CleanUp_Retention_Months": "60",
    "Aggregate_CleanUp_Enabled": "1",
    "Aggregate_CleanUp_Retention_Months": "60",
    "RawData_CleanUp_Enabled": "1",
    "RawData_CleanUp_Retention_Days": "45",
    "ErrorLog_CleanUp_Enabled": "1",
    "ErrorLog_CleanUp_Retention_Days": "90",
    "SQLAgent_Jobs_CleanUp_Enabled": "1",
    "SQLAgent_Jobs_CleanUp_Retention_Days": "180",
    "PolicyResult_CleanUp_Enabled": "1",
    "PolicyResult_CleanUp_Retention_Days": "7",
    "Default_DomainName": "example.local",
}

# fixed values: short names of the published policies
POLICY_SHORT_NAMES = (
    ("Advanced Options Turned On", "Server Options"),
    ("All Data Files are Same Size in TempDB", "TempDB"),
    ("Allow Updates Turned On", "Database Options"),
    ("Auto Create Statistics is Disabled", "Database Options"),
    ("Auto Update Statistics Is Disabled", "Database Options"),
    ("Backup and Data File Location", "File Location"),
    ("CmdExec Rights Secured", "Server Options"),
    ("Current Size for TempDB Is Configured Size", "TempDB"),
    ("Data and Log File Location", "File Location"),
    ("Database Auto Close", "Database Options"),
    ("Database Auto Shrink", "Database Options"),
    ("Database Collation", "Database Options"),
    ("Database Consistency Check Completed", "Database Consistency Check"),
    ("Database Data File Growth Setting is Not 1MB", "Database File Size"),
    ("Database Data File Growth Settings is Not Percent", "Database File Size"),
    ("Database Log File Growth Setting is Less than 1024MB", "Database File Size"),
    ("Database Log File Growth Setting is Not 1MB", "Database File Size"),
    ("Database Log File Growth Setting is Not Percent", "Database File Size"),
    ("Database Page Status", "Database Options"),
    ("Database Page Verification", "Database Options"),
    ("Database Recovery Model Is Simple", "Database Options"),
    ("Databases Found with Disabled Indexes", "Indexes"),
    ("Fill Factor Configured", "Server Options"),
    ("Guest Permissions", "Guest"),
    ("Large Number of Virtual Log Files", "VLF"),
    ("Last Successful Backup Date", "Backups"),
    ("Last Successful Log Backup Date", "Backups"),
    ("Login 'sa' is Enabled", "Server Security"),
    ("Max Degree of Parallelism Configured", "MAXDOP"),
    ("Max Memory Not Set to Default Value", "Memory"),
    ("Max Server Memory is at least 1GB", "Memory"),
    ("Max Worker Thread Not Set to Default", "Server Options"),
    ("Min Memory Does Not Equal Max Server Memory", "Memory"),
    ("Min Memory Not Set to Default Value", "Memory"),
    ("Min Server Memory at Least 25% Of Max Memory", "Memory"),
    ("Number of TempDB Files", "TempDB"),
    ("Optimize for Ad Hoc Workload Truned Off", "Server Options"),
    ("Orphaned Windows NT Logins Found", "Server Security"),
    ("Public Database Role Has No Access", "Database Security"),
    ("Read-only Database Recovery Model", "Database Options"),
    ("Recovery Interval Setting Changed from Default", "Database Options"),
    ("Remote Dedicated Admin Connection is Enabled", "Server Options"),
    ("SQL Server Affinity Mask", "Server Options"),
    ("SQL Server Blocked Process Threshold", "Server Options"),
    ("SQL Server Default Trace", "Server Options"),
    ("SQL Server Dynamic Locks", "Server Options"),
    ("SQL Server Login Mode", "Server Options"),
    ("SQL Server System Tables Updatable", "Server Options"),
    ("Transaction Log Bigger then Data Files Size", "Database File Size"),
)


def seed_dimension(
    target: DataFrame, seed: DataFrame, key: str | Sequence[str], update_cols: Sequence[str] = (), unknown_row: dict | None = None,
    id_col: str | None = None,
) -> DataFrame:
    """Load seed rows so that a second run changes nothing.

    ``unknown_row`` (reserved id 1) is added only if its key is absent.  With ``update_cols`` existing
    rows are refreshed; without, the seed is insert-only.  ``id_col`` of a new row is the next free number.
    """
    keys = [key] if isinstance(key, str) else list(key)
    out = upsert(target, seed, keys, update_cols, id_col=id_col) if update_cols else insert_missing(target, seed, keys, id_col=id_col)
    if unknown_row:
        one = target.sparkSession.createDataFrame([tuple(unknown_row.get(c) for c in target.columns)], target.schema)
        out = out.unionByName(one.join(target.select(*keys), keys, "left_anti").select(*target.columns))
    return out


def seed_operating_systems(target: DataFrame) -> DataFrame:
    spark = target.sparkSession
    seed = spark.createDataFrame(list(OPERATING_SYSTEMS), "OperatingSystemName string, OperatingSystemShortName string")
    return seed_dimension(
        target, seed, "OperatingSystemName", ["OperatingSystemShortName"],
        {"OperatingSystemID": 1, "OperatingSystemName": "Unknown", "OperatingSystemShortName": "Unknown"}, "OperatingSystemID")


def seed_versions(target: DataFrame) -> DataFrame:
    """Existing versions get a new short name or support end; build numbers are never changed."""
    seed = target.sparkSession.createDataFrame(
        list(SQL_VERSIONS), "SQLVersion string, SQLVersionShortName string, SQLMajorVersion int, SQLMinorVersion int, SQLBuild int, e string")
    seed = seed.withColumn("SQLVersionSupportEndDate", F.col("e").cast("date")).drop("e")
    import datetime as dt

    return seed_dimension(
        target, seed, "SQLVersion", ["SQLVersionShortName", "SQLVersionSupportEndDate"],
        {"SQLVersionID": 1, "SQLVersion": "Unknown", "SQLVersionShortName": "Unknown", "SQLMajorVersion": 0, "SQLMinorVersion": 0,
         "SQLBuild": 0, "SQLVersionSupportEndDate": dt.date(1900, 1, 1)}, "SQLVersionID")


def seed_applications(target: DataFrame) -> DataFrame:
    seed = target.sparkSession.createDataFrame([(1, "Unknown", "Unknown")], "ApplicationID int, ApplicationName string, ApplicationOwner string")
    return seed_dimension(target, seed, "ApplicationName")


def seed_settings(target: DataFrame) -> DataFrame:
    """Insert-only: a value that was changed by hand survives."""
    seed = target.sparkSession.createDataFrame(list(SETTINGS.items()), "SettingName string, SettingValue string")
    return seed_dimension(target, seed, "SettingName")


def seed_policy_short_names(target: DataFrame, policies: DataFrame) -> DataFrame:
    """Short names joined to the policy ids of this installation; policies it lacks are left out."""
    names = target.sparkSession.createDataFrame(list(POLICY_SHORT_NAMES), "PolicyName string, Policy_ShortName string")
    rows = names.join(policies.select("PolicyName", F.col("policy_id").alias("Policy_ID")), "PolicyName")
    return seed_dimension(target, rows.select("Policy_ID", "Policy_ShortName"), "Policy_ID", ["Policy_ShortName"])


def empty_table(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
