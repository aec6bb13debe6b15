"""Typed tables of the warehouse: declared schemas, reads with defaults, staged batches and writes.

A table lives at ``<root>/<namespace>/<table>``.  Daily facts are partitioned
by ``yyyymm``; staging by schema version and run, so clearing a run drops a directory's
partition and a schema change starts a new path.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from fleetlens.functions.columns import yyyymm
from fleetlens.sources.shared import delete_path, list_names, path_exists

# table -> (namespace, schema, defaults of missing or null columns)
SCHEMAS: dict[str, tuple[str, str, dict[str, object]]] = {
    "settings": ("dbo", "SettingName string, SettingValue string", {}),
    "operating_systems": ("dbo", "OperatingSystemID int, OperatingSystemName string, OperatingSystemShortName string", {}),
    "sql_versions": ("dbo", "SQLVersionID int, SQLVersion string, SQLVersionShortName string, SQLMajorVersion int, SQLMinorVersion int, SQLBuild int, SQLVersionSupportEndDate date", {}),
    "application": ("dbo", "ApplicationID bigint, ApplicationName string, ApplicationOwner string", {}),
    "run_log": ("dbo", "LogID bigint, DateTimeCaptured timestamp_ntz, ProcessID int, Description string", {}),
    "servers": ("dbo", "ServerID bigint, ServerName string, OperatingSystemID int, ProcessorName string, NumberOfCores int, NumberOfLogicalCores int, Memory_mb bigint, PageFile_mb bigint, IsPhysical boolean, IsMonitored boolean, DiscoveryOn date, LastUpdated date",
                {"ProcessorName": "Unknown", "NumberOfCores": 0, "NumberOfLogicalCores": 0, "IsPhysical": True, "IsMonitored": True}),
    "sql_services": ("dbo", "SQLServiceID bigint, ServerID bigint, ServiceName string, InstanceName string, DisplayName string, FilePath string, ServiceType string, StartMode string, ServiceAccount string, ServiceVersion int, ServiceBuild string, Status string, DiscoveryOn date, LastUpdated date", {}),
    "sql_clusters": ("dbo", "SQLClusterID int, SQLClusterName string, IsMonitored boolean, DiscoveryOn date, LastUpdated date", {"IsMonitored": True}),
    "sql_cluster_nodes": ("dbo", "SQLClusterID int, SQLNodeID bigint, IsActiveNode boolean", {"IsActiveNode": False}),
    "disk_volumes": ("dbo", "DiskVolumeID bigint, DiskVolumeName string, ServerID bigint, SQLClusterID int, IsMonitored boolean, DiscoveryOn date, LastUpdated date", {"IsMonitored": True}),
    "disk_volume_space": ("dbo", "DiskVolumeID bigint, DateCaptured date, SpaceUsed_mb bigint, TotalSpace_mb bigint", {}),
    "sql_instances": ("dbo", "SQLInstanceID bigint, ServerID bigint, SQLClusterID int, SQLInstanceName string, SQLInstanceVersionID int, SQLInstanceBuild string, SQLInstanceEdition string, SQLInstanceType string, SQLInstanceEnviornment string, IsMonitored boolean, DiscoveryOn date, LastUpdated date",
                      {"SQLInstanceVersionID": 1, "IsMonitored": True}),
    "databases": ("dbo", "DatabaseID bigint, SQLInstanceID bigint, DatabaseName string, DatabaseState string, ApplicationID bigint, IsMonitored boolean, DiscoveryOn date, LastUpdated date", {"ApplicationID": 1, "IsMonitored": True}),
    "database_size": ("dbo", "DatabaseID bigint, FileType string, DateCaptured date, FileSize_mb bigint", {"FileType": "", "FileSize_mb": 0}),
    "sql_error_log": ("dbo", "ErrorLogID bigint, SQLInstanceID bigint, DateTime timestamp_ntz, ErrorMsg string", {}),
    "sql_job_categories": ("dbo", "SQLJobCategoryID bigint, SQLJobCategoryName string", {}),
    "sql_jobs": ("dbo", "SQLJobID bigint, SQLInstanceID bigint, SQLJobCategoryID bigint, SQLJobName string, LastUpdated date", {}),
    "sql_job_history": ("dbo", "SQLJobID bigint, ExecutionDateTime timestamp_ntz, Duration int, JobStatus string", {}),
    "availability_groups": ("dbo", "AGID bigint, AGName string, AGGuid string, DiscoveryOn date, LastUpdated date", {}),
    "ag_instances": ("dbo", "AGInstanceID bigint, AGID bigint, SQLInstanceID bigint, ReplicaRole string, DiscoveryOn date, LastUpdated date", {}),
    "ag_databases": ("dbo", "AGInstanceID bigint, DatabaseID bigint, DiscoveryOn date, LastUpdated date", {}),
    "extended_properties": ("dbo", "ExtendedPropertyID bigint, ExtendedPropertyName string", {}),
    "extended_property_values": ("dbo", "SQLInstanceID bigint, ExtendedPropertyID bigint, ExtendedPropertyValue string, DiscoveryOn date, LastUpdated date", {}),
    "databases_exclusions": ("dbo", "DatabaseID bigint, SQLInstanceID bigint, DatabaseName string, Reason string", {}),
    "groups_to_monitor": ("cms", "GroupID int, IsMonitored boolean", {"IsMonitored": False}),
    "database_monthly": ("history", "DatabaseID bigint, YearMonth int, FileType string, FileSize_mb bigint", {}),
    "volume_monthly": ("history", "DiskVolumeID bigint, YearMonth int, SpaceUsed_mb bigint, TotalSpace_mb bigint", {}),
    "trending_servers": ("trending", "YearMonth int, OperatingSystemID int, ServerCount bigint", {}),
    "trending_instances": ("trending", "YearMonth int, ServerVersionID int, Environment string, InstanceCount bigint", {}),
    "trending_databases": ("trending", "YearMonth int, SQLVersionID int, Environment string, DatabaseCount bigint, DatabaseTotalSize bigint", {}),
    "policy_exclusions": ("policy", "Policy_ID int, EvaluatedServer string, ObjectName string", {}),
    "policy_summary": ("policy", "CategoryName string, Policy_id int, PolicyName string, EvaluatedServer string, ObjectName string, EvaluationDateTime timestamp_ntz, PolicyResult string", {}),
    "policy_short_names": ("policy", "Policy_ID int, Policy_ShortName string", {}),
    "policy_history": ("policy", "PolicyHistoryID bigint, EvaluatedServer string, EvaluationDateTime timestamp_ntz, EvaluatedPolicy string, EvaluationResults string", {}),
    "policy_history_detail": ("policy", "PolicyHistoryID bigint, EvaluatedServer string, EvaluationDateTime timestamp_ntz, EvaluatedPolicy string, EvaluatedObject string, PolicyResult string, ExceptionMessage string, ResultDetail string, Policy_id int, CategoryName string, MonthYear string, PolicyHistorySource string", {}),
    "evaluation_errors": ("policy", "EvaluatedServer string, EvaluationDateTime timestamp_ntz, EvaluatedPolicy string, EvaluationResults string", {}),
    "server_principals": ("security", "PrincipalID bigint, PrincipalName string, PrincipalType string", {}),
    "database_principals": ("security", "PrincipalID bigint, PrincipalName string, PrincipalType string", {}),
    "server_principal_membership": ("security", "MembershipID bigint, SQLInstanceID bigint, ServerRoleID bigint, ServerLoginID bigint, IsArchived boolean, DiscoveryOn date, LastUpdated date", {"IsArchived": False}),
    "database_principal_membership": ("security", "MembershipID bigint, DatabaseID bigint, DatabaseRoleID bigint, DatabaseUserID bigint, IsOrphaned boolean, IsArchived boolean, DiscoveryOn date, LastUpdated date", {"IsArchived": False}),
    "server_permission": ("security", "PermissionID bigint, SQLInstanceID bigint, GranteeID bigint, GrantorID bigint, ObjectType string, ObjectID bigint, Access string, PermissionName string, IsArchived boolean, DiscoveryOn date, LastUpdated date", {"IsArchived": False}),
    "database_permission": ("security", "PermissionID bigint, DatabaseID bigint, GranteeID bigint, GrantorID bigint, ObjectType string, ObjectName string, Access string, PermissionName string, IsArchived boolean, DiscoveryOn date, LastUpdated date", {"IsArchived": False}),
}

# fixed-width text columns whose padding is removed on read
PADDED = {"FileType"}


def schema_of(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name][1])


def table_path(root: str, name: str) -> str:
    return os.path.join(root, SCHEMAS[name][0], name)


def conform(df: DataFrame, name: str, lenient: bool = False) -> DataFrame:
    """Cast to the declared schema, add absent columns, apply defaults and drop text padding; ``lenient`` values that cannot be cast are null."""
    return shaped(df, schema_of(name), SCHEMAS[name][2], lenient)


def shaped(df: DataFrame, schema: StructType, defaults: Mapping[str, object], lenient: bool = False) -> DataFrame:
    there = {c.lower(): c for c in df.columns}

    def column(field) -> Column:
        value = F.col(f"`{there[field.name.lower()]}`") if field.name.lower() in there else F.lit(None)
        value = value.try_cast(field.dataType) if lenient else value.cast(field.dataType)
        if field.name in PADDED:
            value = F.rtrim(value)
        if field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]).cast(field.dataType))
        return value.alias(field.name)

    return df.select(*[column(f) for f in schema.fields])


CORRUPT = "_corrupt_record"


def _csv_text(spark: SparkSession, name: str, path: str, **options: str) -> DataFrame:
    """Columns of CSV files as text, and the whole line of each that does not fit; named by the header if there is one, else as declared."""
    named = str(options.get("header", "false")).lower() == "true"
    names = spark.read.options(**options).csv(path).columns if named else schema_of(name).names
    text = StructType.fromDDL(", ".join(f"`{n}` string" for n in (*names, CORRUPT)))
    return spark.read.schema(text).options(**options).options(mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, columnPruning="false").csv(path)


def _unreadable(df: DataFrame, schema: StructType) -> Column:
    """A line that does not fit, or a value that its column cannot hold."""
    there = {c.lower(): c for c in df.columns}
    bad = F.col(CORRUPT).isNotNull()
    for field in schema.fields:
        if field.name.lower() in there:
            value = F.col(f"`{there[field.name.lower()]}`")
            bad = bad | (value.isNotNull() & value.try_cast(field.dataType).isNull())
    return bad


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """One table with its declared schema, from files that may lack columns, have more, or hold other types.

    Parquet files are read by their own schema, JSON by the declared one. CSV columns go by the names in the header
    (``header="true"``), else by their places; lines that cannot be read are left out, see :func:`rejected_lines`. ``fmt="jdbc"`` pulls from an existing repository
    database; pass ``url``, ``dbtable`` and, for a parallel read, ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions``.
    """
    if fmt == "csv":
        text = _csv_text(spark, name, path, **options)
        return conform(text.filter(~_unreadable(text, schema_of(name))), name, lenient=True)
    reader = spark.read.format(fmt).options(**options)
    if fmt in ("jdbc", "parquet"):
        return conform(reader.load(path) if fmt == "parquet" else reader.load(), name)
    return conform(reader.schema(schema_of(name)).load(path), name)


def rejected_lines(spark: SparkSession, name: str, path: str, **options: str) -> DataFrame:
    """Lines of CSV files that :func:`read_table` leaves out: ``line`` if it does not fit the header, else its ``fields`` as text."""
    text = _csv_text(spark, name, path, **options)
    fields = F.to_json(F.struct(*(F.col(f"`{c}`") for c in text.columns if c != CORRUPT)))
    return text.filter(_unreadable(text, schema_of(name))).select(F.col(CORRUPT).alias("line"), fields.alias("fields"))


# facts and roll-ups stored by period: table -> (partition column, date column it derives from)
PARTITIONED: dict[str, tuple[str, str | None]] = {
    "database_size": ("yyyymm", "DateCaptured"),
    "disk_volume_space": ("yyyymm", "DateCaptured"),
    "sql_error_log": ("yyyymm", "DateTime"),
    "sql_job_history": ("yyyymm", "ExecutionDateTime"),
    "database_monthly": ("YearMonth", None),
    "volume_monthly": ("YearMonth", None),
    "trending_servers": ("YearMonth", None),
    "trending_instances": ("YearMonth", None),
    "trending_databases": ("YearMonth", None),
    "run_log": ("yyyymm", "DateTimeCaptured"),
    "policy_history": ("yyyymm", "EvaluationDateTime"),
    "policy_history_detail": ("yyyymm", "EvaluationDateTime"),
    "evaluation_errors": ("yyyymm", "EvaluationDateTime"),
}


# daily facts: below its month each day has a folder of its own, so a day's merge rewrites that day and a purge drops folders
DAILY: dict[str, str] = {"database_size": "DateCaptured", "disk_volume_space": "DateCaptured"}


class Warehouse:
    """Stored tables as attributes, the form every report and merge accepts.

    Period facts are partitioned and rewritten one period at a time; all other tables are
    replaced as a whole, generation by generation.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def path(self, name: str) -> str:
        return table_path(self.root, name)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise KeyError(name)
        path = self.path(name)
        if name not in PARTITIONED:
            if not markers(self.spark, path):
                return self.spark.createDataFrame([], schema_of(name))
            return conform(read_current(self.spark, path), name)
        typed = StructType(list(schema_of(name).fields))
        if PARTITIONED[name][0] not in typed.names:
            typed = typed.add(PARTITIONED[name][0], IntegerType())
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], typed)
        # The partition column stays visible to the scan, so a filter on the period prunes directories.
        rows = self.spark.read.schema(typed).parquet(path)
        return rows.select(*typed.names)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in SCHEMAS:
            raise AttributeError(name)
        return self[name]

    def save(self, name: str, df: DataFrame) -> None:
        """Store a table; of a partitioned one only the periods, of a daily one only the days that ``df`` contains."""
        rows = conform(df, name)
        if name in PARTITIONED:
            key, date_col = PARTITIONED[name]
            write_partitioned(rows, self.path(name), (key, *filter(None, [DAILY.get(name)])), date_col or key)
        else:
            replace_table(rows, self.path(name))

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows to a partitioned table without reading or rewriting what is stored."""
        key, date_col = PARTITIONED[name]
        rows = conform(df, name)
        rows = rows.withColumn(key, yyyymm(date_col)) if date_col else rows
        rows.write.mode("append").partitionBy(key).parquet(self.path(name))

    def periods(self, name: str) -> list[int]:
        """Stored periods, from the directory names; a few dozen per table."""
        key = PARTITIONED[name][0] + "="
        path = self.path(name)
        if not path_exists(self.spark, path):
            return []
        return sorted(int(d.removeprefix(key)) for d in list_names(self.spark, path) if d.startswith(key))

    def days(self, name: str, period: int) -> list[str]:
        """Stored days of a daily table's month, from the folder names."""
        key, path = DAILY[name] + "=", self._period_path(name, period)
        return sorted(d.removeprefix(key) for d in list_names(self.spark, path) if d.startswith(key)) if path_exists(self.spark, path) else []

    def drop_day(self, name: str, period: int, day: str) -> None:
        delete_path(self.spark, os.path.join(self._period_path(name, period), f"{DAILY[name]}={day}"))

    def rewrite_period(self, name: str, period: int, rows: DataFrame) -> None:
        """Replace all rows of a period by ``rows`` of it, which may be none."""
        if rows.isEmpty():
            self.drop_period(name, period)
            return
        left = {str(r[0]) for r in rows.select(DAILY[name]).distinct().collect()} if name in DAILY else set()  # 31 at most
        self.save(name, rows)
        for day in self.days(name, period) if name in DAILY else ():
            if day not in left:
                self.drop_day(name, period, day)

    def _period_path(self, name: str, period: int) -> str:
        return os.path.join(self.path(name), f"{PARTITIONED[name][0]}={int(period)}")

    def drop_period(self, name: str, period: int) -> None:
        delete_path(self.spark, self._period_path(name, period))


# ---- writes ----------------------------------------------------------------------

def write_partitioned(df: DataFrame, path: str, keys: Sequence[str] = ("yyyymm",), date_col: str = "DateCaptured") -> None:
    """Overwrite only the partitions that ``df`` contains.

    ``yyyymm`` is derived from ``date_col`` when it is a key.  The rebalance hint
    clusters rows by partition key, yet lets adaptive execution split a big month over
    many tasks and merge small ones.
    """
    out = df.withColumn("yyyymm", yyyymm(date_col)) if "yyyymm" in keys and "yyyymm" not in df.columns else df
    out.hint("rebalance", *[F.col(k) for k in keys]).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


#: Generations of a table that stay readable, so that a reader that has just looked up the marker can finish.
GENERATIONS_KEPT = 3


def markers(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Complete markers (number, folder), oldest first; one without its success file does not count."""
    if not path_exists(spark, path):
        return []
    found = [(int(d.removeprefix("marker=")), os.path.join(path, d)) for d in list_names(spark, path) if d.startswith("marker=")]
    return sorted((n, folder) for n, folder in found if path_exists(spark, os.path.join(folder, "_SUCCESS")))


def _generation(spark: SparkSession, marker: str) -> str:
    return spark.read.schema("generation string").parquet(marker).first()[0]


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), kept: int = GENERATIONS_KEPT) -> str:
    """Write a new generation beside the old ones, then a new marker that names it.

    A job cannot overwrite the files it reads, and a lost executor must not leave half a table. Markers are numbered and
    never rewritten: the highest complete one counts, so a reader sees either the old or the new generation at any time.
    Afterwards all but the last ``kept`` generations go.
    """
    spark = df.sparkSession
    generation = f"gen={uuid.uuid4().hex}"
    df.write.mode("error").partitionBy(*partition_by).parquet(os.path.join(path, generation))
    older = markers(spark, path)
    number = older[-1][0] + 1 if older else 1
    marker = spark.createDataFrame([(generation,)], "generation string")
    marker.coalesce(1).write.mode("error").parquet(os.path.join(path, f"marker={number:08d}"))
    for _, folder in older[: max(0, len(older) + 1 - kept)]:
        delete_path(spark, os.path.join(path, _generation(spark, folder)))
        delete_path(spark, folder)
    return generation


def read_current(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(os.path.join(path, _generation(spark, markers(spark, path)[-1][1])))


# ---- staging ---------------------------------------------------------------------

def staging_path(root: str, dataset: str, schema_version: int) -> str:
    return os.path.join(root, "staging", dataset, f"v={int(schema_version)}")


def land_batch(df: DataFrame, root: str, dataset: str, run_id: int, schema_version: int = 1) -> None:
    """Add one collector batch under its run id; a repeated run replaces its own batch only."""
    df.withColumn("run_id", F.lit(run_id).cast("bigint")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(staging_path(root, dataset, schema_version))


def read_batch(
    spark: SparkSession, root: str, dataset: str, run_id: int, schema: str | StructType, schema_version: int = 1,
) -> DataFrame:
    """One run's rows; the filter prunes to its directory."""
    typed = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    typed = StructType(list(typed.fields)).add("run_id", LongType())
    rows = spark.read.schema(typed).parquet(staging_path(root, dataset, schema_version))
    return rows.filter(F.col("run_id") == run_id).drop("run_id")


def read_versions(spark: SparkSession, root: str, dataset: str, schema: str, defaults: Mapping[str, object] | None = None, run_id: int | None = None) -> DataFrame:
    """Staged rows of all schema versions in the present form: each version is read by its own files' schema, then conformed.

    Columns that a version lacks get their default or null; those it alone has are dropped. Only the latest version of a run counts, as a
    collector that is upgraded between two attempts of a run lands it again.
    """
    base = os.path.dirname(staging_path(root, dataset, 0))
    versions = sorted(int(n.removeprefix("v=")) for n in list_names(spark, base) if n.startswith("v=")) if path_exists(spark, base) else []
    typed = StructType.fromDDL(schema).add("run_id", LongType())
    out = spark.createDataFrame([], typed)
    for version in versions:
        rows = spark.read.option("mergeSchema", "true").parquet(staging_path(root, dataset, version))
        rows = rows if run_id is None else rows.filter(F.col("run_id") == run_id)
        rows = shaped(rows, typed, defaults or {})
        runs = rows.select("run_id").distinct()
        out = out.join(runs, "run_id", "left_anti").select(*typed.names).unionByName(rows)
    return out


def clear_batch(spark: SparkSession, root: str, dataset: str, run_id: int, schema_version: int = 1) -> bool:
    """Drop one run's staged rows; other runs are untouched.  Returns whether there was something to drop."""
    return delete_path(spark, os.path.join(staging_path(root, dataset, schema_version), f"run_id={int(run_id)}"))


def append_run_log(spark: SparkSession, path: str, run_id: int, messages: Sequence[tuple[str, str]]) -> None:
    """Append (timestamp text, description) status lines of one run."""
    rows = spark.createDataFrame([(ts, run_id, text) for ts, text in messages], "ts string, ProcessID int, Description string")
    rows.select(
        F.xxhash64("ts", "ProcessID", "Description").alias("LogID"), F.col("ts").cast("timestamp_ntz").alias("DateTimeCaptured"),
        "ProcessID", "Description").write.mode("append").parquet(path)


def settings_map(settings: DataFrame) -> Mapping[str, str]:
    """The known settings as a dict: at most one row per known name reaches the driver."""
    from fleetlens.sources.seeds import SETTINGS

    known = settings.filter(F.col("SettingName").isin(*SETTINGS)).groupBy("SettingName").agg(F.max("SettingValue").alias("v"))
    return {r["SettingName"]: r["v"] for r in known.collect()}
