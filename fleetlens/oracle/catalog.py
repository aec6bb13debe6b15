"""Every registered query with its check SQL.  All of them run over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.operators import feeds, licence, lifecycle, merges, policy, rollup, upsert, views
from fleetlens.oracle.sql import D, EV, SIZE_DAY, edition, growth, trimmed
from fleetlens.plans import reports, snapshot
from fleetlens.sources import seeds, tables
from fleetlens.sources.fleet import AS_OF, EVENTS_AS_OF, SIZE_AS_OF, Fleet, spark_sql
from fleetlens.sources.shared import shared_dir
from fleetlens.streaming import backfill, incremental, ordered

TREND_DAY = "2001-10-01"
TREND_AS_OF = "2001-01-15"
DOMAIN = "corp.local"

REGISTRY: dict[str, tuple[Callable[[Fleet], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Fleet], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn

    return register


# ---- shared inputs -------------------------------------------------------------

def _iv(t):
    return reports.instance_view(t)


def _details(t):
    return policy.load_policy_history(t.policy_history, t.policies)[0]


def _summary(t):
    return policy.policy_summary(_details(t))


def _health(t, **kw):
    return reports.report_config_health(_summary(t), t.policies, t.policy_exclusions, **kw)


def _stored_services(t):
    return feeds.classify_services(t.service_feed).select(
        "ServerID", "ServiceName", "InstanceName", "DisplayName", "FilePath", "ServiceType", "StartMode", "ServiceAccount",
        F.lit(0).alias("ServiceVersion"), F.lit("0.0").alias("ServiceBuild"), "Status", F.lit("1999-01-01").cast("date").alias("DiscoveryOn"),
        F.date_sub(F.lit(AS_OF).cast("date"), (F.col("ServerID") % 2 * 3).cast("int")).alias("LastUpdated"))


def _property_names(t):
    return t.property_feed.select("PropertyName").distinct().select(
        F.col("PropertyName").alias("ExtendedPropertyName"),
        (F.length("PropertyName") * 100 + F.ascii("PropertyName")).cast("bigint").alias("ExtendedPropertyID"))


def _property_values(t):
    return t.property_feed.filter(F.col("PropertyName") != "CostCenter").join(
        _property_names(t), F.col("PropertyName") == F.col("ExtendedPropertyName")).select(
        "SQLInstanceID", "ExtendedPropertyID", F.col("PropertyValue").alias("ExtendedPropertyValue"),
        F.lit("1999-01-01").cast("date").alias("DiscoveryOn"), F.lit("2001-10-01").cast("date").alias("LastUpdated"))


def _build_parts(t):
    return feeds.version_label(t.build_feed)


class _Bulk:
    """The fleet with the bulk size fact in place of the plain one."""

    def __init__(self, t):
        self._t = t
        self.databases = t.databases_bulk
        self.database_size = t.database_size_bulk

    def __getattr__(self, name):
        return getattr(self._t, name)


def _expired(t, **kw):
    return lifecycle.expired_objects(t, AS_OF, **kw)


def _monthly(t):
    return rollup.monthly_database_size(t.database_size)


def _monthly_volumes(t):
    return rollup.monthly_volume_space(t.disk_volume_space)


def _error_marks(t):
    return merges.high_water_marks(t.sql_error_log, "DateTime")


# ---- sources and sinks ---------------------------------------------------------

@query("s1_read_table", """
    SELECT DatabaseID, CASE WHEN DatabaseID % 3 = 0 THEN '' ELSE coalesce(FileType, '') END AS FileType, DateCaptured, FileSize_mb FROM database_size""")
def _(t):
    """Stored files of three kinds: without a column and with a narrower type; with more columns and padded text; CSV in another order with lines that cannot be read."""
    root, size = shared_dir(t.spark, "drift"), t.database_size.select("DatabaseID", "FileType", "DateCaptured", "FileSize_mb")
    third = F.col("DatabaseID") % 3
    size.filter(third == 0).select(F.col("FileSize_mb").cast("int"), "DateCaptured", F.col("DatabaseID").cast("int")).write.parquet(f"{root}/one")
    size.filter(third == 1).withColumns({"FileType": F.rpad("FileType", 12, " "), "Collector": F.lit("x")}).write.parquet(f"{root}/two")
    size.filter(third == 2).select("DateCaptured", "FileSize_mb", "DatabaseID", "FileType", F.lit(1).alias("Extra")).write.option("header", "true").csv(f"{root}/csv")
    header = "DateCaptured,FileSize_mb,DatabaseID,FileType,Extra"
    bad = size.filter(third == 2).select(F.concat_ws(
        "\n", F.lit(header), F.concat(F.lit("1998-01-01,many,"), "DatabaseID", F.lit(",Data,1")), F.concat(F.lit("1998-01-01,1,"), "DatabaseID", F.lit(",Data,1,2,3"))).alias("value"))
    bad.write.mode("append").text(f"{root}/csv")
    kinds = [tables.read_table(t.spark, "database_size", f"{root}/{part}", fmt, **options)
             for part, fmt, options in (("one", "parquet", {}), ("two", "parquet", {}), ("csv", "csv", {"header": "true"}))]
    return reduce(DataFrame.unionByName, kinds)


@query("s2_read_versions", """
    SELECT SQLInstanceID, JobName, CASE WHEN SQLInstanceID % 2 = 0 THEN 'none' ELSE CategoryName END AS CategoryName, ExecutionDateTime,
           CAST(Duration AS BIGINT) AS Duration, JobStatus, CASE WHEN SQLInstanceID % 2 = 0 THEN 1 ELSE 2 END AS run_id FROM staged_jobs""")
def _(t):
    """Runs landed by collectors of two versions: the older one has no category, an int duration and a column that is gone now; run 2 was landed by both."""
    root, even = shared_dir(t.spark, "versions"), F.col("SQLInstanceID") % 2 == 0
    old = t.staged_jobs.drop("CategoryName").withColumn("Note", F.lit("old"))
    tables.land_batch(old.filter(even), root, "jobs", 1, 1)
    tables.land_batch(old.filter(~even), root, "jobs", 2, 1)
    tables.land_batch(t.staged_jobs.filter(~even).withColumn("Duration", F.col("Duration").cast("bigint")), root, "jobs", 2, 2)
    out = tables.read_versions(t.spark, root, "jobs", _STAGED_JOBS.replace("Duration int", "Duration bigint"), {"CategoryName": "none"})
    return out.withColumn("run_id", F.col("run_id").cast("int"))


def _values(rows) -> str:
    """Rows as an SQL list."""
    text = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(text, row)) + ")" for row in rows)


def _own_ids(out: DataFrame, stored: DataFrame, id_col: str) -> DataFrame:
    """A seeded table with what is owed of its ids: stored ones stay, each new row has one of its own above them."""
    last = stored.agg(F.max(id_col)).scalar()
    own = F.count(F.lit(1)).over(Window.partitionBy(id_col)) == 1
    return out.withColumns({"IsOwn": own & F.col(id_col).isNotNull(), "IsNew": F.coalesce(F.col(id_col) > last, F.lit(False))}).withColumn(
        id_col, F.when(~F.col("IsNew"), F.col(id_col)))


@query("s4_seed_dimension", f"""
    SELECT o.OperatingSystemID, coalesce(o.OperatingSystemName, s.n) AS OperatingSystemName,
           CASE WHEN s.n IS NOT NULL THEN s.sn ELSE o.OperatingSystemShortName END AS OperatingSystemShortName, true AS IsOwn, o.OperatingSystemName IS NULL AS IsNew
    FROM operating_systems o FULL OUTER JOIN (VALUES {_values(seeds.OPERATING_SYSTEMS)}) s(n, sn) ON s.n = o.OperatingSystemName""")
def _(t):
    return _own_ids(seeds.seed_operating_systems(t.operating_systems), t.operating_systems, "OperatingSystemID")


@query("s4_seed_versions", f"""
    SELECT o.SQLVersionID, coalesce(o.SQLVersion, s.n) AS SQLVersion, coalesce(s.sn, o.SQLVersionShortName) AS SQLVersionShortName, coalesce(o.SQLMajorVersion, s.a) AS SQLMajorVersion,
           coalesce(o.SQLMinorVersion, s.b) AS SQLMinorVersion, coalesce(o.SQLBuild, s.c) AS SQLBuild, coalesce(CAST(s.e AS DATE), o.SQLVersionSupportEndDate) AS SQLVersionSupportEndDate,
           true AS IsOwn, o.SQLVersion IS NULL AS IsNew
    FROM (SELECT * FROM sql_versions UNION ALL SELECT 1, 'Unknown', 'Unknown', 0, 0, 0, DATE '1900-01-01' WHERE NOT EXISTS (SELECT 1 FROM sql_versions WHERE SQLVersion = 'Unknown')) o
    FULL OUTER JOIN (VALUES {_values(seeds.SQL_VERSIONS)}) s(n, sn, a, b, c, e) ON s.n = o.SQLVersion""")
def _(t):
    # Stored ids start at 2, as id 1 is reserved.
    stored = t.sql_versions.withColumn("SQLVersionID", F.col("SQLVersionID").cast("int"))
    return _own_ids(seeds.seed_versions(stored), stored, "SQLVersionID")


@query("s4_seed_applications", """
    SELECT * FROM application UNION ALL SELECT 1, 'Unknown', 'Unknown' WHERE NOT EXISTS (SELECT 1 FROM application WHERE lower(ApplicationName) = 'unknown')""")
def _(t):
    return seeds.seed_applications(t.application)


@query("s4_seed_settings", f"""
    WITH mine AS (SELECT event_type AS SettingName, CAST(count(*) AS VARCHAR) AS SettingValue FROM events GROUP BY 1
        UNION ALL SELECT 'RunLog_Enabled', CAST(count(*) AS VARCHAR) FROM events)
    SELECT * FROM mine UNION ALL SELECT * FROM (VALUES {_values(seeds.SETTINGS.items())}) s(n, v) WHERE n NOT IN (SELECT SettingName FROM mine)""")
def _(t):
    events = t.raw("events")
    count = F.count(F.lit(1)).cast("string").alias("SettingValue")
    mine = events.groupBy(F.col("event_type").alias("SettingName")).agg(count).unionByName(
        events.agg(count).select(F.lit("RunLog_Enabled").alias("SettingName"), "SettingValue"))
    return seeds.seed_settings(mine)


@query("s4_seed_policy_short_names", f"""
    WITH p AS (SELECT DISTINCT policy_id AS id, PolicyName AS n FROM policies UNION ALL SELECT CAST(1000 + o_orderkey AS INTEGER), 'guest permissions' FROM orders WHERE o_orderkey < 3
               UNION ALL SELECT CAST(2000 + p_size AS INTEGER), 'Database Auto Close' FROM (SELECT DISTINCT p_size FROM part) x),
         s AS (SELECT p.id, v.sn FROM p JOIN (VALUES {_values(seeds.POLICY_SHORT_NAMES)}) v(n, sn) ON v.n = p.n)
    SELECT coalesce(o.id, s.id) AS Policy_ID, coalesce(s.sn, o.sn) AS Policy_ShortName
    FROM (SELECT id, 'old' AS sn FROM p WHERE id % 2 = 0) o FULL OUTER JOIN s ON s.id = o.id""")
def _(t):
    one = t.raw("orders").filter("o_orderkey < 3").select((1000 + F.col("o_orderkey")).cast("int").alias("policy_id"), F.lit("guest permissions").alias("PolicyName"))
    two = t.raw("part").select((2000 + F.col("p_size")).cast("int").alias("policy_id"), F.lit("Database Auto Close").alias("PolicyName")).distinct()
    here = t.policies.select("policy_id", "PolicyName").distinct().unionByName(one).unionByName(two)
    stored = here.filter("policy_id % 2 = 0").select(F.col("policy_id").alias("Policy_ID"), F.lit("old").alias("Policy_ShortName"))
    return seeds.seed_policy_short_names(stored, here)


@query("s4_fresh_warehouse_hosts", f"""
    WITH names AS (SELECT row_number() OVER () - 1 AS k, n FROM (VALUES {_values(seeds.OPERATING_SYSTEMS)}) s(n, sn))
    SELECT ServerName, coalesce(n, 'Unknown') AS OperatingSystemName FROM servers LEFT JOIN names ON k = ServerID % 9""")
def _(t):
    """A warehouse that starts empty: seeds first, then hosts; the ninth part reports a system that no seed names."""
    os = seeds.seed_operating_systems(seeds.empty_table(t.spark, tables.SCHEMAS["operating_systems"][1]))
    names = F.array(*(F.lit(n) for n, _ in seeds.OPERATING_SYSTEMS), F.lit("Windows NT"))
    feed = t.servers.select("ServerName", F.get(names, (F.col("ServerID") % 9).cast("int")).alias("OperatingSystemName"), "NumberOfCores")
    hosts = merges.merge_servers(seeds.empty_table(t.spark, tables.SCHEMAS["servers"][1]), feed, os, AS_OF)
    return hosts.join(os, "OperatingSystemID").select("ServerName", "OperatingSystemName")


@query("s4_fresh_warehouse_versions", f"""
    SELECT b.SQLInstanceID, coalesce((SELECT v.n FROM (VALUES {_values(seeds.SQL_VERSIONS)}) v(n, sn, a, b, c, e)
        WHERE v.a = b.SQLBuild_Major AND v.b = b.SQLBuild_Minor AND v.c <= b.SQLBuild_Build ORDER BY v.c DESC, v.n LIMIT 1), 'Unknown') AS SQLVersion
    FROM build_parts b""")
def _(t):
    versions = seeds.seed_versions(seeds.empty_table(t.spark, tables.SCHEMAS["sql_versions"][1]))
    return merges.resolve_version(_build_parts(t), versions).select("SQLInstanceID", "SQLInstanceVersionID").join(
        versions.select(F.col("SQLVersionID").alias("SQLInstanceVersionID"), "SQLVersion"), "SQLInstanceVersionID").select("SQLInstanceID", "SQLVersion")


# ---- conformed views -----------------------------------------------------------

@query("v1_instance_view", "SELECT * FROM instance_view")
def _(t):
    return _iv(t)


@query("v2_volume_forecast", "SELECT * FROM volume_forecast")
def _(t):
    return views.volume_forecast(t.disk_volume_space, t.disk_volumes, t.servers, t.sql_clusters)


@query("v3_group_paths", "SELECT * FROM group_paths")
def _(t):
    return views.group_paths(t.server_groups)


@query("v4_group_list", "SELECT g.GroupID, g.GroupName, m.IsMonitored FROM group_paths g JOIN groups_to_monitor m ON m.GroupID = g.GroupID")
def _(t):
    return views.group_list(views.group_paths(t.server_groups), t.groups_to_monitor)


@query("v5_monitored_instances", """
    SELECT g.GroupName, lower(r.ServerInstance) AS ServerInstance, lower(r.ServerInstance) AS ServerInstanceConnectionString
    FROM group_paths g JOIN groups_to_monitor m ON m.GroupID = g.GroupID JOIN registered_servers r ON r.server_group_id = m.GroupID
    WHERE m.IsMonitored""")
def _(t):
    return views.monitored_instances(views.group_paths(t.server_groups), t.groups_to_monitor, t.registered_servers)


@query("v6_group_tree", """
    WITH RECURSIVE w AS (
        SELECT parent_id, server_group_id, 'ALL' AS GroupName, 1 AS GroupLevel, 'ALL' AS Sort, '' AS GroupValue FROM server_groups WHERE parent_id IS NULL
        UNION ALL SELECT c.parent_id, c.server_group_id, repeat('  ', w.GroupLevel) || c.name, w.GroupLevel + 1, w.Sort || ' | ' || c.name, c.name
        FROM server_groups c JOIN w ON c.parent_id = w.server_group_id) SELECT * FROM w""")
def _(t):
    return views.group_tree(t.server_groups)


@query("v7_group_instances", "SELECT r.ServerInstance AS server_name, g.GroupName FROM registered_servers r JOIN group_paths g ON g.GroupID = r.server_group_id")
def _(t):
    return views.group_instances(views.group_paths(t.server_groups), t.registered_servers)


# ---- feeds ----------------------------------------------------------------------

@query("f1_split_instance_name", r"""
    SELECT RowID, ServerInstance, regexp_extract(lower(ServerInstance), '^([^.,\\]*)', 1) AS ComputerName,
           regexp_extract(lower(ServerInstance), '^[^.,\\]*\.([^,\\]*)', 1) AS DomainName,
           CASE WHEN instr(ServerInstance, chr(92)) > 0 THEN regexp_extract(lower(ServerInstance), '\\([^,]*)', 1) ELSE 'mssqlserver' END AS SQLInstanceName,
           CASE WHEN instr(ServerInstance, ',') > 0 THEN CAST(split_part(ServerInstance, ',', 2) AS INTEGER) ELSE 0 END AS Port
    FROM registered_servers""")
def _(t):
    return feeds.split_instance_name(t.registered_servers.select("RowID", "ServerInstance"))


@query("f2_normalise_registered_names", r"""
    SELECT RowID, regexp_extract(s, '^([^.,\\]*)', 1) || CASE WHEN instr(s, chr(92)) > 0 THEN regexp_extract(s, '(\\[^,]*)', 1) ELSE '' END AS ServerInstance,
           regexp_extract(s, '^([^.,\\]*)', 1) || '.corp.local' || regexp_extract(s, '^[^,\\]*(.*)$', 1) AS ServerInstanceConnectionString,
           regexp_extract(s, '^([^.,\\]*)', 1) || '.corp.local' AS ComputerName,
           CASE WHEN instr(s, chr(92)) > 0 THEN regexp_extract(s, '\\([^,]*)', 1) ELSE 'mssqlserver' END AS SQLInstanceName
    FROM (SELECT RowID, lower(ServerInstance) AS s FROM registered_servers) x""")
def _(t):
    low = F.lower("ServerInstance")
    return feeds.normalise_registered_names(
        t.registered_servers.select("RowID", low.alias("ServerInstance"), low.alias("ServerInstanceConnectionString")), DOMAIN)


@query("f3_extract_errors", "SELECT * FROM extracted_errors")
def _(t):
    return feeds.extract_errors(t.log_lines)


@query("f4_select_log_archives", """
    SELECT * FROM (SELECT SQLInstanceID, ArchiveNo, lag(LastModified) OVER (PARTITION BY SQLInstanceID ORDER BY LastModified, ArchiveNo) AS CreationDate,
        LastModified AS ModifiedDate FROM log_archives) x
    WHERE CreationDate IS NOT NULL AND ModifiedDate >= TIMESTAMP '2024-01-10 00:00:00' AND CreationDate <= TIMESTAMP '2024-01-20 00:00:00'""")
def _(t):
    return feeds.select_log_archives(t.log_archives, "2024-01-10 00:00:00", "2024-01-20 00:00:00")


@query("f5_decode_job_history", """
    SELECT j.SQLInstanceID, j.name AS JobName, c.name AS CategoryName, h.run_ts AS ExecutionDateTime,
           CAST(run_duration // 1000000 * 86400 + run_duration // 10000 % 100 * 3600 + run_duration // 100 % 100 * 60 + run_duration % 100 AS INTEGER) AS Duration,
           CASE run_status WHEN 0 THEN 'Failed' WHEN 1 THEN 'Successful' WHEN 2 THEN 'Retrying' WHEN 3 THEN 'Cancelled' WHEN 4 THEN 'Running' ELSE 'Unknown' END AS JobStatus
    FROM job_history_raw h JOIN jobs_raw j ON j.job_id = h.job_id JOIN job_categories_raw c ON c.category_id = j.category_id
    WHERE h.step_id = 0 AND j.name NOT LIKE 'syspolicy%'""")
def _(t):
    return feeds.decode_job_history(t.job_history_raw, t.jobs_raw, t.job_categories_raw)


_FILES_SQL = """
    SELECT d.SQLInstanceID, {guid} AS AGGuid, coalesce(a.ApplicationName, 'Unknown') AS ApplicationName, {owner} AS ApplicationOwner,
           d.DatabaseName, upper(d.DatabaseState) AS DatabaseState, CASE WHEN f.FileTypeCode = 0 THEN 'Data' ELSE 'Log' END AS FileType,
           CAST(sum(f.SizePages // 128) AS BIGINT) AS FileSize_mb
    FROM file_feed f JOIN databases d ON d.DatabaseID = f.DatabaseID LEFT JOIN database_apps_raw a ON a.DatabaseID = f.DatabaseID
    {join} GROUP BY 1, 2, 3, 4, 5, 6, 7"""


@query("f6_rollup_database_files", _FILES_SQL.format(
    guid="coalesce(g.AGGuid, '00000000-0000-0000-0000-000000000000')", owner="coalesce(a.ApplicationOwner, 'Unknown')",
    join="LEFT JOIN ag_databases x ON x.DatabaseID = f.DatabaseID LEFT JOIN ag_instances y ON y.AGInstanceID = x.AGInstanceID "
         "LEFT JOIN availability_groups g ON g.AGID = y.AGID"))
def _(t):
    ag = t.ag_databases.join(t.ag_instances.select("AGInstanceID", "AGID"), "AGInstanceID").join(
        t.availability_groups.select("AGID", "AGGuid"), "AGID").select("DatabaseID", "AGGuid")
    return feeds.rollup_database_files(t.file_feed, t.databases, t.database_apps_raw, ag)


@query("f6_rollup_database_files_older", _FILES_SQL.format(
    guid="'00000000-0000-0000-0000-000000000000'", owner="CAST(NULL AS VARCHAR)", join=""))
def _(t):
    return feeds.rollup_database_files(t.file_feed, t.databases, t.database_apps_raw, None, with_owner=False)


_PRODUCT = ("'Microsoft SQL Server' || CASE SQLBuild_Major WHEN 8 THEN ' 2000' WHEN 9 THEN ' 2005' WHEN 10 THEN CASE WHEN SQLBuild_Minor >= 50 THEN ' 2008 R2' "
            "ELSE ' 2008' END WHEN 11 THEN ' 2012' WHEN 12 THEN ' 2014' WHEN 13 THEN ' 2016' WHEN 14 THEN ' 2017' WHEN 15 THEN ' 2019' WHEN 16 THEN ' 2022' ELSE '' END")


@query("f7_version_label", f"SELECT *, {_PRODUCT} AS SQLVersion FROM build_parts")
def _(t):
    return _build_parts(t)


@query("f8_os_label", """
    SELECT *, CASE WHEN OSCaption LIKE '%2012 R2%' THEN 'Windows Server 2012 R2' WHEN OSCaption LIKE '%2019%' THEN 'Windows Server 2019'
        WHEN OSCaption LIKE '% 10 %' THEN 'Windows 10' ELSE 'Unknown' END AS OperatingSystem FROM build_feed""")
def _(t):
    return feeds.os_label(t.build_feed)


@query("f9_host_capacity", """
    SELECT m.ServerID, coalesce(p.n, 'Unknown') AS ProcessorName, coalesce(p.c, 0) AS NumberOfCores, coalesce(p.l, 0) AS NumberOfLogicalCores,
           CAST(m.TotalPhysicalMemory // 1048576 AS BIGINT) AS Memory_mb, coalesce(g.s, 0) AS PageFile_mb
    FROM memory_feed m LEFT JOIN (SELECT ServerID, max(Name) AS n, CAST(sum(NumberOfCores) AS BIGINT) AS c, CAST(sum(NumberOfLogicalProcessors) AS BIGINT) AS l
        FROM processor_feed GROUP BY 1) p ON p.ServerID = m.ServerID
    LEFT JOIN (SELECT ServerID, CAST(sum(AllocatedBaseSize) AS BIGINT) AS s FROM pagefile_feed GROUP BY 1) g ON g.ServerID = m.ServerID""")
def _(t):
    return feeds.host_capacity(t.processor_feed, t.memory_feed, t.pagefile_feed)


@query("f10_data_folders", """
    SELECT DISTINCT lower(substring(PhysicalName, 1, length(PhysicalName) - instr(reverse(PhysicalName), chr(92)))) AS FolderName FROM file_feed
    UNION ALL
    SELECT DISTINCT lower(substring(PhysicalDeviceName, 1, length(PhysicalDeviceName) - instr(reverse(PhysicalDeviceName), chr(92))))
    FROM backup_feed WHERE PhysicalDeviceName <> 'nul:'""")
def _(t):
    return feeds.data_folders(t.file_feed, t.backup_feed)


@query("f11_classify_services", "SELECT * FROM classified_services")
def _(t):
    return feeds.classify_services(t.service_feed)


@query("f12_parse_replica_names", """
    SELECT r.ReplicaID, r.AGGuid, r.AGName,
           CASE WHEN instr(r.ReplicaServerName, chr(92)) > 0 THEN lower(substring(r.ReplicaServerName, 1, instr(r.ReplicaServerName, chr(92)) - 1)) ELSE lower(r.ReplicaServerName) END AS ComputerName,
           CASE WHEN instr(r.ReplicaServerName, chr(92)) > 0 THEN lower(substring(r.ReplicaServerName, instr(r.ReplicaServerName, chr(92)) + 1)) ELSE 'mssqlserver' END AS InstanceName,
           coalesce(s.RoleDesc, 'PRIMARY') AS ReplicaRole
    FROM replica_feed r LEFT JOIN replica_states s ON s.ReplicaID = r.ReplicaID""")
def _(t):
    return feeds.parse_replica_names(t.replica_feed, t.replica_states)


_MACHINE = "PropertyName IN ('EnvironmentType', 'MachineType', 'ServerType', 'ActiveNode') OR PropertyName LIKE 'PassiveNode%'"


@query("f13_pivot_properties", f"""
    SELECT SQLInstanceID, string_agg(CASE WHEN {_MACHINE} THEN PropertyName || '=' || PropertyValue END, ';' ORDER BY PropertyName) AS MachineProperties,
           string_agg(CASE WHEN NOT ({_MACHINE}) THEN PropertyName || '=' || PropertyValue END, ';' ORDER BY PropertyName) AS CustomProperties,
           count(CASE WHEN {_MACHINE} THEN 1 END) >= 4 AS IsComplete
    FROM property_feed GROUP BY 1""")
def _(t):
    def flat(c):
        return F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias(c)

    return feeds.pivot_properties(t.property_feed).select("SQLInstanceID", flat("MachineProperties"), flat("CustomProperties"), "IsComplete")


@query("f14_cluster_nodes", """
    SELECT SQLInstanceID, CASE WHEN instr(PropertyValue, '.') > 0 THEN lower(PropertyValue) ELSE lower(PropertyValue) || '.corp.local' END AS NodeName,
           PropertyName = 'ActiveNode' AS IsActiveNode
    FROM property_feed WHERE PropertyName = 'ActiveNode' OR PropertyName LIKE 'PassiveNode%'""")
def _(t):
    return feeds.cluster_nodes(feeds.pivot_properties(t.property_feed), DOMAIN)


_NOISE = "lower({0}) <> 'sa' AND lower({0}) NOT LIKE 'nt service' || chr(92) || 'mssql$%'"


@query("f15_server_memberships", f"""
    SELECT * FROM (
        SELECT SQLInstanceID, 'public' AS RoleName, name AS LoginName, type_desc AS LoginType FROM login_feed WHERE type <> 'R'
        UNION ALL
        SELECT m.SQLInstanceID, r.name, p.name, p.type_desc FROM login_role_members m
        JOIN login_feed r ON r.SQLInstanceID = m.SQLInstanceID AND r.principal_id = m.role_principal_id AND r.type = 'R'
        JOIN login_feed p ON p.SQLInstanceID = m.SQLInstanceID AND p.principal_id = m.member_principal_id WHERE p.principal_id <> 1) x
    WHERE {_NOISE.format('LoginName')}""")
def _(t):
    return feeds.server_memberships(t.login_feed, t.login_role_members)


@query("f16_database_memberships", """
    WITH s AS (SELECT DISTINCT SQLInstanceID, sid FROM login_feed WHERE sid IS NOT NULL),
    m AS (
        SELECT m.SQLInstanceID, m.DatabaseName, r.name AS RoleName, p.name AS UserName, p.type_desc AS UserType, p.sid FROM user_role_members m
        JOIN user_feed r ON r.SQLInstanceID = m.SQLInstanceID AND r.DatabaseName = m.DatabaseName AND r.principal_id = m.role_principal_id
        JOIN user_feed p ON p.SQLInstanceID = m.SQLInstanceID AND p.DatabaseName = m.DatabaseName AND p.principal_id = m.member_principal_id
        WHERE p.type IN ('U', 'S', 'G') AND r.type = 'R'
        UNION ALL
        SELECT SQLInstanceID, DatabaseName, 'public', name, type_desc, sid FROM user_feed WHERE type IN ('U', 'S') AND name NOT IN ('sys', 'INFORMATION_SCHEMA'))
    SELECT m.SQLInstanceID, m.DatabaseName, m.RoleName, m.UserName, m.UserType, s.sid IS NULL AS IsOrphaned
    FROM m LEFT JOIN s ON s.SQLInstanceID = m.SQLInstanceID AND s.sid = m.sid
    UNION ALL
    SELECT DISTINCT d.SQLInstanceID, d.DatabaseName, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS BOOLEAN)
    FROM database_replica_states d WHERE d.RoleDesc = 'SECONDARY'
      AND NOT EXISTS (SELECT 1 FROM m WHERE m.SQLInstanceID = d.SQLInstanceID AND m.DatabaseName = d.DatabaseName)""")
def _(t):
    return feeds.database_memberships(t.user_feed, t.user_role_members, t.login_feed, t.database_replica_states)


@query("f17_server_permissions", f"""
    SELECT g.SQLInstanceID, p.name AS GranteeName, q.name AS GrantorName, p.type_desc AS GranteeType, q.type_desc AS GrantorType,
           g.class_desc AS ObjectType, g.major_id AS ObjectID, g.state_desc AS Access, g.permission_name AS PermissionName
    FROM login_grants g JOIN login_feed p ON p.SQLInstanceID = g.SQLInstanceID AND p.principal_id = g.grantee_principal_id
    JOIN login_feed q ON q.SQLInstanceID = g.SQLInstanceID AND q.principal_id = g.grantor_principal_id
    WHERE {_NOISE.format('p.name')} AND g.permission_name NOT IN ('AUTHENTICATE SERVER', 'CONNECT SQL', 'CONNECT')""")
def _(t):
    return feeds.server_permissions(t.login_feed, t.login_grants)


@query("f18_database_permissions", """
    WITH r AS (
        SELECT g.SQLInstanceID, g.DatabaseName, p.name AS GranteeName, q.name AS GrantorName, p.type_desc AS GranteeType, q.type_desc AS GrantorType,
               g.class_desc AS ObjectType, coalesce(o.name, 'UNKNOWN') AS ObjectName, g.state_desc AS Access, g.permission_name AS PermissionName
        FROM user_grants g JOIN user_feed p ON p.SQLInstanceID = g.SQLInstanceID AND p.DatabaseName = g.DatabaseName AND p.principal_id = g.grantee_principal_id
        JOIN user_feed q ON q.SQLInstanceID = g.SQLInstanceID AND q.DatabaseName = g.DatabaseName AND q.principal_id = g.grantor_principal_id
        LEFT JOIN object_feed o ON o.SQLInstanceID = g.SQLInstanceID AND o.DatabaseName = g.DatabaseName AND o.object_id = g.major_id
        WHERE p.name NOT IN ('sa', 'dbo') AND g.permission_name <> 'CONNECT' AND g.major_id > 0
          AND (p.type = 'R' OR EXISTS (SELECT 1 FROM user_grants c WHERE c.permission_name = 'CONNECT' AND c.SQLInstanceID = g.SQLInstanceID
               AND c.DatabaseName = g.DatabaseName AND c.grantee_principal_id = g.grantee_principal_id)))
    SELECT * FROM r
    UNION ALL
    SELECT DISTINCT d.SQLInstanceID, d.DatabaseName, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR),
           CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)
    FROM database_replica_states d WHERE d.RoleDesc = 'SECONDARY'
      AND NOT EXISTS (SELECT 1 FROM r WHERE r.SQLInstanceID = d.SQLInstanceID AND r.DatabaseName = d.DatabaseName)""")
def _(t):
    return feeds.database_permissions(t.user_feed, t.user_grants, t.object_feed, t.database_replica_states)


@query("f19_server_roles", "SELECT SQLInstanceID, name AS RoleName, type_desc AS RoleType FROM login_feed WHERE type = 'R'")
def _(t):
    return feeds.server_roles(t.login_feed)


@query("f19_database_roles", "SELECT DISTINCT SQLInstanceID, name AS RoleName, type_desc AS RoleType FROM user_feed WHERE type = 'R'")
def _(t):
    return feeds.database_roles(t.user_feed)


@query("f20_shred_policy_results", "SELECT * FROM policy_targets")
def _(t):
    return policy.shred_policy_results(t.policy_history, t.policies)


@query("f21_shred_no_target_results", "SELECT * FROM policy_no_targets")
def _(t):
    return policy.shred_no_target_results(t.policy_history, t.policies)


@query("f22_shred_policy_errors", """
    SELECT EvaluatedServer, EvaluationDateTime, EvaluatedPolicy, ExceptionMessage AS EvaluationResults FROM policy_detail WHERE ExceptionMessage <> ''
    UNION ALL SELECT EvaluatedServer, EvaluationDateTime, EvaluatedPolicy, 'late' FROM policy_docs WHERE NOT bare AND PolicyHistoryID % 4 = 2""")
def _(t):
    return policy.shred_policy_errors(t.policy_history, t.policies)


def _shown(df, id_col, stored):
    """Ids of new rows as null, as the check SQL does not number them; -1 for a missing one and -2 for one that another row has."""
    last = stored.agg(F.coalesce(F.max(id_col), F.lit(0))).scalar()
    alone = F.count(F.lit(1)).over(Window.partitionBy(id_col)) == 1
    checked = df.withColumn("_alone", alone)
    value = F.when(F.col(id_col).isNull(), -1).when(~F.col("_alone"), -2).when(F.col(id_col) <= last, F.col(id_col))
    return checked.withColumn(id_col, value.cast(df.schema[id_col].dataType)).drop("_alone")


# ---- upserts ---------------------------------------------------------------------

@query("u0_upsert", f"""
    SELECT coalesce(t.DatabaseID, s.DatabaseID) AS DatabaseID, coalesce(s.st, t.DatabaseState) AS DatabaseState,
           CASE WHEN s.DatabaseID IS NOT NULL THEN {D} ELSE t.LastUpdated END AS LastUpdated
    FROM databases t FULL OUTER JOIN (SELECT DatabaseID, max(CASE WHEN SizePages > 3000000 THEN 'BIG' ELSE 'SMALL' END) AS st FROM file_feed GROUP BY 1) s
      ON s.DatabaseID = t.DatabaseID""")
def _(t):
    source = t.file_feed.select("DatabaseID", F.when(F.col("SizePages") > 3000000, "BIG").otherwise("SMALL").alias("DatabaseState"))
    return upsert.upsert(t.databases.select("DatabaseID", "DatabaseState", "LastUpdated"), source, ["DatabaseID"], ["DatabaseState"], {}, AS_OF)


@query("u1_applications", """
    SELECT t.ApplicationID, coalesce(t.ApplicationName, s.ApplicationName) AS ApplicationName, coalesce(s.o, t.ApplicationOwner) AS ApplicationOwner
    FROM application t FULL OUTER JOIN (SELECT ApplicationName, max(ApplicationOwner) AS o FROM application_feed GROUP BY 1) s ON s.ApplicationName = t.ApplicationName""")
def _(t):
    return _shown(merges.merge_applications(t.application, t.application_feed), "ApplicationID", t.application)


@query("u2_databases", f"""
    SELECT t.DatabaseID, coalesce(t.SQLInstanceID, s.SQLInstanceID) AS SQLInstanceID, coalesce(t.DatabaseName, s.DatabaseName) AS DatabaseName,
           coalesce(s.DatabaseState, t.DatabaseState) AS DatabaseState, coalesce(s.ApplicationID, t.ApplicationID) AS ApplicationID,
           coalesce(s.ApplicationName, t.ApplicationName) AS ApplicationName, coalesce(t.IsMonitored, true) AS IsMonitored,
           coalesce(t.DiscoveryOn, {D}) AS DiscoveryOn, CASE WHEN s.DatabaseName IS NOT NULL THEN {D} ELSE t.LastUpdated END AS LastUpdated
    FROM databases t FULL OUTER JOIN (SELECT DISTINCT f.SQLInstanceID, f.DatabaseName, f.DatabaseState, a.ApplicationID, f.ApplicationName
        FROM staged_databases f JOIN application a ON a.ApplicationName = f.ApplicationName) s
      ON s.SQLInstanceID = t.SQLInstanceID AND s.DatabaseName = t.DatabaseName""")
def _(t):
    return _shown(merges.merge_databases(t.databases, t.staged_databases, t.application, AS_OF), "DatabaseID", t.databases)


@query("u3_database_size", f"""
    WITH s AS (SELECT d.DatabaseID, {SIZE_DAY} AS DateCaptured, f.FileType, f.FileSize_mb FROM staged_databases f
        JOIN databases d ON d.DatabaseName = f.DatabaseName AND d.SQLInstanceID = f.SQLInstanceID AND d.IsMonitored)
    SELECT coalesce(t.DatabaseID, s.DatabaseID) AS DatabaseID, coalesce(t.FileType, s.FileType) AS FileType,
           coalesce(t.DateCaptured, s.DateCaptured) AS DateCaptured, coalesce(s.FileSize_mb, t.FileSize_mb) AS FileSize_mb
    FROM database_size t FULL OUTER JOIN s ON s.DatabaseID = t.DatabaseID AND s.DateCaptured = t.DateCaptured AND s.FileType = t.FileType""")
def _(t):
    return merges.merge_database_size(t.database_size, t.staged_databases, t.databases, SIZE_AS_OF)


@query("u4_ag_databases", f"""
    WITH s AS (SELECT DISTINCT i.AGInstanceID, d.DatabaseID FROM staged_databases f
        JOIN databases d ON d.DatabaseName = f.DatabaseName AND d.SQLInstanceID = f.SQLInstanceID AND d.IsMonitored
        JOIN availability_groups g ON g.AGGuid = f.AGGuid JOIN ag_instances i ON i.AGID = g.AGID AND i.SQLInstanceID = f.SQLInstanceID
        WHERE f.FileType = 'Data')
    SELECT coalesce(t.AGInstanceID, s.AGInstanceID) AS AGInstanceID, coalesce(t.DatabaseID, s.DatabaseID) AS DatabaseID,
           coalesce(t.DiscoveryOn, {D}) AS DiscoveryOn, CASE WHEN s.DatabaseID IS NOT NULL THEN {D} ELSE t.LastUpdated END AS LastUpdated
    FROM ag_databases t FULL OUTER JOIN s ON s.AGInstanceID = t.AGInstanceID AND s.DatabaseID = t.DatabaseID""")
def _(t):
    return merges.merge_ag_databases(t.ag_databases, t.staged_databases, t.databases, t.availability_groups, t.ag_instances, AS_OF)


_REPLICAS = """SELECT AGGuid, AGName, ComputerName, InstanceName, ReplicaRole, ReplicaID AS SQLInstanceID, ServerInstance FROM (
    SELECT r.*, lower(r.ReplicaServerName) AS ServerInstance,
        CASE WHEN instr(r.ReplicaServerName, chr(92)) > 0 THEN lower(substring(r.ReplicaServerName, 1, instr(r.ReplicaServerName, chr(92)) - 1)) ELSE lower(r.ReplicaServerName) END AS ComputerName,
        CASE WHEN instr(r.ReplicaServerName, chr(92)) > 0 THEN lower(substring(r.ReplicaServerName, instr(r.ReplicaServerName, chr(92)) + 1)) ELSE 'mssqlserver' END AS InstanceName,
        coalesce(s.RoleDesc, 'PRIMARY') AS ReplicaRole FROM replica_feed r LEFT JOIN replica_states s ON s.ReplicaID = r.ReplicaID) z"""


def _replica_batch(t):
    names = feeds.parse_replica_names(t.replica_feed, t.replica_states)
    return names.join(t.replica_feed.select("ReplicaID", F.lower("ReplicaServerName").alias("ServerInstance")), "ReplicaID").withColumnRenamed(
        "ReplicaID", "SQLInstanceID")


@query("u5_availability_groups", f"""
    SELECT AGID, AGName, AGGuid, DiscoveryOn, CASE WHEN (AGName, AGGuid) IN (SELECT (AGName, AGGuid) FROM replica_feed) THEN {D} ELSE LastUpdated END AS LastUpdated
    FROM availability_groups""")
def _(t):
    return _shown(merges.merge_availability_groups(t.availability_groups, t.replica_feed, AS_OF), "AGID", t.availability_groups)


@query("u6_ag_replicas", f"""
    WITH f AS ({_REPLICAS}),
    s AS (SELECT g.AGID, f.SQLInstanceID, max(f.ReplicaRole) AS ReplicaRole FROM f LEFT JOIN availability_groups g ON g.AGGuid = f.AGGuid AND g.AGName = f.AGName GROUP BY 1, 2)
    SELECT t.AGInstanceID, coalesce(t.AGID, s.AGID) AS AGID, coalesce(t.SQLInstanceID, s.SQLInstanceID) AS SQLInstanceID,
           coalesce(s.ReplicaRole, t.ReplicaRole) AS ReplicaRole, coalesce(t.DiscoveryOn, {D}) AS DiscoveryOn,
           CASE WHEN s.AGID IS NOT NULL THEN {D} ELSE t.LastUpdated END AS LastUpdated
    FROM ag_instances t FULL OUTER JOIN s ON s.AGID = t.AGID AND s.SQLInstanceID = t.SQLInstanceID""")
def _(t):
    return _shown(merges.merge_ag_replicas(t.ag_instances, _replica_batch(t), t.availability_groups, t.servers, t.sql_instances, AS_OF), "AGInstanceID", t.ag_instances)


@query("u7_job_categories", """
    SELECT SQLJobCategoryName, SQLJobCategoryID FROM sql_job_categories
    UNION ALL SELECT DISTINCT CategoryName, CAST(NULL AS BIGINT) FROM staged_jobs WHERE CategoryName NOT IN (SELECT SQLJobCategoryName FROM sql_job_categories)""")
def _(t):
    return _shown(merges.merge_job_categories(t.sql_job_categories, t.staged_jobs), "SQLJobCategoryID", t.sql_job_categories)


@query("u7_jobs", """
    SELECT j.SQLJobID, j.SQLInstanceID, coalesce(s.c, j.SQLJobCategoryID) AS SQLJobCategoryID, j.SQLJobName
    FROM sql_jobs j LEFT JOIN (SELECT f.SQLInstanceID, f.JobName, max(c.SQLJobCategoryID) AS c FROM staged_jobs f
        JOIN sql_job_categories c ON c.SQLJobCategoryName = f.CategoryName GROUP BY 1, 2) s ON s.SQLInstanceID = j.SQLInstanceID AND s.JobName = j.SQLJobName""")
def _(t):
    return _shown(merges.merge_jobs(t.sql_jobs, t.staged_jobs, t.sql_job_categories, AS_OF), "SQLJobID", t.sql_jobs)


@query("u8_job_history", """
    WITH s AS (SELECT j.SQLJobID, f.ExecutionDateTime + INTERVAL 1 DAY AS ExecutionDateTime, f.Duration, f.JobStatus FROM staged_jobs f
        JOIN sql_jobs j ON j.SQLInstanceID = f.SQLInstanceID AND j.SQLJobName = f.JobName)
    SELECT * FROM sql_job_history
    UNION ALL
    SELECT SQLJobID, ExecutionDateTime, (max((Duration, JobStatus)))[1], max(JobStatus) FROM s
    WHERE NOT EXISTS (SELECT 1 FROM sql_job_history h WHERE h.SQLJobID = s.SQLJobID AND h.ExecutionDateTime = s.ExecutionDateTime) GROUP BY 1, 2""")
def _(t):
    batch = t.staged_jobs.withColumn("ExecutionDateTime", F.col("ExecutionDateTime") + F.make_dt_interval(F.lit(1)))
    return merges.append_job_history(t.sql_job_history, batch, t.sql_jobs)


@query("u9_error_log", """
    SELECT SQLInstanceID, DateTime, ErrorMsg FROM sql_error_log UNION ALL SELECT SQLInstanceID, DateTimeCaptured, Message FROM extracted_errors""")
def _(t):
    return merges.append_error_log(t.sql_error_log, feeds.extract_errors(t.log_lines))


@query("u10_services", f"""
    SELECT t.ServerID, t.ServiceName, t.InstanceName, t.DisplayName, t.FilePath, t.ServiceType,
           s.m AS StartMode, s.a AS ServiceAccount, 15 AS ServiceVersion, '15.0' AS ServiceBuild, s.st AS Status, t.DiscoveryOn, {D} AS LastUpdated
    FROM stored_services t JOIN (SELECT v.ServerID, c.ServiceName, c.StartMode AS m, c.ServiceAccount AS a, c.Status AS st
        FROM classified_services c JOIN servers v ON v.ServerName = c.ServerName) s ON s.ServerID = t.ServerID AND s.ServiceName = t.ServiceName""")
def _(t):
    batch = feeds.classify_services(t.service_feed).withColumns({"ServiceVersion": F.lit(15), "ServiceBuild": F.lit("15.0")})
    return merges.merge_services(_stored_services(t), batch, t.servers, AS_OF)


@query("u11_property_names", "SELECT ExtendedPropertyName, ExtendedPropertyID FROM property_names")
def _(t):
    return _shown(merges.merge_property_names(_property_names(t), t.property_feed), "ExtendedPropertyID", _property_names(t))


@query("u11_property_values", f"""
    SELECT f.SQLInstanceID, p.ExtendedPropertyID, f.PropertyValue AS ExtendedPropertyValue,
           CASE WHEN f.PropertyName = 'CostCenter' THEN {D} ELSE DATE '1999-01-01' END AS DiscoveryOn, {D} AS LastUpdated
    FROM property_feed f JOIN property_names p ON p.ExtendedPropertyName = f.PropertyName""")
def _(t):
    return merges.merge_property_values(_property_values(t), t.property_feed, _property_names(t), AS_OF)


_NEW_PRINCIPALS = """
    SELECT PrincipalID, PrincipalName, PrincipalType FROM {dim}
    UNION ALL SELECT DISTINCT CAST(NULL AS BIGINT), {n}, {k} FROM {feed}
    WHERE NOT EXISTS (SELECT 1 FROM {dim} p WHERE p.PrincipalName = {n} AND p.PrincipalType = {k})"""


@query("u12_server_principals", _NEW_PRINCIPALS.format(dim="server_principals", n="LoginName", k="LoginType", feed="staged_server_membership"))
def _(t):
    return _shown(merges.merge_principals(t.server_principals, t.staged_server_membership, "LoginName", "LoginType"), "PrincipalID", t.server_principals)


@query("u12_database_principals", _NEW_PRINCIPALS.format(dim="database_principals", n="UserName", k="UserType", feed="staged_database_membership"))
def _(t):
    return _shown(merges.merge_principals(t.database_principals, t.staged_database_membership, "UserName", "UserType"), "PrincipalID", t.database_principals)


def _archive_sql(table: str, id_col: str, keys: list[str], source: str, scope: str, extra: str = "") -> str:
    on = " AND ".join(f"s.{k} = t.{k}" for k in keys)
    cols = ", ".join(f"coalesce(t.{k}, s.{k}) AS {k}" for k in keys)
    orphan = f"coalesce(s.{extra}, t.{extra}) AS {extra}," if extra else ""
    old_orphan = f"{extra}," if extra else ""
    agg = f", bool_or({extra}) AS {extra}" if extra else ""
    by = ", ".join(keys)
    return f"""
    WITH raw AS ({source}),
    s AS (SELECT {by}{agg} FROM raw GROUP BY {by}),
    t AS (SELECT * FROM {table} WHERE NOT IsArchived),
    m AS (SELECT t.{id_col}, {cols}, {orphan} coalesce(t.DiscoveryOn, {D}) AS DiscoveryOn,
          CASE WHEN s.{keys[-1]} IS NOT NULL THEN {D} ELSE t.LastUpdated END AS LastUpdated FROM t FULL OUTER JOIN s ON {on})
    SELECT {id_col}, {by}, {old_orphan} (LastUpdated < {D} AND {keys[0]} IN (SELECT {keys[0]} FROM {scope})) AS IsArchived, DiscoveryOn, LastUpdated FROM m
    UNION ALL
    SELECT {id_col}, {by}, {old_orphan} IsArchived, DiscoveryOn, LastUpdated FROM {table} WHERE IsArchived"""


def _pid(dim: str, name: str, kind: str) -> str:
    return f"(SELECT min(PrincipalID) FROM {dim} p WHERE p.PrincipalName = f.{name} AND p.PrincipalType = {kind})"


@query("u13_server_memberships", _archive_sql(
    "server_principal_membership", "MembershipID", ["SQLInstanceID", "ServerRoleID", "ServerLoginID"],
    f"""SELECT f.SQLInstanceID, {_pid('server_principals', 'RoleName', "'SERVER_ROLE'")} AS ServerRoleID,
        {_pid('server_principals', 'LoginName', 'f.LoginType')} AS ServerLoginID FROM staged_server_membership f""", "staged_server_membership").replace(
    "CASE WHEN s.ServerLoginID IS NOT NULL", "CASE WHEN s.SQLInstanceID IS NOT NULL"))
def _(t):
    return _shown(merges.merge_server_memberships(t.server_principal_membership, t.staged_server_membership, t.server_principals, AS_OF), "MembershipID", t.server_principal_membership)


@query("u14_database_memberships", _archive_sql(
    "database_principal_membership", "MembershipID", ["DatabaseID", "DatabaseRoleID", "DatabaseUserID"],
    f"""SELECT f.DatabaseID, {_pid('database_principals', 'RoleName', "'DATABASE_ROLE'")} AS DatabaseRoleID,
        {_pid('database_principals', 'UserName', 'f.UserType')} AS DatabaseUserID, f.IsOrphaned FROM staged_database_membership f""",
    "staged_database_membership", "IsOrphaned").replace("CASE WHEN s.DatabaseUserID IS NOT NULL", "CASE WHEN s.DatabaseID IS NOT NULL"))
def _(t):
    return _shown(merges.merge_database_memberships(t.database_principal_membership, t.staged_database_membership, t.database_principals, AS_OF), "MembershipID", t.database_principal_membership)


@query("u15_server_permissions", _archive_sql(
    "server_permission", "PermissionID", merges.SERVER_GRANT_KEYS, "SELECT * FROM staged_server_permission", "staged_server_permission"))
def _(t):
    return _shown(merges.merge_server_permissions(t.server_permission, t.staged_server_permission, AS_OF), "PermissionID", t.server_permission)


@query("u16_database_permissions", _archive_sql(
    "database_permission", "PermissionID", merges.DATABASE_GRANT_KEYS, "SELECT * FROM staged_database_permission", "staged_database_permission"))
def _(t):
    return _shown(merges.merge_database_permissions(t.database_permission, t.staged_database_permission, AS_OF), "PermissionID", t.database_permission)


def _named(feed: DataFrame, principals: DataFrame) -> DataFrame:
    """A grant feed as machines report it: names and types in place of ids, spelt in another way."""
    for role in ("Grantee", "Grantor"):
        names = principals.select(F.col("PrincipalID").alias(f"{role}ID"), F.concat(F.upper("PrincipalName"), F.lit(" ")).alias(f"{role}Name"),
                                  F.col("PrincipalType").alias(f"{role}Type"))
        feed = feed.join(names, f"{role}ID", "left").drop(f"{role}ID")
    return feed


def _by_name_sql(staged: str, principals: str) -> str:
    """The staged grants with the least id of all principals of the same name and type."""
    one = f"(SELECT PrincipalID, min(PrincipalID) OVER (PARTITION BY lower(trim(PrincipalName)), lower(PrincipalType)) AS k FROM {principals})"
    return f"SELECT f.* REPLACE (a.k AS GranteeID, b.k AS GrantorID) FROM {staged} f LEFT JOIN {one} a ON a.PrincipalID = f.GranteeID LEFT JOIN {one} b ON b.PrincipalID = f.GrantorID"


@query("u15_server_permissions_by_name", _archive_sql(
    "server_permission", "PermissionID", merges.SERVER_GRANT_KEYS, _by_name_sql("staged_server_permission", "server_principals"), "staged_server_permission"))
def _(t):
    grants = merges.resolve_grants(_named(t.staged_server_permission, t.server_principals), t.server_principals)
    return _shown(merges.merge_server_permissions(t.server_permission, grants, AS_OF), "PermissionID", t.server_permission)


@query("u16_database_permissions_by_name", _archive_sql(
    "database_permission", "PermissionID", merges.DATABASE_GRANT_KEYS, _by_name_sql("staged_database_permission", "database_principals"), "staged_database_permission"))
def _(t):
    grants = merges.resolve_grants(_named(t.staged_database_permission, t.database_principals), t.database_principals)
    return _shown(merges.merge_database_permissions(t.database_permission, grants, AS_OF), "PermissionID", t.database_permission)


@query("u17_policy_history_load", """
    SELECT * FROM policy_detail WHERE EvaluationDateTime >= TIMESTAMP '2024-01-16 00:00:00'""")
def _(t):
    # Documents before the 16th are already loaded; the load must add the rest only.
    before = t.policy_history.filter(F.col("EvaluationDateTime") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"))
    loaded, _errors = policy.load_policy_history(before, t.policies)
    return policy.load_policy_history(t.policy_history, t.policies, loaded)[0]


@query("u18_policy_summary", "SELECT * FROM policy_summary")
def _(t):
    return _summary(t)


@query("u19_group_registry", """
    SELECT GroupID, IsMonitored FROM groups_to_monitor
    UNION ALL SELECT server_group_id, false FROM server_groups WHERE server_group_id NOT IN (SELECT GroupID FROM groups_to_monitor)""")
def _(t):
    return merges.merge_group_registry(t.groups_to_monitor, t.server_groups)


@query("u20_servers", f"""
    WITH s AS (SELECT f.ServerName, coalesce(o.OperatingSystemID, 1) AS os, f.NumberOfCores AS c, f.Memory_mb AS m FROM staged_servers f
        LEFT JOIN operating_systems o ON o.OperatingSystemName = f.OperatingSystemName)
    SELECT t.ServerID, coalesce(t.ServerName, s.ServerName) AS ServerName, coalesce(s.os, t.OperatingSystemID) AS OperatingSystemID, t.ProcessorName,
           coalesce(s.c, t.NumberOfCores) AS NumberOfCores, t.NumberOfLogicalCores, coalesce(s.m, t.Memory_mb) AS Memory_mb, t.PageFile_mb, t.IsPhysical,
           coalesce(t.IsMonitored, true) AS IsMonitored, coalesce(t.DiscoveryOn, {D}) AS DiscoveryOn,
           CASE WHEN s.ServerName IS NOT NULL THEN {D} ELSE t.LastUpdated END AS LastUpdated
    FROM servers t FULL OUTER JOIN s ON s.ServerName = t.ServerName""")
def _(t):
    return _shown(merges.merge_servers(t.servers, t.staged_servers, t.operating_systems, AS_OF), "ServerID", t.servers)


@query("u20_operating_systems", """
    SELECT OperatingSystemID, OperatingSystemName, OperatingSystemShortName FROM operating_systems
    UNION ALL SELECT DISTINCT CAST(NULL AS INTEGER), OperatingSystemName, replace(OperatingSystemName, 'Windows Server ', 'Windows ') FROM staged_servers
    WHERE OperatingSystemName NOT IN (SELECT OperatingSystemName FROM operating_systems)""")
def _(t):
    return _shown(merges.add_operating_systems(t.operating_systems, t.staged_servers), "OperatingSystemID", t.operating_systems)


@query("u20_clusters", f"""
    WITH s AS (SELECT DISTINCT OperatingSystemName AS n FROM staged_servers UNION SELECT SQLClusterName FROM sql_clusters)
    SELECT t.SQLClusterID, s.n AS SQLClusterName, coalesce(t.IsMonitored, true) AS IsMonitored, coalesce(t.DiscoveryOn, {D}) AS DiscoveryOn, {D} AS LastUpdated
    FROM s LEFT JOIN sql_clusters t ON t.SQLClusterName = s.n""")
def _(t):
    names = t.staged_servers.select(F.col("OperatingSystemName").alias("SQLClusterName")).unionByName(t.sql_clusters.select("SQLClusterName"))
    return _shown(merges.merge_clusters(t.sql_clusters, names, AS_OF), "SQLClusterID", t.sql_clusters)


@query("u20_cluster_nodes", """
    SELECT CAST(ServerID % 5 AS INTEGER) AS SQLClusterID, ServerID AS SQLNodeID, NumberOfCores > 3 AS IsActiveNode FROM servers""")
def _(t):
    feed = t.servers.select((F.col("ServerID") % 5).cast("int").alias("SQLClusterID"), F.col("ServerID").alias("SQLNodeID"), (F.col("NumberOfCores") > 3).alias("IsActiveNode"))
    return merges.merge_cluster_nodes(t.sql_cluster_nodes, feed)


@query("u21_resolve_version", """
    SELECT b.SQLInstanceID, b.ProductVersion, coalesce((SELECT v.SQLVersionID FROM sql_versions v WHERE v.SQLMajorVersion = b.SQLBuild_Major
        AND v.SQLMinorVersion = b.SQLBuild_Minor AND v.SQLBuild <= b.SQLBuild_Build ORDER BY v.SQLBuild DESC LIMIT 1), 1) AS SQLInstanceVersionID
    FROM build_parts b""")
def _(t):
    return merges.resolve_version(_build_parts(t), t.sql_versions).select("SQLInstanceID", "ProductVersion", "SQLInstanceVersionID")


def _label_feed(t):
    return t.build_feed.select(
        "SQLInstanceID", F.concat(F.lit("Microsoft SQL Server NATION_"), (F.col("SQLInstanceID") % 30).cast("string")).alias("SQLVersion"),
        (F.col("SQLInstanceID") % 6000).cast("int").alias("SQLBuild_Build"))


@query("u21_resolve_version_by_label", """
    SELECT b.SQLInstanceID, coalesce(max_by(v.SQLVersionID, v.SQLBuild), 1) AS SQLInstanceVersionID
    FROM build_feed b LEFT JOIN sql_versions v ON v.SQLVersion LIKE 'Microsoft SQL Server NATION/_' || (b.SQLInstanceID % 30)::VARCHAR || ' %' ESCAPE '/'
      AND v.SQLBuild <= b.SQLInstanceID % 6000 GROUP BY 1""")
def _(t):
    return merges.resolve_version(_label_feed(t), t.sql_versions, match="label").select("SQLInstanceID", "SQLInstanceVersionID")


@query("u21_instances", f"""
    SELECT SQLInstanceID, ServerID, SQLClusterID, SQLInstanceName, CAST(2 AS INTEGER) AS SQLInstanceVersionID, '12.0.1' AS SQLInstanceBuild, SQLInstanceEdition, SQLInstanceType,
           SQLInstanceEnviornment, IsMonitored, DiscoveryOn, {D} AS LastUpdated FROM sql_instances""")
def _(t):
    feed = t.sql_instances.select(
        "ServerID", "SQLClusterID", "SQLInstanceName", F.lit(2).alias("SQLInstanceVersionID"), F.lit("12.0.1").alias("SQLInstanceBuild"))
    return merges.merge_instances(t.sql_instances, feed, AS_OF)


@query("u22_monitoring_switch", "SELECT SQLInstanceID, CASE WHEN SQLInstanceName = 'MSSQLServer' THEN false ELSE IsMonitored END AS IsMonitored FROM sql_instances")
def _(t):
    return merges.set_monitoring(t.sql_instances, "SQLInstanceName", "MSSQLServer", False).select("SQLInstanceID", "IsMonitored")


_VOLUMES = """
    WITH f AS (SELECT ServerID, SQLClusterID, Capacity, FreeSpace, lower(rtrim(Name, chr(92))) AS v FROM volume_feed),
    k AS (SELECT f.*,
        EXISTS (SELECT 1 FROM disk_volumes d WHERE lower(d.DiskVolumeName) = f.v AND d.ServerID = f.ServerID) AS s,
        EXISTS (SELECT 1 FROM disk_volumes d WHERE lower(d.DiskVolumeName) = f.v AND d.SQLClusterID = f.SQLClusterID AND f.SQLClusterID <> 0) AS c,
        f.SQLClusterID <> 0 AND EXISTS (SELECT 1 FROM disk_volumes d JOIN sql_cluster_nodes n ON n.SQLClusterID = d.SQLClusterID AND d.ServerID IS NULL
            WHERE n.SQLNodeID = f.ServerID AND lower(d.DiskVolumeName) = f.v AND d.SQLClusterID <> f.SQLClusterID) AS o,
        f.SQLClusterID <> 0 AND EXISTS (SELECT 1 FROM cluster_folder_feed x WHERE x.SQLClusterID = f.SQLClusterID AND contains(lower(x.FolderName), f.v)) AS h
        FROM f),
    chosen AS (SELECT ServerID, SQLClusterID, Capacity, FreeSpace, v AS DiskVolumeName,
        CASE WHEN v IN ('c:', 'd:') THEN CASE WHEN s THEN 'keep_server' ELSE 'insert_server' END WHEN o THEN 'skip' WHEN s AND c THEN 'drop_server_copy'
             WHEN c THEN 'keep_cluster' WHEN s THEN CASE WHEN h THEN 'reparent' ELSE 'keep_server' END WHEN h THEN 'insert_cluster' ELSE 'insert_server' END AS Action
        FROM k),
    decided AS (SELECT * REPLACE (CASE WHEN Action = 'reparent' AND EXISTS (SELECT 1 FROM chosen o WHERE o.Action = 'reparent' AND o.DiskVolumeName = c.DiskVolumeName
        AND o.SQLClusterID = c.SQLClusterID AND o.ServerID < c.ServerID) THEN 'drop_server_copy' ELSE Action END AS Action) FROM chosen c)"""


def _decisions(t):
    return merges.attribute_volumes(t.volume_feed, t.disk_volumes, t.sql_cluster_nodes, t.cluster_folder_feed)


@query("u23_attribute_volumes", _VOLUMES + " SELECT * FROM decided")
def _(t):
    return _decisions(t)


@query("u23_apply_volume_decisions", _VOLUMES + f""",
    gone AS (SELECT d.DiskVolumeID FROM disk_volumes d JOIN decided x ON x.Action = 'drop_server_copy' AND x.DiskVolumeName = lower(d.DiskVolumeName) AND x.ServerID = d.ServerID),
    moved AS (SELECT DiskVolumeName, ServerID, min(SQLClusterID) AS c FROM decided WHERE Action = 'reparent' GROUP BY 1, 2),
    kept AS (SELECT d.DiskVolumeID, d.DiskVolumeName, CASE WHEN m.c IS NULL THEN d.ServerID END AS ServerID, coalesce(m.c, d.SQLClusterID) AS SQLClusterID,
             d.IsMonitored, d.DiscoveryOn, d.LastUpdated FROM disk_volumes d LEFT JOIN moved m ON m.DiskVolumeName = lower(d.DiskVolumeName) AND m.ServerID = d.ServerID
             WHERE d.DiskVolumeID NOT IN (SELECT DiskVolumeID FROM gone)),
    seen AS (SELECT DISTINCT DiskVolumeName, CASE WHEN Action IN ('insert_server', 'keep_server') THEN ServerID END AS ServerID,
             CASE WHEN Action IN ('insert_cluster', 'keep_cluster', 'reparent') THEN SQLClusterID END AS SQLClusterID
             FROM decided WHERE Action NOT IN ('skip', 'drop_server_copy'))
    SELECT k.DiskVolumeID, coalesce(k.DiskVolumeName, n.DiskVolumeName) AS DiskVolumeName, coalesce(k.ServerID, n.ServerID) AS ServerID,
           coalesce(k.SQLClusterID, n.SQLClusterID) AS SQLClusterID, coalesce(k.IsMonitored, true) AS IsMonitored, coalesce(k.DiscoveryOn, {D}) AS DiscoveryOn,
           CASE WHEN n.DiskVolumeName IS NOT NULL AND coalesce(k.IsMonitored, true) THEN {D} ELSE k.LastUpdated END AS LastUpdated
    FROM kept k FULL OUTER JOIN seen n ON lower(k.DiskVolumeName) = n.DiskVolumeName AND coalesce(k.ServerID, -1) = coalesce(n.ServerID, -1)
      AND coalesce(k.SQLClusterID, -1) = coalesce(n.SQLClusterID, -1)""")
def _(t):
    return _shown(merges.apply_volume_decisions(t.disk_volumes, _decisions(t), AS_OF), "DiskVolumeID", t.disk_volumes)


@query("u24_volume_space_daily", f"""
    WITH r AS (SELECT ServerID AS DiskVolumeID, max((Capacity, FreeSpace)) AS p FROM volume_feed GROUP BY 1),
    n AS (SELECT DiskVolumeID, CAST((p[1] - p[2]) // 1048576 AS BIGINT) AS u, CAST(p[1] // 1048576 AS BIGINT) AS t FROM r)
    SELECT coalesce(s.DiskVolumeID, n.DiskVolumeID) AS DiskVolumeID, coalesce(s.DateCaptured, {SIZE_DAY}) AS DateCaptured,
           CAST(CASE WHEN s.DiskVolumeID IS NULL THEN n.u WHEN n.u IS NULL THEN s.SpaceUsed_mb ELSE (s.SpaceUsed_mb + n.u) // 2 END AS BIGINT) AS SpaceUsed_mb,
           CAST(CASE WHEN s.DiskVolumeID IS NULL THEN n.t WHEN n.t IS NULL THEN s.TotalSpace_mb ELSE (s.TotalSpace_mb + n.t) // 2 END AS BIGINT) AS TotalSpace_mb
    FROM disk_volume_space s FULL OUTER JOIN n ON n.DiskVolumeID = s.DiskVolumeID AND s.DateCaptured = {SIZE_DAY}""")
def _(t):
    readings = t.volume_feed.select(F.col("ServerID").alias("DiskVolumeID"), "Capacity", "FreeSpace")
    return merges.volume_space_daily(t.disk_volume_space, readings, SIZE_AS_OF)


@query("u25_high_water_marks", """
    SELECT SQLInstanceID, max(m) AS LastDateTimeCaptured FROM (SELECT SQLInstanceID, max(DateTime) AS m FROM sql_error_log GROUP BY 1
        UNION ALL SELECT SQLInstanceID, max(LogDate) FROM log_lines GROUP BY 1) x GROUP BY 1""")
def _(t):
    return merges.advance_marks(_error_marks(t), merges.high_water_marks(t.log_lines, "LogDate"))


# ---- roll-ups, trends, licences -----------------------------------------------------

@query("a1_monthly_database_size", "SELECT * FROM database_monthly")
def _(t):
    return _monthly(t)


@query("a1_monthly_database_size_guarded", "SELECT * FROM database_monthly WHERE YearMonth < 199801")
def _(t):
    loaded = t.database_size.filter(F.col("DateCaptured") >= F.lit("1998-01-01").cast("date")).select(
        (F.year("DateCaptured") * 100 + F.month("DateCaptured")).alias("YearMonth"))
    return rollup.monthly_database_size(t.database_size, existing=loaded)


@query("a1_late_days", "SELECT * FROM database_monthly")
def _(t):
    """Stored sums without every ninth day and with wrong sizes on every eleventh; then those days come, late and corrected."""
    keys, values = ["DatabaseID", "FileType"], ["FileSize_mb"]
    day = F.datediff("DateCaptured", F.lit("1990-01-01").cast("date"))
    size = t.database_size.select(*keys, "DateCaptured", "FileSize_mb")
    late, wrong = day % 9 == 0, day % 11 == 0
    first = size.filter(~late).withColumn("FileSize_mb", F.when(wrong, F.col("FileSize_mb") + 100).otherwise(F.col("FileSize_mb")))
    sums = rollup.month_sums(first, keys, values)
    changed = rollup.changed_sums(sums, first.filter(wrong), size.filter(late | wrong), keys, values)
    return rollup.averages(changed, keys, values)


@query("a2_late_days", "SELECT * FROM volume_monthly")
def _(t):
    """As a1_late_days, over the space of volumes; the last day of each month comes late."""
    keys, values = ["DiskVolumeID"], ["SpaceUsed_mb", "TotalSpace_mb"]
    space = t.disk_volume_space.select(*keys, "DateCaptured", *values)
    late = F.last_day("DateCaptured") == F.col("DateCaptured")
    sums = rollup.month_sums(space.filter(~late), keys, values)
    return rollup.averages(rollup.changed_sums(sums, space.limit(0), space.filter(late), keys, values), keys, values)


@query("a2_monthly_volume_space", "SELECT * FROM volume_monthly")
def _(t):
    return _monthly_volumes(t)


_ALIVE = f"DiscoveryOn <= DATE '{TREND_DAY}' AND {{0}}.LastUpdated >= DATE '{TREND_DAY}' - 30"


@query("a3_trend_servers", f"""
    SELECT 200110 AS YearMonth, o.OperatingSystemID, count(*) AS ServerCount FROM servers s JOIN operating_systems o ON o.OperatingSystemID = s.OperatingSystemID
    WHERE s.{_ALIVE.format('s')} AND o.OperatingSystemID <> 1 GROUP BY 2""")
def _(t):
    return rollup.trend_servers(t.servers, t.operating_systems, TREND_DAY)


@query("a4_trend_instances", f"""
    SELECT 200110 AS YearMonth, v.SQLVersionID AS ServerVersionID, s.SQLInstanceEnviornment AS Environment, count(*) AS InstanceCount
    FROM sql_instances s JOIN sql_versions v ON v.SQLVersionID = s.SQLInstanceVersionID WHERE s.{_ALIVE.format('s')} GROUP BY 2, 3""")
def _(t):
    return rollup.trend_instances(t.sql_instances, t.sql_versions, TREND_DAY)


@query("a5_trend_databases", f"""
    SELECT 200110 AS YearMonth, i.SQLInstanceVersionID AS SQLVersionID, i.SQLInstanceEnviornment AS Environment, count(*) AS DatabaseCount,
           CAST(sum(z.TotalSize) AS BIGINT) AS DatabaseTotalSize
    FROM databases s JOIN sql_instances i ON i.SQLInstanceID = s.SQLInstanceID JOIN sql_versions v ON v.SQLVersionID = i.SQLInstanceVersionID
    JOIN database_last_total z ON z.DatabaseID = s.DatabaseID
    WHERE (s.DatabaseID NOT IN (SELECT DatabaseID FROM ag_databases) OR s.SQLInstanceID IN (SELECT SQLInstanceID FROM ag_ranked WHERE InstanceNumber = 1))
      AND s.IsMonitored AND s.{_ALIVE.format('s')} GROUP BY 2, 3""")
def _(t):
    return rollup.trend_databases(t.databases, t.sql_instances, t.sql_versions, t.database_size, t.ag_instances, t.ag_databases, TREND_DAY)


@query("a6_license_details", "SELECT * FROM license_details")
def _(t):
    return licence.license_details(t.servers, t.sql_clusters, t.sql_cluster_nodes, _iv(t), t.ag_instances, AS_OF)


@query("a7_license_overview", """
    SELECT Enviornment, AssumedCPUInfo, Edition, ServerRole, CAST(grouping_id(Enviornment, AssumedCPUInfo, Edition, ServerRole) AS INTEGER) AS SubtotalLevel,
           CAST(sum(LicenseCores) AS BIGINT) AS LicenseCores, count(*) AS HostCount
    FROM license_details GROUP BY ROLLUP (Enviornment, AssumedCPUInfo, Edition, ServerRole)""")
def _(t):
    return licence.license_overview(reports.report_licences(t, as_of=AS_OF))


_DB_GROWTH = f"""
    SELECT DatabaseID, {{p}}, FileType, FileSize_mb, {growth('prev', 'FileSize_mb')} AS GrowthInPercent
    FROM (SELECT a.*, b.FileSize_mb AS prev FROM (SELECT *, row_number() OVER (PARTITION BY DatabaseID, FileType ORDER BY {{p}}) AS rn FROM {{t}}) a
          LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY DatabaseID, FileType ORDER BY {{p}}) AS rn FROM {{t}}) b
          ON b.DatabaseID = a.DatabaseID AND b.FileType = a.FileType AND b.rn = a.rn - 1) x"""


@query("a8_growth_percent", _DB_GROWTH.format(p="DateCaptured", t="database_size"))
def _(t):
    return rollup.growth_percent(t.database_size, ["DatabaseID", "FileType"], "DateCaptured", "FileSize_mb").select(
        "DatabaseID", "DateCaptured", "FileType", "FileSize_mb", "GrowthInPercent")


@query("a9_size_change_category", "SELECT * FROM size_change")
def _(t):
    return rollup.size_change_category(_iv(t), t.databases_bulk, t.database_size_bulk, SIZE_AS_OF)


# ---- staleness and retention ----------------------------------------------------------

@query("x1_expired_objects", "SELECT * FROM expired_objects")
def _(t):
    return _expired(t)


@query("x1_expired_objects_bucket", "SELECT * FROM expired_objects WHERE DaysOld >= 60 AND DaysOld < 90 AND ObjectType = 'Databases'")
def _(t):
    return _expired(t, kind="Databases", sort_key=2)


@query("x2_expired_counts", """
    SELECT g.SortKey, g.ObjectType, count(e.ObjectType) AS ObjectCount
    FROM (SELECT k.SortKey, o.ObjectType FROM (VALUES (1), (2), (3), (4)) k(SortKey), (VALUES ('Servers'), ('SQL Instances'), ('SQL Clusters'), ('Disk Volumes'),
          ('Availability Groups'), ('Databases')) o(ObjectType)) g
    LEFT JOIN expired_objects e ON e.ReportSortKey = g.SortKey AND e.ObjectType = g.ObjectType GROUP BY 1, 2""")
def _(t):
    return lifecycle.expired_counts(_expired(t))


@query("r1_purge_raw_size", f"SELECT * FROM database_size WHERE DateCaptured > {SIZE_DAY} - 45")
def _(t):
    return lifecycle.purge_raw(t.database_size, SIZE_AS_OF)


@query("r1_purge_raw_space", f"SELECT * FROM disk_volume_space WHERE DateCaptured > {SIZE_DAY} - 45")
def _(t):
    return lifecycle.purge_raw(t.disk_volume_space, SIZE_AS_OF)


@query("r2_purge_error_log", f"SELECT * FROM sql_error_log WHERE DateTime > TIMESTAMP '2031-07-15 12:00:00' - INTERVAL 90 MONTH")
def _(t):
    return lifecycle.purge_error_log(t.sql_error_log, "2031-07-15 12:00:00")


@query("r3_purge_job_history", f"SELECT * FROM sql_job_history WHERE ExecutionDateTime > TIMESTAMP '2039-01-15 12:00:00' - INTERVAL 180 MONTH")
def _(t):
    return lifecycle.purge_job_history(t.sql_job_history, "2039-01-15 12:00:00")


@query("r4_purge_run_log", f"""
    SELECT * FROM run_log WHERE NOT coalesce(DateTimeCaptured <= (SELECT CAST(max(DateTimeCaptured) AS DATE) FROM run_log
        WHERE Description = 'Collection End' AND DateTimeCaptured <= {EV} - INTERVAL 10 DAY), false)""")
def _(t):
    return lifecycle.purge_run_log(t.run_log, EVENTS_AS_OF, 10)


@query("r5_purge_policy_results", f"SELECT PolicyHistoryID, EvaluationDateTime FROM policy_history WHERE EvaluationDateTime > {EV} - INTERVAL 7 DAY")
def _(t):
    return lifecycle.purge_policy_results(t.policy_history, EVENTS_AS_OF).select("PolicyHistoryID", "EvaluationDateTime")


@query("r6_purge_aggregates", "SELECT * FROM database_monthly WHERE YearMonth >= 199610")
def _(t):
    return lifecycle.purge_months(_monthly(t), AS_OF)


@query("r7_purge_trends", "SELECT * FROM trending_instances WHERE YearMonth >= 200005")
def _(t):
    return lifecycle.purge_months(t.trending_instances, "2005-05-20")


@query("r8_purge_expired", f"SELECT * FROM databases WHERE LastUpdated >= {D} - 91")
def _(t):
    return lifecycle.purge_expired(t.databases, AS_OF)


_DEAD = f"""
    WITH s AS (SELECT ServerID AS k FROM servers WHERE LastUpdated < {D} - 91), c AS (SELECT SQLClusterID AS k FROM sql_clusters WHERE LastUpdated < {D} - 91),
    v AS (SELECT DiskVolumeID AS k FROM disk_volumes WHERE LastUpdated < {D} - 91 OR ServerID IN (SELECT k FROM s) OR SQLClusterID IN (SELECT k FROM c)),
    g AS (SELECT AGID AS k FROM availability_groups WHERE LastUpdated < {D} - 91),
    i AS (SELECT SQLInstanceID AS k FROM sql_instances WHERE LastUpdated < {D} - 91 OR ServerID IN (SELECT k FROM s) OR SQLClusterID IN (SELECT k FROM c)),
    gi AS (SELECT AGInstanceID AS k FROM ag_instances WHERE AGID IN (SELECT k FROM g) OR SQLInstanceID IN (SELECT k FROM i)),
    j AS (SELECT SQLJobID AS k FROM sql_jobs WHERE SQLInstanceID IN (SELECT k FROM i)),
    d AS (SELECT DatabaseID AS k FROM databases WHERE LastUpdated < {D} - 91 OR SQLInstanceID IN (SELECT k FROM i))"""
# Every table of the cascade with the conditions under which a row goes.
_GOES = {
    "servers": "ServerID IN s", "sql_clusters": "SQLClusterID IN c", "disk_volumes": "DiskVolumeID IN v", "availability_groups": "AGID IN g",
    "sql_instances": "SQLInstanceID IN i", "ag_instances": "AGInstanceID IN gi", "sql_jobs": "SQLJobID IN j", "databases": "DatabaseID IN d",
    "sql_cluster_nodes": "SQLNodeID IN s OR SQLClusterID IN c", "disk_volume_space": "DiskVolumeID IN v", "sql_error_log": "SQLInstanceID IN i",
    "sql_job_history": "SQLJobID IN j", "ag_databases": "AGInstanceID IN gi OR DatabaseID IN d", "database_size": "DatabaseID IN d",
    "server_principal_membership": "SQLInstanceID IN i", "server_permission": "SQLInstanceID IN i",
    "database_principal_membership": "DatabaseID IN d", "database_permission": "DatabaseID IN d"}


def _condition(text: str) -> str:
    return " OR ".join("coalesce({0} IN (SELECT k FROM {2}), false)".format(*part.split()) for part in text.split(" OR "))


@query("r8_cascade", _DEAD + " UNION ALL ".join(
    f" SELECT '{name}' AS TableName, count(*) AS Kept, coalesce(CAST(sum({goes.split()[0]}) AS BIGINT), 0) AS KeySum FROM {name} WHERE NOT ({_condition(goes)})"
    for name, goes in _GOES.items()))
def _(t):
    """Rows that stay in every table when the expired entities go with all that hangs on them."""
    expired = {n: t[n].join(lifecycle.purge_expired(t[n], AS_OF).select(lifecycle.CHILDREN[n][0]), lifecycle.CHILDREN[n][0], "left_anti") for n in lifecycle.EXPIRING}
    gone = lifecycle.cascade_keys({n: t[n] for n in lifecycle.CHILDREN}, expired)
    kept = [lifecycle.cascade(name, t[name], gone).agg(
        F.lit(name).alias("TableName"), F.count(F.lit(1)).alias("Kept"), F.coalesce(F.sum(goes.split()[0]), F.lit(0)).cast("bigint").alias("KeySum"))
        for name, goes in _GOES.items()]
    return reduce(DataFrame.unionAll, kept)


@query("r9_apply_retention", f"SELECT * FROM disk_volume_space WHERE DateCaptured > {SIZE_DAY} - 45")
def _(t):
    return lifecycle.apply_retention("raw_data", t.disk_volume_space, seeds.SETTINGS, SIZE_AS_OF)


@query("r5_purge_policy_detail", f"SELECT PolicyHistoryID, EvaluatedObject, EvaluationDateTime FROM policy_detail WHERE EvaluationDateTime > {EV} - INTERVAL 7 DAY")
def _(t):
    return lifecycle.purge_policy_results(_details(t), EVENTS_AS_OF).select("PolicyHistoryID", "EvaluatedObject", "EvaluationDateTime")


@query("r5_purge_policy_errors", f"""
    SELECT EvaluatedServer, EvaluationDateTime, EvaluatedPolicy FROM policy_detail WHERE ExceptionMessage <> '' AND EvaluationDateTime > {EV} - INTERVAL 7 DAY
    UNION ALL SELECT EvaluatedServer, EvaluationDateTime, EvaluatedPolicy FROM policy_docs
    WHERE NOT bare AND PolicyHistoryID % 4 = 2 AND EvaluationDateTime > {EV} - INTERVAL 7 DAY""")
def _(t):
    errors = policy.shred_policy_errors(t.policy_history, t.policies)
    return lifecycle.purge_policy_results(errors, EVENTS_AS_OF).select("EvaluatedServer", "EvaluationDateTime", "EvaluatedPolicy")


def _retained(name: str, dataset: str, table: str, as_of: str, sql: str) -> None:
    @query(f"r9_apply_retention_{name}", sql)
    def _(t):
        return lifecycle.apply_retention(dataset, getattr(t, table), seeds.SETTINGS, as_of)


_retained("expired", "expired", "servers", AS_OF, f"SELECT * FROM servers WHERE LastUpdated >= {D} - 91")
_retained("trending", "trending", "trending_instances", "2005-05-20", "SELECT * FROM trending_instances WHERE YearMonth >= 200005")
_retained("error_log", "error_log", "sql_error_log", "2031-07-15 12:00:00", "SELECT * FROM sql_error_log WHERE DateTime > TIMESTAMP '2031-07-15 12:00:00' - INTERVAL 90 MONTH")
_retained("job_history", "job_history", "sql_job_history", "2039-01-15 12:00:00",
          "SELECT * FROM sql_job_history WHERE ExecutionDateTime > TIMESTAMP '2039-01-15 12:00:00' - INTERVAL 180 MONTH")
_retained("policy_results", "policy_results", "policy_history", EVENTS_AS_OF, f"SELECT * FROM policy_history WHERE EvaluationDateTime > {EV} - INTERVAL 7 DAY")
_retained("run_log", "run_log", "run_log", "2024-07-20 00:00:00", """
    SELECT * FROM run_log WHERE NOT coalesce(DateTimeCaptured <= (SELECT CAST(max(DateTimeCaptured) AS DATE) FROM run_log
        WHERE Description = 'Collection End' AND DateTimeCaptured <= TIMESTAMP '2024-07-20 00:00:00' - INTERVAL 180 DAY), false)""")


# ---- reports ----------------------------------------------------------------------------

@query("q1_applications", """
    SELECT a.ApplicationID, a.ApplicationName, a.ApplicationOwner, i.SQLInstanceEnviornment, count(*) AS DatabaseCount
    FROM application a JOIN databases d ON d.ApplicationID = a.ApplicationID JOIN instance_view i ON i.SQLInstanceID = d.SQLInstanceID GROUP BY 1, 2, 3, 4""")
def _(t):
    return reports.report_applications(t)


_APP_DETAIL = """
    SELECT i.ServerInstance, i.SQLInstanceEnviornment, a.ApplicationName, a.ApplicationOwner, d.DatabaseName, CAST(sum(z.TotalSize) AS BIGINT) AS TotalDBSize_mb
    FROM application a JOIN databases d ON d.ApplicationID = a.ApplicationID JOIN instance_view i ON i.SQLInstanceID = d.SQLInstanceID
    JOIN database_last_total z ON z.DatabaseID = d.DatabaseID GROUP BY 1, 2, 3, 4, 5"""


@query("q2_application_detail", _APP_DETAIL)
def _(t):
    return reports.report_application_detail(t)


@query("q2_application_totals", f"SELECT count(*) AS DatabaseCount, CAST(sum(TotalDBSize_mb) AS BIGINT) AS TotalDBSize_mb FROM ({_APP_DETAIL}) x")
def _(t):
    return reports.report_application_totals(reports.report_application_detail(t))


@query("q3_config_health_details", "SELECT * FROM policy_health WHERE Policy_ShortName = 'Short c' AND PolicyResult = 'FAIL' AND CategoryName LIKE '%Maintenance'")
def _(t):
    return _health(t, policy="Short c", result="FAIL", category="Maintenance")


@query("q4_config_health_overview", "SELECT * FROM policy_health")
def _(t):
    return _health(t)


@query("q4_config_health_counts", "SELECT CategoryName, Policy_ShortName, PolicyResult, count(*) AS ObjCount FROM policy_health GROUP BY 1, 2, 3")
def _(t):
    return reports.report_config_health_counts(_health(t))


@query("q5_category_list", "SELECT DISTINCT CategoryName FROM policy_health UNION ALL SELECT 'ALL'")
def _(t):
    return reports.report_value_list(snapshot.snapshot_policy(_health(t)), "CategoryName")


@query("q5_result_list", "SELECT DISTINCT PolicyResult FROM policy_health UNION ALL SELECT 'ALL'")
def _(t):
    return reports.report_value_list(snapshot.snapshot_policy(_health(t)), "PolicyResult")


@query("q6_policy_info", """
    SELECT policy_id, CategoryName, PolicyName, description, CASE WHEN help_text = '' THEN 'No help text is recorded for this policy.' ELSE help_text END AS help_text FROM policies""")
def _(t):
    return reports.report_policy_info(t.policies)


@query("q7_database_growth_daily", f"""
    SELECT DatabaseID, DateCaptured, FileType, FileSize_mb, coalesce(GrowthInPercent, 0.0) AS GrowthInPercent FROM ({_DB_GROWTH.format(p='DateCaptured', t='database_size')}) g
    WHERE DatabaseID IN (SELECT DatabaseID FROM databases)""")
def _(t):
    return reports.report_database_growth_daily(t)


@query("q7_database_growth_pivot", """
    SELECT DatabaseID, DateCaptured, CAST(sum(FileSize_mb) FILTER (FileType = 'Data') AS BIGINT) AS Data, CAST(sum(FileSize_mb) FILTER (FileType = 'Log') AS BIGINT) AS Log
    FROM database_size WHERE DatabaseID IN (SELECT DatabaseID FROM databases) GROUP BY 1, 2""")
def _(t):
    return reports.pivot_file_types(reports.report_database_growth_daily(t), "DateCaptured")


@query("q8_database_growth_monthly", _DB_GROWTH.format(p="YearMonth", t="database_monthly"))
def _(t):
    return reports.report_database_growth_monthly(_monthly(t), t.databases)


@query("q9_database_info", "SELECT i.ServerInstance, d.DatabaseID, d.DatabaseName FROM databases d JOIN instance_view i ON i.SQLInstanceID = d.SQLInstanceID")
def _(t):
    return reports.report_database_info(t)


@query("q10_database_memberships", """
    SELECT i.ServerInstance, d.DatabaseName, r.PrincipalName AS DatabaseRoleName, u.PrincipalName AS DatabaseUserName, u.PrincipalType AS DatabaseUserType,
           m.IsOrphaned, m.IsArchived, m.DiscoveryOn, m.LastUpdated
    FROM database_principal_membership m LEFT JOIN database_principals r ON r.PrincipalID = m.DatabaseRoleID LEFT JOIN database_principals u ON u.PrincipalID = m.DatabaseUserID
    LEFT JOIN databases d ON d.DatabaseID = m.DatabaseID LEFT JOIN instance_view i ON i.SQLInstanceID = d.SQLInstanceID
    WHERE u.PrincipalName NOT IN ('dbo', 'guest')""")
def _(t):
    return reports.report_database_memberships(t)


@query("q11_database_permissions", """
    SELECT i.ServerInstance, u.PrincipalName AS DatabaseUserName, u.PrincipalName AS GranteeName, d.DatabaseName, m.ObjectName, m.Access, m.PermissionName,
           m.IsArchived, m.DiscoveryOn, m.LastUpdated
    FROM database_permission m LEFT JOIN database_principals u ON u.PrincipalID = m.GranteeID
    LEFT JOIN databases d ON d.DatabaseID = m.DatabaseID LEFT JOIN instance_view i ON i.SQLInstanceID = d.SQLInstanceID""")
def _(t):
    return reports.report_database_permissions(t)


@query("q12_server_memberships", """
    SELECT i.ServerInstance, r.PrincipalName AS ServerRoleName, u.PrincipalName AS ServerLoginName, u.PrincipalType AS ServerLoginType, m.IsArchived, m.DiscoveryOn, m.LastUpdated
    FROM server_principal_membership m LEFT JOIN server_principals r ON r.PrincipalID = m.ServerRoleID LEFT JOIN server_principals u ON u.PrincipalID = m.ServerLoginID
    LEFT JOIN instance_view i ON i.SQLInstanceID = m.SQLInstanceID WHERE u.PrincipalName NOT IN ('sa') AND NOT m.IsArchived""")
def _(t):
    return reports.report_server_memberships(t, status="Active")


@query("q13_server_permissions", """
    SELECT i.ServerInstance, u.PrincipalName AS DatabaseUserName, u.PrincipalName AS GranteeName, m.ObjectID, m.ObjectType, m.Access, m.PermissionName,
           m.IsArchived, m.DiscoveryOn, m.LastUpdated
    FROM server_permission m LEFT JOIN server_principals u ON u.PrincipalID = m.GranteeID LEFT JOIN instance_view i ON i.SQLInstanceID = m.SQLInstanceID
    WHERE m.IsArchived""")
def _(t):
    return reports.report_server_permissions(t, status="Audit")


@query("q14_databases", """
    WITH days AS (SELECT *, count(*) OVER (PARTITION BY DatabaseID, FileType ORDER BY DateCaptured DESC ROWS UNBOUNDED PRECEDING) AS back FROM database_size),
    sizes AS (SELECT DatabaseID, max(FileSize_mb) FILTER (FileType = 'Data' AND back = 1) AS dn, max(FileSize_mb) FILTER (FileType = 'Log' AND back = 1) AS ln,
                     max(FileSize_mb) FILTER (FileType = 'Data' AND back = 2) AS dp, max(FileSize_mb) FILTER (FileType = 'Log' AND back = 2) AS lp
              FROM days WHERE back <= 2 GROUP BY 1),
    groups AS (SELECT gd.DatabaseID, g.AGID, g.AGName FROM ag_databases gd LEFT JOIN ag_instances gi USING (AGInstanceID) LEFT JOIN availability_groups g USING (AGID))
    SELECT i.ServerInstance, i.SQLInstanceEnviornment, v.SQLVersionShortName AS SQLVersion, i.SQLInstanceID, a.ApplicationID, a.ApplicationName, d.DatabaseID, d.DatabaseName,
           d.DatabaseState, coalesce(dn, 0) AS DataFileSize_mb, coalesce(ln, 0) AS LogFileSize_mb, coalesce(dp, 0) AS pDataFileSize_mb, coalesce(lp, 0) AS pLogFileSize_mb,
           x.AGID, x.AGName AS AvailabilityGroupName, d.DiscoveryOn, d.LastUpdated, coalesce(dn, 0) + coalesce(ln, 0) AS TotalSize_mb,
           coalesce(dn, 0) + coalesce(ln, 0) - coalesce(dp, 0) - coalesce(lp, 0) AS SizeChange_mb
    FROM databases d JOIN instance_view i ON i.SQLInstanceID = d.SQLInstanceID JOIN sql_versions v ON v.SQLVersionID = i.SQLInstanceVersionID
    LEFT JOIN sizes z ON z.DatabaseID = d.DatabaseID LEFT JOIN application a ON a.ApplicationID = d.ApplicationID LEFT JOIN groups x ON x.DatabaseID = d.DatabaseID
    LEFT JOIN databases_exclusions e ON e.DatabaseID = d.DatabaseID AND e.SQLInstanceID = i.SQLInstanceID AND e.DatabaseName = d.DatabaseName
    WHERE e.DatabaseID IS NULL""")
def _(t):
    return reports.report_databases(t)


@query("q15_error_detail", """
    SELECT i.ServerInstance AS SQLInstanceName, e.SQLInstanceID, e.ErrorMsg, min(e.DateTime) AS FirstOccurance, max(e.DateTime) AS LastOccurance,
           count(*) AS NumberOfErrors, count(*) FILTER (e.DateTime >= TIMESTAMP '2024-01-20 00:00:00') AS NumberOfErrorsLast30Hours
    FROM sql_error_log e JOIN instance_view i USING (SQLInstanceID) GROUP BY i.ServerInstance, e.SQLInstanceID, e.ErrorMsg
    HAVING max(e.DateTime) >= TIMESTAMP '2024-01-20 00:00:00'""")
def _(t):
    return reports.report_error_detail(t, since="2024-01-20 00:00:00")


@query("q16_error_default_since", "SELECT CAST(max(DateTime) AS DATE) - 1 AS DefaultDate FROM sql_error_log")
def _(t):
    newest = t.sql_error_log.agg(F.max("DateTime").alias("m"))
    return newest.select(reports.default_error_since(F.to_date("m")).alias("DefaultDate"))


@query("q17_error_summary", "SELECT * FROM error_summary")
def _(t):
    return reports.report_error_summary(t, as_of=EVENTS_AS_OF, marks=_error_marks(t))


@query("q17_error_summary_clean", "SELECT * FROM error_summary WHERE SQLInstanceEnviornment = 'Prod' AND ErrorLogCount = 0")
def _(t):
    return reports.report_error_summary(t, as_of=EVENTS_AS_OF, environment="Prod", with_errors=False, marks=_error_marks(t))


@query("q18_properties", "SELECT ExtendedPropertyID, ExtendedPropertyName FROM property_names")
def _(t):
    return reports.report_properties(_property_names(t))


@query("q19_property_values", """
    SELECT v.SQLInstanceID, i.ServerInstance, n.ExtendedPropertyID, n.ExtendedPropertyName, v.ExtendedPropertyValue, v.DiscoveryOn, v.LastUpdated
    FROM property_names n JOIN property_values v ON v.ExtendedPropertyID = n.ExtendedPropertyID JOIN instance_view i ON i.SQLInstanceID = v.SQLInstanceID""")
def _(t):
    return reports.report_property_values(t, _property_names(t), _property_values(t))


@query("q20_large_size_change", "SELECT * FROM size_change WHERE VolumeOfChangeCategory = '25GB to 50GB Change'")
def _(t):
    return reports.report_size_change(_Bulk(t), as_of=SIZE_AS_OF, category="25GB to 50GB Change")


_TREND_FROM = "200001"


@query("q21_trend_servers", f"""
    SELECT o.OperatingSystemName, s.YearMonth, s.ServerCount FROM trending_servers s JOIN operating_systems o ON o.OperatingSystemID = s.OperatingSystemID
    WHERE o.OperatingSystemName <> 'Unknown' AND s.YearMonth >= {_TREND_FROM}""")
def _(t):
    return reports.report_trend_servers(t, as_of=TREND_AS_OF)


_MATRIX_MONTHS = reports.last_months(TREND_AS_OF)


@query("q21_trend_servers_matrix", f"""
    SELECT o.OperatingSystemName, {', '.join(f'CAST(sum(ServerCount) FILTER (YearMonth = {m}) AS BIGINT) AS "{m}"' for m in _MATRIX_MONTHS)}
    FROM trending_servers s JOIN operating_systems o ON o.OperatingSystemID = s.OperatingSystemID WHERE o.OperatingSystemName <> 'Unknown' GROUP BY 1""")
def _(t):
    return reports.report_trend_servers_matrix(reports.report_trend_servers(t, as_of=TREND_AS_OF), _MATRIX_MONTHS)


@query("q22_trend_instances", f"""
    SELECT v.n AS SQLVersion, s.Environment, s.YearMonth, CAST(sum(s.InstanceCount) AS BIGINT) AS InstanceCount
    FROM trending_instances s JOIN (SELECT SQLVersionID, {trimmed('SQLVersion')} AS n FROM sql_versions) v ON v.SQLVersionID = s.ServerVersionID
    WHERE v.n <> 'Unknown' AND s.YearMonth >= {_TREND_FROM} GROUP BY 1, 2, 3""")
def _(t):
    return reports.report_trend_instances(t, as_of=TREND_AS_OF)


@query("q23_trend_databases", f"""
    SELECT v.n AS SQLVersion, s.Environment, s.YearMonth, CAST(sum(s.DatabaseCount) AS BIGINT) AS DatabaseCount, CAST(sum(s.DatabaseTotalSize) AS BIGINT) AS DatabaseTotalSize_mb
    FROM trending_databases s JOIN (SELECT SQLVersionID, {trimmed('SQLVersion')} AS n FROM sql_versions) v ON v.SQLVersionID = s.SQLVersionID
    WHERE v.n <> 'Unknown' AND s.YearMonth >= {_TREND_FROM} GROUP BY 1, 2, 3""")
def _(t):
    return reports.report_trend_databases(t, as_of=TREND_AS_OF)


@query("q24_instance_summary", f"""
    SELECT i.SQLInstanceEnviornment, v.SQLVersionShortName AS SQLVersion, count(*) AS InstanceCount
    FROM instance_view i JOIN sql_versions v ON v.SQLVersionID = i.SQLInstanceVersionID
    WHERE i.LastUpdated >= {D} - 1 AND v.SQLVersionShortName <> 'Unknown' GROUP BY 1, 2""")
def _(t):
    return reports.report_instance_summary(t, as_of=AS_OF)


@query("q25_out_of_support", f"SELECT * FROM support_dates WHERE BuildSupportEndDate <= {D} AND SQLVersionSupportEndDate <= {D}")
def _(t):
    return reports.report_out_of_support(t, as_of=AS_OF)


_NO_COPY = "d.DatabaseID NOT IN (SELECT DatabaseID FROM ag_copies)"


def _database_summary_sql(version: str) -> str:
    return f"""
    SELECT i.SQLInstanceEnviornment, {edition('i.SQLInstanceEdition')} AS SQLEdition, {version} AS SQLVersion, c.DatabaseState, CAST(sum(c.n) AS BIGINT) AS DBCount
    FROM sql_instances i JOIN (SELECT d.SQLInstanceID, d.DatabaseState, count(*) AS n FROM databases d WHERE d.LastUpdated >= {D} - 1 AND {_NO_COPY} GROUP BY 1, 2) c
      ON c.SQLInstanceID = i.SQLInstanceID LEFT JOIN sql_versions v ON v.SQLVersionID = i.SQLInstanceVersionID
    WHERE upper(c.DatabaseState) = 'ONLINE' AND i.SQLInstanceEdition NOT LIKE 'Express Edition%' AND i.LastUpdated >= {D} - 1
    GROUP BY i.SQLInstanceEnviornment, i.SQLInstanceEdition, {version}, c.DatabaseState"""


def _size_summary_sql(version: str) -> str:
    return f"""
    SELECT i.SQLInstanceEnviornment, {version} AS SQLVersion, CAST(sum(z.mb) AS BIGINT) / 1024.0::DOUBLE / 1024.0::DOUBLE AS DBSize_tb
    FROM sql_instances i JOIN (SELECT d.SQLInstanceID, d.DatabaseID, sum(s.FileSize_mb) AS mb FROM databases d JOIN database_size s ON s.DatabaseID = d.DatabaseID
        WHERE d.LastUpdated >= DATE '2001-07-19' AND s.DateCaptured = {SIZE_DAY} AND {_NO_COPY} GROUP BY 1, 2) z ON z.SQLInstanceID = i.SQLInstanceID
    LEFT JOIN sql_versions v ON v.SQLVersionID = i.SQLInstanceVersionID
    WHERE i.SQLInstanceEdition NOT LIKE 'Express Edition%' AND i.LastUpdated >= DATE '2001-07-19' GROUP BY 1, 2"""


@query("q26_database_summary", _database_summary_sql("v.SQLVersionShortName"))
def _(t):
    return reports.report_database_summary(t, as_of=AS_OF)


@query("q27_database_size_summary", _size_summary_sql("v.SQLVersionShortName"))
def _(t):
    return reports.report_database_size_summary(t, as_of=SIZE_AS_OF, seen_as_of="2001-07-20")


@query("q28_server_summary", """
    SELECT o.OperatingSystemShortName AS OSName, count(*) AS ServerCount FROM servers s JOIN operating_systems o ON o.OperatingSystemID = s.OperatingSystemID GROUP BY 1""")
def _(t):
    return reports.report_server_summary(t)


@query("q29_instance_types", f"""
    WITH seen AS (SELECT *, SQLInstanceType IN ('Microsoft Clustering', 'Veritas Clustering') AS failover, SQLInstanceID IN (SELECT SQLInstanceID FROM ag_instances) AS grouped
        FROM sql_instances WHERE LastUpdated >= {D} - 1),
    kinds AS (SELECT unnest([if(failover AND SQLClusterID IN (SELECT SQLClusterID FROM sql_clusters), SQLInstanceType, NULL), if(grouped, 'AlwaysOn Availiability Group', NULL),
                             if(NOT failover AND NOT grouped, 'Stand Alone', NULL)]) AS kind FROM seen)
    SELECT a.kind AS SQLInstanceType, count(k.kind) AS SQLInstanceCount
    FROM (SELECT unnest(['Microsoft Clustering', 'Veritas Clustering', 'AlwaysOn Availiability Group', 'Stand Alone']) AS kind) a LEFT JOIN kinds k ON k.kind = a.kind GROUP BY 1""")
def _(t):
    return reports.report_instance_types(t, as_of=AS_OF)


@query("q30_support_life_cycle", f"""
    SELECT *, CASE WHEN BuildSupportEndDate <= {D} AND SQLVersionSupportEndDate <= {D} THEN 'Expired' WHEN BuildSupportEndDate <= {D} THEN 'BuildExpired' ELSE 'Supported' END AS SupportStatus
    FROM support_dates""")
def _(t):
    return reports.report_support_life_cycle(t, as_of=AS_OF)


@query("q31_instances", """
    SELECT i.SQLInstanceID, i.ComputerName, i.ServerInstance, i.SQLInstanceName, i.SQLInstanceEnviornment, v.SQLVersion, v.SQLVersionSupportEndDate, i.SQLInstanceBuild,
           i.SQLInstanceEdition, i.DiscoveryOn, i.LastUpdated FROM instance_view i JOIN sql_versions v ON v.SQLVersionID = i.SQLInstanceVersionID""")
def _(t):
    return reports.report_instances(t)


@query("q32_job_history", "SELECT * FROM last_jobs")
def _(t):
    return reports.report_job_history(t, as_of=EVENTS_AS_OF)


@query("q33_licences", "SELECT * FROM license_details WHERE Enviornment = 'Prod'")
def _(t):
    return reports.report_licences(t, as_of=AS_OF, environment="Prod")


_SERVICES = f"""
    SELECT s.ServerName, x.DisplayName, x.FilePath, x.ServiceType, x.StartMode, x.Status, x.ServiceAccount, x.ServiceBuild, x.DiscoveryOn, x.LastUpdated
    FROM stored_services x JOIN servers s ON s.ServerID = x.ServerID WHERE x.LastUpdated >= {D} - 1"""


@query("q34_services", _SERVICES)
def _(t):
    return reports.report_services(_stored_services(t), t.servers, as_of=AS_OF)


@query("q34_services_unknown_status", _SERVICES + " AND x.Status IS NULL")
def _(t):
    return reports.report_services(_stored_services(t), t.servers, as_of=AS_OF, status="Unknown")


@query("q35_service_types", "SELECT DISTINCT ServiceType FROM stored_services UNION ALL SELECT 'ALL'")
def _(t):
    return reports.report_value_list(_stored_services(t), "ServiceType")


@query("q35_service_start_modes", "SELECT DISTINCT StartMode FROM stored_services UNION ALL SELECT 'ALL'")
def _(t):
    return reports.report_value_list(_stored_services(t), "StartMode")


@query("q35_service_statuses", "SELECT DISTINCT Status FROM stored_services UNION ALL SELECT 'ALL' UNION ALL SELECT 'Unknown'")
def _(t):
    return reports.report_value_list(_stored_services(t), "Status", "ALL", "Unknown")


@query("q35_service_servers", "SELECT ServerName FROM servers UNION ALL SELECT 'ALL'")
def _(t):
    return reports.report_value_list(t.servers, "ServerName")


@query("q36_run_log", """
    SELECT * FROM run_log WHERE DateTimeCaptured BETWEEN TIMESTAMP '2024-01-15 00:00:00' AND TIMESTAMP '2024-01-15 23:59:59' AND Description NOT LIKE 'click%'""")
def _(t):
    return reports.report_run_log(t.run_log, day="2024-01-15", unless_like="click%")


@query("q37_run_log_dates", "SELECT CAST(max(DateTimeCaptured) AS DATE) - CAST(i AS INTEGER) AS DateValue FROM run_log, range(14) r(i) GROUP BY i")
def _(t):
    return reports.report_run_log_dates(t.run_log.agg(F.max("DateTimeCaptured").alias("m")), "m")


@query("q38_expired_details", "SELECT * FROM expired_objects WHERE ObjectType = 'SQL Instances'")
def _(t):
    return _expired(t, kind="SQL Instances")


@query("q38_expired_overview", """
    SELECT ReportSortKey AS SortKey, CASE ReportSortKey WHEN 1 THEN '90 Days' WHEN 2 THEN '89 - 60 Days' WHEN 3 THEN '59 - 30 Days' ELSE '29 - 1 Day' END AS DaysOld, count(*) AS ObjectCount
    FROM expired_objects GROUP BY 1, 2""")
def _(t):
    counts = lifecycle.expired_counts(_expired(t)).groupBy("SortKey").agg(F.sum("ObjectCount").alias("ObjectCount")).filter("ObjectCount > 0")
    label = F.lit(None).cast("string")
    for key, text in lifecycle.BUCKET_LABELS.items():
        label = F.when(F.col("SortKey") == key, text).otherwise(label)
    return counts.select("SortKey", label.alias("DaysOld"), "ObjectCount")


@query("q40_instance_choices", "SELECT SQLInstanceID, ServerInstance FROM instance_view UNION ALL SELECT 0, '<ALL>'")
def _(t):
    return reports.report_instance_choices(t)


_SERVER_COLS = """s.ServerName, o.OperatingSystemName, s.ProcessorName, s.NumberOfCores, s.NumberOfLogicalCores, s.Memory_mb, s.PageFile_mb, s.DiscoveryOn, s.LastUpdated
    FROM servers s JOIN operating_systems o ON o.OperatingSystemID = s.OperatingSystemID"""


@query("q41_server_detail", f"SELECT {_SERVER_COLS} WHERE lower(s.ServerName) = 'supplier#000000007'")
def _(t):
    return reports.report_servers(t, computer="Supplier#000000007")


@query("q42_server_volumes", """
    SELECT s.ServerName, v.DiskVolumeID, v.DiskVolumeName, d.SpaceUsed_mb, d.TotalSpace_mb, v.DiscoveryOn, v.LastUpdated
    FROM servers s JOIN disk_volumes v ON v.ServerID = s.ServerID JOIN disk_volume_space d ON d.DiskVolumeID = v.DiskVolumeID
    JOIN (SELECT DiskVolumeID, max(DateCaptured) AS m FROM disk_volume_space GROUP BY 1) l ON l.DiskVolumeID = d.DiskVolumeID AND l.m = d.DateCaptured""")
def _(t):
    return reports.report_server_volumes(t)


@query("q43_server_instances", """
    SELECT s.ServerName, i.SQLInstanceID, i.SQLInstanceName, i.SQLVersion, i.SQLInstanceBuild, i.SQLInstanceEdition, i.SQLInstanceType, i.SQLInstanceEnviornment, i.DiscoveryOn, i.LastUpdated
    FROM servers s JOIN instance_view i ON i.ComputerName = s.ServerName""")
def _(t):
    return reports.report_server_instances(t)


@query("q44_server_services", """
    SELECT s.ServerName, x.ServiceType, x.DisplayName, x.StartMode, x.Status, x.ServiceAccount, x.DiscoveryOn, x.LastUpdated FROM servers s JOIN stored_services x ON x.ServerID = s.ServerID""")
def _(t):
    return reports.report_server_services(_stored_services(t), t.servers)


@query("q45_servers", f"SELECT {_SERVER_COLS}")
def _(t):
    return reports.report_servers(t)


_VOL_GROWTH = f"""
    SELECT x.DiskVolumeID, o.ComputerName, o.DiskVolumeName, {{p}}, SpaceUsed_mb, TotalSpace_mb, SpaceUsed_mb - prev AS UsedSpaceChange_mb,
           {growth('prev', 'SpaceUsed_mb')} AS GrowthInPercent, TotalSpace_mb - SpaceUsed_mb AS FreeSpace_mb
    FROM (SELECT a.*, b.SpaceUsed_mb AS prev FROM (SELECT *, row_number() OVER (PARTITION BY DiskVolumeID ORDER BY {{p}}) AS rn FROM {{t}}) a
          LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY DiskVolumeID ORDER BY {{p}}) AS rn FROM {{t}}) b ON b.DiskVolumeID = a.DiskVolumeID AND b.rn = a.rn - 1) x
    JOIN volume_owner o ON o.DiskVolumeID = x.DiskVolumeID"""


@query("q46_volume_growth_daily", _VOL_GROWTH.format(p="DateCaptured", t="disk_volume_space"))
def _(t):
    return reports.report_volume_growth_daily(t)


@query("q47_volume_growth_monthly", _VOL_GROWTH.format(p="YearMonth", t="volume_monthly"))
def _(t):
    return reports.report_volume_growth_monthly(t, _monthly_volumes(t))


@query("q48_volume_info", """
    SELECT ComputerName, DiskVolumeID, DiskVolumeName, DiscoveryOn, LastUpdated, 'Computer: ' || ComputerName || ' Volume: ' || DiskVolumeName AS ReportTitle FROM volume_owner""")
def _(t):
    return reports.report_volume_info(t)


@query("q49_volumes", """
    SELECT *, SpaceUsed_gb + Est_90Days_gb AS Est_90Days_UsedSpace_gb, SpaceUsed_gb + Est_180Days_gb AS Est_180Days_UsedSpace_gb,
           greatest(SpaceUsed_gb + Est_90Days_gb - TotalSpace_gb, 0.0) AS Overflow_90Days_gb, greatest(SpaceUsed_gb + Est_180Days_gb - TotalSpace_gb, 0.0) AS Overflow_180Days_gb,
           CASE WHEN DaysUntil_OutOfSpace = 99999 THEN 'INF' ELSE CAST(CAST(ceil(DaysUntil_OutOfSpace) AS BIGINT) AS VARCHAR) END AS DaysLabel
    FROM volume_forecast""")
def _(t):
    return reports.report_volumes(t)


@query("q50_computer_choices", """
    SELECT DISTINCT ComputerName FROM instance_owner UNION ALL SELECT '<ALL>'""")
def _(t):
    return reports.report_computer_choices(t)


@query("q50_volume_choices", "SELECT ComputerName, DiskVolumeID, DiskVolumeName FROM volume_owner UNION ALL SELECT 'Default', 0, '<ALL>'")
def _(t):
    return reports.report_volume_choices(t)


@query("q51_job_listing", """
    SELECT i.ServerInstance, j.SQLJobName, c.SQLJobCategoryName, h.ExecutionDateTime, h.Duration AS Duration_s, h.JobStatus
    FROM instance_view i JOIN sql_jobs j ON j.SQLInstanceID = i.SQLInstanceID JOIN sql_job_categories c ON c.SQLJobCategoryID = j.SQLJobCategoryID
    JOIN sql_job_history h ON h.SQLJobID = j.SQLJobID""")
def _(t):
    return reports.report_job_listing(t)


@query("q52_availability_groups", """
    SELECT a.AGID, a.AGName AS AvailabilityGroupName, a.AGGuid AS AvailabilityGroupGUID, i.ServerInstance AS ReplicaName, g.ReplicaRole, a.DiscoveryOn AS AvailabilityGroupDiscoveryDate,
           a.LastUpdated AS AvailabilityGroupLastUpdateDate, g.DiscoveryOn AS ReplicaDiscoveryDate, g.LastUpdated AS ReplicaLastUpdateDate
    FROM availability_groups a JOIN ag_instances g ON g.AGID = a.AGID JOIN instance_view i ON i.SQLInstanceID = g.SQLInstanceID""")
def _(t):
    return reports.report_availability_groups(t)


@query("q53_lookup_instance", "SELECT * FROM instance_view WHERE lower(SQLInstanceName) = 'mssqlserver'")
def _(t):
    return reports.lookup(t, "instance", SQLInstanceName="MSSQLSERVER")


@query("q53_lookup_cluster_node", """
    SELECT n.SQLClusterID, n.SQLNodeID, n.IsActiveNode, c.SQLClusterName, s.ServerName AS NodeName
    FROM sql_cluster_nodes n JOIN sql_clusters c ON c.SQLClusterID = n.SQLClusterID JOIN servers s ON s.ServerID = n.SQLNodeID""")
def _(t):
    return reports.lookup(t, "cluster_node")


class _Stored:
    """The fleet with the tables that a stored warehouse adds."""

    def __init__(self, t):
        self._t = t
        self.sql_services = _stored_services(t)
        self.extended_properties = _property_names(t)
        self.extended_property_values = _property_values(t)
        count = F.count(F.lit(1)).cast("string").alias("SettingValue")
        self.settings = t.raw("events").groupBy(F.concat(F.lit("Events_"), F.col("event_type")).alias("SettingName")).agg(count)

    def __getattr__(self, name):
        return getattr(self._t, name)


@query("q53_lookup_service", "SELECT x.*, s.ServerName FROM stored_services x JOIN servers s ON s.ServerID = x.ServerID")
def _(t):
    return reports.lookup(_Stored(t), "service")


@query("q53_lookup_property", """
    SELECT v.SQLInstanceID, i.ServerInstance, n.ExtendedPropertyID, n.ExtendedPropertyName, v.ExtendedPropertyValue, v.DiscoveryOn, v.LastUpdated
    FROM property_names n JOIN property_values v ON v.ExtendedPropertyID = n.ExtendedPropertyID JOIN instance_view i ON i.SQLInstanceID = v.SQLInstanceID
    WHERE lower(n.ExtendedPropertyName) = 'machinetype'""")
def _(t):
    return reports.lookup(_Stored(t), "property", ExtendedPropertyName="machinetype")


@query("q53_lookup_setting", "SELECT 'Events_' || event_type AS SettingName, CAST(count(*) AS VARCHAR) AS SettingValue FROM events WHERE event_type = 'click' GROUP BY 1")
def _(t):
    return reports.lookup(_Stored(t), "setting", SettingName="events_CLICK")


@query("q53_lookup_error_mark", "SELECT SQLInstanceID, max(DateTime) AS LastDateTimeCaptured FROM sql_error_log GROUP BY 1")
def _(t):
    return reports.lookup(t, "error_log_mark")


@query("q53_lookup_job_mark", """
    SELECT j.SQLInstanceID, max(h.ExecutionDateTime) AS LastDateTimeCaptured FROM sql_job_history h JOIN sql_jobs j ON j.SQLJobID = h.SQLJobID GROUP BY 1""")
def _(t):
    return reports.lookup(t, "job_mark")


@query("q53_lookup_server", f"SELECT {_SERVER_COLS} WHERE lower(s.ServerName) = 'supplier#000000007'")
def _(t):
    return reports.lookup(t, "server", ServerName="SUPPLIER#000000007")


@query("q53_lookup_cluster", "SELECT * FROM sql_clusters WHERE SQLClusterName = (SELECT min(SQLClusterName) FROM sql_clusters)")
def _(t):
    first = t.sql_clusters.agg(F.min(F.upper("SQLClusterName")).alias("_name"))
    found = reports.lookup(t, "cluster")
    return found.join(first, F.upper("SQLClusterName") == F.col("_name")).drop("_name")


@query("q53_lookup_operating_system", "SELECT * FROM operating_systems WHERE OperatingSystemName = 'Windows Server 2012'")
def _(t):
    return reports.lookup(t, "operating_system", OperatingSystemName="WINDOWS SERVER 2012 ")


# ---- dashboard snapshot ---------------------------------------------------------------------

@query("d1_services", f"SELECT ServiceType, Status, count(*) AS SvcCount FROM ({_SERVICES}) x GROUP BY 1, 2")
def _(t):
    return snapshot.snapshot_services(_stored_services(t), t.servers, AS_OF)


_ERRORS = """SELECT SQLInstanceEnviornment, CASE WHEN ErrorLogCount > 0 THEN 'Errors' ELSE 'No Errors' END AS ErrorStatus, count(*) AS InstanceCount,
    CAST(sum(ErrorLogCount) AS BIGINT) AS TotalErrors FROM error_summary GROUP BY 1, 2"""


@query("d2_errors", _ERRORS)
def _(t):
    return snapshot.snapshot_errors(t, EVENTS_AS_OF)


@query("d3_databases", f"""
    SELECT d.DatabaseState, count(*) AS RwCount FROM databases d JOIN instance_view i ON i.SQLInstanceID = d.SQLInstanceID LEFT JOIN ag_databases g ON g.DatabaseID = d.DatabaseID
    WHERE d.LastUpdated >= {D} - 1 AND NOT EXISTS (SELECT 1 FROM databases_exclusions e WHERE e.DatabaseID = d.DatabaseID AND e.SQLInstanceID = i.SQLInstanceID
        AND e.DatabaseName = d.DatabaseName) GROUP BY 1""")
def _(t):
    return snapshot.snapshot_databases(t, AS_OF)


@query("d4_policy_overview", "SELECT CategoryName, PolicyResult, count(*) AS ObjCount FROM policy_health GROUP BY 1, 2")
def _(t):
    return snapshot.snapshot_policy(_health(t))


@query("d5_jobs", "SELECT JobStatus, count(*) AS TotalCount FROM last_jobs GROUP BY 1")
def _(t):
    return snapshot.snapshot_jobs(t, EVENTS_AS_OF)


@query("d6_size_change", """
    SELECT VolumeOfChangeCategory, CASE VolumeOfChangeCategory WHEN '50GB+ Change' THEN 1 WHEN '25GB to 50GB Change' THEN 2 WHEN '15GB to 25GB Change' THEN 3
        WHEN '10GB to 15GB Change' THEN 4 WHEN '5GB to 10GB Change' THEN 5 ELSE 6 END AS SortKey, count(*) AS TotalInstances FROM size_change GROUP BY 1, 2""")
def _(t):
    return snapshot.snapshot_size_change(_Bulk(t), SIZE_AS_OF)


@query("d7_top_volumes", "SELECT * FROM volume_forecast ORDER BY DaysUntil_OutOfSpace, DiskVolumeID LIMIT 15")
def _(t):
    return snapshot.snapshot_top_volumes(t)


@query("d8_health_filter", f"SELECT * FROM ({_ERRORS}) e WHERE ErrorStatus = 'No Errors'")
def _(t):
    return snapshot.health_filter(snapshot.snapshot_errors(t, EVENTS_AS_OF), "ErrorStatus", "Healthy")


@query("d8_health_filter_unhealthy", f"SELECT * FROM (SELECT ServiceType, Status, count(*) AS SvcCount FROM ({_SERVICES}) x GROUP BY 1, 2) e WHERE Status <> 'Running'")
def _(t):
    return snapshot.health_filter(snapshot.snapshot_services(_stored_services(t), t.servers, AS_OF), "Status", "Unhealthy")


# ---- superseded variants ------------------------------------------------------------------------

@query("b1_cluster_summary", """
    SELECT o.OperatingSystemShortName AS OSName, count(*) AS ClusterCount
    FROM (SELECT SQLClusterID, SQLNodeID, row_number() OVER (PARTITION BY SQLClusterID ORDER BY SQLNodeID) AS rn FROM sql_cluster_nodes) n
    JOIN sql_clusters c ON c.SQLClusterID = n.SQLClusterID JOIN servers s ON s.ServerID = n.SQLNodeID JOIN operating_systems o ON o.OperatingSystemID = s.OperatingSystemID
    WHERE n.rn = 1 GROUP BY 1""")
def _(t):
    return reports.report_cluster_summary(t)


@query("b2_growth_by_file_type", f"SELECT * FROM ({_DB_GROWTH.format(p='YearMonth', t='database_monthly')}) g WHERE FileType = 'Log'")
def _(t):
    return reports.report_database_growth_monthly(_monthly(t), t.databases, file_type="Log")


@query("b3_run_log_of_a_day", "SELECT * FROM run_log WHERE DateTimeCaptured BETWEEN TIMESTAMP '2024-01-16 00:00:00' AND TIMESTAMP '2024-01-16 23:59:59'")
def _(t):
    return reports.report_run_log(t.run_log, day="2024-01-16")


@query("b4_database_summary_by_family", _database_summary_sql(trimmed("v.SQLVersion")))
def _(t):
    return reports.report_database_summary(t, as_of=AS_OF, family=True)


@query("b4_size_summary_by_family", _size_summary_sql(trimmed("v.SQLVersion")))
def _(t):
    return reports.report_database_size_summary(t, as_of=SIZE_AS_OF, seen_as_of="2001-07-20", family=True)


# ---- incremental processing ------------------------------------------------------------------------

def _event_stream(t):
    """The raw events as a file stream."""
    raw = t.raw("events")
    return t.spark.readStream.schema(raw.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)


def _line_stream(t):
    """The stream form of the log-line table: the same derivation over the streamed events."""
    return t.spark.sql(spark_sql("log_lines").replace("FROM events", "FROM {events}"), events=_event_stream(t))


@query("i1_incremental_errors", "SELECT * FROM extracted_errors")
def _(t):
    root = shared_dir(t.spark, "errors")
    incremental.incremental_errors(_line_stream(t), root).awaitTermination()
    return t.spark.read.parquet(f"{root}/errors").select("SQLInstanceID", "DateTimeCaptured", "Message")


@query("i1_final_hours", """
    SELECT SQLInstanceID, date_trunc('hour', LogDate) AS HourStart, date_trunc('hour', LogDate) + INTERVAL 1 HOUR AS HourEnd, count(*) AS LineCount
    FROM log_lines WHERE date_trunc('hour', LogDate) + INTERVAL 1 HOUR <= (SELECT max(LogDate) FROM log_lines) - INTERVAL 30 HOUR GROUP BY 1, 2, 3""")
def _(t):
    root = shared_dir(t.spark, "hours")
    incremental.write_hourly_counts(_line_stream(t), root).awaitTermination()
    return t.spark.read.parquet(f"{root}/hours")


@query("i1_hourly_counts_all", """
    SELECT SQLInstanceID, date_trunc('hour', LogDate) AS HourStart, date_trunc('hour', LogDate) + INTERVAL 1 HOUR AS HourEnd, count(*) AS LineCount
    FROM log_lines WHERE LogDate IS NOT NULL GROUP BY 1, 2, 3""")
def _(t):
    root = shared_dir(t.spark, "hours")
    incremental.write_hourly_counts(_line_stream(t), root).awaitTermination()
    return incremental.with_open_hours(t.spark.read.parquet(f"{root}/hours"), t.log_lines)


@query("i2_incremental_jobs", """
    SELECT j.SQLJobID, f.ExecutionDateTime, (max((f.Duration, f.JobStatus)))[1] AS Duration, max(f.JobStatus) AS JobStatus
    FROM staged_jobs f JOIN sql_jobs j ON j.SQLInstanceID = f.SQLInstanceID AND j.SQLJobName = f.JobName GROUP BY 1, 2""")
def _(t):
    root = shared_dir(t.spark, "jobs")
    runs = t.spark.sql(spark_sql("staged_jobs").replace("FROM events", "FROM {events}"), events=_event_stream(t))
    incremental.incremental_jobs(runs, root, t.sql_jobs).awaitTermination()
    return t.spark.read.parquet(f"{root}/job_history").select("SQLJobID", "ExecutionDateTime", "Duration", "JobStatus")


def _parts(lines: DataFrame) -> DataFrame:
    """Lines with the week of their arrival: a third of a week's last day comes a week later, a few lines two weeks later, a fifth comes twice."""
    day = F.dayofmonth("LogDate")
    week = F.floor((day - 1) / 7).cast("int")
    moved = F.when(F.col("LineNo") % 50 == 7, week + 2).when((F.col("LineNo") % 3 == 0) & ((day - 1) % 7 == 6), week + 1).otherwise(week)
    again = F.when(F.col("LineNo") % 5 == 0, F.array(moved, moved + 1)).otherwise(F.array(moved))
    return lines.withColumn("part", F.explode(again)).withColumn("part", F.least("part", F.lit(4)))


@query("i3_ordered_errors", """
    WITH a AS (SELECT *, CAST(floor((day(LogDate) - 1) / 7) AS INTEGER) AS week FROM log_lines),
    m AS (SELECT *, CASE WHEN LineNo % 50 = 7 THEN week + 2 WHEN LineNo % 3 = 0 AND (day(LogDate) - 1) % 7 = 6 THEN week + 1 ELSE week END AS moved FROM a),
    arrived AS (SELECT *, least(moved, 4) AS part FROM m UNION ALL SELECT *, least(moved + 1, 4) FROM m WHERE LineNo % 5 = 0),
    seen AS (SELECT p.part, (SELECT time_bucket(INTERVAL 6 HOUR, max(b.LogDate) - INTERVAL 30 HOUR) FROM arrived b WHERE b.part < p.part) AS cut FROM (SELECT DISTINCT part FROM arrived) p),
    t AS (SELECT DISTINCT SQLInstanceID, LineNo, LogDate, Text FROM arrived JOIN seen USING (part) WHERE cut IS NULL OR LogDate >= cut),
    h AS (SELECT *, regexp_matches(Text, '(?i)Error:\\s(\\d*).*Severity:\\s(\\d*).*State:\\s(\\d*)') AS hdr,
                 regexp_extract(Text, '(?i)Error:\\s(\\d*).*Severity:\\s(\\d*).*State:\\s(\\d*)', 1) AS num FROM t),
    p AS (SELECT *, lag(CASE WHEN hdr AND num NOT IN ('17187', '35262', '34052') THEN Text END) OVER (PARTITION BY SQLInstanceID ORDER BY LogDate, LineNo) AS prev FROM h)
    SELECT SQLInstanceID, LogDate AS DateTimeCaptured, prev || ' | ' || Text AS Message FROM p WHERE prev IS NOT NULL
    UNION ALL SELECT SQLInstanceID, LogDate, Text FROM p WHERE NOT hdr AND Text ILIKE 'Process ID%was killed by hostname%'""")
def _(t):
    """Five micro-batches with lines that are late, repeated and out of order; final errors and those of the open blocks."""
    root = shared_dir(t.spark, "ordered")
    lines = _parts(t.log_lines)
    for part in range(5):
        lines.filter(F.col("part") == part).drop("part").write.mode("append").parquet(f"{root}/landing")
        stream = t.spark.readStream.schema(t.log_lines.schema).parquet(f"{root}/landing")
        ordered.ordered_errors(stream, root).awaitTermination()
    final = t.spark.read.parquet(f"{root}/errors").drop("batch_id")
    return final.unionByName(ordered.open_errors(t.spark, root))


@query("u25_sliced_backfill", """
    WITH t AS (SELECT * FROM log_lines WHERE LogDate > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 30 HOUR AND LogDate <= TIMESTAMP '2024-01-20 12:00:00'),
    h AS (SELECT *, regexp_matches(Text, '(?i)Error:\\s(\\d*).*Severity:\\s(\\d*).*State:\\s(\\d*)') AS hdr,
                 regexp_extract(Text, '(?i)Error:\\s(\\d*).*Severity:\\s(\\d*).*State:\\s(\\d*)', 1) AS num FROM t),
    p AS (SELECT *, lag(CASE WHEN hdr AND num NOT IN ('17187', '35262', '34052') THEN Text END) OVER (PARTITION BY SQLInstanceID ORDER BY LogDate, LineNo) AS prev FROM h)
    SELECT SQLInstanceID, LogDate AS DateTimeCaptured, prev || ' | ' || Text AS Message FROM p WHERE prev IS NOT NULL
    UNION ALL SELECT SQLInstanceID, LogDate, Text FROM p WHERE NOT hdr AND Text ILIKE 'Process ID%was killed by hostname%'""")
def _(t):
    """Collected in six-hour slices, stopped after the second one and started again."""
    root, now = shared_dir(t.spark, "backfill"), "2024-01-20 12:00:00"
    instances = t.log_lines.select("SQLInstanceID")
    backfill.backfill_errors(t.log_lines, instances, root, now, slice_hours=6, rounds=2)
    backfill.backfill_errors(t.log_lines, instances, root, now, slice_hours=6)
    return backfill.collected(t.spark, root)


@query("i2_folded_jobs", """
    SELECT j.SQLJobID, f.ExecutionDateTime, (max((f.Duration, f.JobStatus)))[1] AS Duration, max(f.JobStatus) AS JobStatus
    FROM staged_jobs f JOIN sql_jobs j ON j.SQLInstanceID = f.SQLInstanceID AND j.SQLJobName = f.JobName GROUP BY 1, 2""")
def _(t):
    """Four micro-batches, folded after each; every batch is delivered again with the next one."""
    root = shared_dir(t.spark, "folded")
    week = F.least(F.floor((F.dayofmonth("ExecutionDateTime") - 1) / 7), F.lit(3))
    for part in range(4):
        t.staged_jobs.filter(week.isin(part, part - 1)).write.mode("append").parquet(f"{root}/landing")
        stream = t.spark.readStream.schema(t.staged_jobs.schema).parquet(f"{root}/landing")
        incremental.incremental_jobs(stream, root, t.sql_jobs).awaitTermination()
        incremental.fold_jobs(t.spark, root)
    return incremental.job_history(t.spark, root).drop("run_date")


# ---- stored batches and tables ------------------------------------------------------------------------

_STAGED_JOBS = "SQLInstanceID bigint, JobName string, CategoryName string, ExecutionDateTime timestamp_ntz, Duration int, JobStatus string"


@query("s2_land_batch", "SELECT * FROM staged_jobs")
def _(t):
    root = shared_dir(t.spark, "staging")
    tables.land_batch(t.staged_jobs, root, "jobs", 7)
    return tables.read_batch(t.spark, root, "jobs", 7, _STAGED_JOBS)


@query("s3_clear_batch", "SELECT * FROM staged_jobs WHERE JobStatus <> 'Failed' AND Duration >= 100")
def _(t):
    root = shared_dir(t.spark, "staging")
    tables.land_batch(t.staged_jobs.filter("Duration < 100"), root, "jobs", 1)
    tables.land_batch(t.staged_jobs.filter("Duration >= 100"), root, "jobs", 2)
    tables.clear_batch(t.spark, root, "jobs", 1)
    return tables.read_batch(t.spark, root, "jobs", 1, _STAGED_JOBS).unionByName(tables.read_batch(t.spark, root, "jobs", 2, _STAGED_JOBS))


@query("s5_append_run_log", """
    SELECT DateTimeCaptured, ProcessID, Description FROM run_log UNION ALL SELECT TIMESTAMP '2024-02-01 00:00:00', 7, 'Collection End'""")
def _(t):
    path = shared_dir(t.spark, "run_log")
    t.run_log.write.parquet(path)
    tables.append_run_log(t.spark, path, 7, [("2024-02-01 00:00:00", "Collection End")])
    return tables.read_table(t.spark, "run_log", path).select("DateTimeCaptured", "ProcessID", "Description")


@query("s6_write_partitioned", """
    SELECT *, CAST(strftime(DateCaptured, '%Y%m') AS INTEGER) AS yyyymm FROM disk_volume_space""")
def _(t):
    path = shared_dir(t.spark, "space")
    tables.write_partitioned(t.disk_volume_space, path)
    return t.spark.read.parquet(path)
