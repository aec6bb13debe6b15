"""Conforming of landed collector feeds: column expressions over all machines at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.columns import DEFAULT_INSTANCE, apply_filters, as_col, ci, idiv, like_ci, ts_lit
from fleetlens.functions.shuffles import dealt
from fleetlens.functions.windows import hour_slice, month_slice, sliced_lag

BS = "\\"

# fixed values: messages that are not worth reporting
ERRORS_TO_SKIP = ("17187", "35262", "34052")
# fixed value: form of an error header
ERROR_HEADER = r"(?i)Error:\s(\d*).*Severity:\s(\d*).*State:\s(\d*)"
# fixed values: stand-alone lines that are reported without a header
STANDALONE_PATTERNS = (
    "A significant part of sql server process memory has been paged out.%",
    "AppDomain%due to memory pressure%",
    "SQL Server has encountered%occurrence(s) of I/O requests taking longer than%",
    "Process ID%was killed by hostname%",
    "%Stack Dump%",
)

# fixed values: product names by major build number
PRODUCT_BY_MAJOR = {
    8: " 2000", 9: " 2005", 10: " 2008", 11: " 2012", 12: " 2014",
    13: " 2016", 14: " 2017", 15: " 2019", 16: " 2022",
}

# fixed values: job run outcome by status code
RUN_STATUS = {0: "Failed", 1: "Successful", 2: "Retrying", 3: "Cancelled", 4: "Running"}

# fixed value: a database in no availability group
NO_GROUP_GUID = "00000000-0000-0000-0000-000000000000"
# fixed values: databases that every instance has
SYSTEM_DATABASES = ("master", "model", "msdb", "SSISDB")
# fixed values: properties of the machine, and how many of them must be there
MACHINE_PROPERTIES = ("EnvironmentType", "MachineType", "ServerType", "ActiveNode")
REQUIRED_PROPERTIES = 4
# fixed values: keys of passive nodes
PASSIVE_KEYS = ("PassiveNode", *(f"PassiveNode{i:02d}" for i in range(2, 9)))

# fixed values: built-in logins and users that access audits leave out
SYSTEM_LOGINS = (
    "sa", "public", "##MS_SQLResourceSigningCertificate##", "##MS_SQLReplicationSigningCertificate##",
    "##MS_SQLAuthenticatorCertificate##", "##MS_PolicySigningCertificate##", "##MS_SmoExtendedSigningCertificate##",
    "##MS_PolicyTsqlExecutionLogin##", r"NT AUTHORITY\SYSTEM", r"NT SERVICE\SQLSERVERAGENT", r"NT SERVICE\ReportServer",
    r"NT Service\MSSQLSERVER", r"NT SERVICE\SQLWriter", r"NT SERVICE\Winmgmt", "##MS_AgentSigningCertificate##",
    "##MS_PolicyEventProcessingLogin##", r"NT SERVICE\SQLTELEMETRY", r"NT SERVICE\PowerBIReportServer",
    r"NT Service\HealthService", "##MS_SSISServerCleanupJobLogin##",
)
SYSTEM_USERS = (*SYSTEM_LOGINS, "##MS_SSISServerCleanupJobUser##", "MS_DataCollectorInternalUser", "AllSchemaOwner")
SYSTEM_GRANTEES = (
    "sa", "##MS_SQLResourceSigningCertificate##", "##MS_SQLReplicationSigningCertificate##",
    "##MS_SQLAuthenticatorCertificate##", "##MS_PolicySigningCertificate##", "##MS_SmoExtendedSigningCertificate##",
    "##MS_PolicyTsqlExecutionLogin##", r"NT AUTHORITY\SYSTEM", r"NT SERVICE\SQLSERVERAGENT", r"NT SERVICE\ReportServer",
    r"NT Service\MSSQLSERVER", r"NT SERVICE\SQLWriter", r"NT SERVICE\Winmgmt", "dbo", "##MS_AgentSigningCertificate##",
    "##MS_PolicyEventProcessingLogin##",
)
# fixed values: grants that everyone has
SERVER_GRANTS_TO_SKIP = ("AUTHENTICATE SERVER", "CONNECT SQL", "CONNECT")
# fixed values: roles that come with the product
SYSTEM_ROLES = (
    "PolicyAdministratorRole", "SQLAgentOperatorRole", "UtilityIMRWriter", "UtilityCMRReader", "UtilityIMRReader",
    "TargetServersRole", "SQLAgentUserRole", "dc_operator", "dc_proxy", "dc_admin", "ServerGroupReaderRole",
    "db_ssisadmin", "db_ssisltduser", "db_ssisoperator", "ServerGroupAdministratorRole", "DatabaseMailUserRole", "RSExecRole",
)
SERVICE_LOGIN_PREFIXES = ("nt service\\mssql$", "nt service\\sqlagent$")


# ---- names ---------------------------------------------------------------------

def _host_part(name: Column) -> Column:
    return F.substring_index(F.substring_index(name, ",", 1), BS, 1)


def split_instance_name(df: DataFrame, col: str = "ServerInstance") -> DataFrame:
    """``host.domain\\inst,port`` into ComputerName, DomainName, SQLInstanceName and Port."""
    name = F.lower(as_col(col))
    host = _host_part(name)
    dotted = F.instr(host, ".") > 0
    port = F.substring_index(name, ",", -1)
    return df.select(
        "*",
        F.substring_index(host, ".", 1).alias("ComputerName"),
        F.when(dotted, F.substring(host, F.instr(host, ".") + 1, F.length(host))).otherwise(F.lit("")).alias("DomainName"),
        F.when(F.instr(name, BS) > 0, F.substring_index(F.substring_index(name, ",", 1), BS, -1))
        .otherwise(F.lit(DEFAULT_INSTANCE)).alias("SQLInstanceName"),
        F.when(F.instr(name, ",") > 0, port.cast("int")).otherwise(F.lit(0)).alias("Port"),
    )


def normalise_registered_names(
    df: DataFrame, default_domain: str, display: str = "ServerInstance", connection: str = "ServerInstanceConnectionString",
) -> DataFrame:
    """Display name without port and domain; connection name with a domain on its host.

    Adds ``ComputerName`` (host of the connection name) and ``SQLInstanceName``.
    """
    shown = F.substring_index(as_col(display), ",", 1)
    host = F.substring_index(shown, BS, 1)
    clean = F.concat(F.substring_index(host, ".", 1), F.substring(shown, F.length(host) + 1, F.length(shown) + 1))
    link = as_col(connection)
    link_host = _host_part(link)
    full_host = F.when(F.instr(link_host, ".") > 0, link_host).otherwise(F.concat(link_host, F.lit("." + default_domain)))
    rest = F.substring(link, F.length(link_host) + 1, F.length(link) + 1)
    others = [c for c in df.columns if c not in (display, connection)]
    return df.select(
        *others, clean.alias(display), F.concat(full_host, rest).alias(connection), full_host.alias("ComputerName"),
        F.when(F.instr(shown, BS) > 0, F.substring_index(shown, BS, -1)).otherwise(F.lit(DEFAULT_INSTANCE)).alias("SQLInstanceName"),
    )


# ---- error log -----------------------------------------------------------------

def _header_number(text: Column) -> Column:
    return F.regexp_extract(text, ERROR_HEADER, 1)


def extract_errors(
    lines: DataFrame, exclude: tuple[str, ...] = ERRORS_TO_SKIP,
    keys: tuple[str, ...] = ("SQLInstanceID",), order: tuple[str, ...] = ("LogDate", "LineNo"), slice_of: Callable[[Column], Column] = hour_slice,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Reportable messages: a kept error header joined with its next line, and stand-alone lines.

    The line after a kept header always continues it and carries the timestamp; the
    same line may be a header or a stand-alone message itself.  A header never counts
    as stand-alone.  Pairing looks back one row with a lag that is sliced by
    time, so a machine that writes a third of all lines is spread over many tasks.
    ``keep`` names further columns of the current line to pass through.
    """
    text = F.col("Text")
    is_header = F.rlike(text, F.lit(ERROR_HEADER))
    kept = is_header & ~_header_number(text).isin(*exclude)
    rows = sliced_lag(
        lines, list(keys), list(order), slice_of(F.col(order[0])),
        {"_header": F.when(kept, text)})
    alone = F.lit(False)
    for pattern in STANDALONE_PATTERNS:
        alone = alone | like_ci("Text", pattern)
    messages = F.array_compact(F.array(
        F.when(F.col("_header").isNotNull(), F.concat(F.col("_header"), F.lit(" | "), text)),
        F.when(~is_header & alone, text)))
    return rows.select(*keys, *keep, F.col(order[0]).alias("DateTimeCaptured"), F.explode(messages).alias("Message"))


def select_log_archives(
    files: DataFrame, start: str, end: str, keys: tuple[str, ...] = ("SQLInstanceID",),
) -> DataFrame:
    """Archive files whose life from the previous file's end to their own overlaps the window."""
    rows = sliced_lag(
        files, list(keys), ["LastModified", "ArchiveNo"], month_slice(F.col("LastModified")),
        {"CreationDate": F.col("LastModified")})
    return rows.filter(
        F.col("CreationDate").isNotNull() & (F.col("LastModified") >= ts_lit(start)) & (F.col("CreationDate") <= ts_lit(end))
    ).select(*keys, "ArchiveNo", "CreationDate", F.col("LastModified").alias("ModifiedDate"))


# ---- jobs ----------------------------------------------------------------------

def duration_seconds(packed: Column) -> Column:
    """Seconds of a ``DHHMMSS`` number with any number of digits for the days."""
    value = packed.cast("bigint")

    def part(unit: int) -> Column:
        return idiv(value, unit) % 100

    return (idiv(value, 1_000_000) * 86400 + part(10_000) * 3600 + part(100) * 60 + part(1)).cast("int")


def decode_job_history(history: DataFrame, jobs: DataFrame, categories: DataFrame, after: str | None = None) -> DataFrame:
    """Whole-job outcomes with decoded status and duration; policy-engine jobs are left out."""
    status = F.lit("Unknown")
    for code, label in RUN_STATUS.items():
        status = F.when(F.col("run_status") == code, F.lit(label)).otherwise(status)
    runs = apply_filters(
        history.filter(F.col("step_id") == 0), F.col("run_ts") >= ts_lit(after) if after else None)
    named = (
        jobs.filter(~F.lower("name").startswith("syspolicy")).select("job_id", "SQLInstanceID", F.col("name").alias("JobName"), "category_id")
        .join(categories.select("category_id", F.col("name").alias("CategoryName")), "category_id")
    )
    return runs.join(named, "job_id").select(
        "SQLInstanceID", "JobName", "CategoryName", F.col("run_ts").alias("ExecutionDateTime"),
        duration_seconds(F.col("run_duration")).alias("Duration"), status.alias("JobStatus"))


# ---- databases -----------------------------------------------------------------

def rollup_database_files(
    files: DataFrame, databases: DataFrame, apps: DataFrame, ag: DataFrame | None = None, with_owner: bool = True,
) -> DataFrame:
    """Size in MB per database and file type, with application and group defaults.

    Files are summed per database first, so only small rows meet the dimension joins.
    ``ag=None`` is the form for versions without availability groups;
    ``with_owner=False`` leaves the owner null as the older feed did.
    """
    kind = F.when(F.col("FileTypeCode") == 0, "Data").otherwise("Log")
    sizes = files.groupBy("DatabaseID", kind.alias("FileType")).agg(
        F.sum(idiv(F.col("SizePages"), 128)).alias("FileSize_mb"))
    dbs = databases.filter(~ci("DatabaseName").isin(*map(str.lower, SYSTEM_DATABASES))).select("DatabaseID", "SQLInstanceID", "DatabaseName", "DatabaseState")
    rows = sizes.join(dbs, "DatabaseID").join(apps.select("DatabaseID", "ApplicationName", "ApplicationOwner"), "DatabaseID", "left")
    if ag is not None:
        rows = rows.join(ag.select("DatabaseID", "AGGuid"), "DatabaseID", "left")
    temp = F.lower("DatabaseName") == "tempdb"
    owner = F.when(temp, "SQL Server DBA Team").otherwise(F.coalesce("ApplicationOwner", F.lit("Unknown")))
    guid = F.coalesce(F.col("AGGuid"), F.lit(NO_GROUP_GUID)) if ag is not None else F.lit(NO_GROUP_GUID)
    shaped = rows.select(
        "SQLInstanceID", guid.alias("AGGuid"),
        F.when(temp, "Microsoft SQL Server").otherwise(F.coalesce("ApplicationName", F.lit("Unknown"))).alias("ApplicationName"),
        (owner if with_owner else F.lit(None).cast("string")).alias("ApplicationOwner"),
        "DatabaseName", F.upper("DatabaseState").alias("DatabaseState"), "FileType", "FileSize_mb")
    return shaped.groupBy(
        "SQLInstanceID", "AGGuid", "ApplicationName", "ApplicationOwner", "DatabaseName", "DatabaseState", "FileType"
    ).agg(F.sum("FileSize_mb").alias("FileSize_mb"))


def parent_folder(path: Column) -> Column:
    r"""Lower-cased folder of a path; a path without a folder gives the whole path."""
    return F.lower(F.regexp_replace(path, r"\\[^\\]*$", ""))


def data_folders(files: DataFrame, backups: DataFrame) -> DataFrame:
    """Distinct folders of data files, followed by those of backups (``nul:`` devices skipped)."""
    data = files.select(parent_folder(F.col("PhysicalName")).alias("FolderName")).distinct()
    kept = backups.filter(F.lower("PhysicalDeviceName") != "nul:")
    return data.unionByName(kept.select(parent_folder(F.col("PhysicalDeviceName")).alias("FolderName")).distinct())


# ---- machines ------------------------------------------------------------------

def version_label(df: DataFrame, col: str = "ProductVersion") -> DataFrame:
    """Major, minor and build numbers and the product name of a dotted version."""
    parts = F.split(as_col(col), r"\.")
    major, minor, build = (F.try_element_at(parts, F.lit(i)).try_cast("int") for i in (1, 2, 3))
    suffix = F.lit("")
    for number, name in PRODUCT_BY_MAJOR.items():
        suffix = F.when(major == number, F.lit(name)).otherwise(suffix)
    r2 = F.when((major == 10) & (minor >= 50), F.lit(" R2")).otherwise(F.lit(""))
    return df.select(
        "*", major.alias("SQLBuild_Major"), minor.alias("SQLBuild_Minor"), build.alias("SQLBuild_Build"),
        F.concat(F.lit("Microsoft SQL Server"), suffix, r2).alias("SQLVersion"))


def os_label(df: DataFrame, col: str = "OSCaption") -> DataFrame:
    number = F.regexp_extract(as_col(col), r"(?i)(\d{4}\sR2|\d{4}|\d{1,2})", 1)
    label = (
        F.when(number.isNull() | (number == ""), "Unknown").when(number == "10", "Windows 10")
        .otherwise(F.concat(F.lit("Windows Server "), number)))
    return df.select("*", label.alias("OperatingSystem"))


def host_capacity(processors: DataFrame, memory: DataFrame, pagefiles: DataFrame) -> DataFrame:
    """Cores over all sockets, memory and page-file size of every server in any feed; what is not reported is 0 / Unknown."""
    cpu = processors.groupBy("ServerID").agg(
        F.max("Name").alias("ProcessorName"), F.sum("NumberOfCores").alias("NumberOfCores"),
        F.sum("NumberOfLogicalProcessors").alias("NumberOfLogicalCores"))
    page = pagefiles.groupBy("ServerID").agg(F.sum("AllocatedBaseSize").alias("PageFile_mb"))
    ram = memory.select("ServerID", idiv(F.col("TotalPhysicalMemory"), 1024 * 1024).alias("Memory_mb"))
    zero = F.lit(0).cast("bigint")
    return ram.join(cpu, "ServerID", "full_outer").join(page, "ServerID", "full_outer").select(
        "ServerID", F.coalesce("ProcessorName", F.lit("Unknown")).alias("ProcessorName"),
        F.coalesce("NumberOfCores", zero).alias("NumberOfCores"),
        F.coalesce("NumberOfLogicalCores", zero).alias("NumberOfLogicalCores"),
        F.coalesce("Memory_mb", zero).alias("Memory_mb"), F.coalesce("PageFile_mb", zero).alias("PageFile_mb"))


def classify_services(services: DataFrame) -> DataFrame:
    """Database-related services with their type and instance name; the first matching rule wins."""
    name, shown = F.lower("ServiceName"), F.lower("DisplayName")
    related = (
        shown.contains("sql") | shown.contains("powerbi") | shown.contains("power bi") | name.contains("msdts"))
    skipped = name.startswith("mssqlserveradhelper") | (name == "sqlwriter")
    raw = F.col("ServiceName")

    def after(n: int) -> Column:
        return F.substring(raw, F.lit(n + 1), F.length(raw))

    report = name.startswith("sqlserverreport") | (name == "reportserver")
    rules = [
        (name == "mssqlserver", "Engine", F.lit("MSSQLServer")),
        (name.startswith("mssql$"), "Engine", after(6)),
        (name == "mssqlserverolapservice", "SSAS", F.lit("MSSQLServerOLAPService")),
        # Published quirk: the named-instance rule has no wildcard, so only the bare prefix matches.
        (name == "msolap$", "SSAS", after(7)),
        (name == "sqlserveragent", "SQLAgent", F.lit("MSSQLServer")),
        (name.startswith("sqlagent$"), "SQL Agent", after(9)),
        (name.contains("powerbi") | name.contains("power bi"), "PowerBI (SSRS)", F.lit("PBIRS")),
        (report, "SSRS", F.lit("MSSQLServer")),
        (name.startswith("reportserver"), "SSRS", after(13)),
        (name.startswith("msdts"), "SSIS", F.lit("N/A")),
        (name.startswith("mssqlfd"), "Full-Text Search", F.lit("N/A")),
    ]
    kind, instance = F.lit(None).cast("string"), F.lit(None).cast("string")
    for test, label, inst in reversed(rules):
        kind = F.when(test, F.lit(label)).otherwise(kind)
        instance = F.when(test, inst).otherwise(instance)
    return (
        services.filter(related & ~skipped)
        .withColumn("ServiceType", kind).withColumn("InstanceName", instance)
        .filter(F.col("ServiceType").isNotNull())
    )


def parse_replica_names(replicas: DataFrame, states: DataFrame) -> DataFrame:
    """Host and instance of each replica; an unknown role counts as primary."""
    name = F.lower("ReplicaServerName")
    slash = F.instr(name, BS)
    return replicas.join(states.select("ReplicaID", "RoleDesc"), "ReplicaID", "left").select(
        "ReplicaID", "AGGuid", "AGName", F.substring_index(name, BS, 1).alias("ComputerName"),
        F.when(slash > 0, F.substring(name, slash + 1, F.length(name))).otherwise(F.lit(DEFAULT_INSTANCE)).alias("InstanceName"),
        F.coalesce("RoleDesc", F.lit("PRIMARY")).alias("ReplicaRole"))


def is_machine_property(name: Column) -> Column:
    return name.isin(*MACHINE_PROPERTIES) | name.startswith("PassiveNode")


def pivot_properties(kv: DataFrame) -> DataFrame:
    """One row per instance: machine properties and custom ones as maps.

    ``IsComplete`` is false when fewer than four machine properties were found.
    A property name occurs once per instance, so a map is bounded by the number of names, and rows
    are dealt by instance before anything is aggregated.
    """
    machine = is_machine_property(F.col("PropertyName"))
    entry = F.struct("PropertyName", "PropertyValue")
    one = dealt(kv, "SQLInstanceID").groupBy("SQLInstanceID", "PropertyName").agg(F.max("PropertyValue").alias("PropertyValue"))

    def as_map(test: Column) -> Column:
        return F.map_from_entries(F.array_sort(F.collect_list(F.when(test, entry))))

    return one.groupBy("SQLInstanceID").agg(
        as_map(machine).alias("MachineProperties"), as_map(~machine).alias("CustomProperties"),
        (F.count(F.when(machine, 1)) >= REQUIRED_PROPERTIES).alias("IsComplete"))


def cluster_nodes(properties: DataFrame, default_domain: str) -> DataFrame:
    """Active and passive nodes named by an instance's machine properties.

    ``properties`` is the output of :func:`pivot_properties`; numbered passive nodes count
    only when the plain ``PassiveNode`` exists.  A bare host gets ``default_domain``.
    """
    props = F.col("MachineProperties")
    has_passive = F.array_contains(F.map_keys(props), "PassiveNode")
    names = F.array(*[F.lit(k) for k in ("ActiveNode", *PASSIVE_KEYS)])
    nodes = F.transform(names, lambda k: F.struct(k.alias("key"), F.lower(F.try_element_at(props, k)).alias("node")))
    picked = F.filter(nodes, lambda n: n["node"].isNotNull() & ((n["key"] == "ActiveNode") | has_passive))
    rows = properties.select("SQLInstanceID", F.explode(picked).alias("n"))
    host = F.col("n.node")
    return rows.select(
        "SQLInstanceID",
        F.when(F.instr(host, ".") > 0, host).otherwise(F.concat(host, F.lit("." + default_domain))).alias("NodeName"),
        (F.col("n.key") == "ActiveNode").alias("IsActiveNode"))


# ---- security ------------------------------------------------------------------

def _is_noise(name: Column, system: tuple[str, ...]) -> Column:
    low = F.lower(name)
    noise = low.isin(*[s.lower() for s in system])
    for prefix in SERVICE_LOGIN_PREFIXES:
        noise = noise | low.startswith(prefix)
    return noise


def _members(principals: DataFrame, role_members: DataFrame, scope: list[str], member_types: list[str] | None) -> DataFrame:
    roles = principals.filter(F.col("type") == "R").select(
        *scope, F.col("principal_id").alias("role_principal_id"), F.col("name").alias("RoleName"))
    people = principals if member_types is None else principals.filter(F.col("type").isin(*member_types))
    people = people.select(
        *scope, F.col("principal_id").alias("member_principal_id"), F.col("name").alias("_name"), F.col("type_desc").alias("_type"), "sid")
    return role_members.join(roles, [*scope, "role_principal_id"]).join(people, [*scope, "member_principal_id"])


def server_memberships(principals: DataFrame, role_members: DataFrame) -> DataFrame:
    """A ``public`` row per login and a row per role member, without built-in logins."""
    scope = ["SQLInstanceID"]
    public = principals.filter(F.col("type") != "R").select(
        *scope, F.lit("public").alias("RoleName"), F.col("name").alias("LoginName"), F.col("type_desc").alias("LoginType"))
    members = _members(principals, role_members, scope, None).filter(F.col("member_principal_id") != 1).select(
        *scope, "RoleName", F.col("_name").alias("LoginName"), F.col("_type").alias("LoginType"))
    return public.unionByName(members).filter(~_is_noise(F.col("LoginName"), SYSTEM_LOGINS))


def _unreadable_copies(states: DataFrame, seen: DataFrame, scope: list[str]) -> DataFrame:
    """Databases on a secondary replica that produced no row."""
    return (
        states.filter((F.col("RoleDesc") == "SECONDARY") & ~ci("DatabaseName").isin(*map(str.lower, SYSTEM_DATABASES)))
        .select(*scope).distinct().join(seen.select(*scope).distinct(), scope, "left_anti"))


def database_memberships(
    principals: DataFrame, role_members: DataFrame, server_principals: DataFrame, ag_states: DataFrame,
) -> DataFrame:
    """Role members and public users per database, orphan flag by missing server sid.

    A secondary copy that could not be read contributes one placeholder row with null role and user.
    """
    scope = ["SQLInstanceID", "DatabaseName"]
    members = _members(principals, role_members, scope, ["U", "S", "G"]).select(
        *scope, "RoleName", F.col("_name").alias("UserName"), F.col("_type").alias("UserType"), "sid")
    public = principals.filter(F.col("type").isin("U", "S") & ~F.col("name").isin("sys", "INFORMATION_SCHEMA")).select(
        *scope, F.lit("public").alias("RoleName"), F.col("name").alias("UserName"), F.col("type_desc").alias("UserType"), "sid")
    logins = server_principals.filter(F.col("sid").isNotNull()).select("SQLInstanceID", "sid", F.lit(True).alias("_known")).distinct()
    rows = members.unionByName(public).join(logins, ["SQLInstanceID", "sid"], "left").select(
        *scope, "RoleName", "UserName", "UserType", F.col("_known").isNull().alias("IsOrphaned"))
    gaps = _unreadable_copies(ag_states, rows, scope).select(
        *scope, *[F.lit(None).cast("string").alias(c) for c in ("RoleName", "UserName", "UserType")],
        F.lit(None).cast("boolean").alias("IsOrphaned"))
    return rows.unionByName(gaps).filter(
        (F.col("UserName").isNull() | ~_is_noise(F.col("UserName"), SYSTEM_USERS)) & ~ci("DatabaseName").isin(*map(str.lower, SYSTEM_DATABASES)))


def _grants(principals: DataFrame, grants: DataFrame, scope: list[str]) -> DataFrame:
    def side(who: str) -> DataFrame:
        return principals.select(
            *scope, F.col("principal_id").alias(f"{who.lower()}_principal_id"),
            F.col("name").alias(f"{who}Name"), F.col("type_desc").alias(f"{who}Type"),
            *([F.col("type").alias("_grantee_kind")] if who == "Grantee" else []))

    return grants.join(side("Grantee"), [*scope, "grantee_principal_id"]).join(side("Grantor"), [*scope, "grantor_principal_id"])


def server_permissions(principals: DataFrame, grants: DataFrame) -> DataFrame:
    """Explicit server grants with grantee and grantor names, connection grants left out."""
    scope = ["SQLInstanceID"]
    wanted = grants.filter(~F.col("permission_name").isin(*SERVER_GRANTS_TO_SKIP))
    system = tuple(s for s in SYSTEM_LOGINS if s != r"NT SERVICE\PowerBIReportServer")
    return _grants(principals, wanted, scope).filter(~_is_noise(F.col("GranteeName"), system)).select(
        *scope, "GranteeName", "GrantorName", "GranteeType", "GrantorType", F.col("class_desc").alias("ObjectType"),
        F.col("major_id").alias("ObjectID"), F.col("state_desc").alias("Access"), F.col("permission_name").alias("PermissionName"))


def database_permissions(principals: DataFrame, grants: DataFrame, objects: DataFrame, ag_states: DataFrame) -> DataFrame:
    """Explicit object grants of roles and of users that may connect, with object names.

    Unreadable secondary copies contribute one placeholder row each.
    """
    scope = ["SQLInstanceID", "DatabaseName"]
    connected = grants.filter(F.col("permission_name") == "CONNECT").select(*scope, "grantee_principal_id").distinct().withColumn(
        "_connected", F.lit(True))
    wanted = grants.filter((F.col("permission_name") != "CONNECT") & (F.col("major_id") > 0))
    rows = (
        _grants(principals, wanted, scope).join(connected, [*scope, "grantee_principal_id"], "left")
        .filter(F.col("_connected").isNotNull() | (F.col("_grantee_kind") == "R"))
        .filter(~_is_noise(F.col("GranteeName"), SYSTEM_GRANTEES) & ~F.col("GranteeName").isin(*SYSTEM_ROLES))
        .join(objects.select(*scope, F.col("object_id").alias("major_id"), F.col("name").alias("_object")), [*scope, "major_id"], "left")
        .select(
            *scope, "GranteeName", "GrantorName", "GranteeType", "GrantorType", F.col("class_desc").alias("ObjectType"),
            F.coalesce("_object", F.lit("UNKNOWN")).alias("ObjectName"), F.col("state_desc").alias("Access"),
            F.col("permission_name").alias("PermissionName"))
    )
    empty = [F.lit(None).cast("string").alias(c) for c in rows.columns if c not in scope]
    gaps = _unreadable_copies(ag_states, rows, scope).select(*scope, *empty)
    return rows.unionByName(gaps).filter(~ci("DatabaseName").isin(*map(str.lower, SYSTEM_DATABASES)))


def server_roles(principals: DataFrame) -> DataFrame:
    return principals.filter(F.col("type") == "R").select(
        "SQLInstanceID", F.col("name").alias("RoleName"), F.col("type_desc").alias("RoleType"))


def database_roles(principals: DataFrame) -> DataFrame:
    """Role names of an instance's databases, each once."""
    return server_roles(principals).distinct()
