"""Fleet tables derived from the driver's parquet tables.

Every entry of ``FLEET_SQL`` is one deterministic statement over the raw
tables, written in the SQL subset that Spark and DuckDB share, so an operator
and the SQL it is checked against start from the same rows.  Nothing here
samples or caps: each statement covers its whole input.

Fixed as-of values: inventory 2001-10-15, events 2024-01-31, day-over-day size
1998-06-15 (the dense part of the date range).
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2001-10-15"
EVENTS_AS_OF = "2024-01-31 00:00:00"
SIZE_AS_OF = "1998-06-15"

RAW_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
)

# Key mappings that follow the fixed proportions of the tables (10 orders and 4/3 parts per
# customer, 15 customers per supplier), so no table has to be counted first.
_PART_CUSTOMER = "CAST(floor(p_partkey * 3 / 4) AS BIGINT)"
_CUSTOMER_SUPPLIER = "CAST(floor(c_custkey / 15) AS BIGINT)"
_ORDER_CUSTOMER = "CAST(floor(o_orderkey / 10) AS BIGINT)"
_ORDER_PART = "CAST(floor(o_orderkey * 2 / 15) AS BIGINT)"
_JOB_NO = (
    "CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 "
    "WHEN 'signup' THEN 4 ELSE 5 END"
)
_ENV = "CASE WHEN c_mktsegment = 'BUILDING' THEN 'Prod' ELSE c_mktsegment END"
_ROLE_ID = "CAST(substring(o_orderpriority, 1, 1) AS BIGINT)"
_LOGIN_NAME = (
    "CASE c_custkey % 40 WHEN 0 THEN 'sa' "
    "WHEN 1 THEN concat('NT SERVICE', chr(92), 'MSSQL$I', CAST(c_custkey AS VARCHAR(20))) "
    "ELSE concat('login', CAST(c_custkey AS VARCHAR(20))) END"
)
_LOGIN_TYPE = "CASE WHEN c_mktsegment = 'MACHINERY' THEN 'WINDOWS_LOGIN' ELSE 'SQL_LOGIN' END"
_USER_NAME = (
    "CASE c_custkey % 50 WHEN 0 THEN 'dbo' WHEN 1 THEN 'guest' "
    "ELSE concat('user', CAST(c_custkey AS VARCHAR(20))) END"
)
_USER_TYPE = "CASE WHEN c_mktsegment = 'MACHINERY' THEN 'WINDOWS_USER' ELSE 'SQL_USER' END"
_ACCESS = "CASE o_orderkey % 3 WHEN 0 THEN 'DENY' ELSE 'GRANT' END"
_PERMISSION = (
    "CASE o_orderkey % 4 WHEN 0 THEN 'SELECT' WHEN 1 THEN 'INSERT' "
    "WHEN 2 THEN 'EXECUTE' ELSE 'CONNECT' END"
)
_HOST = (
    "concat('HOST', CAST(c_custkey AS VARCHAR(20)), "
    "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat(chr(92), 'INST', CAST(c_custkey % 4 AS VARCHAR(5))) END)"
)

FLEET_SQL: dict[str, str] = {
    # ---- inventory dimensions -------------------------------------------------
    "servers": """
        SELECT s_suppkey AS ServerID, s_name AS ServerName,
               CAST(s_nationkey % 8 + 2 AS INT) AS OperatingSystemID,
               concat('CPU ', CAST(s_suppkey % 3 AS VARCHAR(5))) AS ProcessorName,
               CAST(s_suppkey % 9 AS INT) AS NumberOfCores,
               CAST(s_suppkey % 9 * 2 AS INT) AS NumberOfLogicalCores,
               CAST(s_suppkey % 64 * 1024 AS BIGINT) AS Memory_mb,
               CAST(s_suppkey % 16 * 512 AS BIGINT) AS PageFile_mb,
               (s_suppkey % 2 = 0) AS IsPhysical, true AS IsMonitored,
               DATE '1999-01-01' AS DiscoveryOn,
               DATE '2001-10-15' - CAST(s_suppkey % 120 AS INT) AS LastUpdated
        FROM supplier""",
    "operating_systems": """
        SELECT 1 AS OperatingSystemID, 'Unknown' AS OperatingSystemName, 'Unknown' AS OperatingSystemShortName
        UNION ALL
        SELECT n_nationkey + 2, concat('Windows Server ', CAST(2000 + n_nationkey AS VARCHAR(10))),
               concat('Windows ', CAST(2000 + n_nationkey AS VARCHAR(10)))
        FROM nation""",
    "sql_clusters": """
        SELECT r_regionkey AS SQLClusterID, r_name AS SQLClusterName, true AS IsMonitored,
               DATE '1999-01-01' AS DiscoveryOn,
               DATE '2001-10-15' - CAST(r_regionkey * 25 AS INT) AS LastUpdated
        FROM region""",
    "sql_cluster_nodes": """
        SELECT CAST(s_suppkey % 5 AS INT) AS SQLClusterID, s_suppkey AS SQLNodeID,
               (s_suppkey % 2 = 0) AS IsActiveNode
        FROM supplier WHERE s_acctbal < 1000""",
    "sql_versions": """
        SELECT n_nationkey + 1 AS SQLVersionID,
               CASE WHEN n_nationkey = 0 THEN 'Unknown' ELSE concat('Microsoft SQL Server ', n_name,
                    CASE WHEN n_nationkey % 2 = 0 THEN ' RTM' ELSE ' Service Pack 1' END) END AS SQLVersion,
               CASE WHEN n_nationkey = 0 THEN 'Unknown' ELSE n_name END AS SQLVersionShortName,
               8 + n_nationkey % 9 AS SQLMajorVersion, (n_nationkey % 2) * 50 AS SQLMinorVersion,
               1000 + n_nationkey * 100 AS SQLBuild,
               DATE '1998-01-01' + CAST(n_nationkey * 90 AS INT) AS SQLVersionSupportEndDate
        FROM nation""",
    "sql_instances": f"""
        SELECT c_custkey AS SQLInstanceID,
               CASE WHEN c_custkey % 6 <> 0 THEN {_CUSTOMER_SUPPLIER} END AS ServerID,
               CASE WHEN c_custkey % 6 = 0 THEN CAST(c_custkey % 5 AS INT) END AS SQLClusterID,
               CASE WHEN c_custkey % 3 = 0 THEN 'MSSQLServer' ELSE c_name END AS SQLInstanceName,
               c_nationkey + 1 AS SQLInstanceVersionID,
               concat('11.0.', CAST(c_custkey % 6000 AS VARCHAR(10))) AS SQLInstanceBuild,
               CASE c_custkey % 4 WHEN 0 THEN 'Enterprise Edition: Core-based Licensing (64-bit)'
                    WHEN 1 THEN 'Standard Edition (64-bit)' WHEN 2 THEN 'Express Edition (64-bit)'
                    ELSE 'Developer Edition (64-bit)' END AS SQLInstanceEdition,
               CASE WHEN c_custkey % 6 = 0 THEN 'Microsoft Clustering' ELSE 'Stand Alone' END AS SQLInstanceType,
               {_ENV} AS SQLInstanceEnviornment, true AS IsMonitored,
               DATE '1999-01-01' AS DiscoveryOn,
               DATE '2001-10-15' - CAST(c_custkey % 100 AS INT) AS LastUpdated
        FROM customer""",
    "application": """
        SELECT DISTINCT CAST(substring(p_brand, 7) AS INT) + 1 AS ApplicationID,
               p_brand AS ApplicationName, concat('Team ', p_brand) AS ApplicationOwner
        FROM part""",
    "databases": f"""
        SELECT p_partkey AS DatabaseID, {_PART_CUSTOMER} AS SQLInstanceID,
               concat('db_', CAST(p_partkey AS VARCHAR(20))) AS DatabaseName,
               CASE WHEN p_size % 10 = 0 THEN 'OFFLINE' ELSE 'ONLINE' END AS DatabaseState,
               CAST(substring(p_brand, 7) AS INT) + 1 AS ApplicationID,
               p_brand AS ApplicationName, true AS IsMonitored, DATE '1999-01-01' AS DiscoveryOn,
               DATE '2001-10-15' - CAST(p_partkey % 100 AS INT) AS LastUpdated
        FROM part""",
    "databases_exclusions": f"""
        SELECT p_partkey AS DatabaseID, {_PART_CUSTOMER} AS SQLInstanceID,
               concat('db_', CAST(p_partkey AS VARCHAR(20))) AS DatabaseName
        FROM part WHERE p_size = 40""",
    "disk_volumes": """
        SELECT s_suppkey AS DiskVolumeID, concat('v', CAST(s_suppkey AS VARCHAR(20)), ':') AS DiskVolumeName,
               CASE WHEN s_suppkey % 6 <> 0 THEN s_suppkey END AS ServerID,
               CASE WHEN s_suppkey % 6 = 0 THEN CAST(s_suppkey % 5 AS INT) END AS SQLClusterID,
               (s_suppkey % 11 <> 0) AS IsMonitored, DATE '1999-01-01' AS DiscoveryOn,
               DATE '2001-10-15' - CAST(s_suppkey % 100 AS INT) AS LastUpdated
        FROM supplier""",
    # ---- daily facts ----------------------------------------------------------
    "database_size": """
        SELECT l_partkey AS DatabaseID, CASE WHEN l_linestatus = 'F' THEN 'Data' ELSE 'Log' END AS FileType,
               CAST(l_shipdate AS DATE) AS DateCaptured, CAST(floor(sum(l_quantity)) AS BIGINT) AS FileSize_mb
        FROM lineitem GROUP BY 1, 2, 3""",
    # The same shape with more bytes and coarser owners, so day-over-day changes fall into every band.
    "database_size_bulk": """
        SELECT l_partkey AS DatabaseID, CASE WHEN l_linestatus = 'F' THEN 'Data' ELSE 'Log' END AS FileType,
               CAST(l_shipdate AS DATE) AS DateCaptured, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS FileSize_mb
        FROM lineitem GROUP BY 1, 2, 3""",
    "databases_bulk": """
        SELECT p_partkey AS DatabaseID, CAST(p_size AS BIGINT) AS SQLInstanceID FROM part""",
    "disk_volume_space": """
        SELECT l_suppkey AS DiskVolumeID, CAST(l_shipdate AS DATE) AS DateCaptured,
               CAST(floor(sum(l_quantity)) AS BIGINT) + 1000 AS SpaceUsed_mb, CAST(5000 AS BIGINT) AS TotalSpace_mb
        FROM lineitem GROUP BY 1, 2""",
    # ---- event facts ----------------------------------------------------------
    "sql_error_log": """
        SELECT event_id AS ErrorLogID, user_id AS SQLInstanceID, ts AS DateTime,
               concat('Error: ', substring(props, 7, length(props) - 7)) AS ErrorMsg
        FROM events WHERE event_type = 'error'""",
    "log_lines": """
        SELECT user_id AS SQLInstanceID, event_id AS LineNo, ts AS LogDate,
               CASE event_type
                    WHEN 'error' THEN concat('Error: ', CASE WHEN value < 10 THEN '17187' ELSE substring(props, 7, length(props) - 7) END,
                                             ', Severity: 16, State: 1.')
                    WHEN 'purchase' THEN 'Process ID 51 was killed by hostname APP1' ELSE event_type END AS Text
        FROM events""",
    "log_archives": """
        SELECT user_id AS SQLInstanceID, event_id AS ArchiveNo, ts AS LastModified
        FROM events WHERE event_type = 'signup'""",
    "sql_job_categories": f"""
        SELECT DISTINCT event_type AS SQLJobCategoryName, CAST(({_JOB_NO}) * 2 AS BIGINT) AS SQLJobCategoryID FROM events""",
    "sql_jobs": f"""
        SELECT DISTINCT user_id * 10 + {_JOB_NO} AS SQLJobID, user_id AS SQLInstanceID,
               CAST(({_JOB_NO}) * 2 AS BIGINT) AS SQLJobCategoryID, event_type AS SQLJobName
        FROM events""",
    "sql_job_history": f"""
        SELECT user_id * 10 + {_JOB_NO} AS SQLJobID, ts AS ExecutionDateTime,
               CAST(floor(value) AS INT) AS Duration,
               CASE event_id % 5 WHEN 0 THEN 'Failed' WHEN 1 THEN 'Cancelled' ELSE 'Successful' END AS JobStatus
        FROM events""",
    "run_log": """
        SELECT event_id AS LogID, ts AS DateTimeCaptured, CAST(user_id AS INT) AS ProcessID,
               CASE WHEN event_id % 400 = 399 THEN 'Collection End' ELSE event_type END AS Description
        FROM events""",
    # ---- availability groups --------------------------------------------------
    "availability_groups": """
        SELECT DISTINCT CAST(floor(c_custkey / 50) AS BIGINT) AS AGID,
               concat('ag', CAST(CAST(floor(c_custkey / 50) AS BIGINT) AS VARCHAR(20))) AS AGName,
               concat('guid-', CAST(CAST(floor(c_custkey / 50) AS BIGINT) AS VARCHAR(20))) AS AGGuid,
               DATE '1999-01-01' AS DiscoveryOn,
               DATE '2001-10-15' - CAST(CAST(floor(c_custkey / 50) AS BIGINT) * 7 % 100 AS INT) AS LastUpdated
        FROM customer WHERE c_acctbal < 0""",
    "ag_instances": """
        SELECT c_custkey AS AGInstanceID, CAST(floor(c_custkey / 50) AS BIGINT) AS AGID, c_custkey AS SQLInstanceID,
               CASE WHEN c_nationkey < 12 THEN 'PRIMARY' ELSE 'SECONDARY' END AS ReplicaRole,
               DATE '1999-01-01' AS DiscoveryOn, DATE '2001-10-01' AS LastUpdated
        FROM customer WHERE c_acctbal < 0""",
    "ag_databases": f"""
        SELECT c_custkey AS AGInstanceID, p_partkey AS DatabaseID,
               DATE '1999-01-01' AS DiscoveryOn, DATE '2001-10-01' AS LastUpdated
        FROM (SELECT p_partkey, p_type, {_PART_CUSTOMER} AS inst FROM part) p
        JOIN customer ON c_custkey = inst
        WHERE c_acctbal < 0 AND p_type <> 'PROMO'""",
    # ---- security -------------------------------------------------------------
    "server_principals": f"""
        SELECT c_custkey + 10 AS PrincipalID, {_LOGIN_NAME} AS PrincipalName, {_LOGIN_TYPE} AS PrincipalType
        FROM customer
        UNION ALL
        SELECT DISTINCT {_ROLE_ID}, o_orderpriority, 'SERVER_ROLE' FROM orders""",
    "server_principal_membership": f"""
        SELECT o_orderkey AS MembershipID, {_ORDER_CUSTOMER} AS SQLInstanceID, {_ROLE_ID} AS ServerRoleID,
               o_custkey + 10 AS ServerLoginID, (o_orderstatus = 'F') AS IsArchived,
               DATE '1995-01-01' AS DiscoveryOn, CAST(o_orderdate AS DATE) AS LastUpdated
        FROM orders""",
    "server_permission": f"""
        SELECT o_orderkey AS PermissionID, {_ORDER_CUSTOMER} AS SQLInstanceID, o_custkey + 10 AS GranteeID,
               o_custkey % 10 + 10 AS GrantorID, 'SERVER' AS ObjectType, {_ROLE_ID} AS ObjectID,
               {_ACCESS} AS Access, {_PERMISSION} AS PermissionName, (o_orderstatus = 'F') AS IsArchived,
               DATE '1995-01-01' AS DiscoveryOn, CAST(o_orderdate AS DATE) AS LastUpdated
        FROM orders""",
    "database_principals": f"""
        SELECT c_custkey + 10 AS PrincipalID, {_USER_NAME} AS PrincipalName, {_USER_TYPE} AS PrincipalType
        FROM customer
        UNION ALL
        SELECT DISTINCT {_ROLE_ID}, o_orderpriority, 'DATABASE_ROLE' FROM orders""",
    "database_principal_membership": f"""
        SELECT o_orderkey AS MembershipID, {_ORDER_PART} AS DatabaseID, {_ROLE_ID} AS DatabaseRoleID,
               o_custkey + 10 AS DatabaseUserID, (o_orderkey % 9 = 0) AS IsOrphaned,
               (o_orderstatus = 'F') AS IsArchived, DATE '1995-01-01' AS DiscoveryOn,
               CAST(o_orderdate AS DATE) AS LastUpdated
        FROM orders""",
    "database_permission": f"""
        SELECT o_orderkey AS PermissionID, {_ORDER_PART} AS DatabaseID, o_custkey + 10 AS GranteeID,
               o_custkey % 10 + 10 AS GrantorID, 'OBJECT_OR_COLUMN' AS ObjectType, o_orderpriority AS ObjectName,
               {_ACCESS} AS Access, {_PERMISSION} AS PermissionName, (o_orderstatus = 'F') AS IsArchived,
               DATE '1995-01-01' AS DiscoveryOn, CAST(o_orderdate AS DATE) AS LastUpdated
        FROM orders""",
    # ---- group registry -------------------------------------------------------
    "server_groups": """
        SELECT 0 AS server_group_id, CAST(NULL AS INT) AS parent_id, 'Root' AS name
        UNION ALL SELECT r_regionkey + 1, 0, r_name FROM region
        UNION ALL SELECT n_nationkey + 100, n_regionkey + 1, n_name FROM nation""",
    "groups_to_monitor": """
        SELECT n_nationkey + 100 AS GroupID, (n_nationkey % 2 = 0) AS IsMonitored FROM nation""",
    "registered_servers": """
        SELECT c_custkey AS RowID, CAST(c_nationkey + 100 AS INT) AS server_group_id,
               concat('HOST', CAST(c_custkey AS VARCHAR(20)),
                      CASE WHEN c_custkey % 2 = 0 THEN '.corp.local' ELSE '' END,
                      CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat(chr(92), 'INST', CAST(c_custkey % 4 AS VARCHAR(5))) END,
                      CASE WHEN c_custkey % 5 = 0 THEN ',1433' ELSE '' END) AS ServerInstance
        FROM customer""",
    # ---- policy results -------------------------------------------------------
    "policies": """
        SELECT DISTINCT event_type AS PolicyName, CAST(length(event_type) * 10 + ascii(event_type) % 10 AS INT) AS policy_id,
               concat('Short ', substring(event_type, 1, 1)) AS Policy_ShortName,
               CASE WHEN event_type IN ('click', 'view') THEN 'Maintenance' ELSE 'Security' END AS CategoryName,
               concat('Checks ', event_type) AS description,
               CASE WHEN event_type = 'view' THEN '' ELSE concat('Help for ', event_type) END AS help_text
        FROM events""",
    "policy_exclusions": """
        SELECT DISTINCT CAST(length(event_type) * 10 + ascii(event_type) % 10 AS INT) AS Policy_ID,
               'SRV1%' AS EvaluatedServer, 'Server/%' AS ObjectName
        FROM events WHERE event_type IN ('click', 'error')""",
    # Prefixed and plain names, one to three details, repeats, CDATA (with tags in it), comments, a processing instruction, quoted signs, self-closing and absent elements.
    "policy_history": """
        SELECT PolicyHistoryID, EvaluatedServer, EvaluationDateTime, EvaluatedPolicy,
               CASE WHEN value < 10 THEN concat('<', p, 'R', ns, '><!-- <EvaluationDetail/> --><', p, 'ServerInstance>', EvaluatedServer, '</', p, 'ServerInstance>', result, fault, '</', p, 'R>')
                    ELSE concat('<?note <EvaluationDetail/> ?><', p, 'R', ns, '>', detail, CASE WHEN PolicyHistoryID % 5 = 0 THEN concat('<![CDATA[', object, ']]>') ELSE object END, named, result, fault,
                                '<!-- <', p, 'Exception>none</', p, 'Exception> --><', p, 'ResultDetail>', CASE WHEN PolicyHistoryID % 7 = 0 THEN concat('<![CDATA[<a b="1">x</', p, 'EvaluationDetail>]]>') ELSE '' END, EvaluatedPolicy, '</', p, 'ResultDetail></', p, 'EvaluationDetail>',
                                CASE PolicyHistoryID % 4 WHEN 1 THEN concat(detail, object, '&#47;db', named, '<', p, 'Result>FALSE</', p, 'Result></', p, 'EvaluationDetail>')
                                                         WHEN 2 THEN concat(detail, object, named, '<', p, 'Result>FALSE</', p, 'Result><', p, 'Exception>late</', p, 'Exception></', p, 'EvaluationDetail>')
                                                         ELSE '' END, '</', p, 'R>') END AS EvaluationResults
        FROM (
            SELECT *, concat('<', p, 'EvaluationDetail', CASE WHEN PolicyHistoryID % 11 = 0 THEN ' note="a > b"' ELSE '' END, '><', p, 'ServerInstance>', EvaluatedServer, '</', p, 'ServerInstance><', p, 'TargetQueryExpression>') AS detail,
                   concat('</', p, 'TargetQueryExpression>') AS named, CASE WHEN p = '' THEN '' ELSE ' xmlns:p="urn:x"' END AS ns,
                   concat('<', p, 'Result>', CASE WHEN PolicyHistoryID % 3 = 0 THEN 'FALSE' ELSE 'TRUE' END, '</', p, 'Result>') AS result,
                   CASE PolicyHistoryID % 6 WHEN 0 THEN concat('<', p, 'Exception>timeout</', p, 'Exception>') WHEN 3 THEN concat('<', p, 'Exception/>')
                                            ELSE concat('<', p, 'Exception></', p, 'Exception>') END AS fault
            FROM (SELECT event_id AS PolicyHistoryID, concat('srv', CAST(user_id AS VARCHAR(20))) AS EvaluatedServer, ts AS EvaluationDateTime, event_type AS EvaluatedPolicy, value,
                         concat('Server/', CAST(user_id AS VARCHAR(20))) AS object, CASE WHEN event_id % 2 = 0 THEN 'p:' ELSE '' END AS p FROM events) e) d""",
    # ---- raw feeds ------------------------------------------------------------
    "job_history_raw": """
        SELECT event_id AS instance_id, user_id AS job_id, CAST(event_id % 2 AS INT) AS step_id,
               CAST(event_id % 6 AS INT) AS run_status, ts AS run_ts,
               CAST(event_id % 3 * 1000000 + event_id % 24 * 10000 + event_id % 60 * 100 + event_id % 59 AS INT) AS run_duration
        FROM events""",
    "jobs_raw": """
        SELECT DISTINCT user_id AS job_id, user_id % 50 AS SQLInstanceID, CAST(user_id % 4 AS INT) AS category_id,
               CASE WHEN user_id % 7 = 0 THEN concat('syspolicy_', CAST(user_id AS VARCHAR(20)))
                    ELSE concat('job_', CAST(user_id AS VARCHAR(20))) END AS name
        FROM events""",
    "job_categories_raw": """
        SELECT DISTINCT CAST(user_id % 4 AS INT) AS category_id,
               concat('Category ', CAST(user_id % 4 AS VARCHAR(5))) AS name FROM events""",
    "file_feed": """
        SELECT l_partkey AS DatabaseID, l_orderkey AS FileID, l_linenumber % 2 AS FileTypeCode,
               CAST(floor(l_extendedprice) AS BIGINT) AS SizePages,
               concat('D:', chr(92), 'Data', chr(92), l_returnflag, chr(92), 'F', CAST(l_orderkey AS VARCHAR(20)), '.mdf') AS PhysicalName
        FROM lineitem""",
    "backup_feed": """
        SELECT o_orderkey AS BackupID,
               CASE WHEN o_orderstatus = 'P' THEN 'nul:'
                    ELSE concat('E:', chr(92), 'Backup', chr(92), o_orderpriority, chr(92), 'B', CAST(o_orderkey AS VARCHAR(20)), '.bak') END AS PhysicalDeviceName
        FROM orders""",
    "database_apps_raw": """
        SELECT p_partkey AS DatabaseID, p_brand AS ApplicationName, concat('Team ', p_brand) AS ApplicationOwner
        FROM part WHERE p_type <> 'SMALL'""",
    "build_feed": """
        SELECT p_partkey AS SQLInstanceID,
               concat(CAST(8 + p_partkey % 9 AS VARCHAR(5)), '.', CAST(p_size % 2 * 50 AS VARCHAR(5)), '.',
                      CAST(p_partkey % 6000 AS VARCHAR(10)), '.0') AS ProductVersion,
               CASE p_partkey % 4 WHEN 0 THEN 'Microsoft Windows Server 2012 R2 Standard'
                    WHEN 1 THEN 'Microsoft Windows Server 2019 Datacenter'
                    WHEN 2 THEN 'Microsoft Windows 10 Pro' ELSE 'Other' END AS OSCaption
        FROM part""",
    "processor_feed": """
        SELECT s_suppkey AS ServerID, 'CPU A' AS Name, CAST(s_suppkey % 8 AS INT) AS NumberOfCores,
               CAST(s_suppkey % 8 * 2 AS INT) AS NumberOfLogicalProcessors FROM supplier
        UNION ALL
        SELECT s_suppkey, 'CPU B', 4, 8 FROM supplier WHERE s_acctbal > 0""",
    "memory_feed": """
        SELECT s_suppkey AS ServerID, s_suppkey % 64 * 1073741824 AS TotalPhysicalMemory FROM supplier""",
    "pagefile_feed": """
        SELECT s_suppkey AS ServerID, CAST(512 AS BIGINT) AS AllocatedBaseSize FROM supplier
        UNION ALL
        SELECT s_suppkey, CAST(1024 AS BIGINT) FROM supplier WHERE s_acctbal > 0""",
    "service_feed": """
        SELECT s_suppkey AS ServerID, s_name AS ServerName, s.n AS ServiceName, concat('SQL ', s.n) AS DisplayName,
               concat('C:', chr(92), s.n, '.exe') AS FilePath,
               CASE s_suppkey % 3 WHEN 0 THEN 'Running' WHEN 1 THEN 'Stopped' END AS Status,
               CASE s_suppkey % 2 WHEN 0 THEN 'Auto' ELSE 'Manual' END AS StartMode,
               concat('svc', CAST(s_suppkey % 5 AS VARCHAR(5))) AS ServiceAccount
        FROM supplier, (SELECT unnest([
            'MSSQLServer', 'MSSQL$INST1', 'SQLServerAgent', 'SQLAgent$INST1', 'MSSQLServerOLAPService',
            'ReportServer', 'ReportServer$INST1', 'MsDtsServer150', 'MSSQLFDLauncher', 'SQLWriter']) AS n) s""",
    "property_feed": f"""
        SELECT c_custkey AS SQLInstanceID, k.n AS PropertyName,
               CASE k.n WHEN 'EnvironmentType' THEN {_ENV}
                    WHEN 'MachineType' THEN CASE WHEN c_custkey % 2 = 0 THEN 'Physical' ELSE 'Virtual' END
                    ELSE concat(lower(k.n), CAST(c_custkey % 7 AS VARCHAR(5)), CASE WHEN c_custkey % 3 = 0 THEN '.corp.local' ELSE '' END) END AS PropertyValue
        FROM customer, (SELECT unnest([
            'EnvironmentType', 'MachineType', 'ServerType', 'ActiveNode', 'PassiveNode', 'PassiveNode02', 'CostCenter']) AS n) k""",
    "replica_feed": f"""
        SELECT c_custkey AS ReplicaID, concat('guid-', CAST(CAST(floor(c_custkey / 50) AS BIGINT) AS VARCHAR(20))) AS AGGuid,
               concat('ag', CAST(CAST(floor(c_custkey / 50) AS BIGINT) AS VARCHAR(20))) AS AGName, {_HOST} AS ReplicaServerName
        FROM customer WHERE c_acctbal < 0""",
    "replica_states": """
        SELECT c_custkey AS ReplicaID, CASE WHEN c_nationkey < 12 THEN 'PRIMARY' ELSE 'SECONDARY' END AS RoleDesc
        FROM customer WHERE c_acctbal < 0 AND c_mktsegment <> 'BUILDING'""",
    "login_feed": f"""
        SELECT c_nationkey AS SQLInstanceID, c_custkey AS principal_id, {_LOGIN_NAME} AS name,
               'S' AS type, {_LOGIN_TYPE} AS type_desc, c_custkey AS sid FROM customer
        UNION ALL
        SELECT n_nationkey, CAST(-1 - n_nationkey AS BIGINT), concat('role_', n_name), 'R', 'SERVER_ROLE', CAST(NULL AS BIGINT)
        FROM nation""",
    "login_role_members": """
        SELECT DISTINCT c_nationkey AS SQLInstanceID, CAST(-1 - c_nationkey AS BIGINT) AS role_principal_id,
               o_custkey AS member_principal_id
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "login_grants": f"""
        SELECT c_nationkey AS SQLInstanceID, o_custkey AS grantee_principal_id, CAST(-1 - c_nationkey AS BIGINT) AS grantor_principal_id,
               'SERVER' AS class_desc, o_orderkey AS major_id, {_ACCESS} AS state_desc, {_PERMISSION} AS permission_name
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "user_feed": f"""
        SELECT c_nationkey AS SQLInstanceID, concat('db_', CAST(c_nationkey AS VARCHAR(20))) AS DatabaseName, c_custkey AS principal_id,
               {_USER_NAME} AS name, 'S' AS type, {_USER_TYPE} AS type_desc, c_custkey AS sid FROM customer
        UNION ALL
        SELECT n_nationkey, concat('db_', CAST(n_nationkey AS VARCHAR(20))), CAST(-1 - n_nationkey AS BIGINT),
               concat('role_', n_name), 'R', 'DATABASE_ROLE', CAST(NULL AS BIGINT) FROM nation""",
    "user_role_members": """
        SELECT DISTINCT c_nationkey AS SQLInstanceID, concat('db_', CAST(c_nationkey AS VARCHAR(20))) AS DatabaseName,
               CAST(-1 - c_nationkey AS BIGINT) AS role_principal_id, o_custkey AS member_principal_id
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "user_grants": f"""
        SELECT c_nationkey AS SQLInstanceID, concat('db_', CAST(c_nationkey AS VARCHAR(20))) AS DatabaseName,
               o_custkey AS grantee_principal_id, CAST(-1 - c_nationkey AS BIGINT) AS grantor_principal_id,
               'OBJECT_OR_COLUMN' AS class_desc, o_orderkey AS major_id, {_ACCESS} AS state_desc, {_PERMISSION} AS permission_name
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "object_feed": """
        SELECT n_nationkey AS SQLInstanceID, concat('db_', CAST(n_nationkey AS VARCHAR(20))) AS DatabaseName,
               o_orderkey AS object_id, concat('obj', CAST(o_orderkey AS VARCHAR(20))) AS name
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey
        WHERE o_orderstatus <> 'P'""",
    "database_replica_states": """
        SELECT n_nationkey AS SQLInstanceID, concat('db_', CAST(n_nationkey AS VARCHAR(20)), '_copy') AS DatabaseName,
               CASE WHEN n_regionkey = 0 THEN 'PRIMARY' ELSE 'SECONDARY' END AS RoleDesc FROM nation
        UNION ALL
        SELECT n_nationkey, concat('db_', CAST(n_nationkey AS VARCHAR(20))), 'SECONDARY' FROM nation""",
    # ---- staged batches for the upserts --------------------------------------
    "application_feed": """
        SELECT p_brand AS ApplicationName, concat('Owner ', p_brand) AS ApplicationOwner FROM part
        UNION ALL
        SELECT concat('New ', p_type), 'New owner' FROM part""",
    "staged_databases": f"""
        SELECT {_PART_CUSTOMER} AS SQLInstanceID, concat('guid-', CAST(CAST(floor({_PART_CUSTOMER} / 50) AS BIGINT) AS VARCHAR(20))) AS AGGuid,
               p_brand AS ApplicationName,
               concat(CASE WHEN p_type = 'PROMO' THEN 'new_' ELSE 'db_' END, CAST(p_partkey AS VARCHAR(20))) AS DatabaseName,
               CASE WHEN p_size > 45 THEN 'RESTORING' ELSE 'ONLINE' END AS DatabaseState,
               f.t AS FileType, CAST(p_size * 100 + length(f.t) AS BIGINT) AS FileSize_mb
        FROM part, (SELECT unnest(['Data', 'Log']) AS t) f""",
    "staged_jobs": """
        SELECT user_id AS SQLInstanceID, event_type AS JobName,
               CASE WHEN value > 400 THEN 'Nightly' ELSE event_type END AS CategoryName, ts AS ExecutionDateTime,
               CAST(floor(value) AS INT) AS Duration, 'Successful' AS JobStatus
        FROM events""",
    "staged_server_membership": f"""
        SELECT {_ORDER_CUSTOMER} AS SQLInstanceID, o_orderpriority AS RoleName,
               concat('login', CAST(o_custkey AS VARCHAR(20))) AS LoginName,
               CASE WHEN o_totalprice > 250000 THEN 'SQL_LOGIN' ELSE 'WINDOWS_LOGIN' END AS LoginType
        FROM orders""",
    "staged_database_membership": f"""
        SELECT {_ORDER_PART} AS DatabaseID, o_orderpriority AS RoleName,
               concat('user', CAST(o_custkey AS VARCHAR(20))) AS UserName,
               CASE WHEN o_totalprice > 250000 THEN 'SQL_USER' ELSE 'WINDOWS_USER' END AS UserType,
               (o_totalprice > 400000) AS IsOrphaned
        FROM orders""",
    "staged_server_permission": f"""
        SELECT {_ORDER_CUSTOMER} AS SQLInstanceID, o_custkey + 10 AS GranteeID, o_custkey % 10 + 10 AS GrantorID,
               'SERVER' AS ObjectType, {_ROLE_ID} AS ObjectID, 'GRANT' AS Access, {_PERMISSION} AS PermissionName
        FROM orders""",
    "staged_database_permission": f"""
        SELECT {_ORDER_PART} AS DatabaseID, o_custkey + 10 AS GranteeID, o_custkey % 10 + 10 AS GrantorID,
               'OBJECT_OR_COLUMN' AS ObjectType, o_orderpriority AS ObjectName, 'GRANT' AS Access, {_PERMISSION} AS PermissionName
        FROM orders""",
    "staged_servers": """
        SELECT concat(s_name, CASE WHEN s_acctbal < 0 THEN '-new' ELSE '' END) AS ServerName,
               CASE WHEN s_acctbal > 9000 THEN 'Windows Server 2031' ELSE concat('Windows Server ', CAST(2000 + s_nationkey AS VARCHAR(10))) END AS OperatingSystemName,
               CAST(s_nationkey AS INT) AS NumberOfCores, CAST(2048 AS BIGINT) AS Memory_mb
        FROM supplier""",
    "volume_feed": """
        SELECT s_suppkey AS ServerID,
               CAST(CASE WHEN s_acctbal < 1000 THEN s_suppkey % 5 ELSE 0 END AS INT) AS SQLClusterID,
               CASE WHEN v.k = 0 THEN 'C:' ELSE concat('v', CAST(s_suppkey + v.k - 1 AS VARCHAR(20)), ':', chr(92)) END AS Name,
               CAST(1000000 + s_suppkey AS BIGINT) * 1048576 AS Capacity,
               CAST(500000 + s_suppkey * v.k AS BIGINT) * 1048576 AS FreeSpace
        FROM supplier, (SELECT unnest([0, 1, 2]) AS k) v""",
    "cluster_folder_feed": """
        SELECT CAST(s_suppkey % 5 AS INT) AS SQLClusterID,
               concat('V', CAST(s_suppkey + 1 AS VARCHAR(20)), ':', chr(92), 'Data') AS FolderName
        FROM supplier WHERE s_acctbal < 1000""",
    # ---- published monthly trends --------------------------------------------
    "trending_servers": """
        SELECT CAST(200000 + 1 + o_orderkey % 12 AS INT) AS YearMonth, CAST(o_custkey % 26 + 1 AS INT) AS OperatingSystemID,
               CAST(count(*) AS INT) AS ServerCount
        FROM orders GROUP BY 1, 2""",
    "trending_instances": """
        SELECT CAST(200000 + 1 + o_orderkey % 12 AS INT) AS YearMonth, CAST(o_custkey % 25 + 1 AS INT) AS ServerVersionID,
               o_orderstatus AS Environment, CAST(count(*) AS INT) AS InstanceCount
        FROM orders GROUP BY 1, 2, 3""",
    "trending_databases": """
        SELECT CAST(200000 + 1 + o_orderkey % 12 AS INT) AS YearMonth, CAST(o_custkey % 25 + 1 AS INT) AS SQLVersionID,
               o_orderstatus AS Environment, CAST(count(*) AS INT) AS DatabaseCount,
               CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS DatabaseTotalSize
        FROM orders GROUP BY 1, 2, 3""",
}

# A literal list crossed with every row; Spark generates it in place, without a join.
_EACH = re.compile(r", \(SELECT unnest\(\[(.*?)\]\) AS (\w+)\) (\w+)", re.S)
_RAW_REF = re.compile(r"\b(FROM|JOIN)\s+(" + "|".join(RAW_TABLES) + r")\b")


def spark_sql(name: str) -> str:
    """The Spark form of one statement."""
    return _EACH.sub(r" LATERAL VIEW explode(array(\1)) \3 AS \2", FLEET_SQL[name])


class Fleet:
    """Lazy access to raw and derived tables of one scale-factor directory.

    ``fleet.servers`` returns the DataFrame; nothing is read until an action.
    Names that ``FLEET_SQL`` does not know are read as raw parquet tables.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._raw: dict[str, DataFrame] = {}
        self._derived: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))
        return self._raw[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in FLEET_SQL:
            raise AttributeError(name)
        if name not in self._derived:
            template = _RAW_REF.sub(r"\1 {\2}", spark_sql(name))
            used = {t: self.raw(t) for t in RAW_TABLES if "{" + t + "}" in template}
            self._derived[name] = self.spark.sql(template, **used)
        return self._derived[name]

    def __getitem__(self, name: str) -> DataFrame:
        try:
            return getattr(self, name)
        except AttributeError as exc:
            raise KeyError(name) from exc
