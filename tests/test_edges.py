"""Hand-made rows for the decisions that driver tables do not reach."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import columns as C
from fleetlens.functions.windows import hour_slice, sliced_lag
from fleetlens.operators import feeds, licence, lifecycle, merges, policy, rollup, upsert, views
from fleetlens.plans import reports, snapshot
from fleetlens.sources import seeds, tables

D = dt.date
TS = dt.datetime
NTZ = "timestamp_ntz"

SERVERS = "ServerID bigint, ServerName string, NumberOfCores int, IsPhysical boolean, LastUpdated date"
INSTANCES = (
    "SQLInstanceID bigint, ServerID bigint, SQLClusterID int, SQLInstanceName string, SQLInstanceVersionID int, SQLInstanceBuild string, "
    "SQLInstanceEdition string, SQLInstanceType string, SQLInstanceEnviornment string, IsMonitored boolean, DiscoveryOn date, LastUpdated date")
VERSIONS = "SQLVersionID int, SQLVersion string, SQLMajorVersion int, SQLMinorVersion int, SQLBuild int"


def inst(i, server, cluster, name, edition="Standard Edition (64-bit)", kind="Stand Alone", env="Prod"):
    return (i, server, cluster, name, 2, "1.0", edition, kind, env, True, D(1999, 1, 1), D(2001, 10, 15))


@pytest.fixture(scope="module")
def dims(make):
    servers = make([(1, "S1", 8, True, D(2001, 10, 15)), (2, "S2", 8, True, D(2001, 10, 15))], SERVERS)
    clusters = make([(1, "C1")], "SQLClusterID int, SQLClusterName string")
    versions = make([(2, "Microsoft SQL Server X RTM", 15, 0, 1000)], VERSIONS)
    return servers, clusters, versions


def test_owner_resolution(make, dims, rows):
    servers, clusters, versions = dims
    data = [inst(1, 1, None, "mssqlserver"), inst(2, None, 1, "I2"), inst(3, None, None, "I3"), inst(4, 1, 1, "I4")]
    out = views.instance_view(make(data, INSTANCES), versions, servers, clusters)
    assert rows(out, "SQLInstanceID", "ServerInstance") == [(1, "S1"), (2, "C1\\I2"), (3, None), (4, None)]


def test_case_and_padding(make):
    df = make([("Online", "ONLINE"), ("Log ", "Log")], "a string, b string").select(C.ci_eq("a", F.col("b")).alias("eq"))
    assert [r.eq for r in df.collect()] == [True, True]
    assert tables.conform(make([(1, "Log ", None)], "DatabaseID bigint, FileType string, FileSize_mb bigint"), "database_size").first().FileType == "Log"


def test_like_with_backslash_and_set(make):
    df = make([("HOST\\INST", "host\\in%"), ("a~b", "a~_"), ("cat", "[bc]at"), ("rat", "[bc]at"), ("a.c", "a.c"), ("abc", "a.c")], "t string, p string")
    assert [r.m for r in df.select(C.like_ci("t", F.col("p")).alias("m")).collect()] == [True, True, True, False, True, False]


def test_mount_points_are_hidden(make):
    df = make([("\\\\?\\vol",), ("d:",)], "DiskVolumeName string").filter(reports._visible())
    assert [r.DiskVolumeName for r in df.collect()] == ["d:"]


def test_volume_forecast_edges(make, dims):
    servers, clusters, _ = dims
    vol = "DiskVolumeID bigint, DiskVolumeName string, ServerID bigint, SQLClusterID int, IsMonitored boolean"
    volumes = make([(1, "one", 1, None, True), (2, "shrink", 1, None, True), (3, "flat", None, 1, True), (4, "off", 1, None, False)], vol)
    space = make(
        [(1, D(2001, 1, 1), 100, 200), (2, D(2001, 1, 1), 100, 200), (2, D(2001, 1, 11), 50, 200),
         (3, D(2001, 1, 1), 100, 200), (3, D(2001, 1, 10), 100, 200), (4, D(2001, 1, 1), 1, 2)],
        "DiskVolumeID bigint, DateCaptured date, SpaceUsed_mb bigint, TotalSpace_mb bigint")
    out = {r.DiskVolumeID: r for r in views.volume_forecast(space, volumes, servers, clusters).collect()}
    assert set(out) == {1, 2, 3}
    assert out[1].Daily_AvgChange_mb == 1.0 and out[1].DaysUntil_OutOfSpace == 100.0 and out[1].DaysHistory == 1
    assert out[2].DaysUntil_OutOfSpace == 99999.0
    assert out[3].ComputerName == "C1" and out[3].Daily_AvgChange_mb == pytest.approx(0.1)
    assert out[1].SpaceUsed_Percent == "50.25 %"


def test_group_path_is_cut(make, rows):
    groups = make([(0, None, "Root"), (1, 0, "x" * 100)], "server_group_id int, parent_id int, name string")
    assert [len(p) for _, p in rows(views.group_paths(groups), "GroupID", "GroupName")] == [4, 75]


def test_growth_zero_first_gap(make):
    df = make([(1, D(2001, 1, 1), 100), (1, D(2001, 1, 5), 0), (1, D(2001, 1, 6), 30), (1, D(2001, 1, 7), 20)], "k int, d date, s bigint")
    out = [r.GrowthInPercent for r in rollup.growth_percent(df, ["k"], "d", "s").orderBy("d").collect()]
    assert out == [None, None, 1.0, -0.5]


def test_integer_average(make):
    assert make([(3,), (4,)], "v bigint").agg(C.avg_big("v").alias("a")).first().a == 3


def test_size_bands(make):
    df = make([(50.0,), (50.1,), (25.0,), (5.0,), (5.1,)], "g double")
    assert [r.b for r in df.select(rollup.size_change_band(F.col("g")).alias("b")).collect()] == [
        "25GB to 50GB Change", "50GB+ Change", "15GB to 25GB Change", "Less Than 5GB Change", "5GB to 10GB Change"]


def test_version_family(make):
    df = make([("Microsoft SQL Server 2016 Service Pack 1",), ("Microsoft SQL Server 2017 RTM",), ("Unknown",), ("Other",)], "v string")
    assert [r.f for r in df.select(C.version_family("v").alias("f")).collect()] == ["SQL Server 2016 ", "SQL Server 2017 ", "Unknown", ""]


# ---- licences ----------------------------------------------------------------------

def _licences(make, servers, nodes, instances, ag):
    _, clusters, versions = None, make([(1, "C1"), (2, "C2")], "SQLClusterID int, SQLClusterName string"), make(
        [(2, "Microsoft SQL Server X RTM", 15, 0, 1000)], VERSIONS)
    s = make(servers, SERVERS)
    iv = views.instance_view(make(instances, INSTANCES), versions, s, clusters)
    out = licence.license_details(
        s, clusters, make(nodes, "SQLClusterID int, SQLNodeID bigint"), iv, make(ag, "AGID bigint, SQLInstanceID bigint"), "2001-10-15")
    return {(r.ServerName, r.SQLClusterName): r for r in out.collect()}


def test_licence_core_factor(make):
    servers = [(i, f"S{i}", i, True, D(2001, 10, 1)) for i in range(6)] + [(9, "OLD", 4, True, D(2001, 1, 1))]
    out = _licences(make, servers, [], [inst(i, i, None, "mssqlserver") for i in range(6)], [])
    cores = {k[0]: (r.NumberOfCores, r.CoreFactor, r.LicenseCores, r.AssumedCPUInfo) for k, r in out.items()}
    assert cores == {"S0": (4, 1, 4, 1), "S1": (1, 4, 4, 0), "S2": (2, 2, 4, 0), "S3": (3, 1, 3, 0), "S4": (4, 1, 4, 0), "S5": (5, 1, 5, 0)}


def test_licence_roles(make):
    servers = [(1, "A", 8, True, D(2001, 10, 1)), (2, "B", 8, True, D(2001, 10, 1)), (3, "E", 8, True, D(2001, 10, 1))]
    nodes = [(1, 1), (1, 2), (2, 1)]
    data = [inst(1, None, 1, "I1", kind="Microsoft Clustering"), inst(3, 3, None, "I3", "Express Edition (64-bit)")]
    out = _licences(make, servers, nodes, data, [])
    assert out[("A", "C1")].ServerRole == "Active" and out[("B", "C1")].ServerRole == "Passive" and out[("B", "C1")].LicenseCores == 0
    assert ("A", "C2") not in out  # C2 is no node's first cluster
    assert out[("E", None)].LicenseCores == 0


def test_licence_two_groups_on_one_host(make):
    servers = [(1, "A", 8, True, D(2001, 10, 1)), (2, "B", 8, True, D(2001, 10, 1))]
    data = [inst(1, 1, None, "I1", kind="Group"), inst(2, 2, None, "I2", kind="Group"), inst(3, 2, None, "I3", kind="Group")]
    out = _licences(make, servers, [], data, [(10, 1), (10, 2), (11, 3)])
    # B is second in group 10 but first in group 11: the lowest row number decides.
    assert out[("B", None)].ServerRole == "Active"


def test_licence_overview_levels(fleet):
    out = licence.license_overview(reports.report_licences(fleet, as_of="2001-10-15")).collect()
    total = [r for r in out if r.SubtotalLevel == 15]
    assert len(total) == 1 and total[0].LicenseCores == sum(r.LicenseCores for r in out if r.SubtotalLevel == 0)


# ---- staleness and retention ----------------------------------------------------------

def test_staleness_label_and_filter(make):
    df = make([(d,) for d in (29, 30, 31, 59, 60, 89, 90)], "d int")
    assert [r.b for r in df.select(lifecycle.staleness_label(F.col("d")).alias("b")).collect()] == [4, 4, 3, 3, 2, 2, 1]
    kept = {k: [r.d for r in df.filter(lifecycle.staleness_filter(F.col("d"), k)).collect()] for k in (1, 2, 3, 4)}
    assert kept == {1: [90], 2: [60, 89], 3: [30, 31, 59], 4: [29]}
    assert lifecycle.staleness_filter(F.col("d"), -1) is None


def test_parameter_lists(spark):
    assert lifecycle.expired_kind_list(spark).count() == 7
    assert lifecycle.expired_bucket_list(spark).count() == 5


def test_purge_boundaries(make):
    days = make([(D(2001, 8, 31),), (D(2001, 9, 1),), (None,)], "DateCaptured date")
    assert [r[0] for r in lifecycle.purge_raw(days, "2001-10-15", 45).collect()] == [D(2001, 9, 1), None]
    events = make([(TS(2001, 7, 15),), (TS(2001, 7, 15, 0, 0, 1),)], f"DateTime {NTZ}")
    assert lifecycle.purge_error_log(events, "2001-10-15", 3).count() == 1
    assert lifecycle.purge_error_log(events, "2001-10-15", 3, unit="days").count() == 0
    months = make([(199609,), (199610,)], "YearMonth int")
    assert [r[0] for r in lifecycle.purge_months(months, "2001-10-15").collect()] == [199610]


def test_run_log_purge_marker(make):
    schema = f"LogID bigint, DateTimeCaptured {NTZ}, Description string"
    log = [(1, TS(2001, 1, 1, 5), "x"), (2, TS(2001, 1, 2, 5), "Job - Collection End"), (3, TS(2001, 1, 3), "x")]
    kept = lifecycle.purge_run_log(make(log, schema), "2001-10-15", 180)
    assert sorted(r.LogID for r in kept.collect()) == [2, 3]  # up to midnight of the marker's day
    assert lifecycle.purge_run_log(make(log[:1], schema), "2001-10-15", 180).count() == 1


def test_disabled_rule_keeps_all(make):
    df = make([(D(1990, 1, 1),)], "DateCaptured date")
    assert lifecycle.apply_retention("raw_data", df, {"RawData_CleanUp_Enabled": "0"}, "2001-10-15").count() == 1
    assert lifecycle.apply_retention("raw_data", df, seeds.SETTINGS, "2001-10-15").count() == 0


# ---- feeds ---------------------------------------------------------------------------

def test_split_names(make, rows):
    df = make([("Host.Corp.Local\\Inst,1433",), ("HOST,99",), ("host",)], "ServerInstance string")
    out = rows(feeds.split_instance_name(df), "ComputerName", "DomainName", "SQLInstanceName", "Port")
    assert out == [("host", "", "mssqlserver", 0), ("host", "", "mssqlserver", 99), ("host", "corp.local", "inst", 1433)]


def test_error_pairing(make, rows):
    head = "Error: {}, Severity: 16, State: 1."
    texts = [head.format(1), head.format(17187), "Process ID 5 was killed by hostname X", head.format(2), head.format(3)]
    df = make([(1, i, TS(2024, 1, 1, 0, 0, i), t) for i, t in enumerate(texts)], f"SQLInstanceID bigint, LineNo bigint, LogDate {NTZ}, Text string")
    got = rows(feeds.extract_errors(df), "DateTimeCaptured", "Message")
    assert got == [
        (TS(2024, 1, 1, 0, 0, 1), texts[0] + " | " + texts[1]), (TS(2024, 1, 1, 0, 0, 2), texts[2]),
        (TS(2024, 1, 1, 0, 0, 4), texts[3] + " | " + texts[4])]


def test_sliced_lag_equals_plain_lag(spark):
    from pyspark.sql import Window

    base = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    df = spark.range(3000).select(
        # key 0 owns a third of all rows
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7 + 1).alias("k"), "id",
        (base + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") * 7919 % 20011).cast("int"))).alias("ts"))
    sliced = sliced_lag(df, ["k"], ["ts", "id"], hour_slice(F.col("ts")), {"prev": F.when(F.col("id") % 5 > 0, F.col("id"))})
    w = Window.partitionBy("k").orderBy("ts", "id")
    plain = df.withColumn("prev", F.lag(F.when(F.col("id") % 5 > 0, F.col("id"))).over(w))
    assert sliced.exceptAll(plain).count() == 0 and plain.exceptAll(sliced).count() == 0


def test_durations(make):
    df = make([(5,), (130,), (10203,), (1020304,)], "d int")
    assert [r.s for r in df.select(feeds.duration_seconds(F.col("d")).alias("s")).collect()] == [5, 90, 3723, 86400 + 2 * 3600 + 3 * 60 + 4]


def test_service_rules(make, rows):
    names = ["MSOLAP$X", "MSOLAP$", "ReportServer$R1", "MSSQLServerADHelper100", "PowerBIReportServer", "MSSQL$A"]
    df = make([(n, "SQL " + n) for n in names] + [("Spooler", "Print")], "ServiceName string, DisplayName string")
    assert rows(feeds.classify_services(df), "ServiceName", "ServiceType", "InstanceName") == [
        ("MSOLAP$", "SSAS", ""), ("MSSQL$A", "Engine", "A"), ("PowerBIReportServer", "PowerBI (SSRS)", "PBIRS"), ("ReportServer$R1", "SSRS", "R1")]


def test_version_and_os_labels(make):
    df = make([("10.50.1600.1",), ("10.0.1600",), ("16.0.1",), ("99.1.1",)], "ProductVersion string")
    assert [r.SQLVersion for r in feeds.version_label(df).collect()] == [
        "Microsoft SQL Server 2008 R2", "Microsoft SQL Server 2008", "Microsoft SQL Server 2022", "Microsoft SQL Server"]
    caps = make([("Windows 10 Pro",), ("Windows Server 2008 R2",), ("none",)], "OSCaption string")
    assert [r.OperatingSystem for r in feeds.os_label(caps).collect()] == ["Windows 10", "Windows Server 2008 R2", "Unknown"]


def test_incomplete_properties_and_passive_nodes(make):
    kv = make([(1, "ActiveNode", "N1"), (1, "PassiveNode02", "N2"), (2, "ActiveNode", "A.x"), (2, "PassiveNode", "B")],
              "SQLInstanceID bigint, PropertyName string, PropertyValue string")
    pivot = feeds.pivot_properties(kv)
    assert not any(r.IsComplete for r in pivot.collect())
    got = sorted((r.SQLInstanceID, r.NodeName, r.IsActiveNode) for r in feeds.cluster_nodes(pivot, "d").collect())
    assert got == [(1, "n1.d", True), (2, "a.x", True), (2, "b.d", False)]


KV = "SQLInstanceID bigint, PropertyName string, PropertyValue string"


def test_properties_are_dealt_before_they_are_aggregated(make):
    kv = make([(1, "ActiveNode", "a"), (1, "ActiveNode", "b"), (1, "Team", None), (1, None, "x"), (None, "ServerType", "s")], KV)
    out = feeds.pivot_properties(kv.filter("PropertyName is not null"))
    assert shuffled_before_aggregation(out)
    got = {r.SQLInstanceID: (r.MachineProperties, r.CustomProperties, r.IsComplete) for r in out.collect()}
    assert got == {1: ({"ActiveNode": "b"}, {"Team": None}, False), None: ({"ServerType": "s"}, {}, False)}


def test_cluster_nodes_are_dealt_before_they_are_aggregated(make, rows):
    kv = make([(1, "ActiveNode", "A"), (1, "PassiveNode", "B"), (1, "PassiveNode", "C"), (None, "ActiveNode", "z.y")], KV)
    out = feeds.cluster_nodes(feeds.pivot_properties(kv), "d")
    assert rows(out, "SQLInstanceID", "NodeName", "IsActiveNode") == [(1, "a.d", True), (1, "c.d", False), (None, "z.y", True)]
    assert shuffled_before_aggregation(out)


# ---- policy documents -------------------------------------------------------------------

HISTORY = f"PolicyHistoryID bigint, EvaluatedServer string, EvaluationDateTime {NTZ}, EvaluatedPolicy string, EvaluationResults string"


def _policy(make, *docs):
    t = TS(2024, 3, 5)
    return make([(i, "srv", t, "P", d) for i, d in enumerate(docs)], HISTORY), make(
        [("P", 7, "Cat")], "PolicyName string, policy_id int, CategoryName string")


def _detail(obj, result, exc="", extra=""):
    return (f'<DMF:EvaluationDetail a="1"><DMF:ServerInstance>s</DMF:ServerInstance><DMF:TargetQueryExpression>{obj}</DMF:TargetQueryExpression>'
            f"<DMF:Result>{result}</DMF:Result><DMF:Exception>{exc}</DMF:Exception>{extra}</DMF:EvaluationDetail>")


def test_policy_documents(make, rows):
    ns = 'xmlns:DMF="urn:x"'
    many = f"<DMF:R {ns}>" + _detail("<![CDATA[A]]>", "TRUE") + _detail("B", "FALSE") + _detail("C &amp; D", "FALSE", "boom") + _detail("B", "TRUE") + "</DMF:R>"
    none = f"<DMF:R {ns}><DMF:ServerInstance>s</DMF:ServerInstance><DMF:Result>FALSE</DMF:Result><DMF:Exception>bad</DMF:Exception></DMF:R>"
    history, policies = _policy(make, many, none)
    assert rows(policy.shred_policy_results(history, policies), "EvaluatedObject", "PolicyResult", "MonthYear") == [
        ("A", "PASS", "March 2024"), ("B", "FAIL", "March 2024"), ("C & D", "ERROR", "March 2024")]
    assert rows(policy.shred_no_target_results(history, policies), "PolicyHistoryID", "EvaluatedObject", "PolicyResult") == [
        (1, "No Targets Found", "ERROR")]
    assert rows(policy.shred_policy_errors(history, policies), "EvaluationResults") == [("bad",), ("boom",)]
    assert policy.shred_policy_results(history, policies, category="Other").count() == 0


def test_policy_documents_as_xml_allows(make, rows):
    detail = lambda name, exc: f"<EvaluationDetail><ServerInstance>s</ServerInstance><TargetQueryExpression>{name}</TargetQueryExpression><Result>False</Result>{exc}</EvaluationDetail>"
    doc = "<R><X>" + "".join((
        detail("self-closing", "<Exception/>"), detail("blank inside", "<Exception />"), detail("absent", ""), detail("empty", "<Exception></Exception>"),
        detail("commented &amp; &#65;&#x42;<![CDATA[ <c> &amp;]]>", "<Exception></Exception><!-- <Exception>no</Exception> -->"),
        detail("two", "<Exception>one</Exception><Exception>two</Exception>"), detail("numeric", "<Exception>a&#10;b</Exception>"),
        detail("twice", "<Exception/>"), detail("twi<![CDATA[ce]]>", "<Exception>late</Exception>"),
        "<!-- <EvaluationDetail><TargetQueryExpression>hidden</TargetQueryExpression></EvaluationDetail> -->")) + "</X></R>"
    closed = "<R><EvaluationDetail/><ServerInstance>s</ServerInstance><Result>FALSE</Result><Exception/></R>"
    bare = "<R><!-- <EvaluationDetail/> --><P><p:ServerInstance>s</p:ServerInstance><p:Result>FALSE</p:Result><p:Exception/></P></R>"
    history, policies = _policy(make, doc, closed, bare)
    assert rows(policy.shred_policy_results(history, policies), "EvaluatedObject", "PolicyResult", "ExceptionMessage") == sorted([
        ("self-closing", "FAIL", ""), ("blank inside", "FAIL", ""), ("absent", "PASS", None), ("empty", "FAIL", ""),
        ("commented & AB <c> &amp;", "FAIL", ""), ("two", "ERROR", "one"), ("numeric", "ERROR", "a\nb"), ("twice", "FAIL", "")],
        key=lambda t: [(v is None, str(v)) for v in t])
    assert rows(policy.shred_no_target_results(history, policies), "PolicyHistoryID", "PolicyResult") == [(2, "FAIL")]
    assert rows(policy.shred_policy_errors(history, policies), "EvaluationResults") == [("a\nb",), ("late",), ("one",)]
    plan = policy.shred_documents(history, policies)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert not any("EvaluationResults" in line for line in exchanges)


def test_policy_load_is_idempotent(make):
    doc = "<R>" + _detail("A", "TRUE", extra="<DMF:ResultDetail>x</DMF:ResultDetail>") + "</R>"
    history, policies = _policy(make, doc)
    detail, errors = policy.load_policy_history(history, policies)
    again, _ = policy.load_policy_history(history, policies, detail, errors)
    assert detail.count() == 1 and again.count() == 0


# ---- names in any case, ids of new rows ----------------------------------------------------

def test_text_keys_ignore_case_and_new_rows_get_ids(make, rows):
    apps = make([(1, "APP", "old")], "ApplicationID bigint, ApplicationName string, ApplicationOwner string")
    merged = merges.merge_applications(apps, make([("app", "new"), ("Other", "x"), ("OTHER ", "y")], "ApplicationName string, ApplicationOwner string"))
    found = {r.ApplicationName.strip().lower(): r for r in merged.collect()}
    assert len(found) == merged.count() == 2 and found["app"].ApplicationID == 1 and found["app"].ApplicationOwner == "new" and found["app"].ApplicationName == "APP"
    assert found["other"].ApplicationID is not None and found["other"].ApplicationOwner == "y"
    # A rerun in another case finds the new row again, and a child merge can join it.
    again = merges.merge_applications(merged, make([("oTHER", "z")], "ApplicationName string, ApplicationOwner string"))
    assert again.count() == 2 and {r.ApplicationID for r in again.collect()} == {r.ApplicationID for r in found.values()}
    databases = make([], "DatabaseID bigint, SQLInstanceID bigint, DatabaseName string, DatabaseState string, ApplicationID bigint, ApplicationName string, IsMonitored boolean, DiscoveryOn date, LastUpdated date")
    feed = make([(5, "Sales", "ONLINE", "other", "Data", 7), (5, "SALES", "ONLINE", "Other", "Data", 7)],
                "SQLInstanceID bigint, DatabaseName string, DatabaseState string, ApplicationName string, FileType string, FileSize_mb bigint")
    merged_dbs = merges.merge_databases(databases, feed, again, "2024-01-02")
    (database,) = merged_dbs.collect()
    assert database.DatabaseID is not None and database.ApplicationID == found["other"].ApplicationID
    sizes = make([], "DatabaseID bigint, FileType string, DateCaptured date, FileSize_mb bigint")
    assert rows(merges.merge_database_size(sizes, feed.limit(1), merged_dbs, "2024-01-02"), "DatabaseID", "FileSize_mb") == [(database.DatabaseID, 7)]
    categories = merges.merge_job_categories(make([(1, "Nightly")], "SQLJobCategoryID bigint, SQLJobCategoryName string"), make([("nightly",), ("new",)], "CategoryName string"))
    assert sorted(r.SQLJobCategoryName for r in categories.collect()) == ["Nightly", "new"] and all(r.SQLJobCategoryID is not None for r in categories.collect())


def test_latest_state_wins_where_an_order_is_given(make):
    target = make([], "k bigint, state string, LastUpdated date")
    source = make([(1, "ZZ", 1), (1, "AA", 2)], "k bigint, state string, seq int")
    assert upsert.upsert(target, source, ["k"], ["state"], latest_by="seq").first().state == "AA"


def test_long_runs_and_hosts_of_any_feed(make, rows):
    assert make([(123_020304,)], "d bigint").select(feeds.duration_seconds(F.col("d")).alias("s")).first().s == 123 * 86400 + 2 * 3600 + 3 * 60 + 4
    cpu = make([(1, "X", 4, 8)], "ServerID bigint, Name string, NumberOfCores int, NumberOfLogicalProcessors int")
    ram = make([(2, 1 << 30)], "ServerID bigint, TotalPhysicalMemory bigint")
    page = make([(3, 5)], "ServerID bigint, AllocatedBaseSize bigint")
    assert rows(feeds.host_capacity(cpu, ram, page), "ServerID", "NumberOfCores", "Memory_mb", "PageFile_mb") == [(1, 4, 0, 0), (2, 0, 1024, 0), (3, 0, 0, 5)]


# ---- merges --------------------------------------------------------------------------------

MEMBERS = "MembershipID bigint, SQLInstanceID bigint, ServerRoleID bigint, ServerLoginID bigint, IsArchived boolean, DiscoveryOn date, LastUpdated date"


def test_archive_rules(make, rows):
    old = D(2001, 10, 1)
    target = make([(1, 1, 1, 1, False, old, old), (2, 1, 1, 2, False, old, old), (3, 9, 1, 1, False, old, old), (4, 1, 1, 3, True, old, old)], MEMBERS)
    feed = make([(1, "R", "L1", "T"), (1, "R", "L3", "T")], "SQLInstanceID bigint, RoleName string, LoginName string, LoginType string")
    people = make([(1, "R", "SERVER_ROLE"), (1, "L1", "T"), (3, "L3", "T")], "PrincipalID bigint, PrincipalName string, PrincipalType string")
    out = merges.merge_server_memberships(target, feed, people, "2001-10-15")
    got = rows(out, "SQLInstanceID", "ServerLoginID", "IsArchived", "LastUpdated")
    day = D(2001, 10, 15)
    assert got == [(1, 1, False, day), (1, 2, True, old), (1, 3, False, day), (1, 3, True, old), (9, 1, False, old)]
    unscoped = merges.merge_server_memberships(target, feed, people, "2001-10-15", scoped=False)
    assert (9, 1, True, old) in rows(unscoped, "SQLInstanceID", "ServerLoginID", "IsArchived", "LastUpdated")


def test_upsert_is_idempotent(fleet):
    once = merges.merge_databases(fleet.databases, fleet.staged_databases, fleet.application, "2001-10-15")
    twice = merges.merge_databases(once, fleet.staged_databases, fleet.application, "2001-10-15")
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0


def test_upsert_duplicate_source_and_null_key(make, rows):
    target = make([(1, "a")], "k int, v string")
    source = make([(1, "b"), (1, "c"), (None, "n")], "k int, v string")
    assert rows(upsert.upsert(target, source, ["k"], ["v"]), "k", "v") == [(1, "c"), (None, "n")]


def test_version_lookup(make, rows):
    versions = make([(2, "SQL Server 2008 RTM", 10, 0, 1600), (3, "SQL Server 2008 SP", 10, 0, 4000), (4, "SQL Server 2008 R2 RTM", 10, 50, 1700)], VERSIONS)
    feed = make([(1, 10, 0, 1599), (2, 10, 0, 1600), (3, 10, 0, 3999), (4, 10, 0, 9000), (5, 10, 50, 1800)], "i int, SQLBuild_Major int, SQLBuild_Minor int, SQLBuild_Build int")
    assert rows(merges.resolve_version(feed, versions), "i", "SQLInstanceVersionID") == [(1, 1), (2, 2), (3, 2), (4, 3), (5, 4)]
    labels = feed.withColumn("SQLVersion", F.lit("SQL Server 2008"))
    # The prefix form lets the R2 row in: build 3999 takes 1700 over 1600.
    assert rows(merges.resolve_version(labels, versions, match="label"), "i", "SQLInstanceVersionID") == [(1, 1), (2, 2), (3, 4), (4, 3), (5, 4)]


def test_volume_ownership(make, rows):
    vol = "DiskVolumeID bigint, DiskVolumeName string, ServerID bigint, SQLClusterID int, IsMonitored boolean, DiscoveryOn date, LastUpdated date"
    old = D(2001, 1, 1)
    volumes = make([(1, "e:", 1, None, True, old, old), (2, "f:", 1, None, True, old, old), (3, "f:", None, 5, True, old, old),
                    (4, "g:", None, 6, True, old, old), (5, "k:", 1, None, True, old, old)], vol)
    feed = make([(1, 5, n, 2, 1) for n in ("C:\\", "E:\\", "F:\\", "G:\\", "H:\\", "I:\\", "K:\\")], "ServerID bigint, SQLClusterID int, Name string, Capacity bigint, FreeSpace bigint")
    nodes = make([(5, 1), (6, 1)], "SQLClusterID int, SQLNodeID bigint")
    folders = make([(5, "H:\\Data\\x"), (5, "e:\\backup"), (6, "I:\\x")], "SQLClusterID int, FolderName string")
    decided = merges.attribute_volumes(feed, volumes, nodes, folders)
    assert dict(rows(decided, "DiskVolumeName", "Action")) == {
        "c:": "insert_server", "e:": "reparent", "f:": "drop_server_copy", "g:": "skip", "h:": "insert_cluster", "i:": "insert_server", "k:": "keep_server"}
    after = merges.apply_volume_decisions(volumes, decided, "2001-10-15")
    assert [r[:3] for r in rows(after, "DiskVolumeName", "ServerID", "SQLClusterID")] == [
        ("c:", 1, None), ("e:", None, 5), ("f:", None, 5), ("g:", None, 6), ("h:", None, 5), ("i:", 1, None), ("k:", 1, None)]
    gone = merges.dropped_volumes(volumes, decided)
    assert [r[0] for r in gone.collect()] == [2]
    space = make([(2, 1), (3, 1)], "DiskVolumeID bigint, x int")
    assert merges.drop_volume_rows(space, gone).count() == 1


def join_rows(df):
    """Rows out of the largest join of a query, as it ran."""
    df.collect()
    open_, most = [df._jdf.queryExecution().executedPlan()], 0
    while open_:
        node = open_.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            open_.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            open_.append(node.plan())
        else:
            open_ += [node.children().apply(i) for i in range(node.children().size())]
            if "Join" in kind:
                most = max(most, node.metrics().apply("numOutputRows").value())
    return most


def test_cluster_volumes_do_not_meet_all_nodes(make, rows):
    n, old = 300, D(2001, 1, 1)
    vol = "DiskVolumeID bigint, DiskVolumeName string, ServerID bigint, SQLClusterID int, IsMonitored boolean, DiscoveryOn date, LastUpdated date"
    volumes = make([(i, f"v{i}:", None, 5, True, old, old) for i in range(n)] + [(n, "g:", None, 6, True, old, old)], vol)
    nodes = make([(5, i) for i in range(n)] + [(6, 0), (6, 0)], "SQLClusterID int, SQLNodeID bigint")
    feed = make([(i, 5, "C:") for i in range(n)] + [(i, 5, f"v{i}:") for i in range(n)] + [(0, 5, "G:\\"), (0, 6, "g:"), (1, 5, "g:"), (None, 6, "g:"), (0, None, "g:"), (0, 5, None)],
                "ServerID bigint, SQLClusterID int, Name string")
    decided = merges.attribute_volumes(feed, volumes, nodes, make([], "SQLClusterID int, FolderName string"))
    assert join_rows(decided) <= feed.count()
    out = rows(decided.filter("DiskVolumeName = 'g:' or DiskVolumeName is null"), "ServerID", "SQLClusterID", "DiskVolumeName", "Action")
    assert out == [(0, 5, "g:", "skip"), (0, 5, None, "insert_server"), (0, 6, "g:", "keep_cluster"), (0, None, "g:", "insert_server"),
                   (1, 5, "g:", "insert_server"), (None, 6, "g:", "keep_cluster")]
    assert decided.filter("Action = 'keep_cluster'").count() == n + 2


def shuffled_before_aggregation(df):
    """Whether nothing is aggregated ahead of a query's only shuffle; ``df`` must not have run."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange") == 1 and plan.rindex("Aggregate") < plan.rindex("Exchange")


def test_growth_pivot_aggregates_once(make, rows):
    a, b = D(2001, 1, 1), D(2001, 1, 2)
    growth = make([(1, a, "Data", 5), (1, a, "Data", 2), (1, a, "Log", 3), (1, b, "Log", None), (2, a, "Index", 9), (None, a, "Log", 4), (2, None, "Data", 1),
                   (3, a, None, 8)], "DatabaseID bigint, DateCaptured date, FileType string, FileSize_mb bigint")
    out = reports.pivot_file_types(growth, "DateCaptured")
    assert out.schema.simpleString() == "struct<DatabaseID:bigint,DateCaptured:date,Data:bigint,Log:bigint>"
    assert rows(out, "DatabaseID", "DateCaptured", "Data", "Log") == [
        (1, a, 7, 3), (1, b, None, None), (2, a, None, None), (2, None, 1, None), (3, a, None, None), (None, a, None, 4)]
    assert shuffled_before_aggregation(out)


def test_volume_decisions_apply_without_meeting_all_nodes(make, rows):
    n, old = 300, D(2001, 1, 1)
    vol = "DiskVolumeID bigint, DiskVolumeName string, ServerID bigint, SQLClusterID int, IsMonitored boolean, DiscoveryOn date, LastUpdated date"
    volumes = make([(i, f"v{i}:", None, 5, True, old, old) for i in range(n)], vol)
    nodes = make([(5, i) for i in range(n)], "SQLClusterID int, SQLNodeID bigint")
    feed = make([(i, 5, f"v{i + 1}:") for i in range(n)], "ServerID bigint, SQLClusterID int, Name string")
    after = merges.apply_volume_decisions(
        volumes, merges.attribute_volumes(feed, volumes, nodes, make([], "SQLClusterID int, FolderName string")), "2001-10-15")
    assert join_rows(after) <= 2 * n
    assert after.count() == n + 1
    assert rows(after.filter("ServerID is not null"), "DiskVolumeName", "ServerID", "SQLClusterID") == [(f"v{n}:", n - 1, None)]
    assert after.filter("LastUpdated = date '2001-10-15'").count() == n  # v0 was reported by nobody


def test_space_blend(make, rows):
    space = make([(1, D(2001, 10, 15), 10, 100)], "DiskVolumeID bigint, DateCaptured date, SpaceUsed_mb bigint, TotalSpace_mb bigint")
    mb = 1024 * 1024
    readings = make([(1, 100 * mb, 79 * mb), (2, 50 * mb, 10 * mb)], "DiskVolumeID bigint, Capacity bigint, FreeSpace bigint")
    assert rows(merges.volume_space_daily(space, readings, "2001-10-15"), "DiskVolumeID", "SpaceUsed_mb", "TotalSpace_mb") == [(1, 15, 100), (2, 40, 50)]


def test_replica_of_another_host(make, rows):
    feed = make([(7, "s1\\a", "g", "G", "s1", "a", "PRIMARY"), (7, "s1\\a", "g", "G", "s2", "mssqlserver", "SECONDARY")],
                "SQLInstanceID bigint, ServerInstance string, AGGuid string, AGName string, ComputerName string, InstanceName string, ReplicaRole string")
    groups = make([(3, "G", "g")], "AGID bigint, AGName string, AGGuid string")
    servers = make([(1, "S1"), (2, "S2")], "ServerID bigint, ServerName string")
    instances = make([(7, 1, "A"), (8, 2, "MSSQLServer")], "SQLInstanceID bigint, ServerID bigint, SQLInstanceName string")
    assert rows(merges.resolve_replicas(feed, groups, servers, instances), "AGID", "SQLInstanceID", "ReplicaRole") == [(3, 7, "PRIMARY"), (3, 8, "SECONDARY")]


def test_grantor_is_resolved_by_its_own_type(make, rows):
    people = make([(1, "x", "A"), (2, "x", "B")], "PrincipalID bigint, PrincipalName string, PrincipalType string")
    feed = make([("x", "A", "x", "B")], "GranteeName string, GranteeType string, GrantorName string, GrantorType string")
    assert rows(merges.resolve_grants(feed, people), "GranteeID", "GrantorID") == [(1, 2)]


def test_group_switch(make, rows):
    registry = make([(1, False), (2, False)], "GroupID int, IsMonitored boolean")
    paths = make([(1, "Root"), (2, "Root\\A")], "GroupID int, GroupName string")
    assert rows(merges.set_group_monitoring(registry, paths, "Root\\A", True), "GroupID", "IsMonitored") == [(1, False), (2, True)]


# ---- reports ---------------------------------------------------------------------------------

def test_health_filter_ignores_null(make, rows):
    df = make([("Running",), ("Stopped",), (None,)], "Status string")
    assert rows(snapshot.health_filter(df, "Status", "Unhealthy"), "Status") == [("Stopped",)]
    assert snapshot.health_filter(df, "Status", "Both").count() == 3


def test_pattern_exclusions(make, rows):
    summary = make([("Cat", 1, "P", "HOST\\INST", "o1", "FAIL"), ("Cat", 1, "P", "HOST2", "o1", "FAIL"), ("Cat", 2, "Q", "HOST\\INST", "o1", "PASS")],
                   "CategoryName string, Policy_id int, PolicyName string, EvaluatedServer string, ObjectName string, PolicyResult string").withColumn(
        "EvaluationDateTime", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")))
    policies = make([(1, "A"), (2, "B")], "policy_id int, Policy_ShortName string")
    exclusions = make([(1, "host\\in%", "%")], "Policy_ID int, EvaluatedServer string, ObjectName string")
    out = reports.report_config_health(summary, policies, exclusions)
    assert rows(out, "Policy_id", "EvaluatedServer") == [(1, "HOST2"), (2, "HOST\\INST")]


def test_filters_narrow_reports(fleet):
    assert reports.report_databases(fleet, state="online").filter(~C.ci_eq("DatabaseState", "ONLINE")).count() == 0
    assert reports.report_job_history(fleet, as_of="2024-01-31 00:00:00", status="Failed").filter("JobStatus <> 'Failed'").count() == 0
    assert reports.report_instances(fleet, environment="Prod").filter("SQLInstanceEnviornment <> 'Prod'").count() == 0
    one = reports.report_volume_growth_daily(fleet, volume_id=3)
    assert {r.DiskVolumeID for r in one.select("DiskVolumeID").distinct().collect()} == {3}


def test_ties_of_latest_run_are_kept(make, fleet):
    class T:
        sql_job_history = make([(1, TS(2024, 1, 30), 5, "Failed"), (1, TS(2024, 1, 30), 6, "Successful")],
                               f"SQLJobID bigint, ExecutionDateTime {NTZ}, Duration int, JobStatus string")
        sql_jobs = make([(1, 1, 2, "j")], "SQLJobID bigint, SQLInstanceID bigint, SQLJobCategoryID bigint, SQLJobName string")
        sql_job_categories = make([(2, "c")], "SQLJobCategoryID bigint, SQLJobCategoryName string")
        sql_instances, sql_versions, servers, sql_clusters = fleet.sql_instances, fleet.sql_versions, fleet.servers, fleet.sql_clusters

    assert reports.report_job_history(T, as_of="2024-01-31 00:00:00").count() == 2


class WithStored:
    """The fleet plus tables that only a stored warehouse has."""

    def __init__(self, fleet):
        from fleetlens.oracle import catalog

        self._fleet = fleet
        self.sql_services = catalog._stored_services(fleet)
        self.extended_properties = catalog._property_names(fleet)
        self.extended_property_values = catalog._property_values(fleet)
        self.settings = fleet.spark.createDataFrame(list(seeds.SETTINGS.items()), "SettingName string, SettingValue string")

    def __getattr__(self, name):
        return getattr(self._fleet, name)


@pytest.mark.parametrize("entity", sorted(reports.LOOKUPS))
def test_lookups(fleet, entity):
    assert reports.lookup(WithStored(fleet), entity).count() > 0


def test_lookup_filters_ignore_case(fleet):
    out = reports.lookup(WithStored(fleet), "setting", SettingName="rawdata_cleanup_enabled")
    assert [r.SettingValue for r in out.collect()] == ["1"]
    assert reports.lookup(WithStored(fleet), "service", ServiceType="engine", ServerID=1).count() == 2


def test_unknown_kind_is_an_error(fleet):
    with pytest.raises(ValueError):
        lifecycle.expired_objects(fleet, "2001-10-15", kind="nothing")
