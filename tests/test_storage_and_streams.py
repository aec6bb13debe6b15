"""Sources, sinks, seeds and micro-batches on temporary folders."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import feeds, rollup
from fleetlens.plans import daily, reports
from fleetlens.sources import seeds, tables
from fleetlens.streaming import incremental

TS = dt.datetime
LINES = "SQLInstanceID bigint, LineNo bigint, LogDate timestamp_ntz, Text string"


def test_staging_by_run_and_version(spark, make, tmp_path):
    root = str(tmp_path)
    df = make([(1, "a")], "k int, v string")
    tables.land_batch(df, root, "jobs", 1)
    tables.land_batch(df.union(df), root, "jobs", 2)
    tables.land_batch(df, root, "jobs", 1)  # a repeated run replaces itself
    tables.land_batch(df, root, "jobs", 1, schema_version=2)
    read = lambda run, v=1: tables.read_batch(spark, root, "jobs", run, "k int, v string", v).count()
    assert (read(1), read(2), read(1, 2)) == (1, 2, 1)
    assert tables.clear_batch(spark, root, "jobs", 1)
    assert (read(1), read(2)) == (0, 2)
    assert not tables.clear_batch(spark, root, "jobs", 99)


def test_partition_overwrite_touches_only_its_months(spark, make, tmp_path):
    path = str(tmp_path / "size")
    schema = "DatabaseID bigint, FileType string, DateCaptured date, FileSize_mb bigint"
    tables.write_partitioned(make([(1, "Data", dt.date(2001, 1, 5), 1), (1, "Data", dt.date(2001, 2, 5), 2)], schema), path)
    tables.write_partitioned(make([(1, "Data", dt.date(2001, 2, 6), 9)], schema), path)
    assert sorted((r.yyyymm, r.FileSize_mb) for r in spark.read.parquet(path).collect()) == [(200101, 1), (200102, 9)]


def test_replace_table_reads_its_own_source(spark, make, tmp_path):
    path = str(tmp_path / "dim")
    tables.replace_table(make([(1,)], "k int"), path)
    current = tables.read_current(spark, path)
    tables.replace_table(current.union(make([(2,)], "k int")), path)
    assert sorted(r.k for r in tables.read_current(spark, path).collect()) == [1, 2]


def test_warehouse_reads_typed_tables(spark, fleet, tmp_path):
    root = str(tmp_path)
    fleet.servers.drop("ProcessorName").write.parquet(tables.table_path(root, "servers"))
    direct = tables.read_table(spark, "servers", tables.table_path(root, "servers"))
    assert direct.columns == tables.schema_of("servers").names
    assert direct.select("ProcessorName").distinct().first()[0] == "Unknown"
    store = tables.Warehouse(spark, root + "/w")
    store.save("servers", direct)
    assert store.servers.exceptAll(direct).count() == 0 and store["servers"].count() == direct.count()
    with pytest.raises(AttributeError):
        store.nothing


def test_csv_read_has_declared_schema(spark, tmp_path):
    (tmp_path / "v.csv").write_text("1,Data ,2001-01-01,5\n")
    row = tables.read_table(spark, "database_size", str(tmp_path / "v.csv"), "csv").first()
    assert (row.FileType, row.DateCaptured, row.FileSize_mb) == ("Data", dt.date(2001, 1, 1), 5)


def test_run_log_append(spark, tmp_path):
    path = str(tmp_path / "log")
    tables.append_run_log(spark, path, 7, [("2024-01-01 00:00:00", "start")])
    tables.append_run_log(spark, path, 7, [("2024-01-01 01:00:00", "Collection End")])
    assert tables.read_table(spark, "run_log", path).filter("ProcessID = 7").count() == 2


def test_seeds_are_idempotent(spark, make):
    os1 = seeds.seed_operating_systems(seeds.empty_table(spark, tables.SCHEMAS["operating_systems"][1]))
    assert os1.count() == len(seeds.OPERATING_SYSTEMS) + 1
    assert seeds.seed_operating_systems(os1).exceptAll(os1).count() == 0
    v1 = seeds.seed_versions(seeds.empty_table(spark, tables.SCHEMAS["sql_versions"][1]))
    assert len(seeds.SQL_VERSIONS) == 37 and v1.count() == 38 and seeds.seed_versions(v1).exceptAll(v1).count() == 0
    changed = make([("RawData_CleanUp_Retention_Days", "10")], tables.SCHEMAS["settings"][1])
    settings = tables.settings_map(seeds.seed_settings(changed))
    assert settings["RawData_CleanUp_Retention_Days"] == "10" and len(settings) == len(seeds.SETTINGS)
    apps = seeds.seed_applications(seeds.empty_table(spark, tables.SCHEMAS["application"][1]))
    assert apps.first().ApplicationName == "Unknown"


def _stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _land(df, folder, name):
    df.coalesce(1).write.parquet(os.path.join(folder, name))


def test_error_stream_equals_batch_across_batches(spark, make, tmp_path):
    head = "Error: {}, Severity: 16, State: 1."
    lines = [(m, i, TS(2024, 1, 1, i // 20, i % 20), head.format(i) if i % 3 == 0 else f"line {i}") for i in range(60) for m in (1, 2)]
    df = make(lines, LINES)
    src, root = str(tmp_path / "in"), str(tmp_path / "out")
    for part, (a, b) in enumerate([(0, 22), (22, 40), (40, 60)]):
        _land(df.filter((F.col("LineNo") >= a) & (F.col("LineNo") < b)), src, f"p{part}")
        incremental.incremental_errors(_stream(spark, src + "/*", df.schema), root).awaitTermination()
    got = spark.read.parquet(root + "/errors").drop("batch_id")
    want = feeds.extract_errors(df)
    assert got.select(want.columns).exceptAll(want).count() == 0 and want.exceptAll(got.select(want.columns)).count() == 0


def test_late_lines_are_dropped(spark, make, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "out")
    pair = lambda n, ts: [(1, n, ts, "Error: 1, Severity: 1, State: 1."), (1, n + 1, ts + dt.timedelta(seconds=1), "x")]
    for part, rows in enumerate([pair(10, TS(2024, 1, 10)), pair(20, TS(2024, 1, 10, 1)), pair(1, TS(2024, 1, 8)) + pair(5, TS(2024, 1, 9, 12))]):
        _land(make(rows, LINES), src, f"p{part}")
        incremental.incremental_errors(_stream(spark, src + "/*", make([], LINES).schema), root).awaitTermination()
    days = {r.DateTimeCaptured.date() for r in spark.read.parquet(root + "/errors").collect()}
    assert days == {dt.date(2024, 1, 10), dt.date(2024, 1, 9)}


def test_job_stream_does_not_double_boundary_rows(spark, make, tmp_path):
    schema = "SQLInstanceID bigint, JobName string, ExecutionDateTime timestamp_ntz, Duration int, JobStatus string"
    jobs = make([(5, 1, "j")], "SQLJobID bigint, SQLInstanceID bigint, SQLJobName string")
    first = make([(1, "j", TS(2024, 1, 1), 1, "Successful"), (1, "j", TS(2024, 1, 2), 2, "Successful")], schema)
    again = make([(1, "j", TS(2024, 1, 2), 2, "Successful"), (1, "j", TS(2024, 1, 3), 3, "Failed")], schema)
    src, root = str(tmp_path / "in"), str(tmp_path / "out")
    for part, df in enumerate([first, again]):
        _land(df, src, f"p{part}")
        incremental.incremental_jobs(_stream(spark, src + "/*", first.schema), root, jobs).awaitTermination()
    out = spark.read.parquet(root + "/job_history")
    assert sorted(r.ExecutionDateTime.day for r in out.collect()) == [1, 2, 3]
    marks = spark.read.parquet(root + "/state/job_marks/batch=1").first()
    assert marks.LastDateTimeCaptured == TS(2024, 1, 3)


def test_hourly_counts_of_closed_hours(spark, make, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(1, i, TS(2024, 1, 1, 0, i), "x") for i in range(5)] + [(1, 99, TS(2024, 1, 5), "x")]
    _land(make(rows, LINES), src, "p0")
    incremental.write_hourly_counts(_stream(spark, src + "/*", make([], LINES).schema), root).awaitTermination()
    assert [(r.HourStart, r.LineCount) for r in spark.read.parquet(root + "/hours").collect()] == [(TS(2024, 1, 1), 5)]


def test_open_hours_are_added_from_the_stored_lines(spark, make, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(1, i, TS(2024, 1, 1, 0, i), "x") for i in range(5)] + [(1, 98, TS(2024, 1, 4, 22, 59), "x"), (1, 99, TS(2024, 1, 5), "x"), (None, 1, TS(2024, 1, 5), "x")]
    lines = make(rows, LINES)
    _land(lines, src, "p0")
    incremental.write_hourly_counts(_stream(spark, src + "/*", lines.schema), root).awaitTermination()
    out = incremental.with_open_hours(spark.read.schema("SQLInstanceID bigint, HourStart timestamp_ntz, HourEnd timestamp_ntz, LineCount bigint").parquet(root + "/hours"), lines)
    assert {(r.SQLInstanceID, r.HourStart, r.HourEnd, r.LineCount) for r in out.collect()} == {
        (1, TS(2024, 1, 1), TS(2024, 1, 1, 1), 5), (1, TS(2024, 1, 4, 22), TS(2024, 1, 4, 23), 1), (1, TS(2024, 1, 5), TS(2024, 1, 5, 1), 1), (None, TS(2024, 1, 5), TS(2024, 1, 5, 1), 1)}


@pytest.fixture(scope="module")
def store(spark, fleet, tmp_path_factory):
    """A stored warehouse filled from the driver's tables."""
    out = tables.Warehouse(spark, str(tmp_path_factory.mktemp("warehouse")))
    for name in ("servers", "operating_systems", "sql_clusters", "sql_versions", "sql_instances", "application", "databases",
                 "ag_instances", "ag_databases", "database_size", "disk_volume_space", "disk_volumes"):
        out.save(name, getattr(fleet, name))
    return out


def test_warehouse_round_trip_and_report(store, fleet, rows):
    assert store.database_size.drop("yyyymm").exceptAll(fleet.database_size.select("DatabaseID", "FileType", "DateCaptured", "FileSize_mb")).count() == 0
    a, b = reports.report_volumes(store), reports.report_volumes(fleet)
    assert a.columns == b.columns and rows(a, "DiskVolumeID", "DaysLabel") == rows(b, "DiskVolumeID", "DaysLabel")


def test_first_of_month_run_is_idempotent(store, fleet):
    settings = {**seeds.SETTINGS, "RawData_CleanUp_Retention_Days": "40"}
    want = rollup.monthly_database_size(fleet.database_size, 1998, 5)
    daily.daily_maintenance(store, settings, "1998-06-01")
    assert store.database_monthly.exceptAll(want.select(store.database_monthly.columns)).count() == 0
    assert store.periods("database_monthly") == [199805]
    kept = store.database_size.filter("DateCaptured <= date '1998-04-22'").count()
    after = store.database_size.count()
    daily.daily_maintenance(store, settings, "1998-06-01")
    assert kept == 0 and store.database_size.count() == after
    assert after == fleet.database_size.filter("DateCaptured > date '1998-04-22'").count()


def test_trends_are_published_once(store, fleet):
    for _ in range(2):
        daily.publish_trends(store, "2001-09-30")
    want = rollup.trend_servers(fleet.servers, fleet.operating_systems, "2001-09-30")
    got = store.trending_servers.filter("YearMonth = 200109")
    assert got.count() == want.count() > 0 and store.periods("trending_databases") == [200109]


def test_daily_collection_merges_one_batch(store, fleet):
    batch = fleet.staged_databases
    daily.collect_databases(store, batch, "1998-06-20")
    day = store.database_size.filter("DateCaptured = date '1998-06-20'")
    assert day.count() >= batch.select("DatabaseName", "FileType").distinct().count()
    assert store.databases.filter("DatabaseID is null").count() == 0
    before = store.database_size.count()
    daily.collect_databases(store, batch, "1998-06-20")
    assert store.database_size.count() == before


def test_error_collection_is_idempotent(store, fleet):
    daily.collect_errors(store, fleet.log_lines)
    daily.collect_errors(store, fleet.log_lines)
    assert store.sql_error_log.count() == feeds.extract_errors(fleet.log_lines).count()


def test_policy_short_names(spark, make):
    target = seeds.empty_table(spark, tables.SCHEMAS["policy_short_names"][1])
    policies = make([("Guest Permissions", 4), ("Home grown", 5)], "PolicyName string, policy_id int")
    assert [tuple(r) for r in seeds.seed_policy_short_names(target, policies).collect()] == [(4, "Guest")]


def test_daily_snapshot_tables(fleet):
    from fleetlens.oracle import catalog

    class Store:
        sql_services = catalog._stored_services(fleet)

        def __getattr__(self, name):
            return getattr(fleet, name)

    out = daily.daily_snapshot(Store(), "2001-10-15", catalog._health(fleet))
    assert sorted(out) == ["databases", "errors", "jobs", "policy", "services", "size_change", "top_volumes"]
    assert out["services"].count() > 0 and out["top_volumes"].count() == min(15, out["top_volumes"].count())


def test_tables_never_stored_are_empty_and_generations_are_bounded(spark, make, tmp_path):
    out = tables.Warehouse(spark, str(tmp_path))
    assert out.servers.count() == 0 and out.servers.columns == tables.schema_of("servers").names
    for n in range(5):
        out.save("application", make([(n, f"a{n}", "o")], "ApplicationID bigint, ApplicationName string, ApplicationOwner string"))
    assert out.application.first().ApplicationID == 4
    folders = os.listdir(out.path("application"))
    assert sum(f.startswith("gen=") for f in folders) == sum(f.startswith("marker=") for f in folders) == tables.GENERATIONS_KEPT
    # A marker without its success file is no marker: readers keep the old generation.
    os.makedirs(os.path.join(out.path("application"), "marker=00000099"))
    assert out.application.first().ApplicationID == 4


def _day_feed(fleet, make):
    jobs = fleet.staged_jobs.limit(50)
    members = make([(1, "sysadmin", "Alice", "SQL_LOGIN"), (1, "SYSADMIN", "alice", "SQL_LOGIN"), (2, "sysadmin", "bob", "SQL_LOGIN")],
                   "SQLInstanceID bigint, RoleName string, LoginName string, LoginType string")
    grants = make([(1, "Alice", "SQL_LOGIN", "bob", "SQL_LOGIN", "SERVER", 0, "GRANT", "CONNECT")],
                  "SQLInstanceID bigint, GranteeName string, GranteeType string, GrantorName string, GrantorType string, ObjectType string, ObjectID bigint, Access string, PermissionName string")
    return {"servers": fleet.staged_servers, "databases": fleet.staged_databases, "jobs": jobs, "log_lines": fleet.log_lines,
            "server_membership": members, "server_permissions": grants, "properties": fleet.property_feed, "policies": fleet.policies}


def test_two_days_over_a_fresh_warehouse(spark, fleet, make, tmp_path):
    out = tables.Warehouse(spark, str(tmp_path))
    out.append("policy_history", fleet.policy_history.limit(30))
    feed = _day_feed(fleet, make)
    daily.run_day(out, feed, "2001-10-14")
    state = lambda: {n: (out[n].count(), out[n].agg(F.sum(F.xxhash64(*out[n].columns).cast("decimal(38,0)"))).first()[0]) for n in tables.SCHEMAS}
    daily.run_day(out, feed, "2001-10-15")
    second = state()
    for table, key in (("servers", "ServerID"), ("operating_systems", "OperatingSystemID"), ("application", "ApplicationID"), ("databases", "DatabaseID"),
                       ("sql_jobs", "SQLJobID"), ("server_principals", "PrincipalID"), ("server_permission", "PermissionID")):
        ids = [r[key] for r in out[table].select(key).collect()]
        assert ids and None not in ids and len(ids) == len(set(ids)), table
    assert out.server_principals.count() == 3 and out.server_principal_membership.count() == 2
    assert out.server_permission.join(out.server_principals, F.col("GranteeID") == F.col("PrincipalID")).count() == 1
    assert out.sql_job_history.join(out.sql_jobs, "SQLJobID").count() == out.sql_job_history.count() > 0
    assert out.policy_history_detail.count() > 0
    daily.run_day(out, feed, "2001-10-15")
    assert state() == second
    paths = daily.store_snapshot(out, "2001-10-15", reports_health(out))
    assert spark.read.parquet(paths["policy"]).columns[-1] == "SnapshotDay"


def reports_health(out):
    return reports.report_config_health(out.policy_summary, out.policy_summary.selectExpr("Policy_id policy_id", "PolicyName Policy_ShortName").distinct(), out.policy_exclusions)
