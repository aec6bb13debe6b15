"""Keys, policy documents, deep trees, cascades, late lines, marks and folds on small cases."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.functions.keys import allocate
from fleetlens.operators import feeds, lifecycle, merges, policy, rollup, views
from fleetlens.plans import daily
from fleetlens.sources import seeds, tables
from fleetlens.streaming import backfill, compaction, incremental, ordered


def test_keys_are_new_and_unique(spark):
    stored = spark.createDataFrame([(7, "a"), (900, "b")], "id int, name string")
    new = spark.range(200_000).select(F.concat(F.lit("n"), F.col("id")).alias("name"))
    out = allocate(new, [F.col("name")], stored, "id")
    low, high, n, own = out.agg(F.min("id"), F.max("id"), F.count("*"), F.countDistinct("id")).first()
    assert out.schema["id"].dataType.simpleString() == "int" and low > 900 and n == own == 200_000 and high < 900 + 1.2 * n
    again = allocate(new.repartition(13), [F.col("name")], stored, "id")
    assert out.exceptAll(again).isEmpty()
    assert {r.id for r in allocate(new.limit(3), [F.col("name")], stored.limit(0), "id").collect()}.isdisjoint({0, 1})


def test_a_fresh_warehouse_knows_its_hosts_and_builds(spark):
    empty = lambda name: seeds.empty_table(spark, tables.SCHEMAS[name][1])
    systems, versions = seeds.seed_operating_systems(empty("operating_systems")), seeds.seed_versions(empty("sql_versions"))
    for df, key, n in ((systems, "OperatingSystemID", 9), (versions, "SQLVersionID", 38)):
        assert df.count() == df.filter(F.col(key).isNotNull()).select(key).distinct().count() == n
        assert df.filter(F.col(key) == 1).count() == 1
    host = merges.merge_servers(empty("servers"), spark.createDataFrame([("h", "Windows Server 2016")], "ServerName string, OperatingSystemName string"), systems, "2024-01-01")
    assert host.join(systems, "OperatingSystemID").first().OperatingSystemName == "Windows Server 2016"
    build = spark.createDataFrame([(1, 13, 0, 5026)], "SQLInstanceID int, SQLBuild_Major int, SQLBuild_Minor int, SQLBuild_Build int")
    found = merges.resolve_version(build, versions).join(versions, F.col("SQLInstanceVersionID") == F.col("SQLVersionID")).first()
    assert found.SQLVersion == "Microsoft SQL Server 2016 Service Pack 2"
    again = seeds.seed_operating_systems(systems)
    assert again.exceptAll(systems).isEmpty() and again.count() == 9


def test_documents_are_parsed_whole(spark):
    inner = "<![CDATA[x </EvaluationDetail> y]]>"
    detail = lambda name, rest: f'<EvaluationDetail note="a > b"><TargetQueryExpression>{name}</TargetQueryExpression>{rest}</EvaluationDetail>'
    doc = f"<?pi <EvaluationDetail/> ?><R><A><B>{detail('one', f'<Result>FALSE</Result><Exception/><ResultDetail>{inner}</ResultDetail>')}</B></A><C><![CDATA[<EvaluationDetail/>]]></C>"
    doc += detail("outer", f"<Result>TRUE</Result>{detail('nested', '<Result>FALSE</Result><Exception>bad</Exception>')}") + "</R>"
    rows = policy.read_document(doc)
    assert [(r[3], r[4], r[5], r[6]) for r in rows] == [
        ("one", "FALSE", "", "x </EvaluationDetail> y"), ("outer", "TRUE", None, None), ("nested", "FALSE", "bad", None)]
    assert "malformed" in policy.read_document("<R><EvaluationDetail></R>")[0][5]
    history = spark.createDataFrame([(1, "s", dt.datetime(2024, 1, 1), "P", doc), (2, "s", dt.datetime(2024, 1, 1), "P", "<oops"), (3, "s", None, "P", None)],
                                    "PolicyHistoryID bigint, EvaluatedServer string, EvaluationDateTime timestamp_ntz, EvaluatedPolicy string, EvaluationResults string")
    policies = spark.createDataFrame([("p", 4, "c")], "PolicyName string, policy_id int, CategoryName string")
    out, errors = policy.load_policy_history(history, policies)
    assert sorted((r.PolicyHistoryID, r.EvaluatedObject, r.PolicyResult) for r in out.collect()) == [
        (1, "nested", "ERROR"), (1, "one", "FAIL"), (1, "outer", "PASS"), (2, "No Targets Found", "ERROR")]
    assert errors.filter("EvaluationResults like 'malformed%'").count() == 1


def test_deep_trees_and_cycles(spark):
    deep = 5_000
    rows = [(None, 0, "root"), *((k, k + 1, f"g{k}") for k in range(deep)), (9_001, 9_002, "x"), (9_002, 9_001, "y"), (77_777, 9_003, "dangling")]
    groups = spark.createDataFrame(rows, "parent_id int, server_group_id int, name string").repartition(4)
    paths = {r.GroupID: r.GroupName for r in views.group_paths(groups).collect()}
    assert len(paths) == deep + 1 and paths[2] == "root\\g0\\g1" and len(paths[deep]) == 75
    few = groups.filter("server_group_id < 40 or server_group_id > 9000")
    tree = {r.server_group_id: (r.GroupLevel, r.GroupName, r.Sort) for r in views.group_tree(few).collect()}
    assert len(tree) == 40 and tree[0] == (1, "ALL", "ALL") and tree[2] == (3, "    g1", "ALL | g0 | g1")
    assert views.group_paths(groups.limit(0)).count() == 0


def test_names_of_groups_and_instances_compare_without_case(spark):
    paths = spark.createDataFrame([(1, "Prod"), (2, "prod")], "GroupID int, GroupName string")
    registered = spark.createDataFrame([(1, "a"), (2, "b")], "server_group_id int, ServerInstance string")
    assert {r[0] for r in views.group_instances(paths, registered, "PROD").collect()} == {"a", "b"}
    assert [r[0] for r in views.group_instances(paths, registered, group_id=2).collect()] == ["b"]
    df = spark.createDataFrame([("Host ", True)], "ServerName string, IsMonitored boolean")
    assert merges.set_monitoring(df, "ServerName", "HOST", False).first().IsMonitored is False


def test_a_purge_leaves_no_orphans(spark, tmp_path):
    store = tables.Warehouse(spark, str(tmp_path))
    old, new = dt.date(2020, 1, 1), dt.date(2024, 1, 1)
    frame = lambda name, rows, cols: store.save(name, spark.createDataFrame(rows, cols))
    frame("servers", [(1, "gone", old), (2, "stays", new)], "ServerID bigint, ServerName string, LastUpdated date")
    frame("sql_instances", [(10, 1, new), (20, 2, new)], "SQLInstanceID bigint, ServerID bigint, LastUpdated date")
    frame("databases", [(100, 10, new), (200, 20, new), (201, 20, old)], "DatabaseID bigint, SQLInstanceID bigint, LastUpdated date")
    frame("database_size", [(d, "Data", day, 1) for d in (100, 200, 201) for day in (new, dt.date(2024, 2, 1))] + [(200, "Data", dt.date(2024, 3, 1), 1)],
          "DatabaseID bigint, FileType string, DateCaptured date, FileSize_mb bigint")
    frame("sql_jobs", [(5, 10), (6, 20)], "SQLJobID bigint, SQLInstanceID bigint")
    frame("sql_job_history", [(5, dt.datetime(2024, 1, 2), 1, "x"), (6, dt.datetime(2024, 1, 2), 1, "x")], "SQLJobID bigint, ExecutionDateTime timestamp_ntz, Duration int, JobStatus string")
    untouched = os.path.join(store.path("database_size"), "yyyymm=202403")
    files = sorted(os.listdir(untouched))
    daily.purge_expired_objects(store, seeds.SETTINGS, "2024-02-01")
    ids = lambda name, c: sorted(r[0] for r in store[name].select(c).distinct().collect())
    assert (ids("servers", "ServerID"), ids("sql_instances", "SQLInstanceID"), ids("databases", "DatabaseID")) == ([2], [20], [200])
    assert (ids("database_size", "DatabaseID"), ids("sql_jobs", "SQLJobID"), ids("sql_job_history", "SQLJobID")) == ([200], [6], [6])
    assert sorted(os.listdir(untouched)) == files
    for child in ("sql_instances", "databases", "database_size", "sql_jobs", "sql_job_history"):
        for parent, key, fk in lifecycle.foreign_keys(child):
            if parent in ("servers", "sql_instances", "databases", "sql_jobs"):
                assert store[child].join(store[parent].select(F.col(key).alias(fk)), fk, "left_anti").isEmpty()


def test_no_error_is_lost_at_the_time_of_the_last_one(spark, tmp_path):
    store = tables.Warehouse(spark, str(tmp_path))
    stack = "Stack Dump"
    line = lambda n, minute, text: (1, n, dt.datetime(2024, 1, 5, 10, minute), text)
    batch = lambda *rows: spark.createDataFrame(rows, "SQLInstanceID bigint, LineNo bigint, LogDate timestamp_ntz, Text string")
    one, two, three = line(1, 30, f"{stack} a"), line(2, 30, f"{stack} b"), line(3, 10, f"{stack} late")
    for rows in ((one,), (one,), (two,), (three,), (one, two, three), (one, line(4, 30, f"{stack} a"))):
        daily.collect_errors(store, batch(*rows))
    assert sorted(r.ErrorMsg for r in store.sql_error_log.collect()) == [f"{stack} a", f"{stack} a", f"{stack} b", f"{stack} late"]


def test_late_days_of_months(spark):
    rows = [(1, "D", dt.date(2024, 1, d), d) for d in range(1, 11)]
    frame = lambda r: spark.createDataFrame(r, "DatabaseID int, FileType string, DateCaptured date, FileSize_mb bigint")
    keys, values = ["DatabaseID", "FileType"], ["FileSize_mb"]
    sums = rollup.month_sums(frame(rows[:5]), keys, values)
    changed = rollup.changed_sums(sums, frame(rows[:1]), frame([(1, "D", dt.date(2024, 1, 1), 101), *rows[5:], (2, "L", dt.date(2024, 2, 1), 4)]), keys, values)
    assert sorted((r.DatabaseID, r.FileSize_mb) for r in rollup.averages(changed, keys, values).collect()) == [(1, (100 + sum(range(1, 11))) // 10), (2, 4)]
    assert rollup.changed_sums(sums, frame(rows[:5]), frame([]), keys, values).count() == 0


LINES = "SQLInstanceID bigint, LineNo bigint, LogDate timestamp_ntz, Text string"


def _log(n=120, seed=5):
    rng, out = random.Random(seed), []
    for k in range(n):
        text = rng.choice(["Error: 17, Severity: 16, State: 1.", "hello", "Process ID 5 was killed by hostname X", "Error: 17187, Severity: 1, State: 1."])
        out.append((1 + k % 3, k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k, minutes=rng.randint(0, 59)), text))
    return out


def test_lines_pair_up_in_any_order(spark, tmp_path):
    lines, root = _log(), str(tmp_path)
    rng = random.Random(1)
    arrivals = [[] for _ in range(6)]
    for k, line in enumerate(lines):
        part = min(5, k // 20 + (1 if k % 20 >= 12 and rng.random() < 0.4 else 0))  # within the 30 hours
        arrivals[part].append(line)
        if rng.random() < 0.3:
            arrivals[min(5, part + rng.randint(0, 1))].append(line)
    arrivals[5].append((1, 500, dt.datetime(2024, 1, 1, 3), "Process ID 9 was killed by hostname LATE"))
    for batch, rows in enumerate(arrivals):
        rng.shuffle(rows)
        ordered.ordered_batch(spark.createDataFrame(rows, LINES), batch, root)
        if batch in (2, 5):  # a batch that is repeated changes nothing
            ordered.ordered_batch(spark.createDataFrame(rows, LINES), batch, root)
    final = spark.read.parquet(f"{root}/errors").drop("batch_id")
    got = sorted(map(tuple, final.unionByName(ordered.open_errors(spark, root)).collect()))
    want = sorted(map(tuple, feeds.extract_errors(spark.createDataFrame(lines, LINES)).collect()))
    assert got == want and 0 < final.count() < len(want)
    kept = [n for n in os.listdir(f"{root}/buffer") if n.startswith("block_no=")]
    assert len(kept) < 12  # blocks that were final before the last batch are gone


def test_slices_can_stop_and_start_again(spark, tmp_path):
    lines = spark.createDataFrame(_log(), LINES)
    instances = spark.createDataFrame([(1,), (2,), (3,), (4,)], "SQLInstanceID bigint")
    now = "2024-01-04 06:00:00"
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    assert backfill.backfill_errors(lines, instances, one, now, slice_hours=5) == 6
    assert [backfill.backfill_errors(lines, instances, two, now, slice_hours=5, rounds=r) for r in (1, 2, None, None)] == [1, 2, 3, 0]
    got = [sorted(map(tuple, backfill.collected(spark, root).collect())) for root in (one, two)]
    low, high = dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 4, 6)
    inside = lines.filter((F.col("LogDate") > F.lit(low)) & (F.col("LogDate") <= F.lit(high)))
    assert got[0] == got[1] == sorted(map(tuple, feeds.extract_errors(inside).collect())) and got[0]
    assert {r.LastDateTimeCaptured for r in backfill.stored_marks(spark, two).collect()} == {high}
    # Days later the floor skips what lies between, and no line pairs across the gap.
    assert backfill.backfill_errors(lines, instances, two, "2024-01-20 00:00:00", slice_hours=30) == 1


def test_folds_are_few_and_readers_finish(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = spark.createDataFrame([], "k bigint, day date").schema
    day = lambda k: dt.date(2024, 1, 1 + k % 3)
    most, reader = 0, None
    for batch in range(20):
        spark.createDataFrame([(batch * 10 + i, day(batch), batch) for i in range(4)], "k bigint, day date, batch_id bigint").coalesce(1).write.mode("append").partitionBy("batch_id", "day").parquet(path)
        if batch % 2:
            if batch == 11:
                reader = compaction.read_folded(spark, path, schema)
            most = max(most, compaction.fold(spark, path, schema, batch - 1, "day"))
            if batch == 11:
                assert reader.count() == 48  # began before the fold
    assert sorted(r.k for r in compaction.read_folded(spark, path, schema).collect()) == [b * 10 + i for b in range(20) for i in range(4)]
    assert most <= 8 and len([n for n in os.listdir(path) if n.startswith("batch_id=")]) <= 5
    assert incremental.job_history is not None and pytest is not None


def test_a_day_rewrites_its_folder_only(spark, tmp_path):
    store = tables.Warehouse(spark, str(tmp_path))
    store.save("databases", spark.createDataFrame([(k, 1, f"d{k}", True) for k in (1, 2)], "DatabaseID bigint, SQLInstanceID bigint, DatabaseName string, IsMonitored boolean"))
    feed = lambda mb: spark.createDataFrame([(1, f"d{k}", "Data", mb + k) for k in (1, 2)], "SQLInstanceID bigint, DatabaseName string, FileType string, FileSize_mb bigint")
    save = lambda day, mb: store.save("database_size", merges.merge_database_size(daily._this_day(store, "database_size", day), feed(mb), store.databases, day))
    for day, mb in (("2024-01-30", 10), ("2024-01-31", 20), ("2024-02-01", 30)):
        save(day, mb)
    folder = lambda day: os.path.join(store.path("database_size"), "yyyymm=202401", f"DateCaptured={day}")
    before = sorted(os.listdir(folder("2024-01-30")))
    save("2024-01-31", 50)
    assert sorted(os.listdir(folder("2024-01-30"))) == before
    assert sorted((r.DatabaseID, str(r.DateCaptured), r.FileSize_mb) for r in store.database_size.collect()) == [
        (1, "2024-01-30", 11), (1, "2024-01-31", 51), (1, "2024-02-01", 31), (2, "2024-01-30", 12), (2, "2024-01-31", 52), (2, "2024-02-01", 32)]
    plan = daily._this_day(store, "database_size", "2024-01-31")._jdf.queryExecution().executedPlan().toString()
    assert "DateCaptured" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    daily.purge_partitioned(store, "database_size", "raw_data", {"RawData_CleanUp_Enabled": "1", "RawData_CleanUp_Retention_Days": "1"}, "2024-01-31")
    assert store.days("database_size", 202401) == ["2024-01-31"] and store.database_size.count() == 4
    store.rewrite_period("database_size", 202401, store.database_size.filter("yyyymm = 202401 and DatabaseID = 9").drop("yyyymm"))
    assert store.periods("database_size") == [202402]
