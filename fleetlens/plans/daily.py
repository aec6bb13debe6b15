"""The daily and monthly runs over a stored warehouse.

Each step is one set-based job over all machines.  Months are given explicitly, and a period
that is already stored is left alone, so a repeated run changes nothing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.columns import date_lit, surrogate_id, yyyymm
from fleetlens.operators import feeds, lifecycle, merges, policy, rollup
from fleetlens.plans import snapshot
from fleetlens.sources.shared import delete_path, shared_dir
from fleetlens.sources.tables import DAILY, PARTITIONED, Warehouse, write_partitioned


def previous_month(as_of: dt.date) -> tuple[int, int]:
    last = as_of.replace(day=1) - dt.timedelta(days=1)
    return last.year, last.month


def collect_databases(store: Warehouse, batch: DataFrame, as_of: str) -> None:
    """Merge one landed database batch: applications, databases, then sizes of the day."""
    store.save("application", merges.merge_applications(store.application, batch))
    store.save("databases", merges.merge_databases(store.databases, batch, store.application, as_of))
    store.save("database_size", merges.merge_database_size(_this_day(store, "database_size", as_of), batch, store.databases, as_of))


def _this_day(store: Warehouse, name: str, as_of: str) -> DataFrame:
    """The day's folder, which is all that a daily merge reads and rewrites."""
    month = F.col("yyyymm") == int(as_of[:4]) * 100 + int(as_of[5:7])
    return store[name].filter(month & (F.col(DAILY[name]) == date_lit(as_of[:10]))).drop("yyyymm")


def _periods_with(store: Warehouse, name: str, keys: list[tuple[DataFrame, str]]) -> list[int]:
    """Periods of a table that hold one of the keys (tables of one column ``k``); a few dozen at most."""
    period = PARTITIONED[name][0]
    hit = [store[name].select(F.col(fk).alias("k"), period).join(k, "k", "left_semi").select(period) for k, fk in keys]
    return [r[0] for r in reduce(DataFrame.unionAll, hit).distinct().collect()]


def collect_hosts(store: Warehouse, feed: Mapping[str, DataFrame], as_of: str) -> None:
    """Operating systems, servers, clusters, nodes, instances with their version, then volumes and their space."""
    if "servers" in feed:
        store.save("operating_systems", merges.add_operating_systems(store.operating_systems, feed["servers"]))
        store.save("servers", merges.merge_servers(store.servers, feed["servers"], store.operating_systems, as_of))
    if "clusters" in feed:
        store.save("sql_clusters", merges.merge_clusters(store.sql_clusters, feed["clusters"], as_of))
    if "cluster_nodes" in feed:
        store.save("sql_cluster_nodes", merges.merge_cluster_nodes(store.sql_cluster_nodes, feed["cluster_nodes"]))
    if "instances" in feed:
        versioned = merges.resolve_version(feed["instances"], store.sql_versions)
        store.save("sql_instances", merges.merge_instances(store.sql_instances, versioned, as_of))
    if "volumes" in feed:
        decisions = merges.attribute_volumes(feed["volumes"], store.disk_volumes, store.sql_cluster_nodes, feed["folders"])
        dropped = merges.dropped_volumes(store.disk_volumes, decisions)
        for name in ("disk_volume_space", "volume_monthly"):
            for period in _periods_with(store, name, [(dropped.select(F.col("DiskVolumeID").alias("k")), "DiskVolumeID")]):
                rows = store[name].filter(F.col(PARTITIONED[name][0]) == period).drop("yyyymm")
                store.rewrite_period(name, period, merges.drop_volume_rows(rows, dropped))
        store.save("disk_volumes", merges.apply_volume_decisions(store.disk_volumes, decisions, as_of))
    if "volume_space" in feed:
        space = _this_day(store, "disk_volume_space", as_of)
        store.save("disk_volume_space", merges.volume_space_daily(space, feed["volume_space"], as_of))


def collect_groups(store: Warehouse, feed: Mapping[str, DataFrame], as_of: str) -> None:
    """Availability groups, their replicas and their databases."""
    if "replicas" in feed:
        store.save("availability_groups", merges.merge_availability_groups(store.availability_groups, feed["replicas"], as_of))
        store.save("ag_instances", merges.merge_ag_replicas(
            store.ag_instances, feed["replicas"], store.availability_groups, store.servers, store.sql_instances, as_of))
    if "databases" in feed:
        store.save("ag_databases", merges.merge_ag_databases(
            store.ag_databases, feed["databases"], store.databases, store.availability_groups, store.ag_instances, as_of))


def collect_jobs(store: Warehouse, feed: DataFrame, as_of: str) -> None:
    """Job categories and jobs, then the runs that are not stored yet are appended."""
    store.save("sql_job_categories", merges.merge_job_categories(store.sql_job_categories, feed))
    store.save("sql_jobs", merges.merge_jobs(store.sql_jobs, feed, store.sql_job_categories, as_of))
    runs = merges.job_runs(feed, store.sql_jobs)
    store.append("sql_job_history", merges.new_job_runs(store.sql_job_history.drop("yyyymm"), runs))


def collect_security(store: Warehouse, feed: Mapping[str, DataFrame], as_of: str) -> None:
    """Principals of every feed first, then memberships and grants with resolved ids."""
    names = {
        "server_principals": (("server_membership", "LoginName", "LoginType"), ("server_membership", "RoleName", "SERVER_ROLE"),
                              ("server_permissions", "GranteeName", "GranteeType"), ("server_permissions", "GrantorName", "GrantorType")),
        "database_principals": (("database_membership", "UserName", "UserType"), ("database_membership", "RoleName", "DATABASE_ROLE"),
                                ("database_permissions", "GranteeName", "GranteeType"), ("database_permissions", "GrantorName", "GrantorType")),
    }
    for table, sources in names.items():
        for name, column, kind in sources:
            if name in feed:
                rows = feed[name] if kind in feed[name].columns else feed[name].withColumn("_kind", F.lit(kind))
                store.save(table, merges.merge_principals(store[table], rows, column, kind if kind in feed[name].columns else "_kind"))
    if "server_membership" in feed:
        store.save("server_principal_membership", merges.merge_server_memberships(
            store.server_principal_membership, feed["server_membership"], store.server_principals, as_of))
    if "database_membership" in feed:
        store.save("database_principal_membership", merges.merge_database_memberships(
            store.database_principal_membership, feed["database_membership"], store.database_principals, as_of))
    if "server_permissions" in feed:
        grants = merges.resolve_grants(feed["server_permissions"], store.server_principals)
        store.save("server_permission", merges.merge_server_permissions(store.server_permission, grants, as_of))
    if "database_permissions" in feed:
        grants = merges.resolve_grants(feed["database_permissions"], store.database_principals)
        store.save("database_permission", merges.merge_database_permissions(store.database_permission, grants, as_of))


def collect_policies(store: Warehouse, policies: DataFrame) -> None:
    """Shred documents that are not loaded yet, then renew the summary."""
    history = store.policy_history.drop("yyyymm")
    detail, errors = policy.load_policy_history(
        history, policies, store.policy_history_detail.drop("yyyymm"), store.evaluation_errors.drop("yyyymm"))
    store.append("policy_history_detail", detail)
    store.append("evaluation_errors", errors)
    store.save("policy_summary", policy.policy_summary(store.policy_history_detail.drop("yyyymm")))


def run_day(store: Warehouse, feed: Mapping[str, DataFrame], as_of: str) -> None:
    """All merges of one collected day in the order in which they need each other; feeds that are absent are skipped.

    Keys of new rows derive from their names, and runs, log lines and policy documents are added only if they are not
    stored yet, so the same day may be run again.
    """
    collect_hosts(store, feed, as_of)
    if "databases" in feed:
        collect_databases(store, feed["databases"], as_of)
    collect_groups(store, feed, as_of)
    if "jobs" in feed:
        collect_jobs(store, feed["jobs"], as_of)
    if "log_lines" in feed:
        collect_errors(store, feed["log_lines"])
    if "services" in feed:
        store.save("sql_services", merges.merge_services(store.sql_services, feed["services"], store.servers, as_of))
    if "properties" in feed:
        store.save("extended_properties", merges.merge_property_names(store.extended_properties, feed["properties"]))
        store.save("extended_property_values", merges.merge_property_values(
            store.extended_property_values, feed["properties"], store.extended_properties, as_of))
    collect_security(store, feed, as_of)
    if "policies" in feed:
        collect_policies(store, feed["policies"])


def collect_errors(store: Warehouse, lines: DataFrame) -> None:
    """Extract errors of a landed log batch and append those that are not stored yet, whenever they come.

    An error is known by machine, time, message and how many equal ones came before it, so a repeated run adds nothing,
    real repeats stay, and a late error or one of the time of the last stored one is not lost. Only the months of
    the batch are read back.
    """
    new = feeds.extract_errors(lines).select(
        surrogate_id("SQLInstanceID", "DateTimeCaptured", "Message").alias("ErrorLogID"), "SQLInstanceID",
        F.col("DateTimeCaptured").alias("DateTime"), F.col("Message").alias("ErrorMsg"))
    months = [r[0] for r in new.select(yyyymm("DateTime")).distinct().collect()]  # those of one batch
    stored = store.sql_error_log.filter(F.col("yyyymm").isin(*months)).drop("yyyymm") if months else store.sql_error_log.drop("yyyymm").limit(0)
    store.append("sql_error_log", merges.new_errors(stored, new))


def publish_month(store: Warehouse, year: int, month: int) -> None:
    """Monthly averages of the size and space facts; reads one month's partition of each."""
    period = year * 100 + month
    if period not in store.periods("database_monthly"):
        rows = store.database_size.filter(F.col("yyyymm") == period)
        store.save("database_monthly", rollup.monthly_database_size(rows, year, month))
    if period not in store.periods("volume_monthly"):
        rows = store.disk_volume_space.filter(F.col("yyyymm") == period)
        store.save("volume_monthly", rollup.monthly_volume_space(rows, year, month))


def publish_trends(store: Warehouse, as_of: str) -> None:
    """Inventory counts of the month of ``as_of``, usually the last day of the previous month."""
    period = int(as_of[:4]) * 100 + int(as_of[5:7])
    jobs = {
        "trending_servers": lambda: rollup.trend_servers(store.servers, store.operating_systems, as_of),
        "trending_instances": lambda: rollup.trend_instances(store.sql_instances, store.sql_versions, as_of),
        "trending_databases": lambda: rollup.trend_databases(
            store.databases, store.sql_instances, store.sql_versions, store.database_size, store.ag_instances, store.ag_databases, as_of),
    }
    for name, job in jobs.items():
        if period not in store.periods(name):
            store.save(name, job())


def daily_snapshot(store: Warehouse, as_of: str, health: DataFrame) -> dict[str, DataFrame]:
    """Dashboard tables of one day; ``health`` is the configuration-health report."""
    return {
        "services": snapshot.snapshot_services(store.sql_services, store.servers, as_of),
        "errors": snapshot.snapshot_errors(store, as_of),
        "databases": snapshot.snapshot_databases(store, as_of),
        "policy": snapshot.snapshot_policy(health),
        "jobs": snapshot.snapshot_jobs(store, as_of),
        "size_change": snapshot.snapshot_size_change(store, as_of),
        "top_volumes": snapshot.snapshot_top_volumes(store),
    }


def store_snapshot(store: Warehouse, as_of: str, health: DataFrame) -> dict[str, str]:
    """Write the dashboard tables of a day below ``<root>/snapshot``, one folder per day; returns their paths."""
    paths = {}
    for name, df in daily_snapshot(store, as_of, health).items():
        paths[name] = f"{store.root}/snapshot/{name}"
        write_partitioned(df.withColumn("SnapshotDay", date_lit(as_of)), paths[name], ("SnapshotDay",), "SnapshotDay")
    return paths


def _month_of(day: dt.date) -> int:
    return day.year * 100 + day.month


def purge_partitioned(store: Warehouse, name: str, dataset: str, settings: Mapping[str, str], as_of: str, unit: str | None = None) -> None:
    """Retention by partition: whole expired months are dropped and only the month of the cut-off is rewritten."""
    rule, enabled, window, default_unit = lifecycle.RETENTION_RULES[dataset]
    if str(settings.get(enabled, "0")) != "1":
        return
    n, unit, day = int(settings[window]), unit or default_unit, dt.date.fromisoformat(as_of[:10])
    if unit == "months":
        index = day.year * 12 + day.month - 1 - n
        cut = index // 12 * 100 + index % 12 + 1
    else:
        cut = _month_of(day - dt.timedelta(days=n))
    key = PARTITIONED[name][0]
    for period in store.periods(name):
        if period < cut:
            store.drop_period(name, period)
    if key == "YearMonth" or cut not in store.periods(name):
        return
    date_col = PARTITIONED[name][1]
    if name in DAILY:
        days = store.days(name, cut)
        kept = rule(store.spark.createDataFrame([(d,) for d in days], "d string").select(F.to_date("d").alias(date_col)), as_of, n, unit, date_col=date_col)
        left = {str(r[0]) for r in kept.collect()}  # 31 at most
        for gone in set(days) - left:
            store.drop_day(name, cut, gone)
        return
    rows = store[name].filter(F.col(key) == cut).drop(key)
    extra = {"date_col": date_col} if rule is lifecycle.purge_raw else {}
    survivors = rule(rows, as_of, n, unit, **extra)
    if survivors.isEmpty():
        store.drop_period(name, cut)
    else:
        store.save(name, survivors)


def daily_maintenance(store: Warehouse, settings: Mapping[str, str], as_of: str) -> None:
    """Roll-ups on the first of a month, then retention of every partitioned fact."""
    day = dt.date.fromisoformat(as_of[:10])
    first = day.day == 1
    if first:
        publish_month(store, *previous_month(day))
        if str(settings.get("Trend_Creation_Enabled", "1")) == "1":
            publish_trends(store, (day - dt.timedelta(days=1)).isoformat())
    for name, dataset, monthly in (
        ("database_size", "raw_data", False), ("disk_volume_space", "raw_data", False), ("sql_error_log", "error_log", False),
        ("sql_job_history", "job_history", False), ("policy_history_detail", "policy_results", False),
        ("evaluation_errors", "policy_results", False), ("policy_history", "policy_results", False), ("database_monthly", "aggregate", True), ("volume_monthly", "aggregate", True),
        ("trending_servers", "trending", True), ("trending_instances", "trending", True), ("trending_databases", "trending", True),
    ):
        if first or not monthly:
            purge_partitioned(store, name, dataset, settings, as_of)
    stored = store.periods("run_log")
    if stored and str(settings.get("RunLog_CleanUp_Enabled", "0")) == "1":
        # The cut is a midnight, so at most one month is rewritten; the ones before it go as folders.
        survivors = lifecycle.apply_retention("run_log", store.run_log, settings, as_of)
        first = survivors.agg(F.min("yyyymm")).first()[0]
        store_first = survivors.filter(F.col("yyyymm") == first).drop("yyyymm")
        if first is not None:
            store.save("run_log", store_first)
        for period in stored:
            if first is None or period < first:
                store.drop_period("run_log", period)
    if str(settings.get("Expired_Objects_Enabled", "0")) == "1":
        purge_expired_objects(store, settings, as_of)


def purge_expired_objects(store: Warehouse, settings: Mapping[str, str], as_of: str) -> None:
    """Expired entities go with everything that hangs on them, children first, so that a run that stops leaves no orphan.

    The purged keys are computed once, before anything is rewritten. Of a partitioned table only the periods that hold a
    purged key are rewritten.
    """
    expired = {}
    for name in lifecycle.EXPIRING:
        key = lifecycle.CHILDREN[name][0]
        expired[name] = store[name].join(lifecycle.apply_retention("expired", store[name], settings, as_of).select(key), key, "left_anti")
    gone = {}
    for name, keys in lifecycle.cascade_keys({n: store[n] for n in lifecycle.CHILDREN}, expired).items():
        path = shared_dir(store.spark, f"purged-{name}")
        keys.write.parquet(path)
        gone[name] = store.spark.read.schema(keys.schema).parquet(path)
    gone = {name: keys for name, keys in gone.items() if not keys.isEmpty()}
    parents = list(lifecycle.CHILDREN)
    children = dict.fromkeys(child for p in parents for child, _ in lifecycle.CHILDREN[p][1] if child not in parents)
    for name in [*children, *reversed(parents)]:
        touching = [(p, fk) for p, _, fk in lifecycle.foreign_keys(name) if p in gone]
        touching += [(name, lifecycle.CHILDREN[name][0])] if name in gone else []
        if not touching:
            continue
        if name not in PARTITIONED:
            store.save(name, lifecycle.cascade(name, store[name], gone))
            continue
        period = PARTITIONED[name][0]
        for value in _periods_with(store, name, [(gone[p], fk) for p, fk in touching]):
            store.rewrite_period(name, value, lifecycle.cascade(name, store[name].filter(F.col(period) == value), gone).drop("yyyymm"))
    for name, keys in gone.items():
        delete_path(store.spark, keys.inputFiles()[0].rsplit("/", 1)[0])
