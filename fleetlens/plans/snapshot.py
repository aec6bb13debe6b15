"""Daily dashboard snapshot and its health switch.  The definitions follow the fields the dashboard reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.columns import ci
from fleetlens.operators import rollup, views
from fleetlens.plans import reports

# fixed values: the healthy value of each status column
HEALTHY = {
    "Status": "Running", "ErrorStatus": "No Errors", "DatabaseState": "Online", "PolicyResult": "PASS", "JobStatus": "Successful",
}
TOP_VOLUMES = 15


def health_filter(df: DataFrame, column: str, status: str = "Both") -> DataFrame:
    """Healthy, Unhealthy or Both.  A null status is neither healthy nor unhealthy."""
    good = ci(column) == HEALTHY[column].lower()
    if status == "Both":
        return df
    return df.filter(good if status == "Healthy" else ~good)


def snapshot_services(services: DataFrame, servers: DataFrame, as_of: str) -> DataFrame:
    return reports.report_services(services, servers, as_of=as_of).groupBy("ServiceType", "Status").agg(F.count(F.lit(1)).alias("SvcCount"))


def snapshot_errors(t, as_of: str) -> DataFrame:
    rows = reports.report_error_summary(t, as_of=as_of)
    status = F.when(F.col("ErrorLogCount") > 0, "Errors").otherwise("No Errors")
    return rows.groupBy("SQLInstanceEnviornment", status.alias("ErrorStatus")).agg(
        F.count(F.lit(1)).alias("InstanceCount"), F.sum("ErrorLogCount").alias("TotalErrors"))


def snapshot_databases(t, as_of: str) -> DataFrame:
    """Row count of the database listing by state.  Sizes are not needed, so the size fact is not read."""
    dbs = t.databases.filter(F.col("LastUpdated") >= F.date_sub(F.lit(as_of).cast("date"), 1)).select(
        "DatabaseID", "SQLInstanceID", "DatabaseName", "DatabaseState")
    kept = dbs.join(t.databases_exclusions.select("DatabaseID", "SQLInstanceID", "DatabaseName"), ["DatabaseID", "SQLInstanceID", "DatabaseName"], "left_anti")
    listed = kept.join(reports.instance_view(t).select("SQLInstanceID"), "SQLInstanceID").join(
        t.ag_databases.select("DatabaseID"), "DatabaseID", "left")
    return listed.groupBy("DatabaseState").agg(F.count(F.lit(1)).alias("RwCount"))


def snapshot_policy(health: DataFrame) -> DataFrame:
    return health.groupBy("CategoryName", "PolicyResult").agg(F.count(F.lit(1)).alias("ObjCount"))


def snapshot_jobs(t, as_of: str) -> DataFrame:
    return reports.report_job_history(t, as_of=as_of).groupBy("JobStatus").agg(F.count(F.lit(1)).alias("TotalCount"))


def snapshot_size_change(t, as_of: str) -> DataFrame:
    label = F.col("VolumeOfChangeCategory")
    return reports.report_size_change(t, as_of=as_of).groupBy("VolumeOfChangeCategory").agg(
        F.count(F.lit(1)).alias("TotalInstances")).select(label, rollup.size_change_order(label).alias("SortKey"), "TotalInstances")


def snapshot_top_volumes(t, n: int = TOP_VOLUMES) -> DataFrame:
    """The volumes that run out first; each task keeps its own top n before the final merge."""
    return views.volume_forecast(t.disk_volume_space, t.disk_volumes, t.servers, t.sql_clusters).orderBy(
        "DaysUntil_OutOfSpace", "DiskVolumeID").limit(n)
