"""Core licence accounting per host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.columns import date_lit, idiv

ALIVE_DAYS = 30
ASSUMED_CORES = 4

# fixed values: preference order of the instance that decides a host's licence
ENVIRONMENT_RANK = {"Prod": 1}
ROLE_RANK = {"Stand Alone": 1}
EDITION_RANK = {
    "Enterprise Edition: Core-based Licensing (64-bit)": 1,
    "Enterprise Edition (64-bit)": 2,
    "Standard Edition (64-bit)": 3,
}


def _rank(value: str, ranks: dict[str, int]) -> Column:
    out = F.lit(max(ranks.values()) + 1)
    for name, rank in ranks.items():
        out = F.when(F.col(value) == name, F.lit(rank)).otherwise(out)
    return out


def _hosts(servers: DataFrame, clusters: DataFrame, nodes: DataFrame, as_of: str) -> DataFrame:
    """Live stand-alone servers, plus every node of a cluster that is some node's first cluster; one pass over each table.

    ``_cluster_active``: the name is the first in at least one of its clusters.
    """
    cut = F.date_sub(date_lit(as_of), ALIVE_DAYS)
    member = nodes.select("SQLClusterID", F.col("SQLNodeID").alias("ServerID"), F.lit(True).alias("_node")).join(
        clusters.select("SQLClusterID", "SQLClusterName"), "SQLClusterID", "left")
    placed = servers.select("ServerID", "ServerName", "NumberOfCores", "IsPhysical", "LastUpdated").join(member, "ServerID", "left")
    # Windows over one server, and over one cluster; servers outside clusters are groups of their own, never one large group.
    own = Window.partitionBy("ServerID")
    cluster = Window.partitionBy("SQLClusterID", F.when(F.col("SQLClusterID").isNull(), F.col("ServerID")))
    named = Window.partitionBy("SQLClusterName", F.when(F.col("SQLClusterName").isNull(), F.col("ServerID")))
    placed = placed.withColumn("_lowest", F.min("SQLClusterID").over(own) == F.col("SQLClusterID")).withColumn(
        "_chosen", F.max("_lowest").over(cluster)).withColumn("_first", F.min("ServerName").over(named) == F.col("ServerName"))
    in_cluster = F.col("SQLClusterName").isNotNull()
    placed = placed.withColumn("_cluster_active", F.max(F.when(in_cluster, F.col("_first"))).over(Window.partitionBy("ServerName")))
    kept = F.when(F.col("_node").isNotNull(), in_cluster & F.col("_chosen")).otherwise(F.col("LastUpdated") >= cut)
    return placed.filter(kept).select("ServerName", "SQLClusterName", "NumberOfCores", "IsPhysical", "_cluster_active")


def _computers(instance_view: DataFrame, ag_instances: DataFrame) -> DataFrame:
    """Per computer: the instance that represents it (ties go to the lowest id), and whether it hosts the first replica of a group.

    ``_group_active`` is null for a computer without replicas.
    """
    rows = instance_view.select(
        "SQLInstanceID", "ComputerName", "SQLInstanceName", "SQLInstanceEdition", "SQLInstanceEnviornment", "SQLInstanceType").join(
        ag_instances.select("AGID", "SQLInstanceID", F.lit(True).alias("_replica")), "SQLInstanceID", "left")
    group = Window.partitionBy("AGID", F.when(F.col("AGID").isNull(), F.col("SQLInstanceID")))
    head = F.min(F.when(F.col("_replica").isNotNull(), F.struct("ComputerName", "SQLInstanceName"))).over(group)
    rows = rows.withColumn("_head", F.when(F.col("_replica").isNotNull(), F.coalesce(head["ComputerName"] == F.col("ComputerName"), F.lit(False))))
    order = F.struct(
        _rank("SQLInstanceEnviornment", ENVIRONMENT_RANK), _rank("SQLInstanceType", ROLE_RANK),
        _rank("SQLInstanceEdition", EDITION_RANK), F.col("SQLInstanceID"))
    pick = F.struct("SQLInstanceEdition", "SQLInstanceEnviornment", "SQLInstanceType")
    return rows.groupBy("ComputerName").agg(F.min_by(pick, order).alias("b"), F.max("_head").alias("_group_active"))


def license_details(
    servers: DataFrame, clusters: DataFrame, nodes: DataFrame, instance_view: DataFrame,
    ag_instances: DataFrame, as_of: str,
) -> DataFrame:
    """Licence cores per host: cores times core factor, 0 for passive hosts and free editions."""
    computers = _computers(instance_view, ag_instances)
    best = computers.select(
        "ComputerName", F.col("b.SQLInstanceEdition").alias("Edition"), F.col("b.SQLInstanceEnviornment").alias("Enviornment"),
        F.col("b.SQLInstanceType").alias("InstanceType"))
    roles = computers.select(F.col("ComputerName").alias("ServerName"), "_group_active").filter("_group_active is not null")
    rows = (
        _hosts(servers, clusters, nodes, as_of)
        .withColumn("ComputerName", F.coalesce("SQLClusterName", "ServerName"))
        .join(best, "ComputerName", "left").join(roles, "ServerName", "left"))
    active = F.coalesce("_group_active", "_cluster_active", F.lit(True)) | F.coalesce(
        F.col("InstanceType") == "Stand Alone", F.lit(False))
    no_cores = F.coalesce(F.col("NumberOfCores") == 0, F.lit(False))
    cores = F.when(no_cores, F.lit(ASSUMED_CORES)).otherwise(F.col("NumberOfCores"))
    free = F.coalesce(F.col("Edition").contains("Express") | F.col("Edition").contains("Developer"), F.lit(False))
    factor = (
        F.when(free | ~active, F.lit(0)).when(cores > 4, F.lit(1)).otherwise(idiv(F.lit(4), cores)).cast("int"))
    return rows.select(
        "ServerName", "SQLClusterName", cores.alias("NumberOfCores"),
        (F.col("IsPhysical") | no_cores).alias("IsPhysical"), factor.alias("CoreFactor"),
        F.when(active, "Active").otherwise("Passive").alias("ServerRole"),
        "Edition", "Enviornment", "InstanceType", no_cores.cast("int").alias("AssumedCPUInfo"),
        (cores * factor).alias("LicenseCores"),
    )


def license_overview(details: DataFrame) -> DataFrame:
    """Licence cores by environment, core source, edition and role with every subtotal level.

    ``SubtotalLevel`` is 0 for detail rows and 15 for the grand total, so a null
    group value is never mistaken for a subtotal.
    """
    return details.rollup("Enviornment", "AssumedCPUInfo", "Edition", "ServerRole").agg(
        F.grouping_id().cast("int").alias("SubtotalLevel"), F.sum("LicenseCores").alias("LicenseCores"),
        F.count(F.lit(1)).alias("HostCount"))
