"""Volumes, nodes, pools and replicas as tables.

placement(volume_id, node_id, pool_id, tier, ...) has one row per volume and
replica(replica_id, primary_id) one row per replica; graph questions are joins
on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.numeric import capacity_fraction, clip, ratio
from tidewatch.operators.windows import latest_rows
from tidewatch.roles import DEFAULT_ROLES, Roles, require_columns

PLACEMENT_COLUMNS = ["node_id", "pool_id", "tier", "capacity_total_gb"]


def placement(telemetry: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Where each volume was last seen."""
    require_columns(telemetry, [roles.entity, roles.group])
    have = [c for c in PLACEMENT_COLUMNS if c in telemetry.columns]
    return latest_rows(telemetry, roles, have).drop(*roles.order)


def volumes_on_nodes(place: DataFrame, nodes: list) -> DataFrame:
    return place.where(F.col("node_id").isin(*nodes)).select("node_id", "volume_id")


def neighbors(place: DataFrame, asked: DataFrame) -> DataFrame:
    """(volume_id, neighbor_id) for the asked volumes only."""
    mine = place.join(asked.select("volume_id").distinct(), "volume_id", "left_semi").select("volume_id", "node_id")
    others = place.select(F.col("volume_id").alias("neighbor_id"), "node_id")
    return mine.join(others, "node_id").where("volume_id <> neighbor_id").select("volume_id", "node_id", "neighbor_id")


def node_table(place: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """All known nodes, those without a volume included."""
    used = place.select("node_id")
    return (used if nodes is None else used.unionByName(nodes.select("node_id"))).distinct()


def graph_export(place: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) for a graph view."""
    def text(c: str) -> Column:
        return F.col(c).cast("string")

    nodes = place.select(
        F.concat(F.lit("node_"), text("node_id")).alias("id"), F.lit("storage_node").alias("type"),
        F.lit(None).cast("string").alias("owner")).distinct()
    volume = F.concat(F.lit("vol_"), text("volume_id"))
    owner = F.concat(F.lit("node_"), text("node_id"))
    volumes = place.select(volume.alias("id"), F.lit("volume").alias("type"), owner.alias("owner"))
    edges = place.select(volume.alias("source"), owner.alias("target"), F.lit("resides_on").alias("relation"))
    return nodes.unionByName(volumes), edges


# --- load ----------------------------------------------------------------------------

def node_utilization(place: DataFrame, latest: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Volumes, summed IOPS and throughput and mean latency per node.

    A volume without metrics counts as a volume and adds nothing; a node
    without volumes stays with zeros.
    """
    live = latest.select("volume_id", "total_iops", "total_throughput_mbps", "avg_latency_us")
    per = place.select("volume_id", "node_id").join(live, "volume_id", "left").groupBy("node_id").agg(
        F.count(F.lit(1)).alias("n_volumes"), F.sum("total_iops").alias("total_iops"),
        F.sum("total_throughput_mbps").alias("total_throughput_mbps"), F.avg("avg_latency_us").alias("avg_latency_us"))
    out = per if nodes is None else node_table(place, nodes).join(per, "node_id", "left")
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("total_iops", "total_throughput_mbps", "avg_latency_us")}
    return out.withColumns({**zero, "n_volumes": F.coalesce("n_volumes", F.lit(0).cast("bigint"))})


def two_least_loaded(utilization: DataFrame) -> Column:
    """The two least loaded nodes as one scalar array, ties by node id.

    Enough to find, for any node, the least loaded *other* node.
    """
    two = utilization.select(F.struct("total_iops", "node_id").alias("n")).orderBy("n").limit(2)
    return two.agg(F.sort_array(F.collect_list("n")).alias("two")).scalar()


def with_best_target(df: DataFrame, utilization: DataFrame, node: str = "node_id") -> DataFrame:
    """Add ``target_node`` and ``target_iops``: the least loaded node other than ``node``."""
    out = df.withColumn("_two", two_least_loaded(utilization))
    first, second = F.get("_two", F.lit(0)), F.get("_two", F.lit(1))
    pick = F.when(F.col(node).isNull() | (first["node_id"] != F.col(node)), first).otherwise(second)
    return out.withColumn("_pick", pick).withColumns({
        "target_node": F.col("_pick.node_id"), "target_iops": F.col("_pick.total_iops")}).drop("_two", "_pick")


def node_panel(volumes: DataFrame, hot: float = 40.0) -> DataFrame:
    """Per node: summed IOPS, mean of the non-zero latencies, hot volumes and all volumes."""
    lat = F.avg(F.when(F.col("avg_latency_us") != 0, F.col("avg_latency_us")))
    return volumes.groupBy("node_id").agg(
        F.sum("total_iops").alias("total_iops"), F.coalesce(lat, F.lit(0.0)).alias("avg_latency_us"),
        F.count_if(F.col("hotspot_score") >= hot).alias("hot_volumes"), F.count(F.lit(1)).alias("volumes"))


# --- capacity headroom ----------------------------------------------------------------

def volume_capacity(place: DataFrame, latest: DataFrame) -> DataFrame:
    """Total GB and used fraction per volume, live values before placement values."""
    live = latest.select("volume_id", F.col("capacity_total_gb").alias("_total"),
                         F.col("capacity_used_pct").alias("_pct"), F.col("capacity_used_gb").alias("_used"))
    out = place.join(live, "volume_id", "left")
    total = F.coalesce("_total", "capacity_total_gb") if "capacity_total_gb" in place.columns else F.col("_total")
    out = out.withColumn("total_gb", total)
    by_gb = F.when(F.col("total_gb") != 0, clip(F.try_divide("_used", "total_gb"), 0.0, 1.0))
    return out.withColumn("used_fraction", F.coalesce(capacity_fraction(F.col("_pct")), by_gb)).drop("_total", "_pct", "_used")


def headroom(volumes: DataFrame, by: str, critical: float = 0.9) -> DataFrame:
    """Capacity per tier or pool; NULL keys count as "Unknown".

    The volumes at or over ``critical`` are rows of :func:`critical_volumes`,
    not an array here: a tier may hold any number of them.
    """
    used = F.coalesce(F.col("used_fraction"), F.lit(0.0)) * F.col("total_gb")
    key = F.coalesce(F.col(by).cast("string"), F.lit("Unknown"))
    out = volumes.groupBy(key.alias(by)).agg(
        F.coalesce(F.sum("total_gb"), F.lit(0.0)).alias("total_capacity_gb"),
        F.coalesce(F.sum(used), F.lit(0.0)).alias("used_capacity_gb"),
        F.coalesce(F.sum(F.greatest(F.col("total_gb") - used, F.lit(0.0))), F.lit(0.0)).alias("headroom_gb"),
        F.count(F.lit(1)).alias("volume_count"),
        F.count_if(F.col("used_fraction") >= critical).alias("critical_count"))
    return out.withColumn("used_pct", ratio(F.col("used_capacity_gb") * 100.0, F.col("total_capacity_gb")))


def critical_volumes(volumes: DataFrame, by: str, critical: float = 0.9) -> DataFrame:
    key = F.coalesce(F.col(by).cast("string"), F.lit("Unknown"))
    return volumes.where(F.col("used_fraction") >= critical).select(key.alias(by), "volume_id", "used_fraction")


# --- replicas --------------------------------------------------------------------------

def replica_groups(place: DataFrame, replica: DataFrame) -> DataFrame:
    """(volume_id, group_id, node_id): a replica's group is its primary's."""
    r = replica.select(F.col("replica_id").alias("volume_id"), "primary_id")
    return place.select("volume_id", "node_id").join(r, "volume_id", "left").select(
        "volume_id", F.coalesce("primary_id", "volume_id").alias("group_id"), "node_id")


def validate_migrations(proposals: DataFrame, place: DataFrame, replica: DataFrame) -> DataFrame:
    """Add ``allowed``: no member of the volume's group is on the target already.

    An unknown volume is never allowed.
    """
    groups = replica_groups(place, replica)
    taken = groups.select("group_id", F.col("node_id").alias("target_node")).distinct().withColumn("_taken", F.lit(True))
    out = proposals.join(groups.select("volume_id", "group_id"), "volume_id", "left")
    out = out.join(taken, ["group_id", "target_node"], "left")
    return out.withColumn("allowed", F.col("group_id").isNotNull() & F.col("_taken").isNull()).drop("_taken", "group_id").select(
        *proposals.columns, "allowed")


# --- log over placement -------------------------------------------------------------------

def effective_placement(base: DataFrame, actions: DataFrame) -> DataFrame:
    """Base placement with the newest standing migration, tier change and cap.

    A rolled-back action no longer counts, so the one before it applies again.
    """
    at = F.struct("ts", "action_id")
    standing = actions.where(~F.col("status").isin("rolled_back", "blocked_by_placement", "queued"))

    def newest(kind: str) -> Column:
        return F.max_by("target", F.when(F.col("action") == kind, at))

    last = standing.groupBy("volume_id").agg(
        newest("migrate").alias("_node"), newest("tier_change").alias("_tier"), newest("qos").alias("_cap"))
    out = base.join(last, "volume_id", "left")
    node_type = dict(base.dtypes)["node_id"]
    return out.withColumns({
        "node_id": F.coalesce(F.col("_node").cast(node_type), F.col("node_id")),
        "tier": F.coalesce("_tier", "tier"),
        "iops_limit": F.col("_cap").cast("double"),
    }).drop("_node", "_tier", "_cap")


def override_placement(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """Base placement with the newest override row per volume; NULL fields keep the base."""
    fields = [c for c in overrides.columns if c not in ("volume_id", "ts")]
    last = overrides.groupBy("volume_id").agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("ts", c))).alias(f"_o_{c}") for c in fields])
    out = base.join(last, "volume_id", "left")
    return out.withColumns({
        c: F.coalesce(F.col(f"_o_{c}").cast(dict(base.dtypes)[c]) if c in base.columns else F.col(f"_o_{c}"),
                      *([F.col(c)] if c in base.columns else [])) for c in fields}).drop(*[f"_o_{c}" for c in fields])


def pool_members(place: DataFrame, expansions: DataFrame) -> DataFrame:
    """(pool_id, node_id, added): nodes of each pool, those added by expansion marked."""
    base = place.select("pool_id", "node_id", F.lit(False).alias("added"))
    more = expansions.select("pool_id", "node_id", F.lit(True).alias("added"))
    return base.unionByName(more).groupBy("pool_id", "node_id").agg(F.min("added").alias("added"))
