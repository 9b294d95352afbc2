"""Scenario tables: what a change would do, for all volumes at once.

Scenario lists (capacities, caps, tiers) are short and given as arguments, so
they are exploded from a literal array; migrations come as a table of proposals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.numeric import clip, ratio
from tidewatch.operators.forecast import days_to_fill
from tidewatch.roles import POLICY

# Node limit, transfer speed, relief of the source node, relief per throttled share.
NODE_IOPS_LIMIT = 30000.0
TRANSFER_MB_PER_S = 50.0
SOURCE_RELIEF_PCT = 15.0
NEIGHBOR_RELIEF_PCT = 30.0
# Fixed values: (from, to) -> (latency improvement %, throughput factor).
TIER_GAINS = {("HDD", "SSD"): (80.0, 5.0), ("HDD", "NVMe"): (95.0, 15.0), ("SSD", "NVMe"): (50.0, 3.0)}
SAME_TIER = (0.0, 1.0)
LOWER_TIER = (-100.0, 0.2)


def _scenarios(values: list) -> Column:
    return F.explode(F.array(*[F.lit(v) for v in values]))


def add_capacity(forecasts: DataFrame, added_gb: list[float]) -> DataFrame:
    """Days to fill before and after adding capacity; growth in GB stays the same."""
    out = forecasts.withColumn("added_gb", _scenarios([float(x) for x in added_gb]))
    out = out.withColumn("scaling_factor", F.col("total_gb") / (F.col("total_gb") + F.col("added_gb")))
    k = F.col("scaling_factor")
    out = out.withColumns({
        "_after": F.transform("forecast", lambda v: clip(v * k, 0.0, 1.0)), "_current": F.col("current_pct") * k})
    columns = {}
    for name, thr in (("warning", POLICY["warning_fraction"]), ("critical", POLICY["critical_fraction"])):
        columns[f"dtf_{name}_before"] = days_to_fill(F.col("current_pct"), F.col("forecast"), thr)
        columns[f"dtf_{name}_after"] = days_to_fill(F.col("_current"), F.col("_after"), thr)
    out = out.withColumns(columns)
    gain = F.col("dtf_warning_after") - F.col("dtf_warning_before")
    return out.withColumns({
        "new_total_gb": F.col("total_gb") + F.col("added_gb"), "current_pct_after": F.col("_current"),
        "improvement_days": F.coalesce(gain, F.lit(0.0))}).drop("_after", "_current", "forecast")


def migrations(proposals: DataFrame, volumes: DataFrame, utilization: DataFrame) -> DataFrame:
    """Load on the target and transfer time of proposed moves.

    ``volumes`` has node, IOPS and used GB per volume. A move to the volume's
    own node is not safe.
    """
    load = utilization.select(F.col("node_id").alias("target_node"), F.col("total_iops").alias("_target_iops"))
    v = volumes.select("volume_id", F.col("node_id").alias("source_node"),
                       F.coalesce("total_iops", F.lit(1000.0)).alias("_iops"),
                       F.coalesce("capacity_used_gb", F.lit(500.0)).alias("_gb"))
    out = proposals.join(v, "volume_id").join(load, "target_node")
    other = F.col("source_node") != F.col("target_node")
    return out.select(
        *proposals.columns, "source_node",
        (other & (F.col("_target_iops") + F.col("_iops") < NODE_IOPS_LIMIT)).alias("safe"),
        F.when(other, F.lit(SOURCE_RELIEF_PCT)).alias("source_improvement_pct"),
        (F.col("_iops") / NODE_IOPS_LIMIT * 100).alias("target_increase_pct"),
        F.floor(F.col("_gb") * 1024 / TRANSFER_MB_PER_S).alias("transfer_seconds"),
        F.when(~other, "already on the target node").when(
            F.col("_target_iops") + F.col("_iops") >= NODE_IOPS_LIMIT, "target node would overflow").alias("reason"))


def iops_caps(volumes: DataFrame, caps: list[float]) -> DataFrame:
    """Throttled share and neighbour relief for each cap."""
    out = volumes.withColumn("iops_limit", _scenarios([float(c) for c in caps]))
    iops = F.coalesce("total_iops", F.lit(1000.0))
    share = F.greatest(ratio(iops - F.col("iops_limit"), iops), F.lit(0.0))
    return out.select("volume_id", "iops_limit", iops.alias("current_iops"), (share * 100).alias("throttling_pct"),
                      (share * NEIGHBOR_RELIEF_PCT).alias("neighbor_relief_pct"))


def tier_changes(volumes: DataFrame, tiers: list[str]) -> DataFrame:
    """Expected latency and throughput change per target tier."""
    out = volumes.select("volume_id", F.coalesce("tier", F.lit("HDD")).alias("current_tier")).withColumn("new_tier", _scenarios(tiers))
    now, new = F.col("current_tier"), F.col("new_tier")

    def lookup(i: int) -> Column:
        c = F.when(now == new, SAME_TIER[i])
        for (a, b), gain in TIER_GAINS.items():
            c = c.when((now == a) & (new == b), gain[i])
        return c.otherwise(LOWER_TIER[i])

    return out.withColumns({"latency_improvement_pct": lookup(0), "throughput_factor": lookup(1)})
