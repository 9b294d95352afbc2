"""Column roles and the fixed values shared by all operators.

Operators never hard-code a table: they take a :class:`Roles` that names the
entity, time and group columns, so the same operator runs on storage telemetry
and on any other time-stamped table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Roles:
    entity: str = "volume_id"
    ts: str = "ts"
    group: str = "node_id"
    #: Further columns that make the time order total when (entity, ts) repeats.
    ties: tuple[str, ...] = ()

    @property
    def order(self) -> list[str]:
        return [self.ts, *self.ties]


DEFAULT_ROLES = Roles()


def require_columns(df: DataFrame, columns) -> None:
    """Raise ``ValueError`` naming the columns that ``df`` lacks."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")


# Workload classes and their integer labels.
LABELS = {"DB_OLTP": 0, "VM": 1, "Backup": 2, "AI_Training": 3, "AI_Inference": 4}

# The five metrics the statistical detector watches.
DETECTOR_METRICS = [
    "total_iops",
    "avg_latency_us",
    "total_throughput_mbps",
    "read_latency_p99_us",
    "write_latency_p99_us",
]

# Columns left out of a feature matrix. They identify a row, leak
# the capacity of one volume, or reveal the split.
NON_FEATURE_COLUMNS = [
    "workload_type", "volume_id", "node_id", "pool_id", "tier", "timestamp",
    "capacity_total_gb", "capacity_headroom_gb", "capacity_used_gb",
    "capacity_used_pct", "capacity_burn_rate",
    "capacity_used_pct_lag_5m", "capacity_used_pct_lag_15m",
    "capacity_used_pct_lag_30m", "capacity_used_pct_lag_60m",
    "capacity_used_pct_delta", "capacity_used_pct_pct_change",
    "day_of_month",
]

# Default policy thresholds.
POLICY = {
    "min_hotspot_score": 75.0,
    "min_hotspot_minutes": 2.0,
    "max_moves_per_hour": 3,
    "max_concurrent": 1,
    "iops_cap": 3000.0,
    "rollback_increase_pct": 20.0,
    "rollback_timeout_minutes": 5.0,
    "max_rollback_rate_pct": 1.0,
    "breaker_min_actions": 10,
    "warning_fraction": 0.85,
    "critical_fraction": 0.95,
    "dtf_warning_days": 30.0,
    "dtf_critical_days": 7.0,
    "latency_slo_us": 8000.0,
    "autoscale_warning_days": 7.0,
    "autoscale_capacity_pct": 85.0,
    "autoscale_max_new": 1,
    "autoscale_min_interval_hours": 24,
}
