"""Statistical hotspot detector: z-scores against the preceding day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.numeric import clip, severity
from tidewatch.operators.windows import rolling_baseline
from tidewatch.roles import DEFAULT_ROLES, DETECTOR_METRICS, Roles, require_columns

# Weights of latency, IOPS and throughput, and the z that scores 100.
WEIGHTS = {"latency": 0.5, "iops": 0.3, "throughput": 0.2}
FULL_SCALE_Z = 7.0
LATENCY_METRICS = ["avg_latency_us", "read_latency_p99_us", "write_latency_p99_us"]


def z_columns(metrics: list[str] = DETECTOR_METRICS) -> dict[str, Column]:
    """z per metric; 0 without a baseline or on a flat one."""
    out = {}
    for m in metrics:
        std = F.col(f"{m}_base_std")
        out[f"{m}_z"] = F.when(std >= 1e-6, (F.col(m) - F.col(f"{m}_base_mean")) / std).otherwise(F.lit(0.0))
    return out


def hotspot_scores(df: DataFrame, roles: Roles = DEFAULT_ROLES, rows: int = 288, min_rows: int = 12,
                   **kw) -> DataFrame:
    """z-scores and the 0-100 hotspot score of every row."""
    require_columns(df, [roles.entity, roles.ts, *DETECTOR_METRICS])
    out = rolling_baseline(df, DETECTOR_METRICS, roles, rows, min_rows, **kw).withColumns(z_columns())
    latency = F.greatest(*[F.col(f"{m}_z") for m in LATENCY_METRICS])
    weighted = (
        WEIGHTS["latency"] * latency + WEIGHTS["iops"] * F.col("total_iops_z")
        + WEIGHTS["throughput"] * F.col("total_throughput_mbps_z")
    )
    return out.withColumn("latency_z", latency).withColumn(
        "hotspot_score", clip(weighted / FULL_SCALE_Z * 100, 0.0, 100.0))


def triggered_metrics(sigma: float = 3.0) -> Column:
    return F.filter(
        F.array(*[F.when(F.col(f"{m}_z") > sigma, F.lit(m)) for m in DETECTOR_METRICS]),
        lambda m: m.isNotNull())


def hotspot_alerts(scored: DataFrame, roles: Roles = DEFAULT_ROLES, threshold: float = 40.0,
                   sigma: float = 3.0) -> DataFrame:
    """Rows at or over the threshold with severity, triggered metrics and details."""
    return scored.where(F.col("hotspot_score") >= threshold).select(
        roles.entity, roles.ts, "hotspot_score", severity(F.col("hotspot_score")).alias("severity"),
        triggered_metrics(sigma).alias("triggered_metrics"),
        F.struct(
            F.col("latency_z").alias("latency_z_score"), F.col("total_iops_z").alias("iops_z_score"),
            F.col("total_throughput_mbps_z").alias("throughput_z_score"),
            F.col("avg_latency_us").alias("current_latency_us"),
            F.col("avg_latency_us_base_mean").alias("baseline_latency_us"),
        ).alias("details"))
