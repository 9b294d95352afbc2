"""The served result tables, built from operator outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.numeric import severity
from tidewatch.operators.ranking import by_category, by_urgency, top
from tidewatch.operators.sets import unpivot
from tidewatch.operators.summaries import action_summary, fleet_kpi
from tidewatch.operators.windows import last_rows
from tidewatch.roles import DEFAULT_ROLES, POLICY, Roles

# Order of recommendation priorities.
PRIORITIES = ["CRITICAL", "HIGH", "WARNING", "MEDIUM"]
# Published targets.
TARGETS = {"accuracy_target_pct": 95.0, "variance_reduction_target_pct": 30.0}
HISTORY_COLUMNS = [
    "read_iops", "write_iops", "total_iops", "read_throughput_mbps", "write_throughput_mbps",
    "avg_latency_us", "read_latency_p95_us", "write_latency_p95_us", "queue_depth", "capacity_used_pct",
]


def kpi(rows: DataFrame, actions: DataFrame) -> DataFrame:
    """One row for the fleet: load of the given rows, action outcomes, targets."""
    acts = action_summary(actions).select(F.struct("total_actions", "rolled_back_count", "rollback_rate_pct").alias("a")).scalar()
    return fleet_kpi(rows).withColumn("_a", acts).select(
        "avg_latency_us", "total_iops", "n_rows", "_a.*", *[F.lit(v).alias(k) for k, v in TARGETS.items()])


def volume_list(analysis: DataFrame, latest: DataFrame) -> DataFrame:
    """Score and class beside the newest metrics; volumes not seen live show 0."""
    live = latest.select("volume_id", F.col("total_iops").alias("current_iops"), F.col("avg_latency_us").alias("current_latency_us"),
                         F.col("ts").alias("last_seen"))
    out = analysis.join(live, "volume_id", "left")
    return out.select(
        "volume_id", "hotspot_score", "workload_type", F.coalesce("tier", F.lit("HDD")).alias("tier"), "capacity_used_pct", "risk_score",
        F.coalesce("current_iops", F.lit(0.0)).alias("current_iops"), F.coalesce("current_latency_us", F.lit(0.0)).alias("current_latency_us"),
        F.coalesce("last_seen", "ts").alias("last_seen"), F.col("last_seen").isNotNull().alias("is_live"))


def volume_history(df: DataFrame, limit: int = 100, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """The newest ``limit`` (1-500) rows per volume, missing metrics as 0, oldest first."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    have = [c for c in HISTORY_COLUMNS if c in df.columns]
    rows = last_rows(df.select(roles.entity, *roles.order, *have), limit, roles)
    return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in have}).orderBy(roles.entity, *roles.order)


def alerts(analysis: DataFrame, threshold: float = 40.0) -> DataFrame:
    hot = analysis.where(F.col("hotspot_score") >= threshold)
    return hot.select("volume_id", "hotspot_score", severity(F.col("hotspot_score")).alias("severity"), "workload_type", "ts").orderBy(
        F.col("hotspot_score").desc(), "volume_id")


def noisy_neighbors(pairs: DataFrame, analysis: DataFrame) -> DataFrame:
    """One row per aggressor and victim: times seen and impact, with the aggressor's score and class."""
    per = pairs.groupBy("aggressor_id", "victim_id").agg(F.sum("impact").alias("impact"), F.count(F.lit(1)).alias("times"))
    a = analysis.select(F.col("volume_id").alias("aggressor_id"), "hotspot_score", "workload_type")
    return per.join(a, "aggressor_id", "left")


def capacity_urgency(analysis: DataFrame) -> DataFrame:
    return by_urgency(analysis.select("volume_id", "warning_days", "critical_days"), "critical_days", ["volume_id"])


def violation_urgency(violations: DataFrame) -> DataFrame:
    return by_category(violations, "risk_level", ["critical", "high", "medium", "low", "none"],
                       [F.col("hours_to_breach").asc_nulls_last(), "volume_id"])


def one_tier(headroom: DataFrame, tier: str) -> DataFrame:
    """The headroom of one tier; an unknown tier is an error that names the known ones."""
    found = headroom.where(F.col("tier") == tier)
    if found.isEmpty():
        known = sorted(r["tier"] for r in headroom.select("tier").collect())  # a handful of tiers
        raise KeyError(f"tier {tier!r} not found; known tiers: {known}")
    return found


def recommendations(analysis: DataFrame, tier_headroom: DataFrame, risk_rule: bool = False) -> DataFrame:
    """Rules over capacity, hotspots, latency and tiers; most urgent first.

    ``risk_rule`` replaces the time-to-violation rule by one on the risk score.
    """
    def rule(when, priority, message):
        p = F.lit(priority) if isinstance(priority, str) else priority
        return F.when(when, F.struct(p.alias("priority"), message.alias("message")))

    def found(df: DataFrame, rules: list) -> DataFrame:
        """The rules that hold for each row, out of one pass over the rows."""
        hold = F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull()))
        return df.select(F.col("volume_id").cast("string").alias("volume_id"), hold.alias("_r")).select("volume_id", "_r.*")

    crit, warn = F.col("critical_days"), F.col("warning_days")
    full = F.coalesce(crit < POLICY["dtf_critical_days"], F.lit(False))
    soon = ~full & F.coalesce(warn < POLICY["dtf_warning_days"], F.lit(False))
    rules = [
        rule(full, "CRITICAL", F.format_string("Capacity limit reached in %.1f days: expand or move cold data now.", crit)),
        rule(soon, "WARNING", F.format_string("Capacity warning level reached in %.1f days: plan an expansion.", warn)),
        rule(F.col("hotspot_score") >= 80, "HIGH", F.format_string("Active hotspot, score %.2f.", F.col("hotspot_score"))),
    ]
    if risk_rule:
        rules.append(rule(F.col("risk_score") >= 0.8, "MEDIUM", F.format_string("High risk of a latency breach (%.1f%%).", F.col("risk_score") * 100)))
    else:
        risk = F.col("risk_level")
        rules.append(rule(risk == "critical", "CRITICAL",
                          F.format_string("Latency objective broken within the hour, peak p95 %.0f us: cap or move now.", F.col("max_p95_us"))))
        rules.append(rule(risk.isin("high", "medium"), F.when(risk == "high", "HIGH").otherwise("MEDIUM"),
                          F.format_string("Latency objective broken in %.1f h, peak p95 %.0f us: consider a move or a cap.",
                                          F.col("hours_to_breach"), F.col("max_p95_us"))))
    text = F.format_string("Tier %s is %.1f%% full, %.0f GB left.", F.col("tier"), F.col("used_pct"), F.col("headroom_gb"))
    tiers = found(tier_headroom.withColumn("volume_id", F.lit("CLUSTER")),
                  [rule(F.col("used_pct") >= 80, F.when(F.col("used_pct") >= 90, "CRITICAL").otherwise("WARNING"), text)])
    return by_category(found(analysis, rules).unionByName(tiers), "priority", PRIORITIES, ["volume_id", "message"])


def score_breakdown(scored: DataFrame, k: int = 3) -> DataFrame:
    """The detector scores of the ``k`` hottest rows in long form."""
    best = top(scored, k, "ensemble_score", ["volume_id"])
    return unpivot(best, ["volume_id"], ["stat_score", "forest_score", "sequence_score", "ensemble_score"])


def analysis_record(base: DataFrame, victims: DataFrame, latency: DataFrame, demand: DataFrame) -> DataFrame:
    """One nested record per volume: scores, days, violation, forecasts.

    Victim impacts stay a table of their own (a volume may have any number);
    the record carries their count and sum. Forecast arrays have the horizon's length.
    """
    per = victims.groupBy(F.col("aggressor_id").alias("volume_id")).agg(
        F.count_distinct("victim_id").alias("n_victims"), F.sum("impact").alias("victim_impact"))
    out = base.join(per, "volume_id", "left").join(latency, "volume_id", "left").join(demand, "volume_id", "left")
    return out.select(
        "volume_id", "ts", "workload_type", "hotspot_score",
        F.struct(F.coalesce("n_victims", F.lit(0)).alias("count"), F.coalesce("victim_impact", F.lit(0.0)).alias("impact")).alias("neighbor_victims"),
        F.struct("warning_days", "critical_days").alias("days_to_fill"),
        F.struct("p50", "p90", "p95").alias("latency_forecast"),
        F.struct("total_iops_p50", "total_iops_p95", "total_iops_p99").alias("demand_forecast"),
        F.struct("will_breach", "hours_to_breach", "max_p95_us", "risk_level").alias("time_to_violation"), "risk_score")


def volume_forecasts(latency: DataFrame, demand: DataFrame, volume) -> DataFrame:
    """Latency and demand forecast of one volume; no demand forecast is an error."""
    d = demand.where(F.col("volume_id") == volume)
    if d.isEmpty():
        raise LookupError(f"no demand forecast for volume {volume}")
    return d.join(latency.where(F.col("volume_id") == volume), ["volume_id"], "left")
