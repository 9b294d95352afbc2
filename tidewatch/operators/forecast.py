"""Capacity, latency and demand forecasts as distributed per-entity statistics.

The contracts (lookback, horizon, thresholds, outputs) are those of a trained
forecaster; the model is a trend or a seasonal quantile that Spark fits for all
entities at once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions import arrays
from tidewatch.functions.linear import solve_symmetric
from tidewatch.functions.numeric import clip
from tidewatch.functions.times import floor_hour
from tidewatch.operators.features import apply_scale, fit_standard_scale
from tidewatch.operators.quantile_regression import CALENDAR, fit_quantiles, predict_quantiles, with_calendar
from tidewatch.operators.quantiles import quantile_rows
from tidewatch.operators.ranking import category_rank
from tidewatch.operators.summaries import densify, end_of_day, hourly_means
from tidewatch.roles import DEFAULT_ROLES, POLICY, Roles
from tidewatch.session import stage

LOOKBACK_DAYS = 20
HORIZON_DAYS = 60
LOOKBACK_HOURS = 24
HORIZON_HOURS = 6
RATE_STEPS = 6
WEEK = 7
#: Added to the moments of the weekly wave.
WAVE_RIDGE = 0.5
#: Coefficients of the weekly wave.
WAVE = ["c0", "c1", "c2", "c3"]

# The metrics of the hourly latency series, the target last.
HOURLY_METRICS = [
    "read_iops", "write_iops", "read_throughput_mbps", "write_throughput_mbps",
    "queue_depth", "sequential_ratio", "latency_p95_us",
]
# Order of capacity severities, most urgent first.
CAPACITY_SEVERITIES = ["breached", "critical", "warning", "normal", "safe"]
# Order of latency risk levels, most urgent first.
RISK_LEVELS = ["critical", "high", "medium", "low", "none"]


# --- capacity -------------------------------------------------------------------------

def recent_daily_capacity(df: DataFrame, roles: Roles = DEFAULT_ROLES, days: int = LOOKBACK_DAYS) -> DataFrame:
    """The last ``days`` days per entity, gaps filled from the last value before.

    Days before the lookback collapse onto its first day (newest value wins), so
    only the lookback is ever filled in.
    """
    columns = ["capacity_used_pct", "capacity_total_gb"]
    eod = end_of_day(df, columns, roles)
    w = W.partitionBy(roles.entity)
    start = F.greatest(F.min("day").over(w), F.max("day").over(w) - F.make_dt_interval(F.lit(days - 1)))
    # rows without an entity have no lookback
    clamped = eod.where(F.col(roles.entity).isNotNull()).withColumn("_day", F.greatest("day", start))
    recent = clamped.groupBy(roles.entity, F.col("_day")).agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col("day"))).alias(c) for c in columns]).withColumnRenamed("_day", "day")
    return densify(recent, columns, "1 DAY", "day", roles.entity)


def capacity_trend(daily: DataFrame, entity: str = "volume_id") -> DataFrame:
    """Least-squares line per entity over a daily series, and its last value."""
    first = F.min("day").over(W.partitionBy(entity))
    x = F.datediff(F.col("day"), first).cast("double")
    return daily.withColumn("_x", x).groupBy(entity).agg(
        F.coalesce(F.regr_slope("capacity_used_pct", "_x"), F.lit(0.0)).alias("slope"),
        F.coalesce(F.regr_intercept("capacity_used_pct", "_x"), F.max("capacity_used_pct")).alias("intercept"),
        F.max("_x").alias("last_x"), F.max_by("capacity_used_pct", "day").alias("current_pct"),
        F.max_by("capacity_total_gb", "day").alias("total_gb"))


def _weekly(x: Column) -> list[Column]:
    """The basis of a trend with a weekly wave at day ``x``."""
    angle = F.lit(2 * math.pi / WEEK) * x
    return [F.lit(1.0), x, F.sin(angle), F.cos(angle)]


def capacity_wave(daily: DataFrame, entity: str = "volume_id") -> DataFrame:
    """Trend and weekly wave per entity over a daily series, by least squares from moment sums.

    ``c0 .. c3`` are the level, the slope and the wave's two parts. The wave is held back by
    ``WAVE_RIDGE`` in its moments, so that a series of a few days is close to a line.
    """
    first = F.min("day").over(W.partitionBy(entity))
    basis = [f"_b{i}" for i in range(4)]
    rows = daily.withColumn("_x", F.datediff(F.col("day"), first).cast("double")).where(F.col("capacity_used_pct").isNotNull())
    rows = rows.withColumns(dict(zip(basis, _weekly(F.col("_x")))))
    ridge = [0.0, 1e-9, WAVE_RIDGE, WAVE_RIDGE]
    moments = {f"_h{i}_{j}": F.sum(F.col(basis[i]) * F.col(basis[j])) + (ridge[i] if i == j else 0.0) for i in range(4) for j in range(i + 1)}
    moments |= {f"_s{i}": F.sum(F.col(basis[i]) * F.col("capacity_used_pct")) for i in range(4)}
    sums = rows.groupBy(entity).agg(
        *[e.alias(n) for n, e in moments.items()], F.max("_x").alias("last_x"),
        F.max_by("capacity_used_pct", "day").alias("current_pct"), F.max_by("capacity_total_gb", "day").alias("total_gb"))
    out = solve_symmetric(sums, [[f"_h{i}_{j}" for j in range(i + 1)] for i in range(4)], [f"_s{i}" for i in range(4)], WAVE)
    return out.drop(*moments)


def capacity_forecast(daily: DataFrame, horizon: int = HORIZON_DAYS, entity: str = "volume_id", model: str = "trend") -> DataFrame:
    """Add ``forecast``: used fraction for each of the next ``horizon`` days, within 0-1.

    ``model`` is ``trend`` (a line) or ``wave`` (a line and a weekly wave).
    """
    if model not in ("trend", "wave"):
        raise ValueError(f"no capacity model {model!r}")
    if model == "trend":
        t = capacity_trend(daily, entity)
        value = lambda f, x: f["intercept"] + f["slope"] * x
    else:
        t = capacity_wave(daily, entity)
        value = lambda f, x: sum((f[c] * b for c, b in zip(WAVE[1:], _weekly(x)[1:])), f["c0"])
    # the fit is bound once for all days: a lambda would work its expressions out again for each
    fit = F.struct("last_x", *[c for c in t.columns if c in ("intercept", "slope") or c in WAVE])
    curve = F.transform(F.array(fit), lambda f: F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda k: clip(value(f, f["last_x"] + k), 0.0, 1.0)))
    return t.withColumn("forecast", curve[0])


def capacity_backtest(daily: DataFrame, hold: int = WEEK, entity: str = "volume_id") -> DataFrame:
    """Mean absolute error of both models over each entity's last ``hold`` days, forecast from the days before.

    Entities without an earlier day have no row.
    """
    last = F.max("day").over(W.partitionBy(entity))
    # a few days per entity, read by both fits and by the check
    marked = stage(daily.where(F.col(entity).isNotNull()).withColumn("_ahead", F.lit(hold) - F.datediff(last, F.col("day"))), "backtest")
    before, after = marked.where("_ahead <= 0"), marked.where("_ahead > 0").select(entity, "_ahead", "capacity_used_pct")
    curves = None
    for model in ("trend", "wave"):
        # a gap at the end of the earlier days must not shift the forecast: days are densified before
        c = capacity_forecast(before, hold, entity, model).select(entity, F.lit(model).alias("model"), F.posexplode("forecast").alias("_k", "told"))
        curves = c if curves is None else curves.unionByName(c)
    met = curves.join(after, [curves[entity] == after[entity], curves["_k"] + 1 == after["_ahead"]]).select(curves[entity], "model", F.abs(F.col("told") - F.col("capacity_used_pct")).alias("error"))
    return met.groupBy(entity, "model").agg(F.avg("error").alias("mae"), F.count(F.lit(1)).alias("days"))


def days_to_fill(current: Column, forecast: Column, threshold: float | Column) -> Column:
    """Days until a curve reaches ``threshold``.

    0 if it is there already; between days by interpolation; beyond the horizon
    at the median of the last daily steps; NULL if that is not rising.
    """
    thr = F.lit(threshold) if not isinstance(threshold, Column) else threshold
    i = arrays.first_index_at_least(forecast, thr)
    at = F.get(forecast, i.cast("int"))
    before = F.when(i > 0, F.get(forecast, (i - 1).cast("int"))).otherwise(current)
    rate = arrays.median(arrays.steps(arrays.last_n(forecast, RATE_STEPS + 1)))
    beyond = F.size(forecast) + (thr - F.element_at(forecast, -1)) / F.when(rate > 0, rate)
    return (F.when(current >= thr, 0.0).when(i >= 0, i + (thr - before) / (at - before + 1e-9)).otherwise(beyond))


def days_to_fill_coarse(forecast: Column, threshold: float) -> Column:
    """Index of the first forecast day at the threshold, NULL if none."""
    i = arrays.first_index_at_least(forecast, threshold)
    return F.when(i >= 0, i.cast("double"))


def days_severity(days: Column) -> Column:
    return (F.when(days.isNull(), "safe").when(days <= 0, "breached").when(days < POLICY["dtf_critical_days"], "critical")
            .when(days < POLICY["dtf_warning_days"], "warning").otherwise("normal"))


def capacity_report(daily: DataFrame, entity: str = "volume_id", model: str = "trend") -> DataFrame:
    """Days to fill, severity, advice and the 7- and 30-day curves per entity."""
    f = capacity_forecast(daily, entity=entity, model=model)
    warn, crit = F.col("dtf_warning_days"), F.col("dtf_critical_days")
    out = f.withColumns({
        "dtf_warning_days": days_to_fill(F.col("current_pct"), F.col("forecast"), POLICY["warning_fraction"]),
        "dtf_critical_days": days_to_fill(F.col("current_pct"), F.col("forecast"), POLICY["critical_fraction"])})
    first = days_severity(crit)
    out = out.withColumn("severity", F.when(first.isin("normal", "safe"), days_severity(warn)).otherwise(first))
    name = F.col(entity).cast("string")

    def whole_days(c: Column) -> Column:
        return F.when(c > 0, F.floor(c).cast("string")).otherwise("?")

    advice = (
        F.when(F.col("severity") == "breached",
               F.format_string("%s is over its capacity threshold: expand it or move cold data to a slower tier now.", name))
        .when(F.col("severity") == "critical",
              F.format_string("%s reaches its capacity limit in %s days: add capacity now or move cold data.", name, F.coalesce(whole_days(crit), F.lit("?"))))
        .when(F.col("severity") == "warning",
              F.format_string("%s needs more capacity in about %s days.", name, F.coalesce(whole_days(warn), F.lit("?"))))
        .otherwise(F.format_string("%s has enough capacity.", name)))
    return out.withColumns({
        "recommendation": advice, "forecast_7d": F.slice("forecast", 1, 7), "forecast_30d": F.slice("forecast", 1, 30)})


def by_capacity_urgency(report: DataFrame, entity: str = "volume_id") -> DataFrame:
    return report.orderBy(category_rank("severity", CAPACITY_SEVERITIES), F.col("dtf_critical_days").asc_nulls_last(), entity)


def severity_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


# --- latency --------------------------------------------------------------------------

def hourly_latency(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Hourly means of the seven metrics; the target is the worse p95."""
    tail = df.withColumn("latency_p95_us", F.greatest("read_latency_p95_us", "write_latency_p95_us"))
    return hourly_means(tail, HOURLY_METRICS, roles, ("latency_p95_us",))


def scaled_hourly(hourly: DataFrame, metrics: list[str] = HOURLY_METRICS, hold: int = 72,
                  entity: str = "volume_id") -> DataFrame:
    """Standard-scale an hourly series, fitted without each entity's last ``hold`` hours.

    A series no longer than that is fitted whole.
    """
    w = W.partitionBy(entity)
    marked = hourly.withColumns({
        "_from_end": F.row_number().over(w.orderBy(F.col("hour").desc())), "_n": F.count(F.lit(1)).over(w)})
    fit = fit_standard_scale(marked.where((F.col("_from_end") > hold) | (F.col("_n") <= hold)), metrics)
    return apply_scale(hourly, fit, metrics)


def seasonal_quantiles(df: DataFrame, value: str, probs: dict[str, float], ts: str, entity: str = "volume_id",
                       method: str = "exact") -> DataFrame:
    """Quantiles per entity and hour of day, and per entity (``hour_of_day`` NULL)."""
    rows = df.select(entity, F.hour(ts).alias("hour_of_day"), value)
    both = rows.unionByName(rows.withColumn("hour_of_day", F.lit(None).cast("int")))
    # -1 stands for "all hours": NULL keys would not join.
    keyed = both.withColumn("hour_of_day", F.coalesce("hour_of_day", F.lit(-1)))
    q = quantile_rows(keyed, [entity, "hour_of_day"], value, list(probs.values()), method)
    return q.groupBy(entity, "hour_of_day").agg(*[
        F.max(F.when(F.col("prob") == float(p), F.col("quantile"))).alias(n) for n, p in probs.items()])


def forecast_hours(entities: DataFrame, start: Column, hours: int) -> DataFrame:
    """One row per entity and coming hour, from ``start`` on; ``step`` counts from 0."""
    return entities.select("*", F.posexplode(F.sequence(
        start, start + F.make_dt_interval(hours=F.lit(hours - 1)), F.expr("INTERVAL 1 HOUR"))).alias("step", "forecast_hour"))


def seasonal_forecast(df: DataFrame, value: str, probs: dict[str, float], start: Column, hours: int, ts: str,
                      entity: str = "volume_id", method: str = "exact") -> DataFrame:
    """Seasonal quantiles laid onto the coming hours; hours never seen use all hours."""
    q = seasonal_quantiles(df, value, probs, ts, entity, method)
    whole = q.where("hour_of_day = -1").select(entity, *[F.col(n).alias(f"_all_{n}") for n in probs])
    grid = forecast_hours(whole, start, hours).withColumn("hour_of_day", F.hour("forecast_hour"))
    out = grid.join(q, [entity, "hour_of_day"], "left")
    return out.select(entity, "step", "forecast_hour", *[F.coalesce(n, f"_all_{n}").alias(n) for n in probs])


def repair_crossing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Quantiles in ascending order and not below 0."""
    s = F.sort_array(F.array(*columns))
    return df.withColumn("_s", s).withColumns({
        c: F.greatest(F.col("_s")[i], F.lit(0.0)) for i, c in enumerate(columns)}).drop("_s")


LATENCY_PROBS = {"p50": 0.5, "p90": 0.9, "p95": 0.95}


def latency_forecast(df: DataFrame, start: Column, value: str = "latency_p95_us", ts: str = "hour",
                     entity: str = "volume_id", hours: int = HORIZON_HOURS, method: str = "exact") -> DataFrame:
    """p50, p90 and p95 latency per entity for the coming hours."""
    return repair_crossing(seasonal_forecast(df, value, LATENCY_PROBS, start, hours, ts, entity, method), list(LATENCY_PROBS))


def forecast_arrays(long: DataFrame, columns: list[str], entity: str = "volume_id") -> DataFrame:
    """A long forecast as one array per column, in step order (at most the horizon)."""
    rows = F.sort_array(F.collect_list(F.struct(F.col("step").alias("_k"), *columns)))
    out = long.groupBy(entity).agg(rows.alias("_f"))
    return out.select(entity, *[F.col(f"_f.{c}").alias(c) for c in columns])


def pinball_loss(df: DataFrame, actual: str, quantiles: dict[str, float]) -> DataFrame:
    """Mean quantile loss, one row per quantile column."""
    def loss(c: str, q: float) -> Column:
        e = F.col(actual) - F.col(c)
        return F.avg(F.greatest((q - 1) * e, q * e))

    one = df.agg(*[loss(c, q).alias(f"_l{i}") for i, (c, q) in enumerate(quantiles.items())])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("quantile"), F.col(f"_l{i}").alias("loss")) for i, c in enumerate(quantiles)])).alias("_e")).select("_e.*")


def latency_risk(peak: Column, slo: float = POLICY["latency_slo_us"]) -> dict[str, Column]:
    """Risk score (1 at the objective), and severity at 1 and 1.5 times it."""
    return {
        "risk_score": F.when(peak >= slo, 1.0).otherwise(peak / slo),
        "severity": F.when(peak >= 1.5 * slo, "critical").when(peak >= slo, "warning").otherwise("normal")}


def time_to_violation(p95: Column, slo: float = POLICY["latency_slo_us"], step_hours: float = 1.0) -> dict[str, Column]:
    """When a p95 forecast first reaches the objective, with the risk level."""
    i = arrays.first_index_at_least(p95, slo)
    at, before = F.get(p95, i.cast("int")), F.get(p95, (i - 1).cast("int"))
    hours = F.when(i == 0, 0.0).when(i > 0, (i - 1 + (slo - before) / (at - before + 1e-9)) * step_hours)
    top = F.coalesce(F.array_max(p95), F.lit(0.0))
    risk = (F.when(hours.isNull(), "none").when(hours < 1, "critical").when(hours < 3, "high")
            .when(hours < 5, "medium").otherwise("low"))
    return {
        "will_breach": i >= 0, "hours_to_breach": hours, "breach_at_step": F.when(i >= 0, i),
        "max_p95_us": top, "headroom_us": F.lit(slo) - top, "risk_level": risk}


def latency_summary(long: DataFrame, slo: float = POLICY["latency_slo_us"], entity: str = "volume_id") -> DataFrame:
    """Peak of each quantile per entity, severity and advice."""
    peaks = long.groupBy(entity).agg(*[F.max(c).alias(f"{c}_peak") for c in LATENCY_PROBS])
    out = peaks.withColumns(latency_risk(F.col("p95_peak"), slo))
    return out.withColumn("action", F.when(F.col("severity") == "critical", "relocate busy volumes")
                          .when(F.col("severity") == "warning", "balance the load").otherwise("none"))


# --- demand ---------------------------------------------------------------------------

DEMAND_PROBS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def demand_forecast(df: DataFrame, start: Column, metrics: list[str], ts: str = "ts", entity: str = "volume_id",
                    hours: int = 24, min_rows: int = 10, method: str = "exact") -> DataFrame:
    """p50, p95 and p99 of each metric per entity for the coming hours, not below 0.

    Entities with fewer than ``min_rows`` samples get no forecast.
    """
    enough = df.groupBy(entity).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows).select(entity)
    rows = df.join(enough, entity, "left_semi")
    out = None
    for m in metrics:
        f = repair_crossing(seasonal_forecast(rows, m, DEMAND_PROBS, start, hours, ts, entity, method), list(DEMAND_PROBS))
        f = f.select(entity, "step", "forecast_hour", *[F.col(p).alias(f"{m}_{p}") for p in DEMAND_PROBS])
        out = f if out is None else out.join(f, [entity, "step", "forecast_hour"])
    return out


def demand_peaks(long: DataFrame, metrics: list[str], entity: str = "volume_id") -> DataFrame:
    return long.groupBy(entity).agg(*[F.max(f"{m}_p99").alias(f"peak_{m}") for m in metrics])


def next_hour(df: DataFrame, ts: str = "ts") -> Column:
    """The hour after the newest row, as a scalar: forecasts start there."""
    newest = df.agg(F.max(ts).alias("_t")).select(floor_hour("_t").alias("_t"))
    return newest.scalar() + F.expr("INTERVAL 1 HOUR")



def demand_regression(df: DataFrame, start: Column, metrics: list[str], ts: str = "ts", entity: str = "volume_id",
                      hours: int = 24, min_rows: int = 10, fits: DataFrame | None = None) -> DataFrame:
    """p50, p95 and p99 of each metric per entity for the coming hours, from a quantile regression on the calendar.

    Linear in the cyclic hour and weekday, ordered and not below 0. ``fits`` takes the
    coefficients of an earlier run.
    """
    if fits is None:
        fits = fit_quantiles(with_calendar(df, ts), metrics, list(DEMAND_PROBS.values()), CALENDAR, entity, min_rows)
    grid = with_calendar(forecast_hours(fits.select(entity).distinct(), start, hours), "forecast_hour")
    told = predict_quantiles(grid, fits, CALENDAR, entity)
    wide = told.groupBy(entity, "step", "forecast_hour").agg(*[
        F.max(F.when((F.col("metric") == m) & (F.col("prob") == p), F.col("value"))).alias(f"{m}_{n}") for m in metrics for n, p in DEMAND_PROBS.items()])
    for m in metrics:
        wide = repair_crossing(wide, [f"{m}_{n}" for n in DEMAND_PROBS])
    return wide
