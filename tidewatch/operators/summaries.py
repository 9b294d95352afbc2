"""Aggregations: baselines, distributions, resampling, confusion counts."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.numeric import ratio
from tidewatch.functions.times import day_start, round_hour
from tidewatch.operators.quantiles import quantile_table, same
from tidewatch.roles import DEFAULT_ROLES, Roles
from tidewatch.session import stage


def entity_baseline(df: DataFrame, roles: Roles = DEFAULT_ROLES, latency: str = "avg_latency_us",
                    iops: str = "total_iops", min_rows: int = 30, min_std: float = 1.0) -> DataFrame:
    """Mean and sample deviation per entity over all time, deviation at least ``min_std``."""
    def floor_std(c: str) -> Column:
        return F.greatest(F.coalesce(F.stddev_samp(c), F.lit(min_std)), F.lit(min_std))

    return df.groupBy(roles.entity).agg(
        F.avg(latency).alias("lat_mean"), floor_std(latency).alias("lat_std"), F.count(latency).alias("lat_n"),
        F.avg(iops).alias("iops_mean"), floor_std(iops).alias("iops_std"), F.count(iops).alias("iops_n"),
    ).where(F.least("lat_n", "iops_n") >= min_rows)


def end_of_day(df: DataFrame, columns: list[str], roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Last non-NULL value of each column per entity and day."""
    at = F.struct(*roles.order)
    return df.groupBy(roles.entity, day_start(roles.ts).alias("day")).agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns])


def densify(series: DataFrame, columns: list[str], step: str, time: str = "day",
            entity: str = "volume_id", backfill: bool = True) -> DataFrame:
    """One row per entity and step between its first and last, gaps filled forward.

    The input is a per-step aggregate, so a window holds at most one row per
    step of the time span, however many samples the entity had. Each row is filled
    where it is and then repeated up to the next one: no made-up row is shuffled.
    """
    w = W.partitionBy(entity).orderBy(time)
    back = w.rowsBetween(W.unboundedPreceding, 0)
    # a series without an entity has its span, and no values
    known = series.where(F.col(time).isNotNull()).select(entity, time, *[F.when(F.col(entity).isNotNull(), F.col(c)).alias(c) for c in columns])
    out = known.withColumns({c: F.last(c, ignorenulls=True).over(back) for c in columns} | {"_next": F.lead(time).over(w)})
    if backfill:
        whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        out = out.withColumns({c: F.coalesce(c, F.first(c, ignorenulls=True).over(whole)) for c in columns})
    one = F.expr(f"INTERVAL {step}")
    return out.select(entity, F.explode(F.sequence(time, F.coalesce(F.col("_next") - one, time), one)).alias(time), *columns)


def daily_capacity(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """(entity, day, capacity_used_pct, capacity_total_gb): end of day, no gaps."""
    columns = ["capacity_used_pct", "capacity_total_gb"]
    return densify(end_of_day(df, columns, roles), columns, "1 DAY", "day", roles.entity)


def hourly_means(df: DataFrame, metrics: list[str], roles: Roles = DEFAULT_ROLES,
                 floor_at_zero: tuple[str, ...] = ()) -> DataFrame:
    """Mean per entity and nearest hour, dense, filled forward, then 0."""
    hourly = df.groupBy(roles.entity, round_hour(roles.ts).alias("hour")).agg(*[F.avg(m).alias(m) for m in metrics])
    out = densify(hourly, metrics, "1 HOUR", "hour", roles.entity, backfill=False)
    out = out.withColumns({m: F.coalesce(m, F.lit(0.0)) for m in metrics})
    return out.withColumns({m: F.greatest(F.col(m), F.lit(0.0)) for m in floor_at_zero})


def class_means(df: DataFrame, columns: list[str], by: str = "workload_type") -> DataFrame:
    return df.groupBy(by).agg(*[F.avg(c).alias(c) for c in columns])


def class_statistics(df: DataFrame, columns: list[str], by: str = "workload_type", method: str = "exact") -> DataFrame:
    """Count, mean, median, sample deviation, min and max, one row per class and metric."""
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(by, F.explode(cells).alias("_m")).select(by, "_m.*")
    stats = long.groupBy(by, "metric").agg(
        F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"))
    q = quantile_table(df, columns, {"median": 0.5}, [by], method)
    return stats.alias("s").join(q.alias("q"), same("s", "q", [by, "metric"])).select("s.*", "q.median")


def class_counts(df: DataFrame, by: str = "workload_type") -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def box_statistics(df: DataFrame, columns: list[str], by: str = "workload_type", method: str = "exact") -> DataFrame:
    """Quartiles, whiskers (outermost values within 1.5 ranges) and outlier count."""
    q = quantile_table(df, columns, {"q1": 0.25, "median": 0.5, "q3": 0.75}, [by], method)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(by, F.explode(cells).alias("_m")).select(by, "_m.*").where("x IS NOT NULL")
    inside = (F.col("x") >= F.col("q1") - reach) & (F.col("x") <= F.col("q3") + reach)
    rows = long.alias("l").join(q.alias("q"), same("l", "q", [by, "metric"])).select("l.*", "q.q1", "q.median", "q.q3")
    return rows.groupBy(by, "metric", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("x"))).alias("low_whisker"), F.max(F.when(inside, F.col("x"))).alias("high_whisker"),
        F.count_if(~inside).alias("outliers"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise Pearson correlation, (a, b, r) with a before b; one pass."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[F.corr(a, b).alias(f"_r{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_r{i}").alias("r"))
                      for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(cells).alias("_c")).select("_c.*")


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(c).alias(c) for c in columns])


def score_distribution(df: DataFrame, column: str, method: str = "exact") -> DataFrame:
    """One row: count, mean, population deviation, p50, p95, p99, min, max.

    The values are read by several passes and worked out once.
    """
    df = stage(df.select(column), "distribution")
    stats = df.agg(F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"),
                   F.min(column).alias("min"), F.max(column).alias("max"))
    q = quantile_table(df, [column], {"p50": 0.5, "p95": 0.95, "p99": 0.99}, method=method)
    return stats.select("*", q.select(F.struct("p50", "p95", "p99").alias("q")).scalar().alias("_q")).select(
        "count", "mean", "std", "min", "max", "_q.*")


def anomaly_rate(df: DataFrame, flag: str, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    n = F.count(F.lit(1))
    return df.groupBy(roles.entity).agg(
        F.count_if(flag).alias("anomalies"), n.alias("total"), (F.count_if(flag) / n).alias("rate"))


def flag_rates(df: DataFrame, flags: dict[str, str]) -> DataFrame:
    """(detector, alerts, rate) from one boolean column per detector, one pass."""
    n = F.count(F.lit(1))
    one = df.agg(n.alias("_n"), *[F.count_if(c).alias(f"_a{i}") for i, c in enumerate(flags.values())])
    cells = F.array(*[F.struct(F.lit(d).alias("detector"), F.col(f"_a{i}").alias("alerts"),
                               (F.col(f"_a{i}") / F.col("_n")).alias("rate")) for i, d in enumerate(flags)])
    return one.select(F.explode(cells).alias("_c")).select("_c.*")


# --- classification figures ---------------------------------------------------

def binary_counts(truth: Column, predicted: Column) -> dict[str, Column]:
    return {"tp": F.count_if(truth & predicted), "fp": F.count_if(~truth & predicted),
            "tn": F.count_if(~truth & ~predicted), "fn": F.count_if(truth & ~predicted)}


def binary_metrics(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Counts, accuracy, precision, recall and F1; 0 where undefined."""
    t, p = F.col(truth).cast("boolean"), F.col(predicted).cast("boolean")
    out = df.groupBy(*(by or [])).agg(*[c.alias(n) for n, c in binary_counts(t, p).items()])
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = out.withColumns({
        "accuracy": ratio(tp + tn, tp + fp + tn + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    pr, rc = F.col("precision"), F.col("recall")
    return out.withColumn("f1", ratio(2 * pr * rc, pr + rc))


def confusion(df: DataFrame, truth: str, predicted: str, classes: list) -> DataFrame:
    """One row per true class: a count and a row percentage per predicted class."""
    counts = df.groupBy(truth).pivot(predicted, classes).agg(F.count(F.lit(1)))
    counts = counts.select(F.col(truth), *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(f"n_{c}") for c in classes])
    total = sum((F.col(f"n_{c}") for c in classes), F.lit(0))
    return counts.withColumns({f"pct_{c}": ratio(F.col(f"n_{c}") * 100.0, total) for c in classes})


def class_metrics(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class, from (truth, predicted) counts."""
    by = by or []
    pairs = df.groupBy(*by, truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    sides = F.explode(F.array(
        F.struct(F.col(truth).alias("class"), F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0).alias("tp"),
                 F.lit(0).cast("bigint").alias("pred"), F.col("n").alias("support")),
        F.struct(F.col(predicted).alias("class"), F.lit(0).cast("bigint").alias("tp"), F.col("n").alias("pred"),
                 F.lit(0).cast("bigint").alias("support"))))
    sums = pairs.select(*by, sides.alias("_s")).select(*by, "_s.*").groupBy(*by, "class").agg(
        F.sum("tp").alias("tp"), F.sum("pred").alias("predicted"), F.sum("support").alias("support"))
    out = sums.withColumns({"precision": ratio(F.col("tp"), F.col("predicted")),
                            "recall": ratio(F.col("tp"), F.col("support"))})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", ratio(2 * p * r, p + r)).select(*by, "class", "precision", "recall", "f1", "support", "tp")


def averaged_metrics(per_class: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, macro and support-weighted averages of :func:`class_metrics`."""
    weight = F.sum("support")
    aggs = [(F.sum("tp") / weight).alias("accuracy"), weight.alias("support")]
    for m in ("precision", "recall", "f1"):
        aggs += [F.avg(m).alias(f"macro_{m}"), (F.sum(F.col(m) * F.col("support")) / weight).alias(f"weighted_{m}")]
    return per_class.groupBy(*(by or [])).agg(*aggs)


def action_summary(actions: DataFrame) -> DataFrame:
    """One row: actions, rolled back, rate, still monitored."""
    n, rolled = F.count(F.lit(1)), F.count_if(F.col("status") == "rolled_back")
    return actions.agg(
        n.alias("total_actions"), rolled.alias("rolled_back_count"),
        ratio(rolled * 100.0, n).alias("rollback_rate_pct"),
        F.count_if(F.col("status") == "monitoring").alias("active_monitors"))


def status_counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def score_by_truth(df: DataFrame, score: str, truth: str, method: str = "exact") -> DataFrame:
    mean = df.groupBy(truth).agg(F.avg(score).alias("mean"), F.count(F.lit(1)).alias("n"))
    q = quantile_table(df, [score], {"median": 0.5}, [truth], method)
    return mean.alias("m").join(q.alias("q"), same("m", "q", [truth])).select("m.*", "q.median")


def fleet_kpi(df: DataFrame) -> DataFrame:
    """One row: mean latency and summed IOPS of the rows given."""
    return df.agg(F.avg("avg_latency_us").alias("avg_latency_us"), F.sum("total_iops").alias("total_iops"),
                  F.count(F.lit(1)).alias("n_rows"))
