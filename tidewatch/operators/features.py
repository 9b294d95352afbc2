"""Feature columns: ratios, calendar, entropy, rolling, lags, rates, label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.numeric import signed_log
from tidewatch.functions.times import calendar_parts, floor_hour
from tidewatch.operators.clean import clean, numeric_columns
from tidewatch.operators.frames import has_hot_entity, with_frames
from tidewatch.operators.quantiles import quantile_table
from tidewatch.roles import DEFAULT_ROLES, LABELS, NON_FEATURE_COLUMNS, Roles

# Rows per rolling window and per lag, with their labels.
ROLLING = {3: "15m", 6: "30m", 12: "1h"}
LAGS = {1: "5m", 3: "15m", 6: "30m", 12: "60m"}
ROLLING_METRICS = ["total_iops", "avg_latency_us", "total_throughput_mbps"]
CHANGE_METRICS = ["total_iops", "avg_latency_us", "capacity_used_pct"]


def iops_per_queue() -> Column:
    return F.try_divide("total_iops", "queue_depth")


def basic_features(df: DataFrame) -> DataFrame:
    """Per-row ratios and sums; columns whose inputs are absent are left out."""
    c = F.col
    wanted: dict[str, tuple[tuple[str, ...], Column]] = {
        "iops_per_queue": (("total_iops", "queue_depth"), iops_per_queue()),
        "total_throughput_mbps": (("read_throughput_mbps", "write_throughput_mbps"),
                                  c("read_throughput_mbps") + c("write_throughput_mbps")),
        "write_pressure": (("read_write_ratio",), 1 - c("read_write_ratio")),
        "read_latency_jitter": (("read_latency_p99_us", "read_latency_p50_us"),
                                c("read_latency_p99_us") - c("read_latency_p50_us")),
        "write_latency_jitter": (("write_latency_p99_us", "write_latency_p50_us"),
                                 c("write_latency_p99_us") - c("write_latency_p50_us")),
        "avg_latency_us": (("read_latency_p50_us", "write_latency_p50_us"),
                           (c("read_latency_p50_us") + c("write_latency_p50_us")) / 2),
        "capacity_headroom_gb": (("capacity_total_gb", "capacity_used_gb"),
                                 c("capacity_total_gb") - c("capacity_used_gb")),
    }
    out = df.withColumns({n: e for n, (need, e) in wanted.items() if set(need) <= set(df.columns)})
    return out.withColumn("iops_latency_score", c("total_iops") / (c("avg_latency_us") + 1))


def worst_tail_latency() -> Column:
    return F.greatest("read_latency_p95_us", "write_latency_p95_us")


def calendar_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumns(calendar_parts(ts))


def hourly_entropy(df: DataFrame, roles: Roles = DEFAULT_ROLES, value: str = "io_size_avg_kb") -> DataFrame:
    """Shannon entropy (bits) of ``value`` per entity and hour.

    H = log2(n) - sum(c * log2(c)) / n over the counts c: two aggregates, both
    combined map-side, and no per-group total to join back.
    """
    counts = df.groupBy(roles.entity, floor_hour(roles.ts).alias("hour_bucket"), F.col(value)).agg(
        F.count(F.lit(1)).alias("c"))
    n = F.sum("c")
    return counts.groupBy(roles.entity, "hour_bucket").agg(
        (F.log2(n) - F.sum(F.col("c") * F.log2("c")) / n).alias("io_size_entropy"))


def add_entropy(df: DataFrame, roles: Roles = DEFAULT_ROLES, value: str = "io_size_avg_kb", hot: bool = True) -> DataFrame:
    """Each row's :func:`hourly_entropy`.

    Without a ``hot`` entity the counts come from windows inside the entity: after other
    windows by entity no row is moved again, and the rows are worked out once.
    """
    out = df.withColumn("hour_bucket", floor_hour(roles.ts))
    if hot:
        return out.join(hourly_entropy(df, roles, value), [roles.entity, "hour_bucket"], "left").drop("hour_bucket")
    hour = W.partitionBy(roles.entity, "hour_bucket")
    n = F.count(F.lit(1)).over(hour)
    out = out.withColumn("_c", F.count(F.lit(1)).over(W.partitionBy(roles.entity, "hour_bucket", value)))
    # the c rows of a value have log2(c) each
    known = F.col(roles.entity).isNotNull() & F.col("hour_bucket").isNotNull()
    return out.withColumn("io_size_entropy", F.when(known, F.log2(n) - F.sum(F.log2("_c")).over(hour) / n)).drop("_c", "hour_bucket")


def rolling_columns(w: WindowSpec, metrics=ROLLING_METRICS, windows=ROLLING) -> dict[str, Column]:
    """Mean and sample deviation over the last n rows, the current one included."""
    out = {}
    for n, label in windows.items():
        frame = w.rowsBetween(-(n - 1), 0)
        for m in metrics:
            out[f"{m}_roll_{label}_mean"] = F.avg(m).over(frame)
            out[f"{m}_roll_{label}_std"] = F.coalesce(F.stddev_samp(m).over(frame), F.lit(0.0))
    return out


def lag_columns(w: WindowSpec, metrics=CHANGE_METRICS, lags=LAGS) -> dict[str, Column]:
    return {f"{m}_lag_{label}": F.coalesce(F.lag(m, n).over(w), F.lit(0))
            for n, label in lags.items() for m in metrics}


def change_columns(w: WindowSpec, metrics=CHANGE_METRICS) -> dict[str, Column]:
    """Difference to the previous row, and as a fraction of it; 0 where undefined."""
    out = {}
    for m in metrics:
        before = F.lag(m, 1).over(w)
        out[f"{m}_delta"] = F.coalesce(F.col(m) - before, F.lit(0))
        out[f"{m}_pct_change"] = F.coalesce(F.try_divide(F.col(m), before) - 1, F.lit(0.0))
    return out


def burn_rate_column(w: WindowSpec, ticks_per_day: int = 288) -> dict[str, Column]:
    """Capacity growth per day from the last step.

    288 five-minute steps make a day; 1440 gives the per-minute scaling.
    """
    step = F.col("capacity_used_gb") - F.lag("capacity_used_gb", 1).over(w)
    return {"capacity_burn_rate": F.coalesce(step, F.lit(0.0)) * ticks_per_day}


def encode_label(column: str = "workload_type", labels: dict[str, int] = LABELS) -> Column:
    return F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[F.col(column)]


def decode_label(column: str = "label", labels: dict[str, int] = LABELS) -> Column:
    return F.create_map(*[F.lit(x) for k, v in labels.items() for x in (v, k)])[F.col(column)]


def downcast(df: DataFrame) -> DataFrame:
    """Integers to 32 bit, floating point to 32 bit."""
    small = {T.LongType: "int", T.ShortType: "int", T.ByteType: "int", T.DoubleType: "float"}
    return df.select(*[
        F.col(f.name).cast(small[type(f.dataType)]).alias(f.name) if type(f.dataType) in small else F.col(f.name)
        for f in df.schema.fields])


def engineer_features(df: DataFrame, roles: Roles = DEFAULT_ROLES, ticks_per_day: int = 288, dealt: bool = False, **kw) -> DataFrame:
    """Clean, then every feature column.

    All row windows share one partitioning and order, so they share one shuffle
    and one sort; entity sizes are looked up once, on the raw table, unless ``hot``
    tells them. ``dealt`` rows lie by entity already and are not moved for it.
    """
    if kw.get("hot") is None:
        kw["hot"] = has_hot_entity(df, roles, kw.get("rows_per_task"))
    out = calendar_features(basic_features(clean(df, roles, dealt, **kw)), roles.ts)
    changes = [m for m in CHANGE_METRICS if m in out.columns]

    def columns(w: WindowSpec) -> dict[str, Column]:
        extra = burn_rate_column(w, ticks_per_day) if "capacity_used_gb" in out.columns else {}
        return {**extra, **rolling_columns(w), **lag_columns(w, changes), **change_columns(w, changes)}

    out = with_frames(out, columns, roles, back=max(LAGS), **kw)
    if "io_size_avg_kb" in out.columns:
        out = add_entropy(out, roles, hot=kw["hot"])
    return out.withColumn("label", encode_label())


# --- matrices and scaling -----------------------------------------------------

def feature_columns(df: DataFrame, label: str = "label", roles: Roles = DEFAULT_ROLES) -> list[str]:
    """The numeric columns a model may see."""
    skip = {*NON_FEATURE_COLUMNS, label, roles.ts, roles.entity, roles.group, *roles.ties}
    return numeric_columns(df, skip=skip)


def features_and_label(df: DataFrame, label: str = "label", keep=("split",), roles: Roles = DEFAULT_ROLES) -> DataFrame:
    kept = [c for c in keep if c in df.columns]
    return df.select(*kept, *feature_columns(df, label, roles), label)


def log_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: signed_log(F.col(c)) for c in columns})


def fit_robust_scale(train: DataFrame, columns: list[str], method: str = "exact") -> DataFrame:
    """(metric, center, scale): median and interquartile range, range 0 becomes 1."""
    q = quantile_table(train, columns, {"q1": 0.25, "center": 0.5, "q3": 0.75}, method=method)
    iqr = F.col("q3") - F.col("q1")
    return q.select("metric", "center", F.when(iqr == 0, 1.0).otherwise(iqr).alias("scale"))


def fit_standard_scale(train: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, center, scale): mean and population deviation, deviation 0 becomes 1."""
    aggs = [a for i, c in enumerate(columns)
            for a in (F.avg(c).alias(f"_m{i}"), F.stddev_pop(c).alias(f"_s{i}"))]
    cells = F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(f"_m{i}").alias("center"),
                 F.when(F.col(f"_s{i}") == 0, 1.0).otherwise(F.col(f"_s{i}")).alias("scale"))
        for i, c in enumerate(columns)])
    return train.agg(*aggs).select(F.explode(cells).alias("_c")).select("_c.*")


def scale_scalar(fit: DataFrame, columns: list[str]) -> Column:
    """A fitted (metric, center, scale) table as one scalar struct."""
    picks = [F.max(F.when(F.col("metric") == c, F.struct("center", "scale"))).alias(c) for c in columns]
    return fit.agg(F.struct(*picks).alias("p")).scalar()


def apply_scale(df: DataFrame, fit: DataFrame, columns: list[str]) -> DataFrame:
    out = df.withColumn("_p", scale_scalar(fit, columns))
    return out.withColumns({
        c: (F.col(c) - F.col(f"_p.{c}.center")) / F.col(f"_p.{c}.scale") for c in columns}).drop("_p")
