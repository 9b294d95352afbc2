"""Time splits, hold-outs, pseudo-truth and sample guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.operators.frames import global_running, running_sum
from tidewatch.roles import DEFAULT_ROLES, Roles


def chronological_split(df: DataFrame, ts: str = "ts", train_days: int = 21, val_days: int = 4) -> DataFrame:
    """Add ``split``: train, val, then test, counted from midnight of the first time."""
    start = df.agg(F.min(ts).cast("date").cast("timestamp_ntz")).scalar()
    t = F.col(ts)
    val_from = F.col("_start") + F.make_dt_interval(F.lit(train_days))
    test_from = F.col("_start") + F.make_dt_interval(F.lit(train_days + val_days))
    split = F.when(t < val_from, "train").when(t < test_from, "val").otherwise("test")
    return df.withColumn("_start", start).withColumn("split", split).drop("_start")


def with_key_bucket(df: DataFrame, key: str, name: str, buckets: int = 1024) -> DataFrame:
    """Add ``name``: which of at most ``buckets`` ranges of ``key``'s order a row is in; NULL keys have none.

    The ranges end at keys drawn by their hash, so they follow the keys of any
    type, however alike these begin.
    """
    drawn = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.xxhash64(key).alias("_h")).orderBy("_h", key).limit(buckets - 1)
    cuts = drawn.agg(F.sort_array(F.collect_list(key)).alias("_cuts")).scalar()
    return df.withColumn("_cuts", cuts).withColumn(
        name, F.when(F.col(key).isNotNull(), F.size(F.filter("_cuts", lambda c: c < F.col(key))))).drop("_cuts")


def fractional_split(df: DataFrame, fraction: float = 0.7, roles: Roles = DEFAULT_ROLES, **kw) -> DataFrame:
    """Add ``in_train``: the first ``fraction`` of rows in (entity, time) order.

    The order goes by entity first, so this separates entities, not times. A
    row's place is its entity's offset plus its place within the entity.
    """
    counts = df.groupBy(roles.entity).agg(F.count(F.lit(1)).alias("_n"))
    counts = with_key_bucket(counts, roles.entity, "_range")
    ends = global_running(counts, {"_n": "_end"}, [roles.entity], F.col("_range"))
    limit = df.agg(F.floor(F.count(F.lit(1)) * F.lit(fraction))).scalar()
    ranked = running_sum(df.withColumn("_one", F.lit(1)), {"_one": "_place"}, roles, **kw)
    offsets = ends.select(roles.entity, (F.col("_end") - F.col("_n")).alias("_offset"))
    out = ranked.join(offsets, roles.entity)
    return out.withColumn("in_train", F.col("_offset") + F.col("_place") <= limit).drop("_one", "_place", "_offset")


def tail_holdout(series: DataFrame, hold: int, lookback: int, horizon: int, min_val: int | None = None,
                 roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Mark training and validation rows of regular (daily, hourly) series.

    The last ``hold`` rows validate, fewer if the series is short: at least one
    window must remain to train on, and at least ``min_val`` rows to validate,
    else the whole series trains. Validation also sees its ``lookback`` context.
    Series shorter than one window are left out.
    """
    window = lookback + horizon
    need = min_val if min_val is not None else window
    per = W.partitionBy(roles.entity)
    from_end = F.row_number().over(per.orderBy(*[F.col(c).desc() for c in roles.order]))
    n = F.count(F.lit(1)).over(per)
    out = series.withColumns({"_from_end": from_end, "_n": n}).where(F.col("_n") >= window)
    held = F.least(F.lit(hold), F.col("_n") - window)
    use = held >= need
    return out.withColumns({
        "in_train": ~use | (F.col("_from_end") > held),
        "in_val": use & (F.col("_from_end") <= held + lookback),
    }).drop("_from_end", "_n")


def three_sigma_truth(df: DataFrame, sigma: float = 3.0) -> DataFrame:
    """Add ``truth``: any of four metrics unusually high for the table, or IOPS low."""
    high = ["avg_latency_us", "total_iops", "total_throughput_mbps", "read_latency_p99_us"]
    s = df.agg(F.struct(*[
        F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in high]).alias("s")).scalar()
    truth = F.col("total_iops") < F.col("_s.total_iops.m") - sigma * F.col("_s.total_iops.s")
    for c in high:
        truth = truth | (F.col(c) > F.col(f"_s.{c}.m") + sigma * F.col(f"_s.{c}.s"))
    return df.withColumn("_s", s).withColumn("truth", truth).drop("_s")


def latest_tick(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.where(F.col(ts) == df.agg(F.max(ts)).scalar())


def with_enough_rows(df: DataFrame, minimum: int, entity: str = "volume_id") -> DataFrame:
    """Rows of entities that have at least ``minimum`` rows."""
    enough = df.groupBy(entity).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= minimum)
    return df.join(enough.select(entity), entity, "left_semi")
