"""Queries of sources, cleaning, features and splits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewatch.functions.numeric import round_half_up as rnd
from tidewatch.operators import clean, features, splits
from tidewatch.operators import windows as win
from tidewatch.plans.fixtures import (
    CAP_SQL, E_SQL, EVENTS, T_SQL, R, capacity, cool, events, table, telemetry, telemetry_with_capacity,
)
from tidewatch.plans.registry import query
from tidewatch.roles import LABELS, Roles
from tidewatch.session import shared_folder, stage
from tidewatch.sources import files

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
EVENT_COLUMNS = "event_id, ts, user_id, event_type, value, props"


def scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks ----------------------------------------------------------

@query("source_parquet", f"SELECT {EVENT_COLUMNS} FROM events")
def _(spark, d):
    return files.read_parquet(spark, f"{d}/events.parquet", EVENT_SCHEMA)


@query("source_partitioned_directories", "SELECT event_type, COUNT(*) AS n, SUM(event_id) AS ids FROM events WHERE event_type IN ('click','view') GROUP BY 1")
def _(spark, d):
    path = scratch(spark, "events-by-type")
    files.write_partitioned(table(spark, d, "events"), path, "event_type")
    rows = files.read_parquet(spark, path).where(F.col("event_type").isin("click", "view"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("source_csv_when_no_parquet", f"SELECT {EVENT_COLUMNS} FROM events")
def _(spark, d):
    path = scratch(spark, "events-csv")
    files.write_csv(table(spark, d, "events"), path)
    return files.read_table(spark, f"{path}-absent", path, EVENT_SCHEMA)


@query("sink_partitioned_parquet", f"SELECT {EVENT_COLUMNS} FROM events")
def _(spark, d):
    path = scratch(spark, "events-sink")
    files.write_partitioned(table(spark, d, "events"), path, ["event_type"])
    files.write_partitioned(table(spark, d, "events"), path, ["event_type"])  # replaces the first
    return files.read_parquet(spark, path).select(*EVENT_COLUMNS.split(", "))


@query("sink_features_parquet_and_csv", f"""WITH t AS ({T_SQL})
SELECT f, COUNT(*) AS n, SUM(total_iops) AS iops, {R('SUM(avg_latency_us)', 2)} AS latency
FROM t, (VALUES ('parquet'), ('csv')) v(f) GROUP BY 1""")
def _(spark, d):
    path = scratch(spark, "features")
    df = telemetry(spark, d)
    files.write_features(df, f"{path}/parquet", f"{path}/csv")
    back = files.read_parquet(spark, f"{path}/parquet").withColumn("f", F.lit("parquet")).unionByName(
        files.read_csv(spark, f"{path}/csv", df.schema).withColumn("f", F.lit("csv")))
    return back.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum("total_iops").alias("iops"),
                                 rnd(F.sum("avg_latency_us"), 2).alias("latency"))


SPLIT_CASE = """CASE WHEN ts < (SELECT DATE_TRUNC('day', MIN(ts)) FROM e) + INTERVAL 21 DAY THEN 'train'
  WHEN ts < (SELECT DATE_TRUNC('day', MIN(ts)) FROM e) + INTERVAL 25 DAY THEN 'val' ELSE 'test' END"""


def split_features(spark, d):
    df = splits.chronological_split(events(spark, d))
    return df.withColumn("label", features.encode_label("workload_type", {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}))


LABEL_CASE = "CASE workload_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END"


@query("sink_splits", f"""WITH e AS ({E_SQL})
SELECT {SPLIT_CASE} AS split, {LABEL_CASE} AS label, COUNT(*) AS n, SUM(event_id) AS ids FROM e GROUP BY 1, 2""")
def _(spark, d):
    path = scratch(spark, "splits")
    files.write_splits(split_features(spark, d), path)
    return files.read_parquet(spark, path).groupBy("split", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("source_load_splits", f"""WITH e AS ({E_SQL})
SELECT {SPLIT_CASE} AS split, COUNT(*) AS n, SUM(event_id) AS ids, SUM({LABEL_CASE}) AS labels FROM e GROUP BY 1""")
def _(spark, d):
    path = scratch(spark, "splits")
    files.write_splits(split_features(spark, d), path)
    parts = []
    for name, (x, y) in files.load_all_splits(spark, path).items():
        ids = x.agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))
        parts.append(ids.select(F.lit(name).alias("split"), "n", "ids", y.agg(F.sum("label")).scalar().alias("labels")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("source_json_events", "SELECT user_id, COUNT(*) AS n, SUM(event_id) AS ids FROM events GROUP BY 1")
def _(spark, d):
    path = scratch(spark, "events-json")
    files.write_json(table(spark, d, "events"), path)
    return files.read_json_events(spark, path, EVENT_SCHEMA).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


# --- cleaning ---------------------------------------------------------------------

@query("clean_duplicate_rows", "SELECT DISTINCT event_id, user_id, event_type, value FROM events")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return clean.drop_duplicate_rows(e.unionByName(e))


@query("clean_timestamps", "SELECT event_id, ts FROM events WHERE event_id % 5 <> 0")
def _(spark, d):
    e = table(spark, d, "events").select(
        "event_id", F.when(F.col("event_id") % 5 == 0, "not a time").otherwise(F.col("ts").cast("string")).alias("ts"))
    return clean.parse_timestamps(e, "ts")


@query("clean_forward_fill", """
SELECT event_id, COALESCE(LAST_VALUE(CASE WHEN event_id % 3 <> 0 THEN value END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS total_iops,
  COALESCE(LAST_VALUE(CASE WHEN event_id % 4 = 0 THEN value * 10 END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS avg_latency_us
FROM events""")
def _(spark, d):
    i = F.col("event_id")
    e = events(spark, d).select(
        "event_id", "volume_id", "ts", F.when(i % 3 != 0, F.col("total_iops")).alias("total_iops"),
        F.when(i % 4 == 0, F.col("avg_latency_us")).alias("avg_latency_us"))
    return clean.fill_gaps(e, EVENTS).select("event_id", "total_iops", "avg_latency_us")


JSON_FIELDS = ["volume_id", "timestamp", "total_iops", "avg_latency_us", "node_id", "event_id"]


def json_events(spark, d):
    """The events as flat JSON text: some numbers quoted, some texts bad, some cut off."""
    i = F.col("event_id")
    iops = F.when(i % 6 == 0, F.lit('"N/A"')).when(i % 6 == 1, F.lit("null")).when(
        i % 6 == 2, F.concat(F.lit('"'), F.col("value").cast("string"), F.lit('"'))).otherwise(F.col("value").cast("string"))
    text = F.concat(
        F.lit('{"event_id": '), i.cast("string"),
        F.when(i % 13 == 0, F.lit("")).otherwise(F.concat(F.lit(', "volume_id": "vol_'), F.col("user_id").cast("string"), F.lit('"'))),
        F.lit(', "timestamp": "'), F.when(i % 17 == 0, F.lit("")).otherwise(F.col("ts").cast("string")), F.lit('"'),
        F.lit(', "total_iops": '), iops, F.lit(', "avg_latency_us": '), (F.col("value") * 10).cast("string"),
        F.lit(', "node_id": "node_A"'), F.when(i % 11 == 0, F.lit("")).otherwise(F.lit("}")))
    return table(spark, d, "events").select(text.alias("json"))


J_OK = "event_id % 11 <> 0"
IOPS_TEXT = "CASE WHEN event_id % 6 = 0 THEN 'N/A' WHEN event_id % 6 = 1 THEN NULL ELSE 'x' END"


@query("clean_parse_json", f"""
SELECT COUNT(*) AS n, SUM(CASE WHEN {J_OK} THEN 0 ELSE 1 END) AS corrupt,
  SUM(CASE WHEN {J_OK} THEN event_id END) AS ids,
  SUM(CASE WHEN {J_OK} AND event_id % 6 = 0 THEN 1 ELSE 0 END) AS texts,
  {R("SUM(CASE WHEN " + J_OK + " AND event_id % 6 > 1 THEN value END)", 2)} AS iops FROM events""")
def _(spark, d):
    p = clean.parse_events(json_events(spark, d), "json", JSON_FIELDS)
    ok = F.col("_corrupt_record").isNull()
    return p.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~ok).alias("corrupt"),
        F.sum(F.when(ok, F.col("event_id").cast("bigint"))).alias("ids"),
        F.count_if(ok & (F.col("total_iops") == "N/A")).alias("texts"),
        rnd(F.sum(F.when(ok, F.col("total_iops").try_cast("double"))), 2).alias("iops"))


LOW = {"total_iops": 5.0, "avg_latency_us": 10.0}
HIGH = {"total_iops": 200.0, "avg_latency_us": 2000.0}


def _clip_sql(x: str, lo, hi) -> str:
    return f"CASE WHEN {x} < {lo} THEN {lo} WHEN {x} > {hi} THEN {hi} ELSE {x} END"


@query("clean_clip_events", f"""
SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'N/A' WHEN event_id % 6 = 1 THEN NULL ELSE 'number' END AS kind,
  CASE WHEN event_id % 6 > 1 THEN {_clip_sql('value', 5, 200)} END AS total_iops,
  {_clip_sql('value*10', 10, 2000)} AS avg_latency_us FROM events WHERE {J_OK}""")
def _(spark, d):
    p = clean.parse_events(json_events(spark, d), "json", JSON_FIELDS).where("_corrupt_record IS NULL")
    c = clean.clip_event_texts(p, LOW, HIGH)
    x = F.col("total_iops").try_cast("double")
    return c.select(
        F.col("event_id").cast("bigint").alias("event_id"),
        F.when(x.isNotNull(), "number").otherwise(F.col("total_iops")).alias("kind"),
        x.alias("total_iops"), F.col("avg_latency_us").cast("double").alias("avg_latency_us"))


@query("clean_clip_columns", f"""
SELECT event_id, {_clip_sql('value', 5, 200)} AS total_iops, {_clip_sql('value*10', 10, 2000)} AS avg_latency_us FROM events""")
def _(spark, d):
    return clean.clip_columns(events(spark, d).select("event_id", "total_iops", "avg_latency_us"), LOW, HIGH)


@query("clean_coerce_events", f"""
SELECT event_id, CASE WHEN event_id % 13 = 0 THEN '' ELSE 'vol_' || user_id END AS volume_id, 'node_A' AS node_id,
  CASE WHEN event_id % 6 > 1 THEN value ELSE 0 END AS total_iops, value * 10 AS avg_latency_us
FROM events WHERE {J_OK}""")
def _(spark, d):
    p = clean.parse_events(json_events(spark, d), "json", JSON_FIELDS).where("_corrupt_record IS NULL")
    return clean.coerce_events(p).select("event_id", "volume_id", "node_id", "total_iops", "avg_latency_us")


@query("clean_reject_events", f"""
SELECT CASE WHEN {J_OK} AND event_id % 13 <> 0 AND event_id % 17 <> 0 THEN 'valid' ELSE 'rejected' END AS kind,
  COUNT(*) AS n FROM events GROUP BY 1""")
def _(spark, d):
    p = clean.parse_events(json_events(spark, d), "json", JSON_FIELDS)
    good, bad = clean.split_events(p)
    return good.select(F.lit("valid").alias("kind")).unionByName(bad.select(F.lit("rejected").alias("kind"))).groupBy(
        "kind").agg(F.count(F.lit(1)).alias("n"))


BOUND_METRICS = ["total_iops", "avg_latency_us", "total_throughput_mbps", "queue_depth"]
TRAIN_T = "(SELECT DATE_TRUNC('day', MIN(ts)) + INTERVAL 1500 DAY FROM t)"
BOUNDS_SQL = " UNION ALL ".join(
    f"""SELECT '{m}' AS metric, QUANTILE_CONT({m}::DOUBLE, 0.25) - 1.5*(QUANTILE_CONT({m}::DOUBLE, 0.75) - QUANTILE_CONT({m}::DOUBLE, 0.25)) AS low,
    QUANTILE_CONT({m}::DOUBLE, 0.75) + 1.5*(QUANTILE_CONT({m}::DOUBLE, 0.75) - QUANTILE_CONT({m}::DOUBLE, 0.25)) AS high
    FROM t WHERE ts < {TRAIN_T}""" for m in BOUND_METRICS)


def _train(df, days=1500):
    return splits.chronological_split(df, train_days=days, val_days=300).where("split = 'train'")


@query("clean_fit_iqr_bounds", f"""WITH t AS ({T_SQL}), b AS ({BOUNDS_SQL})
SELECT metric, {R('low', 4)} AS low, {R('high', 4)} AS high FROM b""")
def _(spark, d):
    b = clean.fit_iqr_bounds(_train(stage(telemetry(spark, d), "telemetry")), BOUND_METRICS)
    return b.select("metric", rnd(F.col("low"), 4).alias("low"), rnd(F.col("high"), 4).alias("high"))


def _bound(m, side):
    return f"(SELECT {side} FROM b WHERE metric = '{m}')"


@query("clean_apply_iqr_bounds", f"""WITH t AS ({T_SQL}), b AS ({BOUNDS_SQL})
SELECT volume_id, ts, {', '.join(R(f"LEAST(GREATEST({m}, {_bound(m, 'low')}), {_bound(m, 'high')})", 4) + f' AS {m}' for m in BOUND_METRICS)} FROM t""")
def _(spark, d):
    t = stage(telemetry(spark, d), "telemetry")  # read by the fit's two passes and the clip
    out = clean.apply_bounds(t, clean.fit_iqr_bounds(_train(t), BOUND_METRICS), BOUND_METRICS)
    return out.select("volume_id", "ts", *[rnd(F.col(m), 4).alias(m) for m in BOUND_METRICS])


@query("clean_capacity_scale_table", "SELECT event_id, value / 100 AS capacity_used_pct FROM events")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("value").alias("capacity_used_pct"))
    return clean.capacity_to_fraction_table(e)


@query("clean_capacity_scale_value", """
SELECT event_id, CASE WHEN value - 1 < 0 THEN 0 WHEN value - 1 <= 1 THEN value - 1
  WHEN value - 1 <= 100 THEN (value - 1) / 100 ELSE 1 END AS capacity_used_pct FROM events""")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("value") - 1).alias("capacity_used_pct"))
    return clean.capacity_to_fraction_value(e)


GAP_SQL = "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN 'NaN'::DOUBLE WHEN event_id % 7 = 2 THEN 'Infinity'::DOUBLE ELSE value END"


def gappy(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select(
        "event_id", F.when(i % 7 == 0, F.lit(None)).when(i % 7 == 1, F.lit(float("nan")))
        .when(i % 7 == 2, F.lit(float("inf"))).otherwise(F.col("value")).alias("value"),
        F.when(i % 2 == 0, F.col("event_type")).alias("event_type"))


@query("clean_impute_median", f"""
SELECT event_id, CASE WHEN event_id % 7 > 2 THEN value ELSE
  {R('(SELECT MEDIAN(value) FROM events WHERE event_id % 7 > 2)', 6)} END AS value FROM events""")
def _(spark, d):
    out = clean.impute_median(gappy(spark, d).select("event_id", "value"), ["value"])
    return out.select("event_id", rnd(F.col("value"), 6).alias("value"))


@query("clean_profile", f"""
SELECT * FROM (
  SELECT 'event_id' AS column_name, 0 AS nulls, 0 AS infinite, COUNT(*) AS n_rows FROM events
  UNION ALL SELECT 'value', SUM(CASE WHEN event_id % 7 < 2 THEN 1 ELSE 0 END), SUM(CASE WHEN event_id % 7 = 2 THEN 1 ELSE 0 END), COUNT(*) FROM events
  UNION ALL SELECT 'event_type', SUM(CASE WHEN event_id % 2 = 1 THEN 1 ELSE 0 END), 0, COUNT(*) FROM events)""")
def _(spark, d):
    return clean.profile(gappy(spark, d))


@query("clean_validate_features", "SELECT 0 AS nulls, 0 AS infinite, COUNT(*) AS n_rows, TRUE AS rows_ok, TRUE AS labels_ok FROM events")
def _(spark, d):
    e = table(spark, d, "events")
    expected = spark.read.parquet(f"{d}/events.parquet").count()  # as many rows as the files say
    return clean.validate_features(e, "event_type", ["click", "error", "purchase", "signup", "view"], expected)


# --- features -----------------------------------------------------------------------

FULL = f"f AS (SELECT t.*, c.capacity_used_gb, c.capacity_total_gb, c.capacity_used_pct FROM ({T_SQL}) t JOIN ({CAP_SQL}) c USING (volume_id, ts))"
BASIC_SQL = """b AS (SELECT * EXCLUDE (total_throughput_mbps, avg_latency_us),
  total_iops / queue_depth AS iops_per_queue, read_throughput_mbps + write_throughput_mbps AS total_throughput_mbps,
  1 - read_write_ratio AS write_pressure, read_latency_p99_us - read_latency_p50_us AS read_latency_jitter,
  write_latency_p99_us - write_latency_p50_us AS write_latency_jitter,
  (read_latency_p50_us + write_latency_p50_us) / 2 AS avg_latency_us,
  capacity_total_gb - capacity_used_gb AS capacity_headroom_gb,
  total_iops / ((read_latency_p50_us + write_latency_p50_us) / 2 + 1) AS iops_latency_score FROM f)"""
BASIC = {"iops_per_queue": 4, "total_throughput_mbps": 2, "write_pressure": 4, "read_latency_jitter": 2,
         "write_latency_jitter": 2, "avg_latency_us": 2, "iops_latency_score": 4, "capacity_headroom_gb": 2}


@query("features_basic", f"""WITH {FULL}, {BASIC_SQL}
SELECT volume_id, ts, {', '.join(R(c, n) + f' AS {c}' for c, n in BASIC.items())} FROM b""")
def _(spark, d):
    out = features.basic_features(telemetry_with_capacity(spark, d))
    return out.select("volume_id", "ts", *[rnd(F.col(c), n).alias(c) for c, n in BASIC.items()])


def _calendar_sql() -> str:
    return f"""HOUR(ts) AS hour, ISODOW(ts) - 1 AS day_of_week, CASE WHEN ISODOW(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  DAY(ts) AS day_of_month, {R('SIN(2*PI()*HOUR(ts)/24)', 4)} AS hour_sin, {R('COS(2*PI()*HOUR(ts)/24)', 4)} AS hour_cos,
  {R('SIN(2*PI()*(ISODOW(ts)-1)/7)', 4)} AS day_sin, {R('COS(2*PI()*(ISODOW(ts)-1)/7)', 4)} AS day_cos"""


CYCLIC = ["hour_sin", "hour_cos", "day_sin", "day_cos"]


@query("features_calendar", f"SELECT event_id, {_calendar_sql()} FROM events")
def _(spark, d):
    out = features.calendar_features(table(spark, d, "events"))
    return out.select("event_id", "hour", "day_of_week", "is_weekend", "day_of_month",
                      *[rnd(F.col(c), 4).alias(c) for c in CYCLIC])


ENTROPY_SQL = """h AS (SELECT volume_id, hour_bucket, SUM(-p * LOG2(p)) AS io_size_entropy FROM (
    SELECT volume_id, hour_bucket, c / SUM(c) OVER (PARTITION BY volume_id, hour_bucket) AS p FROM (
      SELECT volume_id, DATE_TRUNC('hour', ts) AS hour_bucket, {size} AS s, COUNT(*) AS c FROM {src} GROUP BY 1, 2, 3) q) r GROUP BY 1, 2)"""


def sized_events(spark, d):
    # One entity per node makes hours with many samples.
    return events(spark, d).select("event_id", F.col("node_id").alias("volume_id"), "ts",
                                   F.floor(F.col("total_iops") / 20).alias("io_size_avg_kb"))


SIZED = "e AS (SELECT event_id, user_id % 5 AS volume_id, ts, FLOOR(value / 20) AS io_size FROM events)"


@query("features_hourly_entropy", f"""WITH {SIZED}, {ENTROPY_SQL.format(size='io_size', src='e')}
SELECT volume_id, hour_bucket, {R('io_size_entropy', 6)} AS io_size_entropy FROM h""")
def _(spark, d):
    h = features.hourly_entropy(sized_events(spark, d))
    return h.select("volume_id", "hour_bucket", rnd(F.col("io_size_entropy"), 6).alias("io_size_entropy"))


@query("join_entropy_to_rows", f"""WITH {SIZED}, {ENTROPY_SQL.format(size='io_size', src='e')}
SELECT event_id, {R('io_size_entropy', 6)} AS io_size_entropy FROM e LEFT JOIN h
  ON e.volume_id = h.volume_id AND DATE_TRUNC('hour', e.ts) = h.hour_bucket""")
def _(spark, d):
    out = features.add_entropy(sized_events(spark, d))
    return out.select("event_id", rnd(F.col("io_size_entropy"), 6).alias("io_size_entropy"))


def _roll_sql(metrics=features.ROLLING_METRICS) -> str:
    parts = []
    for n, label in features.ROLLING.items():
        over = f"OVER (PARTITION BY volume_id ORDER BY ts ROWS BETWEEN {n-1} PRECEDING AND CURRENT ROW)"
        for m in metrics:
            parts.append(R(f"AVG({m}) {over}", 4) + f" AS {m}_roll_{label}_mean")
            parts.append(R(f"COALESCE(STDDEV_SAMP({m}) {over}, 0)", 4) + f" AS {m}_roll_{label}_std")
    return ", ".join(parts)


def _lag_sql(metrics) -> str:
    return ", ".join(R(f"COALESCE(LAG({m}, {n}) OVER w, 0)", 4) + f" AS {m}_lag_{label}"
                     for n, label in features.LAGS.items() for m in metrics)


def _change_sql(metrics) -> str:
    out = []
    for m in metrics:
        out.append(R(f"COALESCE({m} - LAG({m}) OVER w, 0)", 4) + f" AS {m}_delta")
        out.append(R(f"COALESCE({m} / NULLIF(LAG({m}) OVER w, 0) - 1, 0)", 4) + f" AS {m}_pct_change")
    return ", ".join(out)


W_SQL = "WINDOW w AS (PARTITION BY volume_id ORDER BY ts)"
LAG2 = ["total_iops", "avg_latency_us"]


def _rounded(df, columns, n=4):
    return [rnd(F.col(c), n).alias(c) for c in columns]


@query("window_rolling", f"WITH t AS ({T_SQL}) SELECT volume_id, ts, {_roll_sql()} FROM t")
def _(spark, d):
    from tidewatch.operators.frames import with_frames
    out = with_frames(telemetry(spark, d), features.rolling_columns, back=12)
    return out.select("volume_id", "ts", *_rounded(out, [c for c in out.columns if "_roll_" in c]))


@query("window_lags", f"WITH t AS ({T_SQL}) SELECT volume_id, ts, {_lag_sql(LAG2)} FROM t {W_SQL}")
def _(spark, d):
    from tidewatch.operators.frames import with_frames
    out = with_frames(telemetry(spark, d), lambda w: features.lag_columns(w, LAG2), back=12)
    return out.select("volume_id", "ts", *_rounded(out, [c for c in out.columns if "_lag_" in c]))


@query("window_changes", f"WITH t AS ({T_SQL}) SELECT volume_id, ts, {_change_sql(LAG2)} FROM t {W_SQL}")
def _(spark, d):
    from tidewatch.operators.frames import with_frames
    out = with_frames(telemetry(spark, d), lambda w: features.change_columns(w, LAG2), back=1)
    return out.select("volume_id", "ts", *_rounded(out, [c for c in out.columns if c.endswith(("_delta", "_pct_change"))]))


@query("window_capacity_burn_rate", f"""WITH c AS ({CAP_SQL})
SELECT volume_id, ts, COALESCE(capacity_used_gb - LAG(capacity_used_gb) OVER w, 0) * 288 AS capacity_burn_rate FROM c {W_SQL}""")
def _(spark, d):
    from tidewatch.operators.frames import with_frames
    out = with_frames(capacity(spark, d), features.burn_rate_column, back=1)
    return out.select("volume_id", "ts", "capacity_burn_rate")


LABEL_SQL = "CASE workload_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LABELS.items()) + " END"


@query("features_label_encode_decode", f"WITH t AS ({T_SQL}) SELECT volume_id, ts, {LABEL_SQL} AS label, workload_type AS decoded FROM t")
def _(spark, d):
    t = telemetry(spark, d).withColumn("label", features.encode_label())
    return t.select("volume_id", "ts", "label", features.decode_label().alias("decoded"))


@query("features_signed_log", f"SELECT event_id, {R('SIGN(value-50)*LN(1+ABS(value-50))', 6)} AS x FROM events")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("value") - 50).alias("x"))
    return features.log_columns(e, ["x"]).select("event_id", rnd(F.col("x"), 6).alias("x"))


SCALE_METRICS = ["total_iops", "avg_latency_us", "total_throughput_mbps"]


@query("features_robust_scale", f"""WITH t AS ({T_SQL}), q AS (SELECT {', '.join(
    f"QUANTILE_CONT({m}, 0.25) AS {m}_1, MEDIAN({m}) AS {m}_2, QUANTILE_CONT({m}, 0.75) AS {m}_3" for m in SCALE_METRICS)}
  FROM t WHERE ts < {TRAIN_T})
SELECT volume_id, ts, {', '.join(R(f"({m} - {m}_2) / CASE WHEN {m}_3 = {m}_1 THEN 1 ELSE {m}_3 - {m}_1 END", 5) + f' AS {m}' for m in SCALE_METRICS)},
  queue_depth * 0 AS flat FROM t, q""")
def _(spark, d):
    t = stage(telemetry(spark, d).select("volume_id", "ts", *SCALE_METRICS), "telemetry").withColumn("flat", F.lit(7))
    columns = [*SCALE_METRICS, "flat"]
    out = features.apply_scale(t, features.fit_robust_scale(_train(t), columns), columns)
    return out.select("volume_id", "ts", *_rounded(out, SCALE_METRICS, 5), "flat")


@query("features_standard_scale", f"""WITH t AS ({T_SQL}), q AS (SELECT {', '.join(
    f"AVG({m}) AS {m}_1, STDDEV_POP({m}) AS {m}_2" for m in SCALE_METRICS)} FROM t WHERE ts < {TRAIN_T})
SELECT volume_id, ts, {', '.join(R(f"({m} - {m}_1) / {m}_2", 5) + f' AS {m}' for m in SCALE_METRICS)} FROM t, q""")
def _(spark, d):
    t = telemetry(spark, d)
    out = features.apply_scale(t, features.fit_standard_scale(_train(t), SCALE_METRICS), SCALE_METRICS)
    return out.select("volume_id", "ts", *_rounded(out, SCALE_METRICS, 5))


@query("features_downcast", "SELECT event_id, CAST(value AS FLOAT) = value AS same, ROUND(value)::BIGINT AS near FROM events")
def _(spark, d):
    e = features.downcast(table(spark, d, "events").select("event_id", "value", F.col("value").alias("wide")))
    w = table(spark, d, "events").select(F.col("event_id").alias("i"), F.col("value").alias("v"))
    return e.join(w, F.col("event_id") == F.col("i")).select(
        F.col("event_id").cast("bigint").alias("event_id"), (F.col("value").cast("double") == F.col("v")).alias("same"),
        F.round("v").cast("bigint").alias("near"))


@query("features_worst_tail", f"WITH t AS ({T_SQL}) SELECT volume_id, ts, GREATEST(read_latency_p95_us, write_latency_p95_us) AS latency_p95_us FROM t")
def _(spark, d):
    return telemetry(spark, d).select("volume_id", "ts", features.worst_tail_latency().alias("latency_p95_us"))


ENG_COLUMNS = [*BASIC, "capacity_burn_rate"]
CH3 = features.CHANGE_METRICS


@query("features_engineered", f"""WITH {FULL}, {BASIC_SQL}
SELECT volume_id, ts, {', '.join(R(c, 4) + f' AS {c}' for c in BASIC)},
  {R('COALESCE(capacity_used_gb - LAG(capacity_used_gb) OVER w, 0) * 288', 4)} AS capacity_burn_rate,
  {_calendar_sql()}, {_roll_sql()}, {_lag_sql(CH3)}, {_change_sql(CH3)}, 0.0 AS io_size_entropy, {LABEL_SQL} AS label
FROM b {W_SQL}""")
def _(spark, d):
    known = cool(spark, d)
    # without a hot volume both sides lie by volume, and so does what they are joined to
    out = features.engineer_features(telemetry_with_capacity(spark, d), Roles(), dealt=bool(known), **known)
    derived = [c for c in out.columns if "_roll_" in c or "_lag_" in c or c.endswith(("_delta", "_pct_change"))]
    return out.select("volume_id", "ts", *_rounded(out, [*ENG_COLUMNS, *derived, *CYCLIC, "io_size_entropy"]),
                      "hour", "day_of_week", "is_weekend", "day_of_month", "label")


@query("features_matrix_columns", f"""WITH t AS ({T_SQL})
SELECT COUNT(*) AS n, SUM(queue_depth) AS queue_depth, SUM(total_iops) AS total_iops,
  'avg_latency_us,io_size_avg_kb,queue_depth,read_iops,read_latency_p50_us,read_latency_p95_us,read_latency_p99_us,read_throughput_mbps,read_write_ratio,sequential_ratio,total_iops,total_throughput_mbps,write_iops,write_latency_p50_us,write_latency_p95_us,write_latency_p99_us,write_throughput_mbps' AS names FROM t""")
def _(spark, d):
    t = telemetry(spark, d).withColumn("label", features.encode_label())
    x = features.features_and_label(t)
    names = ",".join(sorted(c for c in x.columns if c != "label"))
    return x.agg(F.count(F.lit(1)).alias("n"), F.sum("queue_depth").alias("queue_depth"),
                 F.sum("total_iops").alias("total_iops")).withColumn("names", F.lit(names))


# --- splits and predicates -------------------------------------------------------------

@query("split_chronological", f"WITH e AS ({E_SQL}) SELECT event_id, {SPLIT_CASE} AS split FROM e")
def _(spark, d):
    return splits.chronological_split(events(spark, d)).select("event_id", "split")


@query("split_fractional", f"""WITH e AS ({E_SQL})
SELECT event_id, ROW_NUMBER() OVER (ORDER BY volume_id, ts, event_id) <= FLOOR(0.7 * (SELECT COUNT(*) FROM e)) AS in_train FROM e""")
def _(spark, d):
    return splits.fractional_split(events(spark, d), 0.7, EVENTS).select("event_id", "in_train")


DAILY_SQL = "y AS (SELECT user_id AS volume_id, DATE_TRUNC('day', ts) AS day, SUM(value) AS v FROM events GROUP BY 1, 2)"


@query("split_tail_holdout", f"""WITH {DAILY_SQL}, n AS (SELECT *, COUNT(*) OVER (PARTITION BY volume_id) AS n,
    ROW_NUMBER() OVER (PARTITION BY volume_id ORDER BY day DESC) AS k FROM y)
SELECT volume_id, day, NOT (LEAST(7, n - 15) >= 5) OR k > LEAST(7, n - 15) AS in_train,
  LEAST(7, n - 15) >= 5 AND k <= LEAST(7, n - 15) + 10 AS in_val FROM n WHERE n >= 15""")
def _(spark, d):
    e = table(spark, d, "events")
    from tidewatch.functions.times import day_start
    y = e.groupBy(F.col("user_id").alias("volume_id"), day_start("ts").alias("day")).agg(F.sum("value").alias("v"))
    out = splits.tail_holdout(y, 7, 10, 5, min_val=5, roles=Roles(ts="day"))
    return out.select("volume_id", "day", "in_train", "in_val")


TRUTH_SQL = """g AS (SELECT *, avg_latency_us > (SELECT AVG(avg_latency_us) + 3*STDDEV_SAMP(avg_latency_us) FROM t)
  OR total_iops > (SELECT AVG(total_iops) + 3*STDDEV_SAMP(total_iops) FROM t)
  OR total_iops < (SELECT AVG(total_iops) - 3*STDDEV_SAMP(total_iops) FROM t)
  OR total_throughput_mbps > (SELECT AVG(total_throughput_mbps) + 3*STDDEV_SAMP(total_throughput_mbps) FROM t)
  OR read_latency_p99_us > (SELECT AVG(read_latency_p99_us) + 3*STDDEV_SAMP(read_latency_p99_us) FROM t) AS truth FROM t)"""


@query("filter_three_sigma_truth", f"WITH t AS ({T_SQL}), {TRUTH_SQL} SELECT volume_id, ts, truth FROM g")
def _(spark, d):
    return splits.three_sigma_truth(telemetry(spark, d)).select("volume_id", "ts", "truth")


@query("filter_latest_tick", f"WITH t AS ({T_SQL}) SELECT volume_id, ts, total_iops FROM t WHERE ts = (SELECT MAX(ts) FROM t)")
def _(spark, d):
    return splits.latest_tick(telemetry(spark, d)).select("volume_id", "ts", "total_iops")


@query("filter_enough_rows", "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING COUNT(*) >= 66)")
def _(spark, d):
    return splits.with_enough_rows(table(spark, d, "events").select("event_id", "user_id"), 66, "user_id")


@query("filter_severity", """
SELECT event_id, CASE WHEN value < 40 THEN 'normal' WHEN value < 60 THEN 'warning' WHEN value < 80 THEN 'high' ELSE 'critical' END AS severity
FROM events WHERE value >= 40""")
def _(spark, d):
    from tidewatch.functions.numeric import severity
    e = table(spark, d, "events").where("value >= 40")
    return e.select("event_id", severity(F.col("value")).alias("severity"))


# --- row windows -----------------------------------------------------------------------

@query("window_latest_row", f"""WITH t AS ({T_SQL}) SELECT volume_id, ts, total_iops, avg_latency_us FROM t
QUALIFY ROW_NUMBER() OVER (PARTITION BY volume_id ORDER BY ts DESC) = 1""")
def _(spark, d):
    return win.latest_rows(telemetry(spark, d)).select("volume_id", "ts", "total_iops", "avg_latency_us")


@query("window_last_rows", f"""WITH t AS ({T_SQL}) SELECT volume_id, ts, total_iops FROM t
QUALIFY ROW_NUMBER() OVER (PARTITION BY volume_id ORDER BY ts DESC) <= 100""")
def _(spark, d):
    return win.last_rows(telemetry(spark, d), 100).select("volume_id", "ts", "total_iops")


@query("window_sequences", f"""WITH t AS ({T_SQL}) SELECT volume_id, ts, total_iops AS last_iops,
  LAG(total_iops, 11) OVER w AS first_iops, SUM(total_iops) OVER (PARTITION BY volume_id ORDER BY ts ROWS 11 PRECEDING) AS sum_iops
FROM t {W_SQL} QUALIFY LAG(ts, 11) OVER w IS NOT NULL""")
def _(spark, d):
    s = win.sequences(telemetry(spark, d), ["total_iops", "avg_latency_us"])
    q = F.col("sequence")
    return s.select("volume_id", "ts", q[11][0].alias("last_iops"), q[0][0].alias("first_iops"),
                    F.aggregate(q, F.lit(0.0), lambda a, x: a + x[0]).alias("sum_iops"))


@query("window_padded_sequences", f"""WITH t AS ({T_SQL}), n AS (SELECT *, ROW_NUMBER() OVER w AS k,
    FIRST_VALUE(total_iops) OVER w AS oldest, SUM(total_iops) OVER (PARTITION BY volume_id ORDER BY ts ROWS 11 PRECEDING) AS s
  FROM t {W_SQL})
SELECT volume_id, ts, s + CASE WHEN k < 12 THEN (12 - k) * oldest ELSE 0 END AS sum_iops FROM n""")
def _(spark, d):
    s = win.sequences(telemetry(spark, d), ["total_iops"], pad=True)
    return s.select("volume_id", "ts", F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x[0]).alias("sum_iops"))


@query("window_supervised", f"""WITH t AS ({T_SQL}) SELECT volume_id, ts,
  SUM(total_iops) OVER (PARTITION BY volume_id ORDER BY ts ROWS 19 PRECEDING) AS input_sum,
  SUM(total_iops) OVER (PARTITION BY volume_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS target_sum
FROM t {W_SQL} QUALIFY LAG(ts, 19) OVER w IS NOT NULL AND LEAD(ts, 7) OVER w IS NOT NULL""")
def _(spark, d):
    s = win.supervised_windows(telemetry(spark, d), "total_iops")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return s.select("volume_id", "ts", total("input").alias("input_sum"), total("target").alias("target_sum"))


@query("window_hot_runs", """
WITH m AS (SELECT event_id, user_id, ts, value >= 50 AS hot,
    SUM(CASE WHEN value >= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM events),
r AS (SELECT *, CASE WHEN hot THEN MIN(CASE WHEN hot THEN ts END) OVER (PARTITION BY user_id, grp) END AS run_start FROM m)
SELECT event_id, run_start, FLOOR(DATE_DIFF('microsecond', run_start, ts)/60e6*1e4+0.500001)/1e4 AS run_minutes,
  CASE WHEN NOT hot THEN 'cold' WHEN DATE_DIFF('microsecond', run_start, ts)/60e6 < 2 THEN 'waiting_persistence' ELSE 'verified' END AS status
FROM r""")
def _(spark, d):
    out = win.hot_runs(events(spark, d), "total_iops", 50, EVENTS)
    return out.select("event_id", "run_start", rnd(F.col("run_minutes"), 4).alias("run_minutes"), "status")
