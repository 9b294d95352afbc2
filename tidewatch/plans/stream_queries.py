"""Stream queries: run over the given tables as streams, checked against batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.numeric import round_half_up as rnd
from tidewatch.plans.data_queries import HIGH, JSON_FIELDS, LOW, json_events
from tidewatch.plans.detection_queries import WITH_SCORES
from tidewatch.plans.fixtures import EVENTS, R, table, telemetry
from tidewatch.plans.registry import query
from tidewatch.roles import DETECTOR_METRICS
from tidewatch.session import shared_folder
from tidewatch.streaming import sinks, sources, state


def place(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


#: Schema of what arrives in a folder part by part.
_arriving: dict[str, T.StructType] = {}
PARTS = 3
#: Batches between compactions, few enough that the queries' streams see one.
COMPACT = 2
#: Volumes whose states one call of the online detector takes, and calls for each batch of a small fleet.
VOLUMES_PER_CALL, LEAST_BUCKETS = 64, 256


def in_parts(df, folder: str, ts: str = "ts"):
    """``df`` as a stream that arrives in ``PARTS`` parts in time order, each with the partitions it has."""
    spark = df.sparkSession
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    cuts = df.agg(F.approx_percentile(at, [i / PARTS for i in range(1, PARTS)])).first()[0] or []
    part = sum(((at > c).cast("int") for c in cuts), F.lit(0))
    df.withColumn("_part", F.coalesce(part, F.lit(0))).write.partitionBy("_part").parquet(f"{folder}/parts")
    _arriving[folder] = T.StructType(list(df.schema.fields))
    spark.createDataFrame([], df.schema).write.parquet(f"{folder}/in")
    return spark.readStream.schema(df.schema).parquet(f"{folder}/in")


def arrive(stream, folder: str, write, mode: str = "append") -> int:
    """Run one checkpointed query over what arrives, part after part; returns the last batch id."""
    spark, schema, last = stream.sparkSession, _arriving.pop(folder, None), -1
    if schema is None:
        return sinks.run_available(stream, f"{folder}/checkpoint", write, mode)
    parts = spark.read.schema(T.StructType([*schema.fields, T.StructField("_part", T.IntegerType())])).parquet(f"{folder}/parts")
    for i in range(PARTS):
        parts.where(F.col("_part") == i).drop("_part").write.mode("append").parquet(f"{folder}/in")
        last = max(last, sinks.run_available(stream, f"{folder}/checkpoint", write, mode))
    return last


def event_stream(spark, d, folder: str, marker: bool = False):
    """The events as a stream of files, over several micro-batches.

    ``marker`` adds one later event of no volume: the time it brings closes
    every window before it.
    """
    e = table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("volume_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("total_iops"), (F.col("value") * 10).alias("avg_latency_us"))
    if marker:
        late = e.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"))
        e = e.unionByName(late, allowMissingColumns=True)
    return in_parts(e, folder)


def run(spark, df, folder: str, mode: str = "append", keys: list[str] | None = None):
    """What a stream has put out when all has arrived; ``keys`` name the rows that update mode replaces."""
    arrive(df, folder, sinks.append_batches(f"{folder}/out"), mode)
    if mode == "update":
        return sinks.read_newest(spark, f"{folder}/out", keys)
    return sinks.read_batches(spark, f"{folder}/out") if mode == "append" else sinks.read_last(spark, f"{folder}/out")


IOPS = "CASE WHEN event_id % 6 > 1 THEN CASE WHEN value < 5 THEN 5 WHEN value > 200 THEN 200 ELSE value END ELSE 0 END"
VALID = "event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0"


@query("stream_clean_events", f"""SELECT event_id, 'vol_' || user_id AS volume_id, ts, {IOPS} AS total_iops,
  CASE WHEN value*10 < 10 THEN 10 WHEN value*10 > 2000 THEN 2000 ELSE value*10 END AS avg_latency_us FROM events WHERE {VALID}""")
def _(spark, d):
    folder = place(spark)
    json_events(spark, d).write.text(f"{folder}/in")
    good, _ = sources.clean_events(sources.read_lines(spark, f"{folder}/in"), LOW, HIGH, JSON_FIELDS)
    out = run(spark, good, folder)
    return out.select(F.col("event_id").cast("bigint").alias("event_id"), "volume_id", F.col("ts").cast("timestamp_ntz").alias("ts"),
                      "total_iops", "avg_latency_us")


@query("stream_rejected_events", f"SELECT COUNT(*) AS rejected FROM events WHERE NOT ({VALID})")
def _(spark, d):
    folder = place(spark)
    json_events(spark, d).write.text(f"{folder}/in")
    _, bad = sources.clean_events(sources.read_lines(spark, f"{folder}/in"), LOW, HIGH, JSON_FIELDS)
    return run(spark, bad, folder).agg(F.count(F.lit(1)).alias("rejected"))


@query("stream_latest_state", """SELECT user_id AS volume_id, event_id, value AS total_iops FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def _(spark, d):
    folder = place(spark)
    return run(spark, state.latest_state(event_stream(spark, d, folder)), folder, "update", ["volume_id"]).select("volume_id", "event_id", "total_iops")


@query("stream_history", """SELECT user_id AS volume_id, event_id FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20""")
def _(spark, d):
    folder = place(spark)
    stream = event_stream(spark, d, folder)
    keep = sinks.newest(20, EVENTS)
    last = arrive(stream, folder, sinks.keep_deltas(f"{folder}/history", keep, COMPACT))
    return sinks.read_deltas(spark, f"{folder}/history", last, stream.schema, keep, COMPACT).select("volume_id", "event_id")


TICK = "TIME_BUCKET(INTERVAL 6 HOUR, ts)"


@query("stream_tick_completeness", f"""WITH t AS (SELECT {TICK} AS ts, COUNT(DISTINCT user_id) AS seen FROM events GROUP BY 1)
SELECT ts, seen, seen >= 5 AS complete, ts = (SELECT MAX(ts) FROM t WHERE seen >= 5) AS latest FROM t""")
def _(spark, d):
    folder = place(spark)
    events = event_stream(spark, d, folder).withColumn("ts", F.window("ts", "6 hours")["start"])
    t = run(spark, state.tick_completeness(events, 5, watermark="6 hours"), folder, "update", ["ts"])
    newest = state.latest_complete_tick(t).scalar()
    return t.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "seen", "complete", F.coalesce(F.col("ts") == newest, F.lit(False)).alias("latest"))


@query("stream_ingest_status", "SELECT COUNT(*) AS events, COUNT(DISTINCT user_id) AS volumes, MIN(ts) AS first_ts, MAX(ts) AS last_ts FROM events")
def _(spark, d):
    folder = place(spark)
    s = state.ingest_status(run(spark, state.ingest_by_volume(event_stream(spark, d, folder)), folder, "update", ["volume_id"]))
    return s.select("events", "volumes", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"))


@query("stream_throttle", """WITH RECURSIVE p AS (SELECT user_id, MIN(ts) AS ts FROM events GROUP BY 1
UNION ALL SELECT p.user_id, (SELECT MIN(e.ts) FROM events e WHERE e.user_id = p.user_id AND e.ts >= p.ts + INTERVAL 90 MINUTE) FROM p WHERE p.ts IS NOT NULL)
SELECT user_id AS volume_id, ts FROM p WHERE ts IS NOT NULL""")
def _(spark, d):
    folder = place(spark)
    kept = run(spark, state.throttle(event_stream(spark, d, folder), 5400), folder)
    return kept.select("volume_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


def telemetry_stream(spark, d, folder: str):
    """The telemetry as a stream, with the columns the online detector takes."""
    return in_parts(telemetry(spark, d).select("volume_id", "ts", *DETECTOR_METRICS), folder)


@query("stream_online_scores", f"{WITH_SCORES} SELECT volume_id, ts, {R('hotspot_score', 4)} AS hotspot_score FROM s")
def _(spark, d):
    folder = place(spark)
    # volumes are suppliers
    buckets = max(-(-table(spark, d, "supplier").count() // VOLUMES_PER_CALL), LEAST_BUCKETS)
    out = run(spark, state.online_scores(telemetry_stream(spark, d, folder), buckets=buckets), folder)
    return out.select("volume_id", "ts", rnd(F.col("hotspot_score"), 4).alias("hotspot_score"))


@query("stream_hot_runs", """
WITH m AS (SELECT event_id, user_id, ts, value >= 50 AS hot,
    SUM(CASE WHEN value >= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM events),
r AS (SELECT *, CASE WHEN hot THEN MIN(CASE WHEN hot THEN ts END) OVER (PARTITION BY user_id, grp) END AS run_start FROM m)
SELECT event_id, FLOOR(DATE_DIFF('microsecond', run_start, ts)/60e6*1e4+0.500001)/1e4 AS run_minutes,
  CASE WHEN NOT hot THEN 'cold' WHEN DATE_DIFF('microsecond', run_start, ts)/60e6 < 2 THEN 'waiting_persistence' ELSE 'verified' END AS status FROM r""")
def _(spark, d):
    folder = place(spark)
    e = event_stream(spark, d, folder)
    out = run(spark, state.online_hot_runs(e, 50, score="total_iops", keep=("event_id",)), folder)
    return out.select("event_id", rnd(F.col("run_minutes"), 4).alias("run_minutes"), "status")


@query("stream_fan_out", """SELECT 'latest' AS output, COUNT(DISTINCT user_id) AS n FROM events
UNION ALL SELECT 'alerts', COUNT(*) FROM events WHERE value >= 40
UNION ALL SELECT 'history', COUNT(*) FROM (SELECT 1 FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50)""")
def _(spark, d):
    folder = place(spark)
    stream = event_stream(spark, d, folder)
    last = arrive(stream, folder, sinks.fan_out_deltas(f"{folder}/out", 50, "total_iops", 40.0, EVENTS, COMPACT))

    def kept(name, n):
        return sinks.read_deltas(spark, f"{folder}/out/{name}", last, stream.schema, sinks.newest(n, EVENTS), COMPACT)

    def count(df, name):
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("output"), "n")

    return count(kept("latest", 1), "latest").unionByName(
        count(sinks.read_batches(spark, f"{folder}/out/alerts"), "alerts")).unionByName(
        count(kept("history", 50), "history"))


def _window_query(spark, d, build):
    folder = place(spark)
    out = run(spark, build(event_stream(spark, d, folder)), folder, "update", ["from", "volume_id"])
    cols = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("from", "to") if c in out.columns]
    return out.select(*cols, "volume_id", "n", rnd(F.col("total_iops"), 4).alias("total_iops"), "max_latency_us")


@query("stream_tumbling_windows", f"""SELECT DATE_TRUNC('hour', ts) AS "from", user_id AS volume_id, COUNT(*) AS n, {R('AVG(value)', 4)} AS total_iops, MAX(value * 10) AS max_latency_us FROM events GROUP BY 1, 2""")
def _(spark, d):
    return _window_query(spark, d, state.tumbling)


@query("stream_sliding_windows", f"""SELECT TIMESTAMP '1970-01-01' + INTERVAL 1 SECOND * CAST((FLOOR(EPOCH(ts) / 900) - i) * 900 AS BIGINT) AS "from", user_id AS volume_id, COUNT(*) AS n, {R('AVG(value)', 4)} AS total_iops,
  MAX(value * 10) AS max_latency_us FROM events, (SELECT UNNEST(RANGE(0, 4)) AS i) r GROUP BY 1, 2""")
def _(spark, d):
    return _window_query(spark, d, state.sliding)


@query("stream_session_windows", f"""WITH g AS (SELECT *, SUM(CASE WHEN p IS NULL OR ts >= p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
  FROM (SELECT *, LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) q)
SELECT MIN(ts) AS "from", MAX(ts) + INTERVAL 30 MINUTE AS "to", user_id AS volume_id, COUNT(*) AS n, {R('AVG(value)', 4)} AS total_iops, MAX(value * 10) AS max_latency_us FROM g GROUP BY user_id, s""")
def _(spark, d):
    folder = place(spark)
    out = run(spark, state.session(event_stream(spark, d, folder, marker=True)), folder, "append")
    return out.select(F.col("from").cast("timestamp_ntz").alias("from"), F.col("to").cast("timestamp_ntz").alias("to"),
                      "volume_id", "n", rnd(F.col("total_iops"), 4).alias("total_iops"), "max_latency_us")
