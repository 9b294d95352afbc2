"""Queries of aggregations, joins along time, ranking, set operations and scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.numeric import round_half_up as rnd
from tidewatch.functions.times import day_start, elapsed_minutes, floor_hour, round_hour
from tidewatch.operators import joins, ranking, sets, summaries, windows
from tidewatch.operators.splits import latest_tick
from tidewatch.plans.data_queries import FULL, telemetry_with_capacity
from tidewatch.plans.detection_queries import WITH_SCORES, scores
from tidewatch.plans.fixtures import (
    A_SQL, CAP_SQL, CLASSES, E_SQL, EVENTS, P_SQL, T_SQL, R, actions, capacity, events, predictions, table, telemetry,
)
from tidewatch.plans.registry import query

WT = f"WITH t AS ({T_SQL})"
WE = f"WITH e AS ({E_SQL})"
WC = f"WITH c AS ({CAP_SQL})"
WP = f"WITH p AS ({P_SQL})"
WA = f"WITH a AS ({A_SQL})"


def r4(df, *columns, n=4):
    return [rnd(F.col(c), n).alias(c) for c in columns]


# --- joins along time ---------------------------------------------------------------

@query("join_flags_to_rows", f"""{WITH_SCORES}
SELECT t.volume_id, t.ts, COALESCE(s.hotspot_score > 60, FALSE) AS flagged FROM t
LEFT JOIN (SELECT * FROM s WHERE hotspot_score >= 40) s ON t.volume_id = s.volume_id AND t.ts = s.ts""")
def _(spark, d):
    results = scores(spark, d).where("hotspot_score >= 40").select(
        "volume_id", "ts", (F.col("hotspot_score") > 60).alias("flagged"))
    return joins.join_flags(telemetry(spark, d).select("volume_id", "ts"), results, "flagged")


@query("join_exact_or_latest", f"""{WE}, q AS (SELECT action_id, volume_id, CASE WHEN action_id % 2 = 0 THEN ts + INTERVAL 1 HOUR ELSE ts END AS ts FROM ({A_SQL}) a),
x AS (SELECT volume_id, ts, MAX(event_id) AS event_id FROM e GROUP BY 1, 2),
l AS (SELECT volume_id, event_id, total_iops FROM e QUALIFY ROW_NUMBER() OVER (PARTITION BY volume_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT q.action_id, x.event_id IS NOT NULL AS is_exact, COALESCE(e.total_iops, l.total_iops) AS total_iops
FROM q LEFT JOIN x ON q.volume_id = x.volume_id AND q.ts = x.ts LEFT JOIN e ON e.event_id = x.event_id
LEFT JOIN l ON l.volume_id = q.volume_id""")
def _(spark, d):
    shift = F.when(F.col("action_id") % 2 == 0, F.expr("INTERVAL 1 HOUR")).otherwise(F.expr("INTERVAL 0 HOUR"))
    asked = actions(spark, d).select("action_id", "volume_id", (F.col("ts") + shift).alias("ts"))
    out = joins.exact_or_latest(asked, events(spark, d), ["total_iops"], EVENTS)
    return out.select("action_id", "is_exact", "total_iops")


@query("join_history_before", f"""{WE}, a AS ({A_SQL}),
j AS (SELECT a.action_id, e.total_iops, ROW_NUMBER() OVER (PARTITION BY a.action_id ORDER BY e.ts DESC, e.event_id DESC) AS k
  FROM a JOIN e ON a.volume_id = e.volume_id AND e.ts <= a.ts)
SELECT action_id, COUNT(*) AS n, MAX(CASE WHEN k = 1 THEN total_iops END) AS newest, {R('SUM(total_iops)', 4)} AS total
FROM j WHERE k <= 12 GROUP BY 1""")
def _(spark, d):
    h = joins.history_before(actions(spark, d), events(spark, d), "action_id", ["total_iops"], 12, EVENTS)
    q = F.col("history")
    return h.select("action_id", F.size(q).cast("bigint").alias("n"), q[F.size(q) - 1][0].alias("newest"),
                    rnd(F.aggregate(q, F.lit(0.0), lambda s, x: s + x[0]), 4).alias("total"))


@query("join_placement_dimension", """
SELECT l_suppkey AS volume_id, n_name AS node, r_name AS pool, COUNT(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3""")
def _(spark, d):
    # Counting first leaves one row per volume for the join.
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("volume_id")).agg(F.count(F.lit(1)).alias("n"))
    su, na, re = table(spark, d, "supplier"), table(spark, d, "nation"), table(spark, d, "region")
    return (rows.join(su, rows.volume_id == su.s_suppkey).join(na, F.col("s_nationkey") == na.n_nationkey)
            .join(re, F.col("n_regionkey") == re.r_regionkey)
            .select("volume_id", F.col("n_name").alias("node"), F.col("r_name").alias("pool"), "n"))


@query("join_action_samples", f"""{WE}, a AS ({A_SQL})
SELECT a.action_id, COUNT(*) AS n, MAX(e.avg_latency_us) AS worst FROM a JOIN e
ON a.volume_id = e.volume_id AND e.ts >= a.ts AND e.ts <= a.ts + INTERVAL 1 DAY GROUP BY 1""")
def _(spark, d):
    out = joins.within_after(actions(spark, d).select("action_id", "volume_id", "ts"),
                             events(spark, d).select("volume_id", "ts", "avg_latency_us"), 86400)
    return out.groupBy("action_id").agg(F.count(F.lit(1)).alias("n"), F.max("avg_latency_us").alias("worst"))


# --- aggregations -------------------------------------------------------------------

BASE_SQL = """bl AS (SELECT volume_id, AVG(avg_latency_us) AS lat_mean, GREATEST(COALESCE(STDDEV_SAMP(avg_latency_us), 1), 1) AS lat_std,
  COUNT(avg_latency_us) AS lat_n, AVG(total_iops) AS iops_mean, GREATEST(COALESCE(STDDEV_SAMP(total_iops), 1), 1) AS iops_std,
  COUNT(total_iops) AS iops_n FROM t GROUP BY 1 HAVING LEAST(COUNT(avg_latency_us), COUNT(total_iops)) >= 30)"""


@query("aggregate_entity_baseline", f"""{WT}, {BASE_SQL} SELECT volume_id, lat_n, iops_n, {R('lat_mean', 4)} AS lat_mean,
  {R('lat_std', 4)} AS lat_std, {R('iops_mean', 4)} AS iops_mean, {R('iops_std', 4)} AS iops_std FROM bl""")
def _(spark, d):
    b = summaries.entity_baseline(telemetry(spark, d))
    return b.select("volume_id", "lat_n", "iops_n", *r4(b, "lat_mean", "lat_std", "iops_mean", "iops_std"))


DAY_SQL = """dd AS (SELECT volume_id, DATE_TRUNC('day', ts) AS day, ARG_MAX(capacity_used_pct, ts) AS capacity_used_pct,
  ARG_MAX(capacity_total_gb, ts) AS capacity_total_gb FROM c GROUP BY 1, 2)"""


@query("aggregate_end_of_day", """
SELECT user_id AS volume_id, DATE_TRUNC('day', ts) AS day, ARG_MAX(value, (ts, event_id)) AS v
FROM events GROUP BY 1, 2""")
def _(spark, d):
    e = events(spark, d).withColumn("v", F.col("total_iops"))
    return summaries.end_of_day(e, ["v"], EVENTS)


DENSE_SQL = f"""{DAY_SQL}, g AS (SELECT volume_id, UNNEST(GENERATE_SERIES(MIN(day), MAX(day), INTERVAL 1 DAY)) AS day FROM dd GROUP BY 1),
dc AS (SELECT g.volume_id, g.day, LAST_VALUE(capacity_used_pct IGNORE NULLS) OVER w AS capacity_used_pct,
  LAST_VALUE(capacity_total_gb IGNORE NULLS) OVER w AS capacity_total_gb
  FROM g LEFT JOIN dd ON g.volume_id = dd.volume_id AND g.day = dd.day
  WINDOW w AS (PARTITION BY g.volume_id ORDER BY g.day ROWS UNBOUNDED PRECEDING))"""


@query("aggregate_daily_densified", f"{WC}, {DENSE_SQL} SELECT * FROM dc")
def _(spark, d):
    return summaries.daily_capacity(capacity(spark, d))


HOURLY = """hh AS (SELECT volume_id, TIMESTAMP '1970-01-01' + INTERVAL 1 HOUR * CAST(ROUND_EVEN(EPOCH_US(ts) / 3.6e9, 0) AS BIGINT) AS hour,
  AVG(total_iops) AS total_iops, AVG(avg_latency_us) AS avg_latency_us FROM e GROUP BY 1, 2),
hg AS (SELECT volume_id, UNNEST(GENERATE_SERIES(MIN(hour), MAX(hour), INTERVAL 1 HOUR)) AS hour FROM hh GROUP BY 1),
hd AS (SELECT hg.volume_id, hg.hour, COALESCE(LAST_VALUE(total_iops IGNORE NULLS) OVER w, 0) AS total_iops,
  GREATEST(COALESCE(LAST_VALUE(avg_latency_us IGNORE NULLS) OVER w, 0), 0) AS avg_latency_us
  FROM hg LEFT JOIN hh ON hg.volume_id = hh.volume_id AND hg.hour = hh.hour
  WINDOW w AS (PARTITION BY hg.volume_id ORDER BY hg.hour ROWS UNBOUNDED PRECEDING))"""


@query("aggregate_hourly_means", f"""{WE}, {HOURLY} SELECT volume_id, hour, {R('total_iops', 4)} AS total_iops,
  {R('avg_latency_us', 4)} AS avg_latency_us FROM hd""")
def _(spark, d):
    h = summaries.hourly_means(events(spark, d), ["total_iops", "avg_latency_us"], EVENTS, ("avg_latency_us",))
    return h.select("volume_id", "hour", *r4(h, "total_iops", "avg_latency_us"))


KEY = ["total_iops", "avg_latency_us", "total_throughput_mbps", "sequential_ratio"]
#: With the volume's capacity, the five of the class statistics.
KEY_FULL = [*KEY, "capacity_used_pct"]


@query("aggregate_class_means", f"{WT} SELECT workload_type, {', '.join(R(f'AVG({m})', 4) + f' AS {m}' for m in KEY)} FROM t GROUP BY 1")
def _(spark, d):
    m = summaries.class_means(telemetry(spark, d), KEY)
    return m.select("workload_type", *r4(m, *KEY))


@query("aggregate_class_statistics", f"WITH {FULL} " + " UNION ALL ".join(
    f"""SELECT workload_type, '{m}' AS metric, COUNT({m}) AS count, {R(f'AVG({m})', 4)} AS mean, {R(f'MEDIAN({m})', 4)} AS median,
    {R(f'STDDEV_SAMP({m})', 4)} AS std, MIN({m}) AS min, MAX({m}) AS max FROM f GROUP BY 1""" for m in KEY_FULL))
def _(spark, d):
    s = summaries.class_statistics(telemetry_with_capacity(spark, d).select("workload_type", *KEY_FULL), KEY_FULL)
    return s.select("workload_type", "metric", "count", *r4(s, "mean", "median", "std"), "min", "max")


@query("aggregate_class_counts", "SELECT event_type AS workload_type, COUNT(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    return summaries.class_counts(events(spark, d))


@query("aggregate_box_statistics", f"WITH {FULL} " + " UNION ALL ".join(
    f"""SELECT f.workload_type, '{m}' AS metric, {R('q1', 4)} AS q1, {R('median', 4)} AS median, {R('q3', 4)} AS q3,
  {R(f'MIN(CASE WHEN {m} >= q1 - 1.5*(q3-q1) AND {m} <= q3 + 1.5*(q3-q1) THEN {m} END)', 4)} AS low_whisker,
  {R(f'MAX(CASE WHEN {m} >= q1 - 1.5*(q3-q1) AND {m} <= q3 + 1.5*(q3-q1) THEN {m} END)', 4)} AS high_whisker,
  SUM(CASE WHEN {m} >= q1 - 1.5*(q3-q1) AND {m} <= q3 + 1.5*(q3-q1) THEN 0 ELSE 1 END) AS outliers
FROM f JOIN (SELECT workload_type, QUANTILE_CONT({m}, 0.25) AS q1, MEDIAN({m}) AS median, QUANTILE_CONT({m}, 0.75) AS q3 FROM f GROUP BY 1) q
  ON f.workload_type = q.workload_type WHERE {m} IS NOT NULL GROUP BY f.workload_type, q1, median, q3""" for m in KEY_FULL))
def _(spark, d):
    b = summaries.box_statistics(telemetry_with_capacity(spark, d).select("workload_type", *KEY_FULL), KEY_FULL)
    return b.select("workload_type", "metric", *r4(b, "q1", "median", "q3"), *r4(b, "low_whisker", "high_whisker"), "outliers")


CORR = ["total_iops", "avg_latency_us", "total_throughput_mbps", "queue_depth", "read_iops", "write_iops", "read_write_ratio",
        "sequential_ratio", "read_latency_p99_us", "write_latency_p99_us"]


@query("aggregate_correlations", WT + " " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {R(f'CORR({a}, {b})', 6)} AS r FROM t" for i, a in enumerate(CORR) for b in CORR[i + 1:]))
def _(spark, d):
    c = summaries.correlations(telemetry(spark, d), CORR)
    return c.select("a", "b", rnd(F.col("r"), 6).alias("r"))


@query("aggregate_distinct_counts", f"{WT} SELECT COUNT(DISTINCT volume_id) AS volume_id, COUNT(DISTINCT node_id) AS node_id, COUNT(DISTINCT pool_id) AS pool_id FROM t")
def _(spark, d):
    return summaries.distinct_counts(telemetry(spark, d), ["volume_id", "node_id", "pool_id"])


@query("aggregate_volumes_per_tier", f"{WT} SELECT tier, COUNT(DISTINCT volume_id) AS volumes FROM t GROUP BY 1")
def _(spark, d):
    return telemetry(spark, d).groupBy("tier").agg(F.count_distinct("volume_id").alias("volumes"))


@query("aggregate_anomaly_rate", f"""{WITH_SCORES} SELECT volume_id, SUM(CASE WHEN hotspot_score >= 40 THEN 1 ELSE 0 END) AS anomalies,
  COUNT(*) AS total, SUM(CASE WHEN hotspot_score >= 40 THEN 1 ELSE 0 END)::DOUBLE / COUNT(*) AS rate FROM s GROUP BY 1""")
def _(spark, d):
    return summaries.anomaly_rate(scores(spark, d).withColumn("flag", F.col("hotspot_score") >= 40), "flag")


@query("aggregate_score_distribution", f"""{WITH_SCORES} SELECT COUNT(hotspot_score) AS count, {R('AVG(hotspot_score)', 4)} AS mean,
  {R('STDDEV_POP(hotspot_score)', 4)} AS std, MIN(hotspot_score) AS min, {R('MAX(hotspot_score)', 4)} AS max,
  {R('MEDIAN(hotspot_score)', 4)} AS p50, {R('QUANTILE_CONT(hotspot_score, 0.95)', 4)} AS p95,
  {R('QUANTILE_CONT(hotspot_score, 0.99)', 4)} AS p99 FROM s""")
def _(spark, d):
    x = summaries.score_distribution(scores(spark, d).select("hotspot_score"), "hotspot_score")
    return x.select("count", *r4(x, "mean", "std"), "min", *r4(x, "max", "p50", "p95", "p99"))


BIN_SQL = """tp AS (SELECT {by} SUM(CASE WHEN t AND p THEN 1 ELSE 0 END) AS tp, SUM(CASE WHEN NOT t AND p THEN 1 ELSE 0 END) AS fp,
  SUM(CASE WHEN NOT t AND NOT p THEN 1 ELSE 0 END) AS tn, SUM(CASE WHEN t AND NOT p THEN 1 ELSE 0 END) AS fn FROM {src} {grp}),
bm AS (SELECT *, (tp+tn)::DOUBLE/(tp+fp+tn+fn) AS accuracy, COALESCE(tp::DOUBLE/NULLIF(tp+fp,0),0) AS precision,
  COALESCE(tp::DOUBLE/NULLIF(tp+fn,0),0) AS recall FROM tp),
bf AS (SELECT *, COALESCE(2*precision*recall/NULLIF(precision+recall,0),0) AS f1 FROM bm)"""


@query("aggregate_binary_metrics", f"""WITH x AS (SELECT quality = 1 AS t, toxic = 1 AS p FROM labels),
{BIN_SQL.format(by='', src='x', grp='')} SELECT tp, fp, tn, fn, {', '.join(R(c, 6) + f' AS {c}' for c in ('accuracy', 'precision', 'recall', 'f1'))} FROM bf""")
def _(spark, d):
    m = summaries.binary_metrics(table(spark, d, "labels"), "quality", "toxic")
    return m.select("tp", "fp", "tn", "fn", *r4(m, "accuracy", "precision", "recall", "f1", n=6))


@query("aggregate_confusion_matrix", WP + " SELECT truth, " + ", ".join(
    f"SUM(CASE WHEN predicted = '{c}' THEN 1 ELSE 0 END) AS n_{c}, " + R(f"100.0::DOUBLE*SUM(CASE WHEN predicted = '{c}' THEN 1 ELSE 0 END)/COUNT(*)", 4) + f" AS pct_{c}"
    for c in CLASSES) + " FROM p GROUP BY 1")
def _(spark, d):
    m = summaries.confusion(predictions(spark, d), "truth", "predicted", CLASSES)
    return m.select("truth", *[f"n_{c}" for c in CLASSES], *r4(m, *[f"pct_{c}" for c in CLASSES]))


def class_sql(pred: str, tag: str) -> str:
    return f"""{tag} AS (SELECT class, COALESCE(tp::DOUBLE/NULLIF(pr,0),0) AS precision, COALESCE(tp::DOUBLE/NULLIF(su,0),0) AS recall, su AS support, tp
  FROM (SELECT class, (SELECT COUNT(*) FROM p WHERE truth = class AND {pred} = class) AS tp,
    (SELECT COUNT(*) FROM p WHERE {pred} = class) AS pr, (SELECT COUNT(*) FROM p WHERE truth = class) AS su
    FROM (SELECT DISTINCT truth AS class FROM p) k) z),
{tag}f AS (SELECT *, COALESCE(2*precision*recall/NULLIF(precision+recall,0),0) AS f1 FROM {tag})"""


@query("aggregate_class_metrics", f"{WP}, {class_sql('predicted', 'm')} SELECT class, support, {R('precision', 6)} AS precision, {R('recall', 6)} AS recall, {R('f1', 6)} AS f1 FROM mf")
def _(spark, d):
    m = summaries.class_metrics(predictions(spark, d), "truth", "predicted")
    return m.select("class", "support", *r4(m, "precision", "recall", "f1", n=6))


AVG_COLS = ["accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_recall", "weighted_f1"]


@query("aggregate_averaged_metrics", f"""{WP}, {class_sql('predicted', 'm')}, v AS (SELECT SUM(tp)::DOUBLE/SUM(support) AS accuracy, SUM(support) AS support,
  {', '.join(f'AVG({c}) AS macro_{c}, SUM({c}*support)/SUM(support) AS weighted_{c}' for c in ('precision', 'recall', 'f1'))} FROM mf)
SELECT support, {', '.join(R(c, 6) + f' AS {c}' for c in AVG_COLS)} FROM v""")
def _(spark, d):
    m = summaries.averaged_metrics(summaries.class_metrics(predictions(spark, d), "truth", "predicted"))
    return m.select("support", *r4(m, *AVG_COLS, n=6))


@query("aggregate_fleet_kpi_latest_tick", f"{WT} SELECT {R('AVG(avg_latency_us)', 4)} AS avg_latency_us, SUM(total_iops) AS total_iops, COUNT(*) AS n_rows FROM t WHERE ts = (SELECT MAX(ts) FROM t)")
def _(spark, d):
    k = summaries.fleet_kpi(latest_tick(telemetry(spark, d)))
    return k.select(*r4(k, "avg_latency_us"), "total_iops", "n_rows")


LATEST_SQL = "l AS (SELECT * FROM t QUALIFY ROW_NUMBER() OVER (PARTITION BY volume_id ORDER BY ts DESC) = 1)"


@query("aggregate_fleet_kpi_latest_rows", f"{WT}, {LATEST_SQL} SELECT {R('AVG(avg_latency_us)', 4)} AS avg_latency_us, SUM(total_iops) AS total_iops, COUNT(*) AS n_rows FROM l")
def _(spark, d):
    k = summaries.fleet_kpi(windows.latest_rows(telemetry(spark, d)))
    return k.select(*r4(k, "avg_latency_us"), "total_iops", "n_rows")


@query("aggregate_action_summary", f"""{WA} SELECT COUNT(*) AS total_actions, SUM(CASE WHEN status = 'rolled_back' THEN 1 ELSE 0 END) AS rolled_back_count,
  {R("100.0::DOUBLE*SUM(CASE WHEN status = 'rolled_back' THEN 1 ELSE 0 END)/COUNT(*)", 4)} AS rollback_rate_pct, SUM(CASE WHEN status = 'monitoring' THEN 1 ELSE 0 END) AS active_monitors FROM a""")
def _(spark, d):
    s = summaries.action_summary(actions(spark, d))
    return s.select("total_actions", "rolled_back_count", *r4(s, "rollback_rate_pct"), "active_monitors")


@query("aggregate_status_counts", f"{WA} SELECT status, COUNT(*) AS n FROM a GROUP BY 1")
def _(spark, d):
    return summaries.status_counts(actions(spark, d))


# --- running figures over a log --------------------------------------------------------

@query("window_prequential_accuracy", f"""{WP}, n AS (SELECT ROW_NUMBER() OVER w AS n_seen, SUM(CASE WHEN truth = predicted THEN 1 ELSE 0 END) OVER w AS n_correct
  FROM p WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT n_seen, n_correct, n_correct::DOUBLE / n_seen AS accuracy FROM n WHERE n_seen % 500 = 0""")
def _(spark, d):
    return windows.prequential_accuracy(predictions(spark, d), "truth", "predicted", EVENTS, every=500)


@query("window_trailing_hour_moves", f"""{WA} SELECT action_id, COUNT(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS recent
FROM a WHERE action = 'migrate'""")
def _(spark, d):
    moves = actions(spark, d).where("action = 'migrate'")
    return windows.trailing_count(moves, 3600).select("action_id", "recent")


BREAKER_SQL = """br AS (SELECT action_id, ts, ROW_NUMBER() OVER w AS n_actions, SUM(CASE WHEN status = 'rolled_back' THEN 1 ELSE 0 END) OVER w AS n_rolled_back
  FROM a WINDOW w AS (ORDER BY ts, action_id ROWS UNBOUNDED PRECEDING)),
bt AS (SELECT *, 100.0::DOUBLE * n_rolled_back / n_actions AS rate FROM br),
bx AS (SELECT *, MAX(CASE WHEN n_actions >= 10 AND rate > {max} THEN 1 ELSE 0 END) OVER (ORDER BY ts, action_id ROWS UNBOUNDED PRECEDING) = 1 AS tripped FROM bt)"""


@query("window_rollback_rate", f"{WA}, {BREAKER_SQL.format(max=27)} SELECT action_id, n_actions, n_rolled_back, {R('rate', 4)} AS rollback_rate_pct, tripped FROM bx")
def _(spark, d):
    r = windows.rollback_rate(actions(spark, d), 27.0)
    return r.select("action_id", "n_actions", "n_rolled_back", *r4(r, "rollback_rate_pct"), "tripped")


# --- ranking ------------------------------------------------------------------------------

@query("rank_top_volumes_by_rate", f"""{WITH_SCORES}, g AS (SELECT volume_id, SUM(CASE WHEN hotspot_score >= 40 THEN 1 ELSE 0 END) AS anomalies, COUNT(*) AS total FROM s GROUP BY 1)
SELECT volume_id, anomalies, total, anomalies::DOUBLE / total AS rate FROM g ORDER BY anomalies::DOUBLE / total DESC, volume_id LIMIT 5""")
def _(spark, d):
    rate = summaries.anomaly_rate(scores(spark, d).withColumn("flag", F.col("hotspot_score") >= 40), "flag")
    return ranking.top(rate, 5, "rate", ["volume_id"])


@query("rank_top_volumes_by_count", f"""{WITH_SCORES} SELECT volume_id, COUNT(*) AS alerts FROM s WHERE hotspot_score >= 40 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(spark, d):
    n = scores(spark, d).where("hotspot_score >= 40").groupBy("volume_id").agg(F.count(F.lit(1)).alias("alerts"))
    return ranking.top(n, 10, "alerts", ["volume_id"])


@query("rank_alerts_by_score", f"{WITH_SCORES} SELECT volume_id, ts, {R('hotspot_score', 4)} AS hotspot_score FROM s WHERE hotspot_score >= 40 ORDER BY hotspot_score DESC")
def _(spark, d):
    a = scores(spark, d).where("hotspot_score >= 40").select("volume_id", "ts", *r4(None, "hotspot_score"))
    return a.orderBy(F.col("hotspot_score").desc(), "volume_id", "ts")


@query("rank_by_urgency", "SELECT o_orderkey AS id, o_totalprice AS days FROM orders UNION ALL SELECT -1, NULL ORDER BY days NULLS LAST")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("days"))
    o = o.unionByName(spark.createDataFrame([(-1, None)], o.schema))
    return ranking.by_urgency(o, "days", ["id"])


@query("rank_by_category", f"""{WITH_SCORES} SELECT volume_id, ts, CASE WHEN hotspot_score < 60 THEN 'warning' WHEN hotspot_score < 80 THEN 'high' ELSE 'critical' END AS severity,
 CASE WHEN hotspot_score < 60 THEN 2 WHEN hotspot_score < 80 THEN 1 ELSE 0 END AS place FROM s WHERE hotspot_score >= 40""")
def _(spark, d):
    from tidewatch.functions.numeric import severity
    a = scores(spark, d).where("hotspot_score >= 40").select("volume_id", "ts", severity(F.col("hotspot_score")).alias("severity"))
    order = ["critical", "high", "warning"]
    return ranking.by_category(a, "severity", order, ["volume_id", "ts"]).withColumn("place", ranking.category_rank("severity", order))


@query("rank_high_middle_low", f"""{WC}, l AS (SELECT * FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY volume_id ORDER BY ts DESC) = 1),
k AS (SELECT volume_id, capacity_used_pct, ROW_NUMBER() OVER (ORDER BY capacity_used_pct DESC, volume_id) AS i, COUNT(*) OVER () AS n FROM l)
SELECT volume_id, capacity_used_pct, CASE WHEN i <= 2 THEN 'high' WHEN i > n - 2 THEN 'low' ELSE 'middle' END AS band FROM k
WHERE i <= 2 OR i > n - 2 OR i IN (n // 2, n // 2 + 1)""")
def _(spark, d):
    latest = windows.latest_rows(capacity(spark, d)).select("volume_id", "capacity_used_pct")
    return ranking.high_middle_low(latest, "capacity_used_pct", "volume_id")


@query("rank_first_per_category", f"{WT} SELECT workload_type, MIN(volume_id) AS volume_id FROM t GROUP BY 1")
def _(spark, d):
    return ranking.first_per(telemetry(spark, d).select("workload_type", "volume_id"), "workload_type", ["volume_id"])


# --- set operations ------------------------------------------------------------------------

@query("set_history_and_live", """SELECT event_id, ts, user_id, value FROM events UNION ALL SELECT event_id, ts, user_id, value FROM events WHERE event_type = 'view'""")
def _(spark, d):
    e = table(spark, d, "events")
    live = e.where("event_type = 'view'").select("ts", "event_id", "value", "user_id", F.lit(1).alias("extra"))
    return sets.history_and_live(e.select("event_id", "ts", "user_id", "value"), live)


@query("set_live_wins", """SELECT event_id, CASE WHEN event_type = 'view' THEN value + 1 ELSE value END AS value FROM events""")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("volume_id"), "ts", "value", "event_type")
    live = e.where("event_type = 'view'").withColumn("value", F.col("value") + 1)
    return sets.history_and_live(e, live, live_wins=True, roles=EVENTS).select("event_id", "value")


@query("set_train_and_validation", f"{WE} SELECT event_id FROM e WHERE ts < (SELECT DATE_TRUNC('day', MIN(ts)) FROM e) + INTERVAL 25 DAY")
def _(spark, d):
    from tidewatch.operators.splits import chronological_split
    return sets.splits(chronological_split(events(spark, d)), ["train", "val"]).select("event_id")


@query("set_unpivot_scores", f"""{WITH_SCORES} SELECT volume_id, ts, score_type, {R('score', 4)} AS score FROM (
  SELECT volume_id, ts, UNNEST(['total_iops_z', 'latency_z', 'hotspot_score']) AS score_type, UNNEST([total_iops_z, latency_z, hotspot_score]) AS score FROM s) u""")
def _(spark, d):
    u = sets.unpivot(scores(spark, d), ["volume_id", "ts"], ["total_iops_z", "latency_z", "hotspot_score"])
    return u.select("volume_id", "ts", "score_type", *r4(u, "score"))


# --- scalar functions -----------------------------------------------------------------------

@query("scalar_math", f"""SELECT event_id, {R('SIN(value)', 6)} AS sin, {R('COS(value)', 6)} AS cos, {R('LN(1+value)', 6)} AS log1p,
  {R('LOG2(value+1)', 6)} AS log2, {R('EXP(-value/100)', 6)} AS exp, SIGN(value-50)::INTEGER AS sign, {R('ABS(value-50)', 4)} AS abs,
  LEAST(GREATEST(value, 10), 100) AS clip, FLOOR(value)::BIGINT AS floor FROM events""")
def _(spark, d):
    from tidewatch.functions.numeric import clip
    v = F.col("value")
    return table(spark, d, "events").select(
        "event_id", rnd(F.sin(v), 6).alias("sin"), rnd(F.cos(v), 6).alias("cos"), rnd(F.log1p(v), 6).alias("log1p"),
        rnd(F.log2(v + 1), 6).alias("log2"), rnd(F.exp(-v / 100), 6).alias("exp"), F.signum(v - 50).cast("int").alias("sign"),
        rnd(F.abs(v - 50), 4).alias("abs"), clip(v, 10.0, 100.0).alias("clip"), F.floor(v).alias("floor"))


@query("scalar_times", f"""SELECT event_id, DATE_TRUNC('hour', ts) AS floor_hour,
  TIMESTAMP '1970-01-01' + INTERVAL 1 HOUR * CAST(ROUND_EVEN(EPOCH_US(ts) / 3.6e9, 0) AS BIGINT) AS round_hour,
  DATE_TRUNC('day', ts) AS midnight, ts + INTERVAL 21 DAY AS later, {R("DATE_DIFF('microsecond', DATE_TRUNC('day', ts), ts)/60e6", 4)} AS minutes FROM events""")
def _(spark, d):
    return table(spark, d, "events").select(
        "event_id", floor_hour("ts").alias("floor_hour"), round_hour("ts").alias("round_hour"), day_start("ts").alias("midnight"),
        (F.col("ts") + F.expr("INTERVAL 21 DAY")).alias("later"),
        rnd(elapsed_minutes(day_start("ts"), F.col("ts")), 4).alias("minutes"))


@query("scalar_texts", f"""SELECT event_id, LOWER(event_type) IN ('view', 'click') AS known, event_type LIKE 'p%' AS is_p,
  'Volume ' || user_id || ' scored ' || CAST(FLOOR(value)::BIGINT AS VARCHAR) || '.' AS message FROM events""")
def _(spark, d):
    return table(spark, d, "events").select(
        "event_id", F.lower("event_type").isin("view", "click").alias("known"), F.startswith(F.col("event_type"), F.lit("p")).alias("is_p"),
        F.format_string("Volume %d scored %d.", F.col("user_id"), F.floor("value")).alias("message"))


@query("scalar_arrays", f"""WITH t AS ({T_SQL}), w AS (SELECT volume_id, ts, LIST(total_iops) OVER (PARTITION BY volume_id ORDER BY ts ROWS 6 PRECEDING) AS a FROM t)
SELECT volume_id, ts, LIST_MAX(a) AS top, COALESCE(LIST_POSITION(LIST_TRANSFORM(a, lambda x: x >= 60), TRUE), 0) - 1 AS first_high,
  LIST_MEDIAN(LIST_TRANSFORM(RANGE(1, LEN(a)), lambda i: a[i+1] - a[i])) AS median_step, LIST_SUM(a[-3:]) AS last3,
  LIST_POSITION(a, LIST_MAX(a)) - 1 AS argmax FROM w""")
def _(spark, d):
    from tidewatch.functions import arrays
    from tidewatch.operators.windows import trailing_arrays
    t = trailing_arrays(telemetry(spark, d), ["total_iops"], steps=7)
    a = F.transform("sequence", lambda x: x[0])
    return t.withColumn("a", a).select(
        "volume_id", "ts", F.array_max("a").alias("top"), arrays.first_index_at_least(F.col("a"), 60).alias("first_high"),
        arrays.median(arrays.steps(F.col("a"))).alias("median_step"),
        F.aggregate(arrays.last_n(F.col("a"), 3), F.lit(0.0), lambda s, x: s + x).alias("last3"), arrays.argmax(F.col("a")).alias("argmax"))


@query("scalar_maps", f"""{WITH_SCORES} SELECT volume_id, ts, {R('latency_z', 4)} AS latency, {R('latency_z + total_iops_z + total_throughput_mbps_z', 4)} AS total FROM s""")
def _(spark, d):
    from tidewatch.functions import arrays
    def entry(k, c):
        return F.struct(F.lit(k).alias("k"), F.col(c).alias("v"))

    m = F.map_from_entries(F.array(entry("latency", "latency_z"), entry("iops", "total_iops_z"),
                                   entry("throughput", "total_throughput_mbps_z")))
    x = scores(spark, d).withColumn("m", m)
    return x.select("volume_id", "ts", rnd(F.col("m")["latency"], 4).alias("latency"), rnd(arrays.map_total(F.col("m")), 4).alias("total"))


@query("scalar_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS k1 FROM events")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
    back = F.from_json(F.to_json(F.struct((F.col("k") + 1).alias("n"))), "n bigint")["n"]
    return e.select("event_id", "k", back.alias("k1"))


@query("scalar_defaults", """SELECT event_id, COALESCE(CASE WHEN event_id % 3 = 0 THEN value END, CASE WHEN event_id % 3 = 1 THEN value * 2 END, 1000.0) AS v FROM events""")
def _(spark, d):
    i, v = F.col("event_id"), F.col("value")
    return table(spark, d, "events").select(
        "event_id", F.coalesce(F.when(i % 3 == 0, v), F.when(i % 3 == 1, v * 2), F.lit(1000.0)).alias("v"))
