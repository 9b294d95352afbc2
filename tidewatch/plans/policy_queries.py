"""Queries of policy decisions and served tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.numeric import round_half_up as rnd
from tidewatch.operators import classify_results, forecast, policy, summaries, topology
from tidewatch.operators.windows import latest_rows
from tidewatch.plans import views
from tidewatch.plans.detection_queries import RAW_SQL, SCORES_SQL, SEV, WITH_SCORES, fused, scores
from tidewatch.plans.fixtures import A_SQL, CAP_SQL, E_SQL, EVENTS, T_SQL, R, actions, capacity, events, predictions, replicas, table, telemetry
from tidewatch.plans.forecast_queries import DEMAND_SQL, LAT_SQL, SLO, TREND_SQL, TTV_SQL, demand, latency, recent, violation
from tidewatch.plans.registry import query
from tidewatch.plans.summary_queries import LATEST_SQL, WA, WP, WT, class_sql, r4
from tidewatch.plans.topology_queries import CAPVOL, VC, GROUPS, PAIRS, PLACE, TARGET, UTIL, pairs, place, utilization, volume_capacity
from tidewatch.session import stage


def ctes(*parts: str) -> str:
    """Join texts that each start with WITH into one list of common tables."""
    return "WITH " + ", ".join(p.strip().removeprefix("WITH ") for p in parts)


def hot_volumes(spark, d):
    """Every volume as a candidate, with the summed impact on its neighbours."""
    impact = pairs(spark, d).groupBy(F.col("aggressor_id").alias("volume_id")).agg(F.sum("impact").alias("victim_impact"))
    return place(spark, d).join(impact, "volume_id", "left").select("volume_id", "node_id", "tier", "victim_impact")


CAND = f"""{PAIRS}, {PLACE}, {GROUPS}, {UTIL}, im AS (SELECT aggressor_id AS volume_id, SUM(impact) AS vi FROM pr GROUP BY 1),
hv AS (SELECT pl.volume_id, pl.node_id, pl.tier, vi, {TARGET.format('pl.node_id')} AS target, group_id FROM pl LEFT JOIN im ON im.volume_id = pl.volume_id JOIN gr ON gr.volume_id = pl.volume_id),
ca AS (SELECT volume_id, 0 AS preference, 'migrate' AS action, CAST(target AS VARCHAR) AS target,
    GREATEST(0, (SELECT total_iops FROM ut WHERE node_id = hv.node_id) - (SELECT total_iops FROM ut WHERE node_id = hv.target)) AS expected_improvement,
    NOT EXISTS (SELECT 1 FROM gr m WHERE m.group_id = hv.group_id AND m.node_id = hv.target) AS safe FROM hv
  UNION ALL SELECT volume_id, 1, 'qos', '3000.0', COALESCE(vi, 0), TRUE FROM hv
  UNION ALL SELECT volume_id, 2, 'tier_change', 'NVMe', CASE WHEN tier = 'HDD' THEN 50 ELSE 0 END, TRUE FROM hv)"""


def candidates(spark, d):
    return policy.candidate_actions(hot_volumes(spark, d), utilization(spark, d), place(spark, d), replicas(spark, d))


@query("policy_candidate_actions", f"{CAND} SELECT volume_id, action, target, {R('expected_improvement', 4)} AS expected_improvement, safe FROM ca")
def _(spark, d):
    c = candidates(spark, d)
    return c.select("volume_id", "action", "target", *r4(c, "expected_improvement"), "safe")


@query("policy_best_action", f"""{CAND}, bb AS (SELECT * FROM ca WHERE safe QUALIFY ROW_NUMBER() OVER (PARTITION BY volume_id ORDER BY expected_improvement DESC, preference) = 1)
SELECT volume_id, CASE WHEN expected_improvement <= 0 THEN 'no_improvement' ELSE 'selected' END AS status, CASE WHEN expected_improvement > 0 THEN action END AS action,
  CASE WHEN expected_improvement > 0 THEN target END AS target, {R('expected_improvement', 4)} AS expected_improvement FROM bb""")
def _(spark, d):
    b = policy.best_action(candidates(spark, d))
    return b.select("volume_id", "status", "action", "target", *r4(b, "expected_improvement"))


def moves(spark, d):
    """Migration requests of five clusters."""
    return actions(spark, d).where("action = 'migrate'").select((F.col("volume_id") % 5).alias("cluster_id"), "action_id", "ts")


@query("policy_admission", f"""{WA.replace('WITH ', 'WITH RECURSIVE ', 1)}, mv AS (SELECT volume_id % 5 AS cluster_id, action_id, ts, EPOCH_US(ts) AS us, ROW_NUMBER() OVER (PARTITION BY volume_id % 5 ORDER BY ts, action_id) AS i FROM a WHERE action = 'migrate'),
fo AS (SELECT DISTINCT cluster_id, 0::BIGINT AS i, NULL::BIGINT AS action_id, []::BIGINT[] AS ran, NULL::VARCHAR AS reason FROM mv
  UNION ALL SELECT q.cluster_id, q.i, q.action_id, CASE WHEN q.why IS NULL THEN LIST_APPEND(q.kept, q.us) ELSE q.kept END, q.why
  FROM (SELECT *, CASE WHEN LEN(LIST_FILTER(kept, lambda x: x > us - 1800000000)) >= 1 THEN 'concurrent_limit' WHEN LEN(kept) >= 3 THEN 'rate_limit' END AS why
    FROM (SELECT m.cluster_id, m.i, m.action_id, m.us, LIST_FILTER(f.ran, lambda x: x >= m.us - 3600000000) AS kept FROM fo f JOIN mv m ON m.cluster_id = f.cluster_id AND m.i = f.i + 1) p) q)
SELECT mv.cluster_id, mv.action_id, mv.ts, CASE WHEN reason IS NULL THEN 'executed' ELSE 'queued' END AS status, reason FROM fo JOIN mv USING (cluster_id, i)""")
def _(spark, d):
    return policy.admit(moves(spark, d), active_seconds=1800).select("cluster_id", "action_id", "ts", "status", "reason")


@query("policy_limits_of_logged_moves", f"""{WA}, n AS (SELECT action_id, COUNT(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) - 1 AS recent,
  COUNT(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 5 MINUTE PRECEDING AND CURRENT ROW) - 1 AS running FROM a WHERE action = 'migrate')
SELECT action_id, recent, running, CASE WHEN running >= 1 THEN 'concurrent_limit' WHEN recent >= 3 THEN 'rate_limit' END AS over_limit FROM n""")
def _(spark, d):
    from tidewatch.operators.windows import trailing_count
    m = actions(spark, d).where("action = 'migrate'").select("action_id", "ts")
    m = trailing_count(trailing_count(m, 3600, name="recent"), 300, name="running")
    recent, running = F.col("recent") - 1, F.col("running") - 1
    return m.select("action_id", recent.alias("recent"), running.alias("running"),
                    F.when(running >= 1, "concurrent_limit").when(recent >= 3, "rate_limit").alias("over_limit"))


@query("policy_queue_drain", f"""{WA}, q AS (SELECT volume_id % 5 AS cluster_id, action_id, FLOOR(EPOCH(ts))::BIGINT AS s, ROW_NUMBER() OVER (PARTITION BY volume_id % 5 ORDER BY ts, action_id) - 1 AS k FROM a WHERE action = 'migrate')
SELECT x.cluster_id, x.action_id, x.k + 1 AS queue_place, TIMESTAMP '1970-01-01' + INTERVAL 1 SECOND * CAST(MAX(y.s + ((x.k - y.k) // 3) * 14400 + ((x.k - y.k) % 3) * 4800) AS BIGINT) AS starts_at
FROM q x JOIN q y ON x.cluster_id = y.cluster_id AND y.k <= x.k GROUP BY 1, 2, 3""")
def _(spark, d):
    s = policy.drain_schedule(moves(spark, d), active_seconds=4800)
    return s.select("cluster_id", "action_id", "queue_place", "starts_at")


@query("policy_breaker_status", f"""{WA}, br AS (SELECT action_id, ts, ROW_NUMBER() OVER w AS n, SUM(CASE WHEN status = 'rolled_back' THEN 1 ELSE 0 END) OVER w AS r FROM a WINDOW w AS (ORDER BY ts, action_id ROWS UNBOUNDED PRECEDING)),
bo AS (SELECT *, 100.0::DOUBLE*r/n AS rate, n >= 10 AND 100.0::DOUBLE*r/n > 27 AS o FROM br)
SELECT MIN(CASE WHEN o THEN ts END) IS NOT NULL AS tripped, MIN(CASE WHEN o THEN ts END) AS tripped_at, {R('ARG_MAX(rate, n)', 4)} AS current_rate_pct, COUNT(*) AS total_actions FROM bo""")
def _(spark, d):
    b = policy.breaker_status(actions(spark, d), 27.0)
    return b.select("tripped", "tripped_at", *r4(b, "current_rate_pct"), "total_actions")


OUTCOME = f"""{WA}, e AS ({E_SQL}), bd AS (SELECT a.action_id, MIN(e.ts) AS rolled_back_at FROM a JOIN e ON a.volume_id = e.volume_id AND e.ts >= a.ts AND e.ts <= a.ts + INTERVAL 1 DAY
  WHERE (e.avg_latency_us - GREATEST(pre_latency, 1)) / GREATEST(pre_latency, 1) * 100 > 20 GROUP BY 1),
oc AS (SELECT a.action_id, rolled_back_at, CASE WHEN rolled_back_at IS NOT NULL THEN 'rolled_back' WHEN a.ts + INTERVAL 1 DAY <= (SELECT MAX(ts) FROM e) THEN 'success' ELSE 'monitoring' END AS outcome FROM a LEFT JOIN bd ON a.action_id = bd.action_id)"""


def outcomes(spark, d):
    return policy.evaluate_actions(actions(spark, d), events(spark, d), 86400)


@query("policy_action_outcomes", f"{OUTCOME} SELECT action_id, rolled_back_at, outcome AS status FROM oc")
def _(spark, d):
    return outcomes(spark, d).select("action_id", "rolled_back_at", "status")


@query("policy_action_history", f"{OUTCOME} SELECT a.action_id, volume_id, ts, action, target, status, outcome AS monitor_status, rolled_back_at FROM a JOIN oc USING (action_id)")
def _(spark, d):
    h = policy.action_history(actions(spark, d), outcomes(spark, d))
    return h.select("action_id", "volume_id", "ts", "action", "target", "status", "monitor_status", "rolled_back_at")


@query("policy_outcome_counts", f"{OUTCOME} SELECT outcome AS status, COUNT(*) AS n FROM oc GROUP BY 1")
def _(spark, d):
    return summaries.status_counts(outcomes(spark, d))


LCAP = "lc AS (SELECT * FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY volume_id ORDER BY ts DESC) = 1)"
COARSE = "dz AS (SELECT volume_id, MIN(CASE WHEN v >= 0.85 THEN k - 1 END)::DOUBLE AS warning_days, MIN(CASE WHEN v >= 0.95 THEN k - 1 END)::DOUBLE AS critical_days FROM fc GROUP BY 1)"
COARSE_ALL = ctes(f"c AS ({CAP_SQL})", TREND_SQL, COARSE, LCAP)


def coarse_days(spark, d):
    f = forecast.capacity_forecast(recent(spark, d))
    return f.select("volume_id", forecast.days_to_fill_coarse(F.col("forecast"), 0.85).alias("warning_days"),
                    forecast.days_to_fill_coarse(F.col("forecast"), 0.95).alias("critical_days"))


@query("policy_autoscale_triggers", ctes(COARSE_ALL, f"t AS ({T_SQL})", PLACE) + """, tg AS (
  SELECT ARG_MAX(volume_id, (capacity_used_pct, volume_id)) AS volume_id, 'cluster_capacity' AS reason, 0 AS o FROM lc HAVING AVG(capacity_used_pct)*100 >= 80
  UNION ALL SELECT volume_id, 'dtf_warning', 1 FROM dz WHERE warning_days <= 7)
SELECT tg.volume_id, reason, CAST(pool_id AS VARCHAR) AS pool_id FROM tg JOIN pl ON tg.volume_id = pl.volume_id ORDER BY o, tg.volume_id LIMIT 4""")
def _(spark, d):
    return policy.autoscale_triggers(latest_rows(capacity(spark, d)), coarse_days(spark, d), place(spark, d), threshold_pct=80, max_new=4).select("volume_id", "reason", "pool_id")


def requests(spark, d):
    """Manual requests out of the click events, some of them wrong."""
    i, u = F.col("event_id"), F.col("user_id")
    kind = F.when(i % 5 == 0, "migrate").when(i % 5 == 1, "qos").when(i % 5 == 2, "tier_change").when(i % 5 == 3, "rollback").otherwise("reset")
    return table(spark, d, "events").where("event_type = 'click'").select(
        i.alias("request_id"), "ts", kind.alias("kind"), u.alias("volume_id"),
        F.when(i % 5 == 0, (i % 30).cast("string")).when(i % 5 == 1, F.when(i % 2 == 0, "many").otherwise((i % 90).cast("string"))).otherwise("SSD").alias("target"),
        F.when(i % 5 == 3, i + 1).alias("action_id"))


REQ = f"""rq AS (SELECT event_id AS request_id, ts, ['migrate','qos','tier_change','rollback','reset'][event_id % 5 + 1] AS kind, user_id AS volume_id,
  CASE event_id % 5 WHEN 0 THEN CAST(event_id % 30 AS VARCHAR) WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN 'many' ELSE CAST(event_id % 90 AS VARCHAR) END ELSE 'SSD' END AS target,
  CASE WHEN event_id % 5 = 3 THEN event_id + 1 END AS action_id FROM events WHERE event_type = 'click'),
ck AS (SELECT *, CASE WHEN kind IN ('migrate','qos','tier_change') AND volume_id NOT IN (SELECT volume_id FROM pl) THEN 'unknown volume'
  WHEN kind = 'migrate' AND target NOT IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation) THEN 'unknown node'
  WHEN kind = 'qos' AND TRY_CAST(target AS DOUBLE) IS NULL THEN 'cap is not a number'
  WHEN kind = 'rollback' AND action_id NOT IN (SELECT action_id FROM a) THEN 'unknown action' END AS problem FROM rq)"""
REQ_ALL = ctes(WT, PLACE, f"a AS ({A_SQL})", REQ)


def checked(spark, d):
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").alias("node_id"))
    return policy.check_requests(requests(spark, d), place(spark, d), nodes, actions(spark, d))


@query("policy_check_requests", f"{REQ_ALL} SELECT request_id, kind, problem FROM ck")
def _(spark, d):
    return checked(spark, d).select("request_id", "kind", "problem")


@query("policy_append_requests", f"""{REQ_ALL} SELECT action_id, volume_id, action, target, CASE WHEN action_id IN (SELECT action_id FROM ck WHERE problem IS NULL AND kind = 'rollback') THEN 'rolled_back' ELSE status END AS status FROM a
UNION ALL SELECT request_id, volume_id, kind, target, 'executed' FROM ck WHERE problem IS NULL AND kind IN ('migrate','qos','tier_change')""")
def _(spark, d):
    return policy.append_requests(actions(spark, d), checked(spark, d)).drop("ts", "pre_latency")


# --- served tables ------------------------------------------------------------------------

@query("view_kpi", ctes(WT, LATEST_SQL, f"a AS ({A_SQL})") + f""" SELECT {R('AVG(avg_latency_us)', 4)} AS avg_latency_us, SUM(total_iops) AS total_iops, COUNT(*) AS n_rows,
  (SELECT COUNT(*) FROM a) AS total_actions, (SELECT COUNT(*) FROM a WHERE status = 'rolled_back') AS rolled_back_count,
  {R("(SELECT 100.0::DOUBLE*SUM(CASE WHEN status = 'rolled_back' THEN 1 ELSE 0 END)/COUNT(*) FROM a)", 4)} AS rollback_rate_pct, 95.0::DOUBLE AS accuracy_target_pct, 30.0::DOUBLE AS variance_reduction_target_pct FROM l""")
def _(spark, d):
    k = views.kpi(latest_rows(telemetry(spark, d)), actions(spark, d))
    return k.select(*r4(k, "avg_latency_us"), "total_iops", "n_rows", "total_actions", "rolled_back_count", *r4(k, "rollback_rate_pct"),
                    "accuracy_target_pct", "variance_reduction_target_pct")


def analysis(spark, d, latency_arrays=None):
    """The newest state per volume: score, class, days to fill, time to violation.

    Each is a row per volume made out of a whole table, and staged: the shuffles of one go before the next begins.
    """
    base = stage(latest_rows(scores(spark, d), columns=["hotspot_score", "workload_type", "tier", "node_id"]), "newest", release=True)
    days = stage(coarse_days(spark, d), "days", release=True)
    cap = stage(latest_rows(capacity(spark, d)).select("volume_id", "capacity_used_pct"), "used", release=True)
    v = stage(violation(spark, d, latency_arrays), "violation", release=True)
    out = base.join(days, "volume_id", "left").join(cap, "volume_id", "left").join(v, "volume_id", "left")
    return out.withColumn("risk_score", forecast.latency_risk(F.col("max_p95_us"), SLO)["risk_score"])


ANALYSIS = ctes(WITH_SCORES, COARSE_ALL, TTV_SQL) + f""", sl AS (SELECT * FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY volume_id ORDER BY ts DESC) = 1),
an AS (SELECT sl.volume_id, sl.ts, sl.hotspot_score, sl.workload_type, sl.tier, sl.node_id, warning_days, critical_days, capacity_used_pct, will_breach, hours_to_breach, breach_at_step, max_p95_us, risk_level,
  CASE WHEN max_p95_us >= {SLO} THEN 1 ELSE max_p95_us/{SLO} END AS risk_score
  FROM sl LEFT JOIN dz ON dz.volume_id = sl.volume_id LEFT JOIN lc ON lc.volume_id = sl.volume_id LEFT JOIN tw ON tw.volume_id = sl.volume_id)"""


@query("view_volumes", f"""{ANALYSIS}, lv AS (SELECT * FROM t WHERE ts > (SELECT MAX(ts) FROM t) - INTERVAL 3 DAY QUALIFY ROW_NUMBER() OVER (PARTITION BY volume_id ORDER BY ts DESC) = 1)
SELECT an.volume_id, {R('hotspot_score', 4)} AS hotspot_score, an.workload_type, an.tier, capacity_used_pct, {R('risk_score', 6)} AS risk_score,
  COALESCE(lv.total_iops, 0) AS current_iops, COALESCE(lv.avg_latency_us, 0) AS current_latency_us, COALESCE(lv.ts, an.ts) AS last_seen, lv.ts IS NOT NULL AS is_live FROM an LEFT JOIN lv ON an.volume_id = lv.volume_id""")
def _(spark, d):
    # live is what reported in the newest days
    t = telemetry(spark, d)
    live = latest_rows(t.where(F.col("ts") > t.agg(F.max("ts")).scalar() - F.expr("INTERVAL 3 DAYS")))
    v = views.volume_list(analysis(spark, d), live)
    return v.withColumns({"hotspot_score": rnd(F.col("hotspot_score"), 4), "risk_score": rnd(F.col("risk_score"), 6)})


@query("view_volume_history", f"""{WT} SELECT volume_id, ts, read_iops, write_iops, total_iops, read_throughput_mbps, write_throughput_mbps, avg_latency_us, read_latency_p95_us, write_latency_p95_us, queue_depth::DOUBLE AS queue_depth
FROM t QUALIFY ROW_NUMBER() OVER (PARTITION BY volume_id ORDER BY ts DESC) <= 100""")
def _(spark, d):
    return views.volume_history(telemetry(spark, d), 100)


@query("view_alerts", f"""{WITH_SCORES}, sl AS (SELECT * FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY volume_id ORDER BY ts DESC) = 1)
SELECT volume_id, {R('hotspot_score', 4)} AS hotspot_score, {SEV.format('hotspot_score')} AS severity, workload_type, ts FROM sl WHERE hotspot_score >= 20""")
def _(spark, d):
    base = latest_rows(scores(spark, d), columns=["hotspot_score", "workload_type"])
    a = views.alerts(base, 20.0)
    return a.withColumn("hotspot_score", rnd(F.col("hotspot_score"), 4))


@query("view_noisy_neighbors", ctes(PAIRS, SCORES_SQL.replace("z AS", "zz AS").replace("FROM z)", "FROM zz)")) + f""", sl AS (SELECT * FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY volume_id ORDER BY ts DESC) = 1)
SELECT aggressor_id, victim_id, {R('SUM(impact)', 4)} AS impact, COUNT(*) AS times, {R('ANY_VALUE(hotspot_score)', 4)} AS hotspot_score, ANY_VALUE(workload_type) AS workload_type FROM pr LEFT JOIN sl ON aggressor_id = sl.volume_id GROUP BY 1, 2""")
def _(spark, d):
    base = latest_rows(scores(spark, d), columns=["hotspot_score", "workload_type"])
    n = views.noisy_neighbors(pairs(spark, d), base)
    return n.select("aggressor_id", "victim_id", *r4(n, "impact"), "times", *r4(n, "hotspot_score"), "workload_type")


@query("view_capacity_urgency", f"{COARSE_ALL} SELECT volume_id, warning_days, critical_days FROM dz ORDER BY critical_days NULLS LAST")
def _(spark, d):
    return views.capacity_urgency(coarse_days(spark, d))


@query("view_violation_urgency", f"{TTV_SQL} SELECT volume_id, {R('hours_to_breach', 4)} AS hours_to_breach, risk_level FROM tw")
def _(spark, d):
    v = views.violation_urgency(violation(spark, d))
    return v.select("volume_id", *r4(v, "hours_to_breach"), "risk_level")


TIERS = ctes(WT, PLACE, CAPVOL) + f""", th AS (SELECT COALESCE(tier, 'Unknown') AS tier, SUM(total_gb) AS total, SUM(COALESCE(f,0)*total_gb) AS used, SUM(GREATEST(total_gb - COALESCE(f,0)*total_gb, 0)) AS headroom_gb FROM vc GROUP BY 1)"""


@query("view_one_tier", f"{TIERS} SELECT tier, {R('headroom_gb', 2)} AS headroom_gb, {R('used*100/total', 4)} AS used_pct FROM th WHERE tier = 'SSD'")
def _(spark, d):
    t = views.one_tier(topology.headroom(volume_capacity(spark, d), "tier"), "SSD")
    return t.select("tier", rnd(F.col("headroom_gb"), 2).alias("headroom_gb"), *r4(t, "used_pct"))


REC = f"""{ctes(ANALYSIS, PLACE, VC)}, th AS (SELECT COALESCE(tier, 'Unknown') AS tier, SUM(total_gb) AS total, SUM(COALESCE(f,0)*total_gb) AS used FROM vc GROUP BY 1)
SELECT priority, volume_id, COUNT(*) AS n FROM (
  SELECT volume_id::VARCHAR AS volume_id, CASE WHEN critical_days < 7 THEN 'CRITICAL' ELSE 'WARNING' END AS priority FROM an WHERE critical_days < 7 OR (COALESCE(critical_days, 99) >= 7 AND warning_days < 30)
  UNION ALL SELECT volume_id::VARCHAR, 'HIGH' FROM an WHERE hotspot_score >= 80
  UNION ALL {{latency}}
  UNION ALL SELECT 'CLUSTER', CASE WHEN used*100/total >= 90 THEN 'CRITICAL' ELSE 'WARNING' END FROM th WHERE used*100/total >= 80) u GROUP BY 1, 2"""


def _recommend(spark, d, risk_rule):
    t = topology.headroom(volume_capacity(spark, d), "tier")
    return views.recommendations(analysis(spark, d), t, risk_rule).groupBy("priority", "volume_id").agg(F.count(F.lit(1)).alias("n"))


@query("view_recommendations", REC.format(latency="SELECT volume_id::VARCHAR, CASE risk_level WHEN 'critical' THEN 'CRITICAL' WHEN 'high' THEN 'HIGH' ELSE 'MEDIUM' END FROM an WHERE risk_level IN ('critical','high','medium')"))
def _(spark, d):
    return _recommend(spark, d, False)


@query("view_recommendations_by_risk", REC.format(latency="SELECT volume_id::VARCHAR, 'MEDIUM' FROM an WHERE risk_score >= 0.8"))
def _(spark, d):
    return _recommend(spark, d, True)


@query("view_model_performance", f"""{WP}, {class_sql('predicted', 'm')} SELECT class, support, {R('precision', 4)} AS precision, {R('recall', 4)} AS recall, {R('f1', 4)} AS f1,
  {R('(SELECT SUM(tp)::DOUBLE/SUM(support) FROM mf)', 4)} AS accuracy, (SELECT SUM(support) FROM mf)::BIGINT AS sample_count FROM mf""")
def _(spark, d):
    m = classify_results.performance(predictions(spark, d), "truth", "predicted")
    return m.select("class", "support", *r4(m, "precision", "recall", "f1", "accuracy"), "sample_count")


@query("view_score_breakdown", f"""{RAW_SQL}, b3 AS (SELECT * FROM ez ORDER BY ensemble_score DESC, volume_id LIMIT 3)
SELECT volume_id, k AS score_type, {R('v', 4)} AS score FROM (SELECT volume_id, UNNEST(['stat_score','forest_score','sequence_score','ensemble_score']) AS k, UNNEST([stat_score, forest_score, sequence_score, ensemble_score]) AS v FROM b3) q""")
def _(spark, d):
    b = views.score_breakdown(fused(spark, d))
    return b.select("volume_id", "score_type", *r4(b, "score"))


def record(spark, d):
    """The analysis record; its parts are staged one after the other, as in :func:`analysis`."""
    lat = stage(forecast.forecast_arrays(latency(spark, d), ["p50", "p90", "p95"]), "latency", release=True)
    dem = stage(forecast.forecast_arrays(demand(spark, d), ["total_iops_p50", "total_iops_p95", "total_iops_p99"]), "demand", release=True)
    return views.analysis_record(analysis(spark, d, lat), pairs(spark, d), lat, dem)


@query("view_analysis_record")
def _(spark, d):
    return record(spark, d)


def _array_sum(c: str):
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


@query("view_analysis_figures", f"""{ANALYSIS}, vi AS ({ctes(PAIRS)} SELECT aggressor_id AS volume_id, COUNT(DISTINCT victim_id) AS n, SUM(impact) AS impact FROM pr GROUP BY 1),
lt AS (SELECT volume_id, SUM(p50) AS p50, SUM(p90) AS p90, SUM(p95) AS p95 FROM lf GROUP BY 1),
dm AS ({DEMAND_SQL} SELECT volume_id, SUM(p50) AS p50, SUM(p95) AS p95, SUM(p99) AS p99 FROM di GROUP BY 1)
SELECT an.volume_id, an.ts, workload_type, {R('hotspot_score', 4)} AS hotspot_score, COALESCE(vi.n, 0) AS victims, {R('COALESCE(vi.impact, 0)', 4)} AS victim_impact, warning_days, critical_days,
  {R('lt.p50', 3)} AS latency_p50, {R('lt.p90', 3)} AS latency_p90, {R('lt.p95', 3)} AS latency_p95, {R('dm.p50', 3)} AS demand_p50, {R('dm.p95', 3)} AS demand_p95, {R('dm.p99', 3)} AS demand_p99
FROM an LEFT JOIN vi USING (volume_id) LEFT JOIN lt USING (volume_id) LEFT JOIN dm USING (volume_id)""")
def _(spark, d):
    """The record's figures, arrays as their sums."""
    r = record(spark, d)
    return r.select(
        "volume_id", "ts", "workload_type", *r4(r, "hotspot_score"), F.col("neighbor_victims.count").alias("victims"), rnd(F.col("neighbor_victims.impact"), 4).alias("victim_impact"),
        F.col("days_to_fill.warning_days").alias("warning_days"), F.col("days_to_fill.critical_days").alias("critical_days"),
        *[rnd(_array_sum(f"latency_forecast.{p}"), 3).alias(f"latency_{p}") for p in ("p50", "p90", "p95")],
        *[rnd(_array_sum(f"demand_forecast.total_iops_{p}"), 3).alias(f"demand_{p}") for p in ("p50", "p95", "p99")])


@query("view_volume_forecasts", f"""{LAT_SQL} SELECT step, {R('p50', 4)} AS p50, {R('p95', 4)} AS p95 FROM lf WHERE volume_id = 1""")
def _(spark, d):
    lat = forecast.forecast_arrays(latency(spark, d), ["step", "p50", "p95"])
    dem = forecast.forecast_arrays(demand(spark, d), ["total_iops_p50"])
    one = views.volume_forecasts(lat, dem, 1)
    return one.select(F.explode(F.arrays_zip("step", "p50", "p95")).alias("z")).select(
        F.col("z.step").cast("bigint").alias("step"), rnd(F.col("z.p50"), 4).alias("p50"), rnd(F.col("z.p95"), 4).alias("p95"))


# --- given predictions ----------------------------------------------------------------------

@query("classify_model_agreement", f"""{WP}, lp AS (SELECT * FROM p QUALIFY ROW_NUMBER() OVER (PARTITION BY volume_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT COUNT(*) AS volumes, SUM(CASE WHEN predicted = second THEN 1 ELSE 0 END) AS agreeing, {R('100.0::DOUBLE*SUM(CASE WHEN predicted = second THEN 1 ELSE 0 END)/COUNT(*)', 4)} AS agreement_pct FROM lp""")
def _(spark, d):
    a = classify_results.agreement(latest_rows(predictions(spark, d), EVENTS), "predicted", "second")
    return a.select("volumes", "agreeing", *r4(a, "agreement_pct"))


@query("classify_disagreeing_volumes", f"""{WP}, lp AS (SELECT * FROM p QUALIFY ROW_NUMBER() OVER (PARTITION BY volume_id ORDER BY ts DESC, event_id DESC) = 1) SELECT volume_id, predicted, second FROM lp WHERE predicted <> second""")
def _(spark, d):
    return classify_results.disagreeing(latest_rows(predictions(spark, d), EVENTS), "predicted", "second").select("volume_id", "predicted", "second")


@query("classify_drift_signal", f"""{WP}, bk AS (SELECT DATE_TRUNC('day', ts) AS bucket, COUNT(*) AS n, AVG(CASE WHEN truth = predicted THEN 1.0::DOUBLE ELSE 0 END) AS accuracy FROM p GROUP BY 1),
pv AS (SELECT *, LAG(n) OVER (ORDER BY bucket) AS n0, LAG(accuracy) OVER (ORDER BY bucket) AS a0 FROM bk)
SELECT bucket, n, {R('accuracy', 6)} AS accuracy, {R('SQRT(0.5*(1.0/n + 1.0/n0)*LN(4/0.5::DOUBLE))', 6)} AS bound, COALESCE(ABS(accuracy - a0) > SQRT(0.5*(1.0/n + 1.0/n0)*LN(4/0.5::DOUBLE)), FALSE) AS drift FROM pv""")
def _(spark, d):
    s = classify_results.drift_signal(predictions(spark, d), "truth", "predicted", delta=0.5)
    return s.select("bucket", "n", *r4(s, "accuracy", "bound", n=6), "drift")


@query("classify_pseudo_labels", f"{WP} SELECT event_id, predicted AS label FROM p WHERE top_probability > 0.85")
def _(spark, d):
    p = predictions(spark, d).withColumn("probabilities", F.array(F.col("top_probability"), 1 - F.col("top_probability")))
    return classify_results.pseudo_labels(p, "probabilities", "predicted").select("event_id", "label")


@query("classify_compare_models", f"""{WP}, {class_sql('predicted', 'm')}, {class_sql('second', 'n')}
SELECT mf.class, {R('mf.f1', 6)} AS first_f1, {R('nf.f1', 6)} AS second_f1 FROM mf JOIN nf ON mf.class = nf.class""")
def _(spark, d):
    c = classify_results.compare(predictions(spark, d), "truth", "predicted", "second")
    return c.select("class", *r4(c, "first_f1", "second_f1", n=6))
