"""Queries of topology, load, headroom, replicas and noisy neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.numeric import round_half_up as rnd
from tidewatch.operators import neighbors, ranking, topology
from tidewatch.operators.windows import latest_rows
from tidewatch.plans.detection_queries import WITH_SCORES, scores
from tidewatch.plans.fixtures import A_SQL, CAP_SQL, REP_SQL, R, actions, capacity, replicas, table, telemetry
from tidewatch.plans.registry import query
from tidewatch.plans.summary_queries import BASE_SQL, LATEST_SQL, WT, r4
from tidewatch.session import stage

PLACE = f"{LATEST_SQL}, pl AS (SELECT volume_id, node_id, pool_id, tier FROM l)"


def place(spark, d):
    return topology.placement(telemetry(spark, d))


@query("topology_placement", f"{WT}, {PLACE} SELECT * FROM pl")
def _(spark, d):
    return place(spark, d)


@query("topology_volumes_on_nodes", f"{WT}, {PLACE} SELECT node_id, volume_id FROM pl WHERE node_id IN (3, 7, 11)")
def _(spark, d):
    return topology.volumes_on_nodes(place(spark, d), [3, 7, 11])


BUSIEST = "bz AS (SELECT node_id, volume_id FROM l QUALIFY ROW_NUMBER() OVER (PARTITION BY node_id ORDER BY total_iops DESC, volume_id DESC) = 1)"


@query("topology_neighbors", f"""{WT}, {LATEST_SQL}, {BUSIEST}
SELECT bz.volume_id, bz.node_id, l.volume_id AS neighbor_id FROM bz JOIN l ON bz.node_id = l.node_id AND bz.volume_id <> l.volume_id""")
def _(spark, d):
    t = telemetry(spark, d)
    busiest = latest_rows(t).groupBy("node_id").agg(F.max(F.struct("total_iops", "volume_id")).alias("b")).select("b.volume_id")
    return topology.neighbors(topology.placement(t), busiest)


@query("topology_graph_nodes", f"""{WT}, {PLACE} SELECT DISTINCT 'node_' || node_id AS id, 'storage_node' AS type, NULL AS owner FROM pl
UNION ALL SELECT 'vol_' || volume_id, 'volume', 'node_' || node_id FROM pl""")
def _(spark, d):
    return topology.graph_export(place(spark, d))[0]


@query("topology_graph_edges", f"{WT}, {PLACE} SELECT 'vol_' || volume_id AS source, 'node_' || node_id AS target, 'resides_on' AS relation FROM pl")
def _(spark, d):
    return topology.graph_export(place(spark, d))[1]


UTIL = """ut AS (SELECT n_nationkey AS node_id, COUNT(l.volume_id) AS n_volumes, COALESCE(SUM(total_iops), 0) AS total_iops,
  COALESCE(SUM(total_throughput_mbps), 0) AS total_throughput_mbps, COALESCE(AVG(avg_latency_us), 0) AS avg_latency_us
  FROM nation LEFT JOIN l ON l.node_id = n_nationkey GROUP BY 1)"""


def utilization(spark, d, t=None):
    t = telemetry(spark, d) if t is None else t
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").alias("node_id"))
    return topology.node_utilization(topology.placement(t), latest_rows(t), nodes)


@query("topology_node_utilization", f"""{WT}, {LATEST_SQL}, {UTIL} SELECT node_id, n_volumes, total_iops,
  {R('total_throughput_mbps', 2)} AS total_throughput_mbps, {R('avg_latency_us', 4)} AS avg_latency_us FROM ut""")
def _(spark, d):
    u = utilization(spark, d)
    return u.select("node_id", "n_volumes", "total_iops", rnd(F.col("total_throughput_mbps"), 2).alias("total_throughput_mbps"), *r4(u, "avg_latency_us"))


TARGET = "(SELECT node_id FROM ut u2 WHERE u2.node_id <> {0} ORDER BY total_iops, node_id LIMIT 1)"


@query("join_least_loaded_other_node", f"{WT}, {LATEST_SQL}, {UTIL} SELECT node_id, {TARGET.format('ut.node_id')} AS target_node FROM ut")
def _(spark, d):
    u = utilization(spark, d)
    return topology.with_best_target(u.select("node_id"), u).select("node_id", "target_node")


@query("topology_node_panel", f"""{WITH_SCORES}, lt AS (SELECT * FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY volume_id ORDER BY ts DESC) = 1)
SELECT node_id, SUM(total_iops) AS total_iops, {R('COALESCE(AVG(NULLIF(avg_latency_us, 0)), 0)', 4)} AS avg_latency_us,
  SUM(CASE WHEN hotspot_score >= 40 THEN 1 ELSE 0 END) AS hot_volumes, COUNT(*) AS volumes FROM lt GROUP BY 1""")
def _(spark, d):
    last = latest_rows(scores(spark, d), columns=["node_id", "total_iops", "avg_latency_us", "hotspot_score"])
    p = topology.node_panel(last)
    return p.select("node_id", "total_iops", *r4(p, "avg_latency_us"), "hot_volumes", "volumes")


VC = """vc AS (SELECT pl.volume_id, CASE WHEN pl.volume_id % 17 <> 0 THEN tier END AS tier, CAST(pool_id AS VARCHAR) AS pool_id, capacity_total_gb AS total_gb,
  CASE WHEN pl.volume_id % 5 = 0 THEN LEAST(1, GREATEST(0, capacity_used_gb / capacity_total_gb)) ELSE capacity_used_pct END AS f
  FROM pl LEFT JOIN lc ON pl.volume_id = lc.volume_id)"""
CAPVOL = f"c AS ({CAP_SQL}), lc AS (SELECT * FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY volume_id ORDER BY ts DESC) = 1), {VC}"
HEAD = """SELECT COALESCE({0}, 'Unknown') AS {0}, {tot} AS total_capacity_gb, {used} AS used_capacity_gb, {head} AS headroom_gb, COUNT(*) AS volume_count,
  SUM(CASE WHEN f >= 0.9 THEN 1 ELSE 0 END) AS critical_count, {pct} AS used_pct FROM vc GROUP BY 1"""


def _head_sql(by):
    return f"{WT}, {PLACE}, {CAPVOL} " + HEAD.format(
        by, tot=R("SUM(total_gb)", 2), used=R("SUM(COALESCE(f,0)*total_gb)", 2), head=R("SUM(GREATEST(total_gb - COALESCE(f,0)*total_gb, 0))", 2),
        pct=R("100*SUM(COALESCE(f,0)*total_gb)/SUM(total_gb)", 4))


def volume_capacity(spark, d):
    p = place(spark, d).withColumn("tier", F.when(F.col("volume_id") % 17 != 0, F.col("tier")))
    live = latest_rows(capacity(spark, d)).withColumn(
        "capacity_used_pct", F.when(F.col("volume_id") % 5 != 0, F.col("capacity_used_pct")))
    return topology.volume_capacity(p, live)


def _head(spark, d, by):
    h = topology.headroom(volume_capacity(spark, d), by)
    return h.select(by, *r4(h, "total_capacity_gb", "used_capacity_gb", "headroom_gb", n=2), "volume_count", "critical_count", *r4(h, "used_pct"))


@query("topology_tier_headroom", _head_sql("tier"))
def _(spark, d):
    return _head(spark, d, "tier")


@query("topology_pool_headroom", _head_sql("pool_id"))
def _(spark, d):
    return _head(spark, d, "pool_id")


@query("topology_critical_volumes", f"{WT}, {PLACE}, {CAPVOL} SELECT COALESCE(tier, 'Unknown') AS tier, volume_id FROM vc WHERE f >= 0.9")
def _(spark, d):
    return topology.critical_volumes(volume_capacity(spark, d), "tier").select("tier", "volume_id")


GROUPS = f"rp AS ({REP_SQL}), gr AS (SELECT pl.volume_id, COALESCE(primary_id, pl.volume_id) AS group_id, node_id FROM pl LEFT JOIN rp ON pl.volume_id = replica_id)"


@query("topology_replica_groups", f"{WT}, {PLACE}, {GROUPS} SELECT * FROM gr")
def _(spark, d):
    return topology.replica_groups(place(spark, d), replicas(spark, d))


@query("join_replica_anti_affinity", f"""{WT}, {PLACE}, {GROUPS}, q AS (SELECT s_suppkey AS volume_id, (s_nationkey + (s_suppkey % 3)) % 25 AS target_node FROM supplier)
SELECT q.volume_id, q.target_node, gr.group_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM gr m WHERE m.group_id = gr.group_id AND m.node_id = q.target_node) AS allowed
FROM q LEFT JOIN gr ON q.volume_id = gr.volume_id""")
def _(spark, d):
    k = F.col("s_suppkey")
    asked = table(spark, d, "supplier").select(k.alias("volume_id"), ((F.col("s_nationkey") + k % 3) % 25).alias("target_node"))
    return topology.validate_migrations(asked, place(spark, d), replicas(spark, d))


def base_place(spark, d):
    ev = table(spark, d, "events").select(F.col("user_id").alias("volume_id")).distinct()
    v = F.col("volume_id")
    return ev.select("volume_id", (v % 25).alias("node_id"), F.when(v % 2 == 0, "SSD").otherwise("HDD").alias("tier"))


BASE_PLACE = "bp AS (SELECT DISTINCT user_id AS volume_id, user_id % 25 AS node_id, CASE WHEN user_id % 2 = 0 THEN 'SSD' ELSE 'HDD' END AS tier FROM events)"


@query("topology_effective_placement", f"""WITH a AS ({A_SQL}), {BASE_PLACE},
k AS (SELECT volume_id, action, target FROM a WHERE status <> 'rolled_back' QUALIFY ROW_NUMBER() OVER (PARTITION BY volume_id, action ORDER BY ts DESC, action_id DESC) = 1)
SELECT bp.volume_id, COALESCE(CAST(m.target AS BIGINT), bp.node_id) AS node_id, COALESCE(c.target, bp.tier) AS tier, CAST(q.target AS DOUBLE) AS iops_limit
FROM bp LEFT JOIN k m ON m.volume_id = bp.volume_id AND m.action = 'migrate' LEFT JOIN k c ON c.volume_id = bp.volume_id AND c.action = 'tier_change'
LEFT JOIN k q ON q.volume_id = bp.volume_id AND q.action = 'qos'""")
def _(spark, d):
    return topology.effective_placement(base_place(spark, d), actions(spark, d))


@query("join_placement_override", f"""WITH {BASE_PLACE}, o AS (SELECT user_id AS volume_id, ts, event_id % 25 AS node_id FROM events WHERE event_type = 'signup' AND event_id % 2 = 0),
k AS (SELECT * FROM o QUALIFY ROW_NUMBER() OVER (PARTITION BY volume_id ORDER BY ts DESC, node_id DESC) = 1)
SELECT bp.volume_id, COALESCE(k.node_id, bp.node_id) AS node_id, tier FROM bp LEFT JOIN k ON bp.volume_id = k.volume_id""")
def _(spark, d):
    o = table(spark, d, "events").where("event_type = 'signup'").select(
        F.col("user_id").alias("volume_id"), "ts", F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 25).alias("node_id"))
    return topology.override_placement(base_place(spark, d), o)


@query("topology_pool_members", f"""{WT}, {PLACE}, x AS (SELECT pool_id, node_id, FALSE AS added FROM pl
UNION ALL SELECT event_id % 5, 1000 + event_id % 100, TRUE FROM events WHERE event_type = 'signup') SELECT pool_id, node_id, MIN(added) AS added FROM x GROUP BY 1, 2""")
def _(spark, d):
    grown = table(spark, d, "events").where("event_type = 'signup'").select(
        (F.col("event_id") % 5).alias("pool_id"), (1000 + F.col("event_id") % 100).alias("node_id"))
    return topology.pool_members(place(spark, d), grown)


# --- noisy neighbours ------------------------------------------------------------------

# Lower thresholds than the defaults: these tables are sparse in time.
PAIRS = f"""{WT}, {BASE_SQL}, z AS (SELECT t.*, (avg_latency_us - lat_mean)/lat_std AS latency_z, (total_iops - iops_mean)/iops_std AS iops_z FROM t JOIN bl USING (volume_id)),
vi AS (SELECT volume_id AS victim_id, ts, node_id, latency_z, iops_z, latency_z / GREATEST(iops_z, 0.1) AS impact, avg_latency_us, total_iops FROM z WHERE latency_z > 0.5 AND iops_z < 1),
ag AS (SELECT volume_id AS aggressor_id, ts, node_id, total_iops AS aggressor_score, total_iops AS aggressor_iops, avg_latency_us AS aggressor_latency_us FROM t WHERE total_iops >= 70),
pr AS (SELECT ag.*, victim_id, latency_z, iops_z, impact, vi.avg_latency_us AS victim_latency_now, vi.total_iops AS victim_iops_now
  FROM ag JOIN vi ON ag.node_id = vi.node_id AND ag.ts = vi.ts AND aggressor_id <> victim_id)"""


def load(spark, d):
    """What the neighbours need of the telemetry: worked out once, and read by each of their steps."""
    t = telemetry(spark, d).select("volume_id", "ts", "node_id", "pool_id", "tier", "total_iops", "total_throughput_mbps", "avg_latency_us")
    return stage(t, "load", release=True)


def pairs(spark, d, t=None):
    t = load(spark, d) if t is None else t
    hot = neighbors.aggressor_rows(t.withColumn("score", F.col("total_iops")), t, topology.placement(t), 70.0)
    # the victims are a part of the rows; the shuffles of all are done with once they are found
    victims = stage(neighbors.victim_rows(t, latency_z=0.5), "victims", release=True)
    return neighbors.neighbor_pairs(hot, victims)


@query("neighbor_pairs", f"""{PAIRS} SELECT node_id, ts, aggressor_id, aggressor_score, aggressor_iops, aggressor_latency_us, victim_id,
  {R('latency_z', 4)} AS latency_z, {R('iops_z', 4)} AS iops_z, {R('impact', 4)} AS impact, victim_latency_now, victim_iops_now FROM pr""")
def _(spark, d):
    p = pairs(spark, d)
    return p.select("node_id", "ts", "aggressor_id", "aggressor_score", "aggressor_iops", "aggressor_latency_us", "victim_id",
                    *r4(p, "latency_z", "iops_z", "impact"), "victim_latency_now", "victim_iops_now")


@query("neighbor_ranked_victims", f"""{PAIRS} SELECT aggressor_id, ts, victim_id, ROW_NUMBER() OVER (PARTITION BY aggressor_id, ts ORDER BY impact DESC, victim_id) AS victim_rank FROM pr""")
def _(spark, d):
    return neighbors.ranked_pairs(pairs(spark, d)).select("aggressor_id", "ts", "victim_id", "victim_rank")


@query("neighbor_events", f"""{PAIRS}, {LATEST_SQL}, {UTIL}, ev AS (SELECT aggressor_id, ts, node_id, COUNT(*) AS n_victims, SUM(impact) AS total_impact, ARG_MAX(victim_id, impact) AS worst_victim FROM pr GROUP BY 1, 2, 3)
SELECT aggressor_id, ts, node_id, n_victims, {R('total_impact', 4)} AS total_impact, worst_victim,
  'Move volume ' || aggressor_id || ' off node ' || node_id || ' onto node ' || {TARGET.format('ev.node_id')} AS recommendation FROM ev""")
def _(spark, d):
    t = load(spark, d)
    e = neighbors.neighbor_events(pairs(spark, d, t), utilization(spark, d, t))
    return e.select("aggressor_id", "ts", "node_id", "n_victims", *r4(e, "total_impact"), "worst_victim", "recommendation")


@query("neighbor_aggressor_summary", f"{PAIRS} SELECT aggressor_id, COUNT(DISTINCT ts) AS events, {R('SUM(impact)', 4)} AS total_impact, COUNT(DISTINCT victim_id) AS distinct_victims FROM pr GROUP BY 1")
def _(spark, d):
    s = neighbors.aggressor_summary(pairs(spark, d))
    return s.select("aggressor_id", "events", *r4(s, "total_impact"), "distinct_victims")


@query("neighbor_pair_summary", f"{PAIRS} SELECT aggressor_id, victim_id, COUNT(DISTINCT ts) AS events, {R('SUM(impact)', 4)} AS total_impact, {R('AVG(impact)', 4)} AS avg_impact FROM pr GROUP BY 1, 2")
def _(spark, d):
    s = neighbors.pair_summary(pairs(spark, d))
    return s.select("aggressor_id", "victim_id", "events", *r4(s, "total_impact", "avg_impact"))


@query("neighbor_event_totals", f"{PAIRS} SELECT COUNT(DISTINCT (aggressor_id, ts)) AS total_events, COUNT(DISTINCT aggressor_id) AS unique_aggressors, COUNT(DISTINCT victim_id) AS unique_victims, COUNT(*) AS total_victim_records FROM pr")
def _(spark, d):
    return neighbors.event_totals(pairs(spark, d))


@query("rank_top_aggressors", f"{PAIRS} SELECT aggressor_id, {R('SUM(impact)', 4)} AS total_impact FROM pr GROUP BY 1 ORDER BY SUM(impact) DESC, 1 LIMIT 10")
def _(spark, d):
    s = ranking.top(neighbors.aggressor_summary(pairs(spark, d)), 10, "total_impact", ["aggressor_id"])
    return s.select("aggressor_id", *r4(s, "total_impact"))


@query("rank_top_pairs", f"{PAIRS} SELECT aggressor_id, victim_id, {R('SUM(impact)', 4)} AS total_impact FROM pr GROUP BY 1, 2 ORDER BY SUM(impact) DESC, 1, 2 LIMIT 15")
def _(spark, d):
    s = ranking.top(neighbors.pair_summary(pairs(spark, d)), 15, "total_impact", ["aggressor_id", "victim_id"])
    return s.select("aggressor_id", "victim_id", *r4(s, "total_impact"))


@query("join_point_lookup_default", f"""{WT}, {PLACE}, q AS (SELECT volume_id, CASE WHEN queue_depth = 1 THEN ts + INTERVAL 1 SECOND ELSE ts END AS ts, total_iops AS score FROM t WHERE total_iops >= 45)
SELECT q.volume_id AS aggressor_id, q.ts, pl.node_id, q.score AS aggressor_score, COALESCE(t.total_iops, 0) AS aggressor_iops, COALESCE(t.avg_latency_us, 0) AS aggressor_latency_us
FROM q JOIN pl ON pl.volume_id = q.volume_id LEFT JOIN t ON t.volume_id = q.volume_id AND t.ts = q.ts""")
def _(spark, d):
    """Hot rows, some at times telemetry does not have: their own metrics are 0."""
    t = telemetry(spark, d)
    late = F.when(F.col("queue_depth") == 1, F.col("ts") + F.expr("INTERVAL 1 SECOND")).otherwise(F.col("ts"))
    scored = t.select("volume_id", late.alias("ts"), F.col("total_iops").alias("score"))
    return neighbors.aggressor_rows(scored, t, topology.placement(t), 45.0)
