"""Placement, autoscale, admission and monitoring scenarios."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import fusion, neighbors, policy, topology, whatif
from tidewatch.plans import views

T0 = dt.datetime(2026, 5, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def place(spark):
    return spark.createDataFrame([("vol1", "nodeA", "p1", "HDD"), ("vol1_rep", "nodeB", "p1", "SSD")],
                                 "volume_id string, node_id string, pool_id string, tier string")


@pytest.fixture(scope="module")
def replica(spark):
    return spark.createDataFrame([("vol1_rep", "vol1")], "replica_id string, primary_id string")


def test_anti_affinity(spark, place, replica):
    asked = spark.createDataFrame([("vol1", "nodeC"), ("vol1", "nodeB"), ("vol1_rep", "nodeA"), ("ghost", "nodeC")], "volume_id string, target_node string")
    got = {(r["volume_id"], r["target_node"]): r["allowed"] for r in topology.validate_migrations(asked, place, replica).collect()}
    assert got == {("vol1", "nodeC"): True, ("vol1", "nodeB"): False, ("vol1_rep", "nodeA"): False, ("ghost", "nodeC"): False}


def test_effective_placement_after_rollback(spark, place):
    log = spark.createDataFrame([
        (1, "vol1", at(0), "migrate", "n3", "success"), (2, "vol1", at(1), "migrate", "n4", "rolled_back"),
        (3, "vol1_rep", at(2), "migrate", "nodeA", "blocked_by_placement"), (4, "vol1", at(3), "qos", "500", "success")],
        "action_id int, volume_id string, ts timestamp_ntz, action string, target string, status string")
    got = {r["volume_id"]: (r["node_id"], r["iops_limit"]) for r in topology.effective_placement(place, log).collect()}
    assert got == {"vol1": ("n3", 500.0), "vol1_rep": ("nodeB", None)}


def test_least_loaded_other_node_and_idle_nodes(spark, place):
    latest = spark.createDataFrame([("vol1", 100.0, 1.0, 10.0), ("vol1_rep", 40.0, 1.0, None)],
                                   "volume_id string, total_iops double, total_throughput_mbps double, avg_latency_us double")
    nodes = spark.createDataFrame([("nodeA",), ("nodeB",), ("nodeC",)], "node_id string")
    u = topology.node_utilization(place, latest, nodes)
    got = {r["node_id"]: (r["target_node"], r["n_volumes"]) for r in topology.with_best_target(u, u).collect()}
    assert got == {"nodeA": ("nodeC", 1), "nodeB": ("nodeC", 1), "nodeC": ("nodeB", 0)}
    alone = u.where("node_id = 'nodeA'")
    assert topology.with_best_target(alone, alone).first()["target_node"] is None


def test_headroom_unknown_key_and_fallbacks(spark):
    place = spark.createDataFrame([("a", "SSD", 100.0), ("b", None, 50.0), ("c", "SSD", None)], "volume_id string, tier string, capacity_total_gb double")
    live = spark.createDataFrame([("a", 95.0, 200.0, None), ("b", None, None, 45.0)],
                                 "volume_id string, capacity_used_pct double, capacity_total_gb double, capacity_used_gb double")
    v = topology.volume_capacity(place, live)
    got = {r["tier"]: (r["total_capacity_gb"], r["used_capacity_gb"], r["critical_count"], r["volume_count"]) for r in topology.headroom(v, "tier").collect()}
    assert got == {"SSD": (200.0, 190.0, 1, 2), "Unknown": (50.0, 45.0, 1, 1)}
    with pytest.raises(KeyError):
        views.one_tier(topology.headroom(v, "tier"), "Tape")


def test_autoscale_single_trigger(spark):
    place = spark.createDataFrame([("volA", "node1", "poolA")], "volume_id string, node_id string, pool_id string")
    cap = spark.createDataFrame([("volA", 0.4)], "volume_id string, capacity_used_pct double")
    days = spark.createDataFrame([("volA", 2.0)], "volume_id string, warning_days double")
    got = policy.autoscale_triggers(cap, days, place).collect()
    assert [(r["volume_id"], r["pool_id"], r["reason"]) for r in got] == [("volA", "poolA", "dtf_warning")]
    now, last = F.lit(at(60)).cast("timestamp_ntz"), F.lit(at(0)).cast("timestamp_ntz")
    assert policy.autoscale_triggers(cap, days, place, now, last).count() == 0
    assert policy.autoscale_triggers(cap, days, place, now, last, min_interval_hours=0).count() == 1


def random_moves(spark, n, clusters, minutes, seed):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(clusters), i, T0 + dt.timedelta(seconds=rnd.randrange(minutes * 60))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "cluster_id int, action_id int, ts timestamp_ntz")


def test_admission_brute_force(spark):
    rows, df = random_moves(spark, 300, 3, 5000, 1)
    got = {r["action_id"]: (r["status"], r["reason"]) for r in policy.admit(df, 1, 3, 600, rows_per_task=20).collect()}
    ran = {}
    for c, i, ts in sorted(rows, key=lambda r: (r[2], r[1])):
        mine = ran.setdefault(c, [])
        if sum((ts - x).total_seconds() < 600 for x in mine) >= 1:
            want = ("queued", "concurrent_limit")
        elif sum((ts - x).total_seconds() <= 3600 for x in mine) >= 3:
            want = ("queued", "rate_limit")
        else:
            mine.append(ts)
            want = ("executed", None)
        assert got[i] == want
    assert len(got) == 300


def test_admission_in_chunks_is_the_same_fold(spark):
    """A busy cluster without a quiet hour, in chunks of a few requests, and one with a gap."""
    rows, df = random_moves(spark, 240, 1, 900, 5)
    later = spark.createDataFrame([(0, 1000 + i, T0 + dt.timedelta(days=2, seconds=200 * i)) for i in range(30)], "cluster_id int, action_id int, ts timestamp_ntz")
    both = df.unionByName(later)
    pick = lambda out: sorted((r["action_id"], r["status"], r["reason"] or "") for r in out.collect())
    whole = pick(policy.admit(both, 2, 4, 900))
    assert pick(policy.admit(both, 2, 4, 900, chunk_rows=8)) == whole and len(whole) == 270
    assert policy.admit(both.limit(0)).collect() == []


@pytest.mark.parametrize("per_hour,active", [(3, 300), (3, 1800), (1, 60), (4, 900)])
def test_queue_drain_brute_force(spark, per_hour, active):
    rows, df = random_moves(spark, 120, 2, 900, 2)
    got = {r["action_id"]: (r["queue_place"], r["starts_at"]) for r in policy.drain_schedule(df, per_hour, active).collect()}
    starts = {}
    for c, i, ts in sorted(rows, key=lambda r: (r[2], r[1])):
        mine = starts.setdefault(c, [])
        start = ts
        if mine:
            start = max(start, mine[-1] + dt.timedelta(seconds=active))
        if len(mine) >= per_hour:
            start = max(start, mine[-per_hour] + dt.timedelta(hours=1))
        mine.append(start)
        assert got[i] == (len(mine), start)


def test_action_outcomes(spark):
    acts = spark.createDataFrame([(i, "v%d" % i, at(0), 0.5 if i == 4 else 100.0, "executed") for i in range(1, 5)],
                                 "action_id int, volume_id string, ts timestamp_ntz, pre_latency double, status string")
    samples = spark.createDataFrame([
        ("v1", at(1), 119.0), ("v1", at(3), 121.0), ("v1", at(4), 500.0), ("v2", at(2), 120.0), ("v2", at(6), 500.0),
        ("v4", at(1), 1.2), ("v9", at(4), 1.0)], "volume_id string, ts timestamp_ntz, avg_latency_us double")
    got = {r["action_id"]: (r["status"], r["rolled_back_at"]) for r in policy.evaluate_actions(acts, samples).collect()}
    assert got == {1: ("rolled_back", at(3)), 2: ("success", None), 3: ("success", None), 4: ("success", None)}
    early = policy.evaluate_actions(acts, samples.where("ts <= '2026-05-01 00:02:00'"))
    assert {r["status"] for r in early.collect()} == {"monitoring"}


def test_breaker_needs_ten_actions_latches_and_resets(spark):
    rows = [(i, at(i), "rolled_back" if i == 3 else "success") for i in range(1, 31)]
    df = spark.createDataFrame(rows, "action_id int, ts timestamp_ntz, status string")
    r = policy.breaker_status(df, 1.0).first()
    assert r["tripped"] and r["tripped_at"] == at(10) and r["total_actions"] == 30
    assert not policy.breaker_status(df.where("action_id < 10"), 1.0).first()["tripped"]
    reset = spark.createDataFrame([(at(20),)], "ts timestamp_ntz")
    assert policy.breaker_status(df, 1.0, resets=reset).first()["tripped_at"] == at(21)
    assert not policy.breaker_status(df, 4.9, resets=reset).first()["tripped"]


def test_best_action_statuses(spark):
    c = spark.createDataFrame([("a", 0, "migrate", "n", 5.0, False), ("a", 1, "qos", "1", 5.0, True), ("a", 2, "tier_change", "x", 5.0, True),
                               ("b", 0, "migrate", "n", 9.0, False), ("c", 1, "qos", "1", 0.0, True)],
                              "volume_id string, preference int, action string, target string, expected_improvement double, safe boolean")
    got = {r["volume_id"]: (r["status"], r["action"]) for r in policy.best_action(c).collect()}
    assert got == {"a": ("selected", "qos"), "b": ("no_safe_actions", None), "c": ("no_improvement", None)}


def test_victims_and_pairs(spark):
    rows = [("a", at(i), "n", 10.0, 100.0) for i in range(40)] + [("b", at(i), "n", 10.0 + i % 2, 50.0 + i % 3) for i in range(40)]
    rows += [("a", at(99), "n", 10.0, 900.0), ("b", at(99), "n", 400.0, 50.0), ("c", at(99), "n", 400.0, 50.0)]
    t = spark.createDataFrame(rows, "volume_id string, ts timestamp_ntz, node_id string, avg_latency_us double, total_iops double")
    place = t.select("volume_id", "node_id").distinct()
    scored = spark.createDataFrame([("a", at(99), 80.0), ("a", at(200), 90.0), ("b", at(99), 59.9)], "volume_id string, ts timestamp_ntz, score double")
    hot = neighbors.aggressor_rows(scored, t, place)
    assert {(r["ts"], r["aggressor_iops"]) for r in hot.collect()} == {(at(99), 900.0), (at(200), 0.0)}
    pairs = neighbors.neighbor_pairs(hot, neighbors.victim_rows(t)).collect()
    assert [(r["aggressor_id"], r["victim_id"]) for r in pairs] == [("a", "b")]  # c has too few rows


def test_whatif_edges(spark):
    v = spark.createDataFrame([("a", None, 0.0), ("b", "HDD", 200.0)], "volume_id string, tier string, total_iops double")
    caps = {r["volume_id"]: r["throttling_pct"] for r in whatif.iops_caps(v, [50]).collect()}
    assert caps == {"a": 0.0, "b": 75.0}
    tiers = {(r["volume_id"], r["new_tier"]): r["throughput_factor"] for r in whatif.tier_changes(v, ["SSD", "HDD"]).collect()}
    assert tiers == {("a", "SSD"): 5.0, ("a", "HDD"): 1.0, ("b", "SSD"): 5.0, ("b", "HDD"): 1.0}


def test_fusion_shares_weights_and_gates(spark):
    df = spark.createDataFrame([(50.0, 100.0, True)], "stat_score double, forest_score double, forest_flagged boolean")
    r = fusion.ensemble(df, min_agreement=2).first()
    assert abs(r["ensemble_score"] - 75.0) < 1e-9 and r["n_agreeing"] == 2 and r["is_anomaly"] and r["severity"] == "high"
    r = fusion.ensemble(df, min_agreement=3).first()
    assert not r["is_anomaly"] and r["severity"] == "normal"
