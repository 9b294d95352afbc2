"""What queries move and keep: lines are dealt once, and steps are staged so that their shuffles can go."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import quantiles
from tidewatch.plans import fixtures, policy_queries, topology_queries
from tidewatch.plans.catalog import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Order lines with null and repeated keys, null times and a volume that no supplier has."""
    d = str(tmp_path_factory.mktemp("tables"))
    day = dt.datetime(2020, 1, 1)
    rows = [(i, None if i % 41 == 0 else i % 7, i % 3 + 1, float(i % 50 + 1), 100.0 + i, i % 10 / 100, i % 8 / 100, None if i % 53 == 0 else day + dt.timedelta(days=i % 90)) for i in range(900)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp_ntz").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(0, 0), (1, 1), (2, 0), (3, 1), (3, 0), (4, None), (5, 1)], "s_suppkey long, s_nationkey int").write.parquet(f"{d}/supplier.parquet")
    spark.createDataFrame([(0, 0), (1, 1)], "n_nationkey int, n_regionkey int").write.parquet(f"{d}/nation.parquet")
    events = [(i, day + dt.timedelta(hours=i), i % 4, "view", float(i % 30), "{}") for i in range(400)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{d}/events.parquet")
    return d


def test_engineered_features_deal_the_order_lines_once(spark, small):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of size
    try:
        text = plan(QUERIES["features_engineered"](spark, small))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert text.count("lineitem") == 1
    wide = [x for x in text.split("\n") if "Exchange hashpartitioning" in x and not re.search("[sn]_(supp|nation)key", x)]
    assert len(wide) == 1


def test_capacity_over_the_same_sums_is_the_joined_one(spark, tables):
    got = fixtures.telemetry_with_capacity(spark, tables)
    want = fixtures.telemetry(spark, tables).join(fixtures.capacity(spark, tables), ["volume_id", "ts"])
    assert got.dtypes == want.dtypes and want.count() > 400
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_a_hot_volume_gives_the_same_telemetry(spark, tables, monkeypatch):
    plain = [f(spark, tables).collect() for f in (fixtures.telemetry, fixtures.telemetry_with_capacity)]
    monkeypatch.setattr(fixtures, "hot_volume", lambda *a: True)
    for rows, f in zip(plain, (fixtures.telemetry, fixtures.telemetry_with_capacity)):
        assert sorted(map(str, rows)) == sorted(map(str, f(spark, tables).collect()))


def test_neighbours_read_the_telemetry_once(spark, tables):
    df = QUERIES["neighbor_events"](spark, tables)
    assert "lineitem" not in plan(df)
    t = fixtures.telemetry(spark, tables)
    want = topology_queries.neighbors.neighbor_pairs(
        topology_queries.neighbors.aggressor_rows(t.withColumn("score", F.col("total_iops")), t, topology_queries.topology.placement(t), 70.0),
        topology_queries.neighbors.victim_rows(t, latency_z=0.5))
    got = topology_queries.pairs(spark, tables)
    keys = ["aggressor_id", "victim_id", "ts", "node_id"]
    assert sorted(map(str, got.select(keys).collect())) == sorted(map(str, want.select(keys).collect()))


@pytest.mark.parametrize("name", ["view_analysis_record", "view_analysis_figures"])
def test_the_record_is_made_of_staged_parts(spark, small, name, monkeypatch):
    parts, stage = [], policy_queries.stage
    monkeypatch.setattr(policy_queries, "stage", lambda df, part, release=False: parts.append((part, release)) or stage(df, part, release))
    text = plan(QUERIES[name](spark, small))
    assert "lineitem" not in text and "events.parquet" not in text
    assert sorted(parts) == [(x, True) for x in ("days", "demand", "latency", "newest", "used", "violation")]


def test_quantiles_of_two_readings_are_exact(spark):
    rows = [(i % 3 if i % 5 else None, v) for i, v in enumerate([None, float("nan"), 0.0, -0.0, 1e-9, -7.5, 3.25, 3.25, 1e12, 2.0] * 3 + [x * 1.0001 for x in range(300)])]
    df = spark.createDataFrame(rows, "g int, v double")
    for by in ([], ["g"]):
        want = quantiles.quantile_rows(df, by, "v", [0.0, 0.25, 0.5, 0.95, 1.0])
        got = quantiles.quantile_rows(df, by, "v", [0.0, 0.25, 0.5, 0.95, 1.0], rescan=True)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_quantiles_of_two_readings_shuffle_few_values(spark, tmp_path):
    path = str(tmp_path / "v")
    spark.range(100_000).select((F.col("id") + F.rand(3)).alias("v")).write.parquet(path)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = quantiles.quantile_rows(spark.read.parquet(path), [], "v", [0.5], rescan=True)
        assert "LeftSemi" in plan(df) and "BroadcastHashJoin" in plan(df)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
