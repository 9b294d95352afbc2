"""Sources, sinks and served tables."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewatch.operators import forecast, splits
from tidewatch.plans import views
from tidewatch.plans.fixtures import events
from tidewatch.roles import Roles, require_columns
from tidewatch.sources import files


def test_split_table_errors_and_pruning(spark, small, tmp_path):
    with pytest.raises(ValueError):
        files.load_split(spark, str(tmp_path), "holdout")
    with pytest.raises(FileNotFoundError):
        files.load_split(spark, f"{tmp_path}/none", "train")
    df = splits.chronological_split(events(spark, small)).withColumn("label", F.lit(1))
    files.write_splits(df, f"{tmp_path}/s")
    x, y = files.load_split(spark, f"{tmp_path}/s", "val")
    assert x.count() == y.count() == df.where("split = 'val'").count() and "label" not in x.columns
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    assert set(files.load_all_splits(spark, f"{tmp_path}/s")) == {"train", "val", "test"}


def test_csv_fallback_only_for_missing_parquet(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    files.write_csv(df.withColumn("nested", F.array("i")), f"{tmp_path}/c")
    assert files.read_table(spark, f"{tmp_path}/p", f"{tmp_path}/c", "i int, s string").collect() == df.collect()
    (tmp_path / "bad.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        files.read_table(spark, f"{tmp_path}/bad.parquet", f"{tmp_path}/c", "i int, s string").collect()


def test_require_columns(spark):
    with pytest.raises(ValueError, match="b"):
        require_columns(spark.range(1), ["id", "b"])


def curve(spark, current, values):
    return spark.createDataFrame([(current, values)], "c double, f array<double>").select(
        forecast.days_to_fill(F.col("c"), F.col("f"), 0.85).alias("d")).first()["d"]


def test_days_to_fill_cases(spark):
    assert curve(spark, 0.9, [0.9]) == 0.0
    assert curve(spark, 0.8, [0.9, 0.95]) == pytest.approx(0.5, abs=1e-6)
    assert curve(spark, 0.5, [0.6, 0.8, 0.9]) == pytest.approx(2.5, abs=1e-6)
    assert curve(spark, 0.5, [0.55, 0.60, 0.65]) == pytest.approx(3 + 4, abs=1e-6)
    assert curve(spark, 0.5, [0.5, 0.5, 0.5]) is None
    assert curve(spark, 0.5, [0.5, 0.4]) is None


def ttv(spark, values):
    df = spark.createDataFrame([(values,)], "p array<double>")
    return df.select(*[c.alias(n) for n, c in forecast.time_to_violation(F.col("p")).items()]).first()


def test_time_to_violation_cases(spark):
    assert (ttv(spark, [9000.0])["hours_to_breach"], ttv(spark, [9000.0])["risk_level"]) == (0.0, "critical")
    r = ttv(spark, [7000.0, 7000.0, 9000.0])
    assert r["hours_to_breach"] == pytest.approx(1.5, abs=1e-6) and r["risk_level"] == "high" and r["breach_at_step"] == 2
    r = ttv(spark, [7000.0])
    assert not r["will_breach"] and r["risk_level"] == "none" and r["headroom_us"] == 1000.0
    assert ttv(spark, [])["max_p95_us"] == 0.0


def test_half_hours_round_to_even(spark):
    from tidewatch.functions.times import round_hour
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ'2026-04-01 00:30:00'), (TIMESTAMP_NTZ'2026-04-01 01:30:00'), (TIMESTAMP_NTZ'2026-04-01 01:29:59') t(ts)")
    assert [r[0].hour for r in df.select(round_hour("ts")).collect()] == [0, 2, 1]


def test_tail_holdout_short_series(spark):
    rows = [(v, i) for v, n in ((1, 50), (2, 33), (3, 20)) for i in range(n)]
    df = spark.createDataFrame(rows, "volume_id int, i int").withColumn("ts", F.timestamp_add("HOUR", "i", F.expr("TIMESTAMP_NTZ'2026-04-01 00:00:00'")))
    got = {r["volume_id"]: (r["t"], r["v"]) for r in splits.tail_holdout(df, 10, 20, 7, min_val=7, roles=Roles()).groupBy("volume_id").agg(
        F.count_if("in_train").alias("t"), F.count_if("in_val").alias("v")).collect()}
    assert got == {1: (40, 30), 2: (33, 0)}  # 3 is shorter than a window


def test_recommendation_rules(spark):
    a = spark.createDataFrame([
        ("a", 3.0, 1.0, 85.0, "none", None, 10.0, 0.1), ("b", 20.0, 9.0, 10.0, "high", 2.0, 9000.0, 0.9),
        ("c", None, None, 79.9, "low", 5.5, 9000.0, 0.5)],
        "volume_id string, warning_days double, critical_days double, hotspot_score double, risk_level string, hours_to_breach double, max_p95_us double, risk_score double")
    t = spark.createDataFrame([("SSD", 91.0, 5.0), ("HDD", 85.0, 9.0), ("NVMe", 10.0, 99.0)], "tier string, used_pct double, headroom_gb double")
    got = [(r["priority"], r["volume_id"]) for r in views.recommendations(a, t).collect()]
    assert got == [("CRITICAL", "CLUSTER"), ("CRITICAL", "a"), ("HIGH", "a"), ("HIGH", "b"), ("WARNING", "CLUSTER"), ("WARNING", "b")]
    by_risk = [(r["priority"], r["volume_id"]) for r in views.recommendations(a, t, True).collect()]
    assert ("MEDIUM", "b") in by_risk and ("HIGH", "b") not in by_risk


def test_history_limit_is_checked(spark):
    with pytest.raises(ValueError):
        views.volume_history(spark.range(1), 501)


def test_catalog_is_consistent(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 150
    df = entry.entry(spark)
    assert df.columns == ["severity", "n", "mean_score"] and df.count() > 0
