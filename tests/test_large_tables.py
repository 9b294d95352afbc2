"""What keeps time and memory of a task in bounds on large tables."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import classify, features, frames, summaries
from tidewatch.operators.windows import rolling_baseline
from tidewatch.plans import fixtures
from tidewatch.roles import Roles

NOON = dt.datetime(2024, 1, 1, 12)


def test_wide_windows_leave_no_method_too_large_to_compile(spark):
    name, other = "spark.sql.codegen.hugeMethodLimit", spark.newSession()
    rows = [(1, NOON + dt.timedelta(minutes=i), float(i)) for i in range(5)]
    for chosen, told in (("65535", "8000"), ("12000", "12000")):
        other.conf.set(name, chosen)
        rolling_baseline(other.createDataFrame(rows, "volume_id long, ts timestamp_ntz, m double"), ["m"])
        assert other.conf.get(name) == told


def test_score_distribution_works_its_rows_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(i):
        seen.add(1)
        return float(i)

    got = summaries.score_distribution(spark.range(101).select(score("id").alias("s")), "s").first()
    assert (got["count"], got["mean"], got["min"], got["p50"], got["max"]) == (101, 50.0, 0.0, 50.0, 100.0)
    assert seen.value == 101


def test_binned_rows_are_dealt_over_the_cores(spark):
    rnd = random.Random(4)
    rows = spark.createDataFrame([(i, rnd.random(), None if i % 7 == 0 else rnd.random()) for i in range(400)], "i long, a double, b double").coalesce(1)
    train, check = classify.binned(rows.where("i < 300"), [rows.where("i >= 300")], ["a", "b"], 8)
    for part, n in ((train, 300), (check, 100)):
        assert part.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        assert part.select("i").distinct().count() == part.count() == n


def test_entropy_by_windows_is_that_by_joins(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice([1, 2, None]), NOON + dt.timedelta(minutes=rnd.randint(0, 200)) if rnd.random() < 0.9 else None, rnd.choice([4.0, 8.0, 16.0, None])) for _ in range(300)]
    df = spark.createDataFrame(rows, "volume_id long, ts timestamp_ntz, io_size_avg_kb double")
    want, windows = features.add_entropy(df), features.add_entropy(df, hot=False)
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r[:3]) + (r[3] is None,)
    for a, b in zip(sorted(want.collect(), key=key), sorted(windows.collect(), key=key), strict=True):
        assert a[:3] == b[:3] and (a[3] is None) == (b[3] is None) and (a[3] is None or abs(a[3] - b[3]) < 1e-9)
    plan = windows._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_a_task_of_the_capacity_curve_has_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(frames, "TASK_ROWS", 100)
    rows = [(v, NOON + dt.timedelta(days=i), 1.0) for v in range(60) for i in range(40)]
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp_ntz, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    curve = fixtures.capacity(spark, str(tmp_path))
    assert curve.rdd.getNumPartitions() >= 24
    assert max(r["n"] for r in curve.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()) < 600
    last = {r["volume_id"]: r["capacity_used_gb"] for r in curve.groupBy("volume_id").agg(F.max("capacity_used_gb").alias("capacity_used_gb")).collect()}
    assert last == {v: 40.0 for v in range(60)}
    assert frames.spread(curve, 1000, Roles()).rdd.getNumPartitions() >= 10


def below_exchanges(df, name):
    """The parts of the plan that read tables: from an exchange down to a scan, if they hold an operator ``name``."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    found, depth = [], lambda x: len(x) - len(x.lstrip(" :+-*("))
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            below = [x for x in lines[i + 1:]]
            end = next((k for k, x in enumerate(below) if depth(x) <= depth(line) or "Exchange" in x), len(below))
            if any("Scan" in x for x in below[:end]) and any(name in x for x in below[:end]):
                found.append(line)
    return found


def order_lines(spark, folder):
    """Lines of volumes and of no volume, several a day; returns the running use of each volume's days."""
    rnd = random.Random(12)
    rows = [(rnd.choice([None, *range(20)]), NOON + dt.timedelta(days=rnd.randint(0, 30)), float(rnd.randint(1, 50))) for _ in range(1500)]
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp_ntz, l_quantity double").write.parquet(f"{folder}/lineitem.parquet")
    want = {}
    for v in range(20):
        days, used = sorted({t for k, t, _ in rows if k == v}), 0.0
        total = math.floor(sum(q for k, _, q in rows if k == v) * (1.02 + v % 7 * 0.05) * 100 + 0.500001) / 100
        for t in days:
            used += sum(q for k, at, q in rows if k == v and at == t)
            want[v, t] = (used, total)
    return want


def test_lines_of_the_capacity_curve_are_dealt_before_they_are_summed(spark, tmp_path, monkeypatch):
    want = order_lines(spark, tmp_path)
    for rows_per_task in (frames.ROWS_PER_TASK, 40):  # without and with hot volumes
        monkeypatch.setattr(frames, "ROWS_PER_TASK", rows_per_task)
        curve = fixtures.capacity(spark, str(tmp_path))
        assert below_exchanges(curve, "Aggregate") == []
        got = {(r["volume_id"], r["ts"]): (r["capacity_used_gb"], r["capacity_total_gb"]) for r in curve.collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
        assert curve.count() == len(want)


def test_lines_of_the_telemetry_are_dealt_before_they_are_summed(spark, small):
    rows = fixtures.telemetry(spark, small)
    assert below_exchanges(rows.select("volume_id", "ts", "total_iops"), "Aggregate") == []
    assert rows.count() == rows.select("volume_id", "ts").distinct().count() > 0
