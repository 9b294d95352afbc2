"""Windows over a hot entity must equal the plain window."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.operators import clean, features, frames, joins, windows
from tidewatch.operators.statistical import hotspot_scores
from tidewatch.plans.fixtures import EVENTS, actions, events, telemetry
from tidewatch.roles import Roles

TINY = dict(rows_per_task=25, bucket_seconds=3600)


def same(a, b, digits=9):
    """Equal rows; numbers up to a tolerance, rows matched by their other values."""
    def norm(df):
        floats = {c for c, t in df.dtypes if t == "double"}
        rows = df.select(*sorted(df.columns)).collect()
        return sorted(([str(v) for c, v in r.asDict().items() if c not in floats],
                       [float("-inf") if v is None else v for c, v in r.asDict().items() if c in floats]) for r in rows)

    x, y = norm(a), norm(b)
    return len(x) == len(y) and all(
        k == m and v == pytest.approx(w, abs=10.0**-digits) for (k, v), (m, w) in zip(x, y))


@pytest.fixture(scope="module")
def ev(spark, small):
    """Events with one volume holding a third of the rows and many equal times."""
    e = events(spark, small)
    hot = F.when(F.col("event_id") % 3 == 0, 1).otherwise(F.col("volume_id"))
    ts = F.when(F.col("event_id") % 5 == 0, F.col("ts").cast("date").cast("timestamp_ntz")).otherwise(F.col("ts"))
    return e.withColumns({"volume_id": hot, "ts": ts}).cache()


def test_hot_entity_is_split(ev):
    f = frames.framed(ev, EVENTS, back=6, **TINY)
    assert f.split
    sizes = f.df.groupBy("volume_id", frames.CHUNK).count().agg(F.max("count")).first()[0]
    assert sizes < ev.where("volume_id = 1").count() / 2


def test_cold_table_is_not_split(ev):
    f = frames.framed(ev, EVENTS, back=6)
    assert not f.split and f.df is ev


@pytest.mark.parametrize("back,ahead,rows,bucket", [(11, 0, 25, 3600), (3, 7, 25, 3600), (30, 30, 25, 60), (5, 0, 7, 86400), (40, 2, 10, 600)])
def test_bounded_frames(ev, back, ahead, rows, bucket):
    def build(w):
        fr = w.rowsBetween(-back, ahead)
        return {"s": F.sum("total_iops").over(fr), "n": F.count(F.lit(1)).over(fr), "l": F.lag("event_id", back).over(w)}

    plain = ev.withColumns(build(W.partitionBy("volume_id").orderBy("ts", "event_id")))
    split = frames.with_frames(ev, build, EVENTS, back=back, ahead=ahead, rows_per_task=rows, bucket_seconds=bucket)
    cols = ["event_id", "s", "n", "l"]
    assert same(plain.select(cols), split.select(cols), 6)


def test_forward_fill_and_running_sum(ev):
    gaps = ev.withColumn("x", F.when(F.col("event_id") % 17 == 0, F.col("total_iops")))
    cols = ["event_id", "y"]
    assert same(frames.forward_fill(gaps, {"x": "y"}, EVENTS).select(cols), frames.forward_fill(gaps, {"x": "y"}, EVENTS, **TINY).select(cols))
    assert same(frames.running_sum(ev, {"total_iops": "y"}, EVENTS).select(cols), frames.running_sum(ev, {"total_iops": "y"}, EVENTS, **TINY).select(cols), 6)


def test_global_running_equals_one_window(ev):
    w = W.orderBy("ts", "event_id")
    plain = ev.select("event_id", F.sum("volume_id").over(w).alias("s"), F.max("volume_id").over(w).alias("m"))
    split = frames.global_running(ev, {"volume_id": "s"}, ["ts", "event_id"], windows.hour_bucket("ts"), {"volume_id": "m"})
    assert same(plain, split.select("event_id", "s", "m"))


def test_hot_runs_and_fill_gaps_split(ev):
    cols = ["event_id", "run_start", "run_minutes", "status"]
    assert same(windows.hot_runs(ev, "total_iops", 50, EVENTS).select(cols), windows.hot_runs(ev, "total_iops", 50, EVENTS, **TINY).select(cols))
    gaps = ev.withColumn("total_iops", F.when(F.col("event_id") % 3 != 0, F.col("total_iops"))).select("event_id", "volume_id", "ts", "total_iops")
    assert same(clean.fill_gaps(gaps, EVENTS), clean.fill_gaps(gaps, EVENTS, **TINY))


def test_sequences_and_supervised_split(ev):
    for fn in (lambda **k: windows.sequences(ev, ["total_iops"], EVENTS, 12, **k), lambda **k: windows.supervised_windows(ev, "total_iops", EVENTS, 5, 3, **k)):
        assert same(fn(), fn(**TINY))


def test_detector_split_and_against_sliding_frame(spark, small):
    t = telemetry(spark, small).withColumn("volume_id", F.when(F.col("volume_id") < 5, 1).otherwise(F.col("volume_id")))
    t = t.groupBy("volume_id", "ts").agg(*[F.max(c).alias(c) for c in t.columns if c not in ("volume_id", "ts")])
    cols = ["volume_id", "ts", "hotspot_score"]
    plain = hotspot_scores(t, rows=50)
    split = hotspot_scores(t, rows=50, rows_per_task=300, bucket_seconds=86400)
    assert same(plain.select(cols), split.select(cols), 7)
    f = W.partitionBy("volume_id").orderBy("ts").rowsBetween(-50, -1)
    slid = t.select("volume_id", "ts", F.when(F.count(F.lit(1)).over(f) >= 12, F.stddev_pop("total_iops").over(f)).alias("sd"))
    assert same(slid, plain.select("volume_id", "ts", F.col("total_iops_base_std").alias("sd")), 7)


def test_flat_baseline_scores_zero(spark):
    rows = [(1, i, 5.1) for i in range(700)] + [(1, 700, 9.0)]
    df = spark.createDataFrame(rows, "volume_id int, i int, v double").withColumn("ts", F.timestamp_add("MINUTE", F.col("i") * 5, F.expr("TIMESTAMP_NTZ'2026-04-01 00:00:00'")))
    out = windows.rolling_baseline(df, ["v"], Roles()).orderBy("ts").collect()
    assert out[11]["v_base_std"] is None and out[12]["v_base_std"] is not None
    assert max(r["v_base_std"] for r in out[12:]) < 1e-9


def test_engineer_features_split(spark, small):
    t = telemetry(spark, small).where("volume_id < 6")
    a, b = features.engineer_features(t), features.engineer_features(t, rows_per_task=200, bucket_seconds=86400)
    cols = ["volume_id", "ts", "total_iops_roll_1h_std", "total_iops_lag_60m", "avg_latency_us_pct_change", "label"]
    assert same(a.select(cols), b.select(cols), 7)


def test_history_before_brute_force(spark, small, ev):
    asked = actions(spark, small).withColumn("volume_id", F.when(F.col("action_id") % 3 == 0, 1).otherwise(F.col("volume_id")))
    got = {r["action_id"]: [x[0] for x in r["history"] or []] for r in joins.history_before(
        asked, ev, "action_id", ["total_iops"], 4, EVENTS, **TINY).collect()}
    rows = sorted((r["volume_id"], r["ts"], r["event_id"], r["total_iops"]) for r in ev.collect())
    for a in asked.collect():
        want = [x[3] for x in rows if x[0] == a["volume_id"] and x[1] <= a["ts"]][-4:]
        assert got[a["action_id"]] == want


def test_trailing_count_brute_force(ev):
    rows = sorted(r["ts"] for r in ev.collect())
    got = sorted((r["ts"], r["recent"]) for r in windows.trailing_count(ev, 3600).collect())
    for ts, n in got:
        assert n == sum(0 <= (ts - x).total_seconds() <= 3600 for x in rows)


def test_within_after_brute_force(ev):
    left = ev.where("event_id % 10 = 0").select("event_id", "volume_id", "ts")
    right = ev.select("volume_id", "ts", F.col("event_id").alias("other"))
    got = sorted((r["event_id"], r["other"]) for r in joins.within_after(left, right, 7200).collect())
    all_rows = [(r["event_id"], r["volume_id"], r["ts"]) for r in ev.collect()]
    want = sorted((a[0], b[0]) for a in all_rows if a[0] % 10 == 0 for b in all_rows
                  if a[1] == b[1] and 0 <= (b[2] - a[2]).total_seconds() <= 7200)
    assert got == want
