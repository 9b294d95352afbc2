"""Streams over several micro-batches must equal the batch operators."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import windows
from tidewatch.operators.statistical import hotspot_scores
from tidewatch.plans.fixtures import telemetry
from tidewatch.roles import Roles
from tidewatch.streaming import sinks, sources, state


@pytest.fixture(scope="module")
def parts(spark, small, tmp_path_factory):
    """Telemetry of a few volumes cut into four files by time."""
    folder = str(tmp_path_factory.mktemp("parts"))
    t = telemetry(spark, small).where("volume_id <= 6")
    year = F.year("ts")
    lo, hi = t.agg(F.min(year), F.max(year)).first()
    cuts = [lo, lo + 2, lo + 3, lo + 5, hi + 1]
    for i in range(4):
        t.where((year >= cuts[i]) & (year < cuts[i + 1])).coalesce(1).write.parquet(f"{folder}/all/part={i}")
    return spark.read.parquet(f"{folder}/all").cache()


def feed(spark, parts, folder, build, mode="append", writer=None):
    """Deliver the four parts one by one to one checkpointed query."""
    schema = parts.drop("part").schema
    os.makedirs(f"{folder}/in")
    stream = build(spark.readStream.schema(schema).parquet(f"{folder}/in"))
    for i in range(4):
        parts.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        last = sinks.run_available(stream, f"{folder}/checkpoint", writer or sinks.append_batches(f"{folder}/out"), mode)
    return last


def rows(df, digits=6):
    return sorted(tuple(round(v, digits) if isinstance(v, float) else str(v) for v in r) for r in df.collect())


def test_online_detector_equals_batch(spark, parts, tmp_path):
    feed(spark, parts, str(tmp_path), lambda s: state.online_scores(s, rows=40))
    got = sinks.read_batches(spark, f"{tmp_path}/out").select("volume_id", "ts", "hotspot_score")
    want = hotspot_scores(parts.drop("part"), rows=40).select("volume_id", "ts", "hotspot_score")
    assert rows(got) == rows(want)


def test_online_hot_runs_equal_batch(spark, parts, tmp_path):
    feed(spark, parts, str(tmp_path), lambda s: state.online_hot_runs(s, 20, score="total_iops"))
    got = sinks.read_batches(spark, f"{tmp_path}/out").select("volume_id", "ts", "run_minutes", "status")
    want = windows.hot_runs(parts.drop("part"), "total_iops", 20, Roles()).select("volume_id", "ts", "run_minutes", "status")
    key = lambda df: sorted((r["volume_id"], r["ts"], r["status"], -1 if r["run_minutes"] is None else r["run_minutes"]) for r in df.collect())
    assert key(got) == key(want)


def test_history_and_fan_out_survive_a_repeated_batch(spark, parts, tmp_path):
    write = sinks.fan_out(f"{tmp_path}/out", 5, "total_iops", 45.0)
    last = feed(spark, parts, str(tmp_path), lambda s: s, writer=write)
    batch = parts.where(F.col("part") == 3).drop("part")
    write(batch, last)  # the same batch again
    data = parts.drop("part")
    got = sinks.read_version(spark, f"{tmp_path}/out/history", last, data.schema)
    assert rows(got.select("volume_id", "ts")) == rows(windows.last_rows(data, 5).select("volume_id", "ts"))
    newest = sinks.read_version(spark, f"{tmp_path}/out/latest", last, data.schema)
    assert rows(newest.select("volume_id", "ts", "total_iops")) == rows(windows.latest_rows(data).select("volume_id", "ts", "total_iops"))
    assert sinks.read_batches(spark, f"{tmp_path}/out/alerts").count() == data.where("total_iops >= 45").count()


def lines(*events):
    return [(json.dumps(e),) for e in events]


def test_clean_stream_equals_clean_table(spark, tmp_path):
    texts = lines({"volume_id": "vol_001", "timestamp": "2026-05-21T12:00:00", "total_iops": 500.0, "avg_latency_us": 120.0},
                  {"volume_id": "vol_001", "timestamp": "2026-05-21T12:00:05", "total_iops": "120.5", "avg_latency_us": "x"},
                  {"volume_id": "vol_002", "timestamp": "2026-05-21T12:00:00", "total_iops": -4, "node_id": None},
                  {"timestamp": "2026-05-21T12:00:00"}, {"volume_id": "v", "timestamp": "later"}) + [("{broken",)]
    table = spark.createDataFrame(texts, "json string")
    table.write.text(f"{tmp_path}/in")
    bounds = ({"total_iops": 0.0}, {"total_iops": 400.0})
    good, bad = sources.clean_events(sources.read_lines(spark, f"{tmp_path}/in"), *bounds)
    sinks.run_available(good, f"{tmp_path}/c1", sinks.append_batches(f"{tmp_path}/good"))
    sinks.run_available(bad, f"{tmp_path}/c2", sinks.append_batches(f"{tmp_path}/bad"))
    want_good, want_bad = sources.clean_events(table, *bounds)
    cols = sorted(want_good.columns)
    assert rows(sinks.read_batches(spark, f"{tmp_path}/good").select(cols)) == rows(want_good.select(cols))
    assert [r["total_iops"] for r in want_good.orderBy("volume_id", "ts").collect()] == [400.0, 120.5, 0.0]
    assert sinks.read_batches(spark, f"{tmp_path}/bad").count() == want_bad.count() == 3


def timed(spark, *values):
    return spark.createDataFrame(list(values), "volume_id string, ts string, total_iops double, avg_latency_us double").withColumn(
        "ts", F.col("ts").cast("timestamp"))


def test_late_rows_are_dropped_and_throttle_holds(spark, tmp_path):
    first = timed(spark, ("a", "2026-01-01 10:00:01", 1.0, 1.0), ("a", "2026-01-01 10:00:02", 2.0, 1.0), ("a", "2026-01-01 12:30:00", 3.0, 1.0))
    late = timed(spark, ("a", "2026-01-01 10:00:03", 9.0, 1.0), ("a", "2026-01-01 12:31:00", 4.0, 1.0))
    for name, build in (("tumbling", state.tumbling), ("throttle", lambda s: state.throttle(s, 1))):
        folder = f"{tmp_path}/{name}"
        os.makedirs(f"{folder}/in")
        stream = build(spark.readStream.schema(first.schema).parquet(f"{folder}/in"))
        for part in (first, late):
            part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
            sinks.run_available(stream, f"{folder}/checkpoint", sinks.append_batches(f"{folder}/out"))
        got = sinks.read_batches(spark, f"{folder}/out")
        if name == "tumbling":
            assert [(r["n"], r["total_iops"]) for r in got.orderBy("from").collect()][0] == (2, 1.5)
        else:
            assert sorted(r["total_iops"] for r in got.collect()) == [1.0, 2.0, 3.0, 4.0]


def test_tables_as_they_stand_after_several_batches(spark, tmp_path):
    parts = [timed(spark, ("a", "2026-01-01 10:00:00", 1.0, 1.0), ("b", "2026-01-01 10:00:00", 1.0, 1.0)),
             timed(spark, ("a", "2026-01-01 10:00:00", 3.0, 1.0), ("a", "2026-01-01 10:05:00", 1.0, 1.0))]
    os.makedirs(f"{tmp_path}/in")
    stream = spark.readStream.schema(parts[0].schema).parquet(f"{tmp_path}/in")
    builds = {"ticks": state.tick_completeness(stream, 2), "volumes": state.ingest_by_volume(stream), "tumbling": state.tumbling(stream),
              "latest": state.latest_state(stream)}
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for name, build in builds.items():
            sinks.run_available(build, f"{tmp_path}/c-{name}", sinks.append_batches(f"{tmp_path}/{name}"), "update")
    ticks = sinks.read_newest(spark, f"{tmp_path}/ticks", ["ts"])
    assert [(r["seen"], r["complete"]) for r in ticks.orderBy("ts").collect()] == [(2, True), (1, False)]
    assert str(state.latest_complete_tick(ticks).first()[0]) == "2026-01-01 10:00:00"
    r = state.ingest_status(sinks.read_newest(spark, f"{tmp_path}/volumes", ["volume_id"])).first()
    assert (r["events"], r["volumes"]) == (4, 2)
    windows_ = sinks.read_newest(spark, f"{tmp_path}/tumbling", ["from", "volume_id"])
    assert [(r["volume_id"], r["n"]) for r in windows_.orderBy("volume_id").collect()] == [("a", 3), ("b", 1)]
    assert sinks.read_newest(spark, f"{tmp_path}/latest", ["volume_id"]).count() == 2


def test_throttle_counts_from_the_last_that_passed(spark, tmp_path):
    parts = [timed(spark, ("a", "2026-01-01 10:00:29", 1.0, 1.0), ("b", "2026-01-01 10:00:00", 1.0, 1.0)),
             timed(spark, ("a", "2026-01-01 10:00:31", 2.0, 1.0), ("a", "2026-01-01 10:00:59", 3.0, 1.0), ("a", "2026-01-01 10:01:28", 4.0, 1.0)),
             timed(spark, ("a", "2026-01-01 10:01:29", 5.0, 1.0))]
    os.makedirs(f"{tmp_path}/in")
    stream = state.throttle(spark.readStream.schema(parts[0].schema).parquet(f"{tmp_path}/in"))
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        sinks.run_available(stream, f"{tmp_path}/c", sinks.append_batches(f"{tmp_path}/out"))
    got = sinks.read_batches(spark, f"{tmp_path}/out")
    assert sorted((r["volume_id"], r["total_iops"]) for r in got.collect()) == [("a", 1.0), ("a", 3.0), ("a", 5.0), ("b", 1.0)]


@pytest.mark.parametrize("rows", [1, 5, 12])
def test_trailing_moments_are_those_of_frames(rows):
    rng = np.random.default_rng(rows)
    line = rng.normal(size=(60, 3)) * 1e4 + 1e6
    line[20:50, 1] = 123456.789  # flat
    line[rng.random(60) < 0.2, 2] = np.nan
    line[30:50, 2] = np.nan
    for since in (0, 7, 59):
        mean, std = state.trailing_moments(line, since, rows)
        for i in range(since, 60):
            for j in range(3):
                frame = line[max(0, i - rows):i, j]
                frame = frame[~np.isnan(frame)]
                if len(frame):
                    assert mean[i - since, j] == pytest.approx(frame.mean(), rel=1e-12)
                    assert std[i - since, j] == pytest.approx(frame.std(), rel=1e-7, abs=1e-6)
                    if (frame == frame[0]).all():
                        assert std[i - since, j] == 0.0
                else:
                    assert np.isnan(mean[i - since, j]) and not std[i - since, j] >= 0


def test_deltas_are_the_whole_table_and_cost_the_batch(spark, tmp_path):
    schema = "volume_id int, ts timestamp_ntz, total_iops double"
    make = lambda rows: spark.createDataFrame(rows, "volume_id int, m int, total_iops double").selectExpr(
        "volume_id", "timestampadd(MINUTE, m, TIMESTAMP_NTZ'2026-04-01 00:00:00') AS ts", "total_iops")
    batches = [make([(v, i, float(i)) for v in range(200) for i in range(4)])] + [make([(k, 10 + k, 50.0)]) for k in range(5)]
    keep = sinks.newest(3)
    write = sinks.keep_deltas(f"{tmp_path}/h", keep, every=3)
    whole = None
    for i, b in enumerate(batches):
        write(b, i)
        write(b, i)  # the same batch again
        whole = b if whole is None else whole.unionByName(b)
        got = sinks.read_deltas(spark, f"{tmp_path}/h", i, spark.createDataFrame([], schema).schema, keep, every=3)
        assert rows(got) == rows(windows.last_rows(whole, 3))
    written = {i: spark.read.parquet(sinks.version_path(f"{tmp_path}/h/delta", i)).count() for i in range(6)}
    assert written == {0: 600, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1}
    assert sorted(os.listdir(f"{tmp_path}/h/base")) == ["version=000000000002", "version=000000000005"]


def test_online_detector_takes_a_bucket_of_volumes_in_one_call(spark, parts, tmp_path):
    calls = []

    def scored(s):
        out = state.online_scores(s, rows=40, buckets=2)
        calls.append(out._jdf.queryExecution().analyzed().toString())
        return out

    none = parts.withColumn("volume_id", F.lit(None).cast(parts.schema["volume_id"].dataType))
    both = parts.unionByName(none.dropDuplicates(["ts"])).persist()
    feed(spark, both, str(tmp_path), scored)
    assert "_bucket" in calls[0]
    got = sinks.read_batches(spark, f"{tmp_path}/out").select("volume_id", "ts", "hotspot_score")
    want = hotspot_scores(parts.drop("part"), rows=40).select("volume_id", "ts", "hotspot_score")
    assert rows(got.where("volume_id IS NOT NULL")) == rows(want)
    assert got.where("volume_id IS NULL").count() == both.where("volume_id IS NULL").count()
