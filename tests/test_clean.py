"""Event parsing, clipping and coercion cases."""

import math

from pyspark.sql import functions as F

from tidewatch.operators import clean
from tidewatch.roles import Roles

LOW = {"total_iops": 0.0, "avg_latency_us": 10.0, "read_iops": 0.0, "write_iops": 0.0}
HIGH = {"total_iops": 10000.0, "avg_latency_us": 2000.0, "read_iops": 5000.0, "write_iops": 5000.0}
FIELDS = ["volume_id", "timestamp", "total_iops", "avg_latency_us", "node_id", "capacity_used_pct"]


def parse(spark, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "json string")
    return clean.parse_events(df, "json", FIELDS)


def one(spark, text):
    return clean.clip_event_texts(parse(spark, text), LOW, HIGH).first()


def test_in_bounds_unchanged(spark):
    r = one(spark, '{"total_iops": 500.0, "avg_latency_us": 120.5, "node_id": "node_A"}')
    assert (float(r["total_iops"]), float(r["avg_latency_us"]), r["node_id"]) == (500.0, 120.5, "node_A")


def test_high_and_low_are_clipped(spark):
    r = one(spark, '{"total_iops": 999999.0, "avg_latency_us": 888888.0}')
    assert (float(r["total_iops"]), float(r["avg_latency_us"])) == (10000.0, 2000.0)
    r = one(spark, '{"total_iops": -50.0, "avg_latency_us": -5.0}')
    assert (float(r["total_iops"]), float(r["avg_latency_us"])) == (0.0, 10.0)


def test_null_text_and_nan_stay(spark):
    r = one(spark, '{"total_iops": null, "avg_latency_us": "N/A", "capacity_used_pct": NaN}')
    assert r["total_iops"] is None and r["avg_latency_us"] == "N/A"
    assert r["capacity_used_pct"] is None or math.isnan(float(r["capacity_used_pct"]))
    r = one(spark, '{"total_iops": "NaN"}')
    assert r["total_iops"] == "NaN"


def test_quoted_and_plain_numbers_parse_alike(spark):
    a = one(spark, '{"total_iops": 120.5}')
    b = one(spark, '{"total_iops": "120.5"}')
    assert float(a["total_iops"]) == float(b["total_iops"]) == 120.5


def test_malformed_event_is_rejected_and_kept(spark):
    text = '{"volume_id": "v", "timestamp": "2026-05-21T12:00:00", "total_iops": 1'
    good, bad = clean.split_events(parse(spark, text, '{"volume_id": "v", "timestamp": "2026-05-21T12:00:00"}', '{"timestamp": "2026-05-21T12:00:00"}', '{"volume_id": "v", "timestamp": "soon"}'))
    assert good.count() == 1 and bad.count() == 3
    assert bad.where(F.col("_corrupt_record") == text).count() == 1


def test_coercion_makes_numbers(spark):
    df = parse(spark, *['{"volume_id": null, "total_iops": %s}' % v for v in ('""', '"None"', '"nan"', '"junk"', "null", '"7.5"')])
    rows = clean.coerce_events(df.drop("_corrupt_record")).collect()
    assert [r["total_iops"] for r in rows] == [0.0, 0.0, 0.0, 0.0, 0.0, 7.5]
    assert {r["volume_id"] for r in rows} == {""}


def test_fill_never_looks_back_and_starts_at_zero(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 4.0), (1, 3, None), (2, 1, float("nan")), (2, 2, 5.0)], "volume_id int, d int, x double")
    df = df.withColumn("ts", F.timestamp_add("DAY", F.col("d"), F.expr("TIMESTAMP_NTZ'2026-04-01 00:00:00'"))).drop("d")
    rows = clean.fill_gaps(df, Roles(), ["x"]).orderBy("volume_id", "ts").collect()
    assert [r["x"] for r in rows] == [0.0, 4.0, 4.0, 0.0, 5.0]


def test_capacity_scales(spark):
    df = spark.createDataFrame([(-1.0,), (0.5,), (1.0,), (50.0,), (250.0,), (None,)], "capacity_used_pct double")
    rows = [r[0] for r in clean.capacity_to_fraction_value(df).collect()]
    assert rows == [0.0, 0.5, 1.0, 0.5, 1.0, None]
    fractions = spark.createDataFrame([(0.2,), (1.0,)], "capacity_used_pct double")
    assert [r[0] for r in clean.capacity_to_fraction_table(fractions).collect()] == [0.2, 1.0]


def test_validate_features(spark):
    df = spark.createDataFrame([(0, 1.0), (1, float("nan")), (1, float("inf"))], "label int, x double")
    r = clean.validate_features(df, "label", [0, 1], 3).first()
    assert (r["nulls"], r["infinite"], r["rows_ok"], r["labels_ok"]) == (1, 1, True, True)
