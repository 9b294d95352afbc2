"""Exact quantiles against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import quantiles
from tidewatch.operators.clean import impute_median

PROBS = {"a": 0.0, "b": 0.02, "c": 0.25, "d": 0.5, "e": 0.95, "f": 0.99, "top": 1.0}


@pytest.mark.parametrize("ranges", [65_536, 3, 0.01])
def test_matches_numpy_per_group(spark, monkeypatch, ranges):
    # Few ranges put many values into each, or all into one.
    monkeypatch.setattr(quantiles, "RANGES", ranges)
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 40).alias("g"),
        (F.xxhash64("id") % 100_000 / 7).alias("x"))
    values = {}
    for r in df.collect():
        values.setdefault(r["g"], []).append(r["x"])
    for r in quantiles.quantile_table(df, ["x"], PROBS, ["g"]).collect():
        want = np.quantile(values[r["g"]], list(PROBS.values()))
        assert np.allclose([r[p] for p in PROBS], want, rtol=1e-12)


def test_ties_nulls_and_single_rows(spark):
    df = spark.createDataFrame([(1, 2.0)] * 5 + [(1, None), (1, float("nan")), (2, 7.0), (3, 1.0), (3, 2.0), (None, -4.0), (None, 0.0)], "g int, x double")
    rows = {r["g"]: r["m"] for r in quantiles.quantile_table(df, ["x"], {"m": 0.5}, ["g"]).collect()}
    assert rows == {1: 2.0, 2: 7.0, 3: 1.5, None: -2.0}


def test_whole_table_scalar(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("x"))
    q = quantiles.quantile_struct(df, "x", {"lo": 0.02, "hi": 0.98})
    r = df.limit(1).select(q["lo"].alias("lo"), q["hi"].alias("hi")).first()
    assert (r["lo"], r["hi"]) == (2.0, 98.0)


def test_approximate_switch(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    r = quantiles.quantile_table(df, ["x"], {"m": 0.5}, method="approx").first()
    assert abs(r["m"] - 500) <= 2


def test_impute_without_any_finite_value(spark):
    df = spark.createDataFrame([(1, None), (2, float("inf"))], "i int, x double")
    assert [r["x"] for r in impute_median(df, ["x"]).collect()] == [0.0, 0.0]
