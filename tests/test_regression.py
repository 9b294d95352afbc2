"""Quantile regression, wave forecasts and the solver against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.linear import solve_symmetric
from tidewatch.operators import forecast
from tidewatch.operators import quantile_regression as qr


def test_solver_solves_row_by_row(spark):
    rng = np.random.default_rng(3)
    rows, want = [], []
    for i in range(20):
        m = rng.normal(size=(6, 4))
        a, b = m.T @ m, rng.normal(size=4)
        rows.append((i, *[float(a[r, c]) for r in range(4) for c in range(r + 1)], *map(float, b)))
        want.append(np.linalg.solve(a, b))
    names = [f"a{r}{c}" for r in range(4) for c in range(r + 1)] + [f"b{r}" for r in range(4)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{n} double" for n in names))
    out = solve_symmetric(df, [[f"a{r}{c}" for c in range(r + 1)] for r in range(4)], [f"b{r}" for r in range(4)], ["x0", "x1", "x2", "x3"])
    assert out.columns == ["id", *names, "x0", "x1", "x2", "x3"]
    got = np.array([[r["x0"], r["x1"], r["x2"], r["x3"]] for r in out.orderBy("id").collect()])
    assert np.allclose(got, np.array(want), rtol=1e-8, atol=1e-8)


def smooth_loss(x, y, beta, q, h):
    r = y - x @ beta
    return np.mean(q * r + h * np.logaddexp(0, -r / h))


def descend(x, y, q, h, ridge, start):
    """A plain minimiser of the smoothed loss: Newton with halving until nothing moves."""
    beta = start.copy()
    for _ in range(500):
        p = 1 / (1 + np.exp(np.clip((y - x @ beta) / h, -500, 500)))
        g = x.T @ (q - p)
        hess = (x * (p * (1 - p) / h)[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step, t = np.linalg.solve(hess, g), 1.0
        while t > 1e-9 and smooth_loss(x, y, beta + t * step, q, h) > smooth_loss(x, y, beta, q, h) + 1e-15:
            t /= 2
        beta = beta + t * step
        if np.abs(step).max() * t < 1e-12 * max(1, np.abs(y).max()):
            break
    return beta


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(11)
    rows = []
    for v, n in ((1, 60), (2, 400), (3, 9), (4, 30)):
        for i in range(n):
            hour = int(rng.integers(0, 24))
            level = 100 + 30 * np.sin(2 * np.pi * hour / 24)
            rows.append((v, int(rng.integers(0, 28)), hour, float(level + rng.exponential(20)) if v != 4 else 5.0, float(rng.uniform(0, 10))))
    rows += [(2, 3, 4, None, 1.0)]
    df = spark.createDataFrame(rows, "volume_id int, d int, h int, a double, b double")
    return df.withColumn("ts", F.expr("timestampadd(HOUR, h, timestampadd(DAY, d, TIMESTAMP_NTZ'2026-04-06 00:00:00'))"))


@pytest.mark.parametrize("rows_per_task", [None, 25])
def test_quantile_fits_are_those_of_numpy(spark, samples, rows_per_task):
    df = qr.with_calendar(samples, "ts")
    probs = [0.5, 0.95, 0.99]
    fits = {(r["volume_id"], r["metric"], r["prob"]): r for r in qr.fit_quantiles(df, ["a", "b"], probs, qr.CALENDAR, rows_per_task=rows_per_task).collect()}
    assert {k[0] for k in fits} == {1, 2, 4} and len(fits) == 3 * 2 * 3
    local = df.toPandas()
    names = qr.coefficient_names(qr.CALENDAR)
    for (v, m, q), r in fits.items():
        mine = local[(local.volume_id == v) & local[m].notna()]
        x = np.column_stack([np.ones(len(mine)), mine[qr.CALENDAR].to_numpy(float)])
        y = mine[m].to_numpy(float)
        assert r["n"] == len(y)
        got = np.array([r[n] for n in names])
        h = qr.SMOOTHING * r["spread"]
        want = descend(x, y, q, h, qr.RIDGE * len(y) / r["spread"], got + r["spread"] * 0.1)
        assert np.abs(got - want).max() <= 1e-3 * max(r["spread"], 1e-6), (v, m, q)
    assert fits[4, "a", 0.99]["b_intercept"] == pytest.approx(5.0, abs=1e-6)


def test_regression_is_no_worse_than_seasonal_quantiles_on_later_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(v, i, float(100 + 40 * np.sin(2 * np.pi * (i % 24) / 24) + rng.normal() * 15)) for v in range(3) for i in range(24 * 20)]
    df = spark.createDataFrame(rows, "volume_id int, i int, a double").withColumn("ts", F.expr("timestampadd(HOUR, i, TIMESTAMP_NTZ'2026-04-06 00:00:00')"))
    train, later = df.where("i < 240"), df.where("i >= 240 AND i < 264").select("volume_id", "ts", "a")
    start = F.lit("2026-04-16 00:00:00").cast("timestamp_ntz")
    cols = {f"a_{p}": q for p, q in forecast.DEMAND_PROBS.items()}
    total = {}
    fits = qr.fit_quantiles(qr.with_calendar(train, "ts"), ["a"], list(forecast.DEMAND_PROBS.values()), qr.CALENDAR, steps=8)
    for name, told in (("seasonal", forecast.demand_forecast(train, start, ["a"])), ("regression", forecast.demand_regression(train, start, ["a"], fits=fits))):
        met = later.join(told.withColumnRenamed("forecast_hour", "ts"), ["volume_id", "ts"])
        assert met.count() == 72
        assert met.where("a_p50 > a_p95 OR a_p95 > a_p99 OR a_p50 < 0").count() == 0
        total[name] = sum(r["loss"] for r in forecast.pinball_loss(met, "a", cols).collect())
    assert total["regression"] <= total["seasonal"]


def test_losses_of_fits(spark, samples):
    df = qr.with_calendar(samples, "ts").where("volume_id = 2")
    fits = qr.fit_quantiles(df, ["a", "b"], [0.5], qr.CALENDAR, steps=8)
    loss = {r["metric"]: r["loss"] for r in qr.smoothed_loss(df, fits, ["a", "b"], qr.CALENDAR).collect()}
    flat = {m: df.agg(F.avg(F.abs(F.col(m) - F.lit(df.approxQuantile(m, [0.5], 0.0)[0])) / 2)).first()[0] for m in "ab"}
    assert loss["a"] < flat["a"] and loss["b"] <= flat["b"] * 1.01


def test_nothing_to_fit(spark, samples):
    df = qr.with_calendar(samples, "ts")
    assert qr.fit_quantiles(df.limit(0), ["a"], [0.5], qr.CALENDAR, steps=2).collect() == []
    assert qr.fit_quantiles(df, ["a"], [0.5], qr.CALENDAR, min_rows=10_000, steps=2).collect() == []


def weekly(spark, waves):
    rows = [(v, i, float(0.4 + 0.004 * i + a * np.sin(2 * np.pi * i / 7) + 0.5 * a * np.cos(2 * np.pi * i / 7))) for v, a in waves.items() for i in range(20)]
    df = spark.createDataFrame(rows, "volume_id int, i int, capacity_used_pct double")
    return df.select("volume_id", F.expr("timestampadd(DAY, i, TIMESTAMP_NTZ'2026-04-01 00:00:00')").alias("day"), "capacity_used_pct", F.lit(100.0).alias("capacity_total_gb"))


def test_wave_is_the_ridge_solution(spark):
    daily = weekly(spark, {1: 0.05, 2: 0.0})
    got = {r["volume_id"]: [r[f"c{i}"] for i in range(4)] for r in forecast.capacity_wave(daily).collect()}
    x = np.arange(20.0)
    b = np.column_stack([np.ones(20), x, np.sin(2 * np.pi * x / 7), np.cos(2 * np.pi * x / 7)])
    for v, a in ((1, 0.05), (2, 0.0)):
        y = 0.4 + 0.004 * x + a * b[:, 2] + 0.5 * a * b[:, 3]
        assert np.allclose(got[v], np.linalg.solve(b.T @ b + np.diag([0, 1e-9, forecast.WAVE_RIDGE, forecast.WAVE_RIDGE]), b.T @ y), atol=1e-9)


def test_wave_beats_the_line_where_there_is_one_and_else_equals_it(spark):
    daily = weekly(spark, {1: 0.05, 2: 0.0})
    mae = {(r["volume_id"], r["model"]): r["mae"] for r in forecast.capacity_backtest(daily).collect()}
    assert mae[1, "wave"] < 0.6 * mae[1, "trend"]
    assert mae[2, "wave"] == pytest.approx(mae[2, "trend"], abs=1e-9)
    short = daily.where("volume_id = 1 AND day < TIMESTAMP_NTZ'2026-04-02 00:00:00'")
    one = forecast.capacity_forecast(short, 3, model="wave").first()
    assert all(0 <= v <= 1 for v in one["forecast"]) and forecast.capacity_backtest(short).count() == 0
    with pytest.raises(ValueError):
        forecast.capacity_forecast(daily, model="network")
