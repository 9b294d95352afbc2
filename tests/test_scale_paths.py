"""Gaps filled without a grid, input read once."""

import datetime as dt
import random

from tidewatch.operators import forecast, summaries


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_gaps_are_filled_where_the_rows_are(spark):
    t0, rnd = dt.datetime(2024, 1, 1), random.Random(3)
    rows = [(v, t0 + dt.timedelta(hours=h), rnd.choice([None, float(h)])) for v in (1, 2, None) for h in sorted(rnd.sample(range(400), 12))] + [(1, None, 7.0), (3, None, 1.0)]
    series = spark.createDataFrame(rows, "volume_id long, hour timestamp_ntz, x double")
    for backfill in (False, True):
        out = summaries.densify(series, ["x"], "1 HOUR", "hour", backfill=backfill)
        assert "Join" not in plan(out)
        want = set()
        for v in (1, 2, None):
            mine = {r[1]: r[2] if v else None for r in rows if r[0] == v and r[1]}
            first = next((x for _, x in sorted(mine.items()) if x is not None), None) if backfill else None
            at, value = min(mine), None
            while at <= max(mine):
                value = mine.get(at) if mine.get(at) is not None else value
                want.add((v, at, first if value is None else value))
                at += dt.timedelta(hours=1)
        got = [tuple(r) for r in out.collect()]
        assert len(got) == len(want) and set(got) == want


def test_recent_days_need_no_join_and_the_backtest_reads_them_once(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(v, t0 + dt.timedelta(days=d, hours=5), 0.01 * d, 10.0) for v in (1, 2) for d in range(40) if d % 3]
    df = spark.createDataFrame(rows, "volume_id long, ts timestamp_ntz, capacity_used_pct double, capacity_total_gb double")
    recent = forecast.recent_daily_capacity(df)
    assert "Join" not in plan(recent) and recent.count() == 40
    assert "LogicalRDD" not in plan(forecast.capacity_backtest(recent))  # read from the staged days
