"""Queries of forecasts and scenario tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.numeric import round_half_up as rnd
from tidewatch.operators import forecast, quantile_regression, summaries, whatif
from tidewatch.operators.windows import latest_rows
from tidewatch.plans.fixtures import CAP_SQL, E_SQL, EVENTS, R, capacity, events, table, telemetry
from tidewatch.plans.registry import query
from tidewatch.plans.summary_queries import DENSE_SQL, LATEST_SQL, WC, WE, WT, r4
from tidewatch.plans.topology_queries import UTIL, place, utilization

RECENT_SQL = f"{DENSE_SQL}, rd AS (SELECT * FROM dc QUALIFY ROW_NUMBER() OVER (PARTITION BY volume_id ORDER BY day DESC) <= 20)"
TREND_SQL = f"""{RECENT_SQL}, xy AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY volume_id ORDER BY day) - 1 AS x FROM rd),
tr AS (SELECT volume_id, COALESCE(REGR_SLOPE(capacity_used_pct, x), 0) AS slope, COALESCE(REGR_INTERCEPT(capacity_used_pct, x), MAX(capacity_used_pct)) AS intercept,
  MAX(x) AS last_x, ARG_MAX(capacity_used_pct, day) AS current_pct, ARG_MAX(capacity_total_gb, day) AS total_gb FROM xy GROUP BY 1),
fc AS (SELECT volume_id, current_pct, total_gb, k, LEAST(1.0, GREATEST(0.0, intercept + slope * (last_x + k))) AS v FROM tr, (SELECT UNNEST(RANGE(1, 61)) AS k) g)"""


def dtf_sql(src: str, thr: float, name: str) -> str:
    """Days to fill per key from long curves (key, current_pct, k, v)."""
    return f"""{name} AS (SELECT key, CASE WHEN MAX(current_pct) >= {thr} THEN 0
    WHEN MIN(CASE WHEN v >= {thr} THEN k END) IS NOT NULL THEN
      MIN(CASE WHEN v >= {thr} THEN k END) - 1 + ({thr} - ARG_MIN(prev, k) FILTER (WHERE v >= {thr})) / (ARG_MIN(v, k) FILTER (WHERE v >= {thr}) - ARG_MIN(prev, k) FILTER (WHERE v >= {thr}) + 1e-9)
    WHEN MEDIAN(v - prev) FILTER (WHERE k > 54) > 0 THEN 60 + ({thr} - ARG_MAX(v, k)) / MEDIAN(v - prev) FILTER (WHERE k > 54) END AS d
  FROM (SELECT *, COALESCE(LAG(v) OVER (PARTITION BY key ORDER BY k), current_pct) AS prev FROM {src}) q GROUP BY 1)"""


def recent(spark, d):
    return forecast.recent_daily_capacity(capacity(spark, d))


@query("forecast_recent_daily_capacity", f"{WC}, {RECENT_SQL} SELECT * FROM rd")
def _(spark, d):
    return recent(spark, d)


@query("forecast_capacity_curve", f"{WC}, {TREND_SQL} SELECT volume_id, k, {R('v', 6)} AS v FROM fc")
def _(spark, d):
    f = forecast.capacity_forecast(recent(spark, d))
    return f.select("volume_id", F.posexplode("forecast").alias("k", "v")).select(
        "volume_id", (F.col("k") + 1).cast("bigint").alias("k"), rnd(F.col("v"), 6).alias("v"))


def solve_sql(src: str, n: int, b: str, out: str) -> str:
    """SQL that adds ``out0 ..``: the solution of the system hi_j (j <= i), b0 .. in each row, by elimination."""
    def minus(first: str, parts: list[str]) -> str:
        return " - ".join([first, *parts])

    for j in range(n):
        src = f"SELECT *, {minus(f'h{j}_{j}', [f'l{j}_{k}*l{j}_{k}*d{k}' for k in range(j)])} AS d{j} FROM ({src}) q"
        if j < n - 1:
            below = ", ".join(f"({minus(f'h{i}_{j}', [f'l{i}_{k}*l{j}_{k}*d{k}' for k in range(j)])}) / d{j} AS l{i}_{j}" for i in range(j + 1, n))
            src = f"SELECT *, {below} FROM ({src}) q"
    for i in range(n):
        src = f"SELECT *, {minus(f'{b}{i}', [f'l{i}_{k}*z{k}' for k in range(i)])} AS z{i} FROM ({src}) q"
    for i in reversed(range(n)):
        src = f"SELECT *, {minus(f'z{i}/d{i}', [f'l{k}_{i}*{out}{k}' for k in range(i + 1, n)])} AS {out}{i} FROM ({src}) q"
    return src


def wave_sql(days: str, name: str) -> str:
    """CTE with the coefficients x0 .. x3 of trend and weekly wave of (volume_id, day) series."""
    basis = ["1.0::DOUBLE", "x", f"SIN(2*PI()*x/{forecast.WEEK})", f"COS(2*PI()*x/{forecast.WEEK})"]
    ridge = [0.0, 1e-9, forecast.WAVE_RIDGE, forecast.WAVE_RIDGE]
    sums = ", ".join([f"SUM({v}*capacity_used_pct) AS s{i}" for i, v in enumerate(basis)]
                     + [f"SUM({basis[i]}*{basis[j]}) + {ridge[i] if i == j else 0.0}::DOUBLE AS h{i}_{j}" for i in range(4) for j in range(i + 1)])
    moments = f"""SELECT volume_id, MAX(x) AS last_x, ARG_MAX(capacity_used_pct, day) AS current_pct, {sums}
  FROM (SELECT *, DATE_DIFF('day', MIN(day) OVER (PARTITION BY volume_id), day)::DOUBLE AS x FROM {days}) q GROUP BY 1"""
    return f"{name} AS (SELECT volume_id, last_x, current_pct, x0, x1, x2, x3 FROM ({solve_sql(moments, 4, 's', 'x')}) q)"


def wave_curve_sql(fit: str, n: int) -> str:
    return f"""SELECT volume_id, current_pct, k, LEAST(1.0, GREATEST(0.0, x0 + x1*(last_x + k) + x2*SIN(2*PI()*(last_x + k)/{forecast.WEEK}) + x3*COS(2*PI()*(last_x + k)/{forecast.WEEK}))) AS v
  FROM {fit}, (SELECT UNNEST(RANGE(1, {n + 1})) AS k) g"""


WAVE_SQL = f"{RECENT_SQL}, {wave_sql('rd', 'wv')}, fw AS ({wave_curve_sql('wv', 60)})"


@query("forecast_capacity_wave", f"{WC}, {WAVE_SQL} SELECT volume_id, k, {R('v', 6)} AS v FROM fw")
def _(spark, d):
    f = forecast.capacity_forecast(recent(spark, d), model="wave")
    return f.select("volume_id", F.posexplode("forecast").alias("k", "v")).select(
        "volume_id", (F.col("k") + 1).cast("bigint").alias("k"), rnd(F.col("v"), 6).alias("v"))


@query("forecast_capacity_backtest", f"""{WC}, {RECENT_SQL}, ah AS (SELECT *, {forecast.WEEK} - DATE_DIFF('day', day, MAX(day) OVER (PARTITION BY volume_id)) AS ahead FROM rd),
be AS (SELECT volume_id, day, capacity_used_pct FROM ah WHERE ahead <= 0), {wave_sql('be', 'wv')}, fw AS ({wave_curve_sql('wv', forecast.WEEK)}),
xl AS (SELECT *, DATE_DIFF('day', MIN(day) OVER (PARTITION BY volume_id), day) AS x FROM be),
tl AS (SELECT volume_id, COALESCE(REGR_SLOPE(capacity_used_pct, x), 0) AS slope, COALESCE(REGR_INTERCEPT(capacity_used_pct, x), MAX(capacity_used_pct)) AS intercept, MAX(x) AS last_x FROM xl GROUP BY 1),
fl AS (SELECT volume_id, k, LEAST(1.0, GREATEST(0.0, intercept + slope*(last_x + k))) AS v FROM tl, (SELECT UNNEST(RANGE(1, {forecast.WEEK + 1})) AS k) g),
bo AS (SELECT volume_id, 'wave' AS model, k, v FROM fw UNION ALL SELECT volume_id, 'trend', k, v FROM fl)
SELECT bo.volume_id, model, {R('AVG(ABS(v - capacity_used_pct))', 6)} AS mae, COUNT(*) AS days FROM bo JOIN ah ON ah.volume_id = bo.volume_id AND ah.ahead = bo.k GROUP BY 1, 2""")
def _(spark, d):
    b = forecast.capacity_backtest(recent(spark, d))
    return b.select("volume_id", "model", rnd(F.col("mae"), 6).alias("mae"), "days")


CURVES = "cv AS (SELECT volume_id AS key, current_pct, k, v FROM fc)"


@query("forecast_days_to_fill", f"""{WC}, {TREND_SQL}, {CURVES}, {dtf_sql('cv', 0.85, 'dw')}, {dtf_sql('cv', 0.95, 'dx')}
SELECT dw.key AS volume_id, {R('dw.d', 4)} AS warning_days, {R('dx.d', 4)} AS critical_days FROM dw JOIN dx ON dw.key = dx.key""")
def _(spark, d):
    f = forecast.capacity_forecast(recent(spark, d))
    c, v = F.col("current_pct"), F.col("forecast")
    return f.select("volume_id", rnd(forecast.days_to_fill(c, v, 0.85), 4).alias("warning_days"),
                    rnd(forecast.days_to_fill(c, v, 0.95), 4).alias("critical_days"))


@query("forecast_days_to_fill_coarse", f"""{WC}, {TREND_SQL} SELECT volume_id, MIN(CASE WHEN v >= 0.85 THEN k - 1 END)::DOUBLE AS warning_days,
  MIN(CASE WHEN v >= 0.95 THEN k - 1 END)::DOUBLE AS critical_days FROM fc GROUP BY 1""")
def _(spark, d):
    f = forecast.capacity_forecast(recent(spark, d))
    return f.select("volume_id", forecast.days_to_fill_coarse(F.col("forecast"), 0.85).alias("warning_days"),
                    forecast.days_to_fill_coarse(F.col("forecast"), 0.95).alias("critical_days"))


def dsev(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'safe' WHEN {x} <= 0 THEN 'breached' WHEN {x} < 7 THEN 'critical' WHEN {x} < 30 THEN 'warning' ELSE 'normal' END"


REPORT_SQL = f"""{WC}, {TREND_SQL}, {CURVES}, {dtf_sql('cv', 0.85, 'dw')}, {dtf_sql('cv', 0.95, 'dx')},
rs AS (SELECT dw.key AS volume_id, dw.d AS w, dx.d AS c, CASE WHEN {dsev('dx.d')} IN ('normal', 'safe') THEN {dsev('dw.d')} ELSE {dsev('dx.d')} END AS severity FROM dw JOIN dx ON dw.key = dx.key)"""


@query("forecast_capacity_report", f"""{REPORT_SQL}, s7 AS (SELECT volume_id, SUM(CASE WHEN k <= 7 THEN v END) AS s7, SUM(CASE WHEN k <= 30 THEN v END) AS s30 FROM fc GROUP BY 1)
SELECT rs.volume_id, severity, CASE severity WHEN 'breached' THEN rs.volume_id || ' is over its capacity threshold: expand it or move cold data to a slower tier now.'
  WHEN 'critical' THEN rs.volume_id || ' reaches its capacity limit in ' || FLOOR(c)::BIGINT || ' days: add capacity now or move cold data.'
  WHEN 'warning' THEN rs.volume_id || ' needs more capacity in about ' || CASE WHEN w > 0 THEN (FLOOR(w)::BIGINT)::VARCHAR ELSE '?' END || ' days.'
  ELSE rs.volume_id || ' has enough capacity.' END AS recommendation, {R('s7', 4)} AS sum_7d, {R('s30', 4)} AS sum_30d FROM rs JOIN s7 USING (volume_id)""")
def _(spark, d):
    r = forecast.by_capacity_urgency(forecast.capacity_report(recent(spark, d)))

    def total(c):
        return rnd(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 4)

    return r.select("volume_id", "severity", "recommendation", total("forecast_7d").alias("sum_7d"), total("forecast_30d").alias("sum_30d"))


@query("forecast_capacity_severity_counts", f"{REPORT_SQL} SELECT severity, COUNT(*) AS n FROM rs GROUP BY 1")
def _(spark, d):
    return forecast.severity_counts(forecast.capacity_report(recent(spark, d)))


# --- latency --------------------------------------------------------------------------

EM = ["total_iops", "avg_latency_us"]
HOURLY_E = """hh AS (SELECT volume_id, TIMESTAMP '1970-01-01' + INTERVAL 1 HOUR * CAST(ROUND_EVEN(EPOCH_US(ts) / 3.6e9, 0) AS BIGINT) AS hour,
  AVG(total_iops) AS total_iops, AVG(avg_latency_us) AS avg_latency_us FROM e GROUP BY 1, 2),
hg AS (SELECT volume_id, UNNEST(GENERATE_SERIES(MIN(hour), MAX(hour), INTERVAL 1 HOUR)) AS hour FROM hh GROUP BY 1),
hd AS (SELECT hg.volume_id, hg.hour, COALESCE(LAST_VALUE(total_iops IGNORE NULLS) OVER w, 0) AS total_iops,
  GREATEST(COALESCE(LAST_VALUE(avg_latency_us IGNORE NULLS) OVER w, 0), 0) AS avg_latency_us
  FROM hg LEFT JOIN hh ON hg.volume_id = hh.volume_id AND hg.hour = hh.hour
  WINDOW w AS (PARTITION BY hg.volume_id ORDER BY hg.hour ROWS UNBOUNDED PRECEDING))"""


def hourly(spark, d):
    return summaries.hourly_means(events(spark, d), EM, EVENTS, ("avg_latency_us",))


@query("forecast_hourly_latency_series", f"""{WT}, hh AS (SELECT volume_id, TIMESTAMP '1970-01-01' + INTERVAL 1 HOUR * CAST(ROUND_EVEN(EPOCH_US(ts) / 3.6e9, 0) AS BIGINT) AS hour,
  {', '.join(f'AVG({m}) AS {m}' for m in forecast.HOURLY_METRICS[:-1])}, AVG(GREATEST(read_latency_p95_us, write_latency_p95_us)) AS latency_p95_us FROM t GROUP BY 1, 2)
SELECT volume_id, COUNT(*) AS n, {R('AVG(latency_p95_us)', 4)} AS latency_p95_us, SUM(queue_depth)::BIGINT AS queue_depth FROM (
  SELECT g.volume_id, g.hour, LAST_VALUE(latency_p95_us IGNORE NULLS) OVER w AS latency_p95_us, LAST_VALUE(queue_depth IGNORE NULLS) OVER w AS queue_depth
  FROM (SELECT volume_id, UNNEST(GENERATE_SERIES(MIN(hour), MAX(hour), INTERVAL 1 HOUR)) AS hour FROM hh GROUP BY 1) g LEFT JOIN hh ON g.volume_id = hh.volume_id AND g.hour = hh.hour
  WINDOW w AS (PARTITION BY g.volume_id ORDER BY g.hour ROWS UNBOUNDED PRECEDING)) q GROUP BY 1""")
def _(spark, d):
    h = forecast.hourly_latency(telemetry(spark, d))
    return h.groupBy("volume_id").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("latency_p95_us"), 4).alias("latency_p95_us"),
                                      F.sum("queue_depth").cast("bigint").alias("queue_depth"))


@query("forecast_scaled_hourly", f"""{WE}, {HOURLY_E}, mk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY volume_id ORDER BY hour DESC) AS fe, COUNT(*) OVER (PARTITION BY volume_id) AS n FROM hd),
st AS (SELECT AVG(total_iops) AS m1, STDDEV_POP(total_iops) AS s1, AVG(avg_latency_us) AS m2, STDDEV_POP(avg_latency_us) AS s2 FROM mk WHERE fe > 72 OR n <= 72)
SELECT volume_id, hour, {R('(total_iops - m1)/s1', 5)} AS total_iops, {R('(avg_latency_us - m2)/s2', 5)} AS avg_latency_us FROM hd, st""")
def _(spark, d):
    s = forecast.scaled_hourly(hourly(spark, d), EM)
    return s.select("volume_id", "hour", *r4(s, *EM, n=5))


def quant_sql(src: str, time: str, value: str, probs: dict, name: str) -> str:
    q = ", ".join(f"QUANTILE_CONT({value}, {p}) AS {n}" for n, p in probs.items())
    pick = ", ".join(f"GREATEST(COALESCE(o.{n}, a.{n}), 0) AS {n}" for n in probs)
    return f"""{name}o AS (SELECT volume_id, HOUR({time}) AS hod, {q} FROM {src} GROUP BY 1, 2), {name}a AS (SELECT volume_id, {q} FROM {src} GROUP BY 1),
{name} AS (SELECT a.volume_id, st.step, st.h AS forecast_hour, {pick} FROM {name}a a, {{steps}} st LEFT JOIN {name}o o ON o.volume_id = a.volume_id AND o.hod = HOUR(st.h))"""


def steps_sql(src: str, time: str, n: int) -> str:
    return f"steps AS (SELECT i AS step, (SELECT DATE_TRUNC('hour', MAX({time})) FROM {src}) + INTERVAL 1 HOUR * (i + 1) AS h FROM (SELECT UNNEST(RANGE(0, {n})) AS i) r)"


LAT_SQL = f"{WE}, {HOURLY_E}, {steps_sql('hd', 'hour', 6)}, " + quant_sql("hd", "hour", "avg_latency_us", forecast.LATENCY_PROBS, "lf").format(steps="steps")


def latency(spark, d):
    h = hourly(spark, d)
    return forecast.latency_forecast(h, forecast.next_hour(h, "hour"), "avg_latency_us")


@query("forecast_latency_quantiles", f"{LAT_SQL} SELECT volume_id, step, forecast_hour, {', '.join(R(c, 4) + f' AS {c}' for c in forecast.LATENCY_PROBS)} FROM lf")
def _(spark, d):
    f = latency(spark, d)
    return f.select("volume_id", F.col("step").cast("bigint").alias("step"), "forecast_hour", *r4(f, *forecast.LATENCY_PROBS))


@query("forecast_repair_crossing", """SELECT event_id, GREATEST(LEAST(value, 50, value*2 - 60), 0) AS p50,
  GREATEST(LIST_SORT([value, 50.0, value*2 - 60])[2], 0) AS p90, GREATEST(value, 50, value*2 - 60) AS p95 FROM events""")
def _(spark, d):
    v = F.col("value")
    e = table(spark, d, "events").select("event_id", v.alias("p50"), F.lit(50.0).alias("p90"), (v * 2 - 60).alias("p95"))
    return forecast.repair_crossing(e, ["p50", "p90", "p95"])


@query("forecast_pinball_loss", f"""SELECT q AS quantile, {R('AVG(GREATEST((p-1)*(value-f), p*(value-f)))', 5)} AS loss FROM (
  SELECT value, UNNEST(['p50','p90','p95']) AS q, UNNEST([0.5::DOUBLE, 0.9::DOUBLE, 0.95::DOUBLE]) AS p, UNNEST([40.0::DOUBLE, 100.0::DOUBLE, 150.0::DOUBLE]) AS f FROM events) x GROUP BY 1""")
def _(spark, d):
    e = table(spark, d, "events").select("value", F.lit(40.0).alias("p50"), F.lit(100.0).alias("p90"), F.lit(150.0).alias("p95"))
    p = forecast.pinball_loss(e, "value", forecast.LATENCY_PROBS)
    return p.select("quantile", rnd(F.col("loss"), 5).alias("loss"))


RISK_SQL = "LEAST(1, p95_peak/{slo}) AS risk_score, CASE WHEN p95_peak >= 1.5*{slo} THEN 'critical' WHEN p95_peak >= {slo} THEN 'warning' ELSE 'normal' END AS severity"
SLO = 2000.0


@query("forecast_latency_risk", f"""{LAT_SQL}, pk AS (SELECT volume_id, MAX(p50) AS p50_peak, MAX(p90) AS p90_peak, MAX(p95) AS p95_peak FROM lf GROUP BY 1)
SELECT volume_id, {R('p50_peak', 4)} AS p50_peak, {R('p90_peak', 4)} AS p90_peak, {R('p95_peak', 4)} AS p95_peak, {R(f'LEAST(1, p95_peak/{SLO})', 6)} AS risk_score,
  CASE WHEN p95_peak >= 1.5*{SLO} THEN 'critical' WHEN p95_peak >= {SLO} THEN 'warning' ELSE 'normal' END AS severity FROM pk""")
def _(spark, d):
    s = forecast.latency_summary(latency(spark, d), SLO)
    return s.select("volume_id", *r4(s, "p50_peak", "p90_peak", "p95_peak"), rnd(F.col("risk_score"), 6).alias("risk_score"), "severity")


@query("forecast_latency_risk_counts", f"""{LAT_SQL}, pk AS (SELECT volume_id, MAX(p95) AS p95_peak FROM lf GROUP BY 1)
SELECT CASE WHEN p95_peak >= 1.5*{SLO} THEN 'critical' WHEN p95_peak >= {SLO} THEN 'warning' ELSE 'normal' END AS severity, COUNT(*) AS n FROM pk GROUP BY 1""")
def _(spark, d):
    return forecast.severity_counts(forecast.latency_summary(latency(spark, d), SLO))


TTV_SQL = f"""{LAT_SQL}, lg AS (SELECT *, LAG(p95) OVER (PARTITION BY volume_id ORDER BY step) AS prev FROM lf),
tv AS (SELECT volume_id, MIN(CASE WHEN p95 >= {SLO} THEN step END) AS i, MAX(p95) AS top,
  CASE WHEN MIN(CASE WHEN p95 >= {SLO} THEN step END) = 0 THEN 0 ELSE MIN(CASE WHEN p95 >= {SLO} THEN step END) - 1 + ({SLO} - ARG_MIN(prev, step) FILTER (WHERE p95 >= {SLO}))
    / (ARG_MIN(p95, step) FILTER (WHERE p95 >= {SLO}) - ARG_MIN(prev, step) FILTER (WHERE p95 >= {SLO}) + 1e-9) END AS h FROM lg GROUP BY 1),
tw AS (SELECT volume_id, i IS NOT NULL AS will_breach, h AS hours_to_breach, i AS breach_at_step, top AS max_p95_us, {SLO} - top AS headroom_us,
  CASE WHEN h IS NULL THEN 'none' WHEN h < 1 THEN 'critical' WHEN h < 3 THEN 'high' WHEN h < 5 THEN 'medium' ELSE 'low' END AS risk_level FROM tv)"""


def violation(spark, d, arrays=None):
    """Time to violation; ``arrays`` are the latency forecast's where they are known."""
    a = forecast.forecast_arrays(latency(spark, d), ["p95"]) if arrays is None else arrays
    return a.select("volume_id", *[c.alias(n) for n, c in forecast.time_to_violation(F.col("p95"), SLO).items()])


@query("forecast_time_to_violation", f"{TTV_SQL} SELECT volume_id, will_breach, {R('hours_to_breach', 4)} AS hours_to_breach, breach_at_step, {R('max_p95_us', 4)} AS max_p95_us, {R('headroom_us', 4)} AS headroom_us, risk_level FROM tw")
def _(spark, d):
    v = violation(spark, d)
    return v.select("volume_id", "will_breach", *r4(v, "hours_to_breach"), "breach_at_step", *r4(v, "max_p95_us", "headroom_us"), "risk_level")


# --- demand ---------------------------------------------------------------------------

DEMAND_SQL = f"""WITH e AS (SELECT *, total_iops / 2 AS total_throughput_mbps FROM ({E_SQL}) z QUALIFY COUNT(*) OVER (PARTITION BY volume_id) >= 55), {steps_sql(f'({E_SQL}) y', 'ts', 24)}, """ \
    + quant_sql("e", "ts", "total_iops", forecast.DEMAND_PROBS, "di").format(steps="steps") + ", " + quant_sql("e", "ts", "total_throughput_mbps", forecast.DEMAND_PROBS, "dt").format(steps="steps")
DM = ["total_iops", "total_throughput_mbps"]


def demand(spark, d):
    e = events(spark, d).withColumn("total_throughput_mbps", F.col("total_iops") / 2)
    return forecast.demand_forecast(e, forecast.next_hour(e), DM, min_rows=55)


@query("forecast_demand", f"""{DEMAND_SQL} SELECT di.volume_id, di.step, di.forecast_hour, {', '.join(R(f'di.{p}', 4) + f' AS total_iops_{p}' for p in forecast.DEMAND_PROBS)},
  {', '.join(R(f'dt.{p}', 4) + f' AS total_throughput_mbps_{p}' for p in forecast.DEMAND_PROBS)} FROM di JOIN dt ON di.volume_id = dt.volume_id AND di.step = dt.step""")
def _(spark, d):
    f = demand(spark, d)
    return f.select("volume_id", F.col("step").cast("bigint").alias("step"), "forecast_hour", *r4(f, *[f"{m}_{p}" for m in DM for p in forecast.DEMAND_PROBS]))


@query("forecast_demand_peaks", f"""{DEMAND_SQL} SELECT di.volume_id, {R('MAX(di.p99)', 4)} AS peak_total_iops, {R('MAX(dt.p99)', 4)} AS peak_total_throughput_mbps
FROM di JOIN dt ON di.volume_id = dt.volume_id AND di.step = dt.step GROUP BY 1""")
def _(spark, d):
    p = forecast.demand_peaks(demand(spark, d), DM)
    return p.select("volume_id", *r4(p, "peak_total_iops", "peak_total_throughput_mbps"))


def quantile_fit_sql(rows: str, probs: list[float], features: list[str]) -> str:
    """CTEs that fit each (volume_id, metric) of ``rows`` (with y and the features) for each quantile, a step each; the last is ``fit``."""
    n = len(features) + 1
    x = ["1", *features]
    ctes = [f"""qs AS MATERIALIZED (SELECT volume_id, metric, COUNT(*) AS n, AVG(y) AS mean, GREATEST(STDDEV_POP(y), 1e-9 * GREATEST(ABS(AVG(y)), 1)) AS spread FROM {rows} GROUP BY 1, 2),
f0 AS MATERIALIZED (SELECT volume_id, metric, prob, n, spread, mean + spread * SIGN(prob - 0.5) AS b0, {', '.join(f'0.0::DOUBLE AS b{i}' for i in range(1, n))}
  FROM qs, (SELECT UNNEST([{', '.join(f'{p}::DOUBLE' for p in probs)}]) AS prob) p)"""]
    for t, h in enumerate(quantile_regression.bandwidths()):
        fitted = " + ".join(f"b{i}*{v}" for i, v in enumerate(x))
        sums = ", ".join([f"SUM((prob - p)*{v}) AS s{i}" for i, v in enumerate(x)]
                         + [f"SUM(p*(1 - p)/(spread*{h!r}::DOUBLE)*{x[i]}*{x[j]})" + (f" + {quantile_regression.RIDGE!r}::DOUBLE*ANY_VALUE(n)/ANY_VALUE(spread)" if i == j else "") + f" AS h{i}_{j}"
                            for i in range(n) for j in range(i + 1)])
        keep = ", ".join(f"ANY_VALUE(b{i}) AS b{i}" for i in range(n))
        system = f"""SELECT volume_id, metric, prob, ANY_VALUE(n) AS n, ANY_VALUE(spread) AS spread, {keep}, {sums}
  FROM (SELECT f.*, {', '.join(f'r.{v}' for v in features)}, 1/(1 + EXP(LEAST(700, (r.y - ({fitted}))/(spread*{h!r}::DOUBLE)))) AS p FROM {rows} r JOIN f{t} f USING (volume_id, metric)) w GROUP BY 1, 2, 3"""
        biggest = "GREATEST(" + ", ".join(f"ABS(x{i})" for i in range(n)) + ")"
        moved = ", ".join(f"b{i} + x{i}*LEAST(1, spread/{biggest}) AS b{i}" for i in range(n))
        ctes.append(f"f{t + 1} AS MATERIALIZED (SELECT volume_id, metric, prob, n, spread, {moved} FROM ({solve_sql(system, n, 's', 'x')}) q)")
    return ",\n".join(ctes) + f", fit AS (SELECT * FROM f{quantile_regression.STEPS})"


CAL_SQL = """SIN(2*PI()*HOUR({t})/24) AS hour_sin, COS(2*PI()*HOUR({t})/24) AS hour_cos, SIN(2*PI()*(ISODOW({t}) - 1)/7) AS day_sin, COS(2*PI()*(ISODOW({t}) - 1)/7) AS day_cos"""
DEMAND_FIT_SQL = f"""WITH e AS (SELECT *, total_iops / 2 AS total_throughput_mbps FROM ({E_SQL}) z QUALIFY COUNT(*) OVER (PARTITION BY volume_id) >= 55), {steps_sql(f'({E_SQL}) y', 'ts', 24)},
c AS (SELECT volume_id, total_iops, total_throughput_mbps, {CAL_SQL.format(t='ts')} FROM e),
lr AS MATERIALIZED (SELECT volume_id, {', '.join(quantile_regression.CALENDAR)}, UNNEST(['total_iops', 'total_throughput_mbps']) AS metric, UNNEST([total_iops, total_throughput_mbps]) AS y FROM c),
{quantile_fit_sql('lr', list(forecast.DEMAND_PROBS.values()), quantile_regression.CALENDAR)}"""


def demand_rows(spark, d):
    e = events(spark, d).withColumn("total_throughput_mbps", F.col("total_iops") / 2)
    return e, quantile_regression.fit_quantiles(quantile_regression.with_calendar(e, "ts"), DM, list(forecast.DEMAND_PROBS.values()),
                                                quantile_regression.CALENDAR, min_rows=55)


@query("forecast_demand_coefficients", f"""{DEMAND_FIT_SQL} SELECT volume_id, metric, prob, n, {', '.join(R(f'b{i}', 3) + f' AS {b}' for i, b in enumerate(quantile_regression.coefficient_names(quantile_regression.CALENDAR)))} FROM fit""")
def _(spark, d):
    _, fits = demand_rows(spark, d)
    return fits.select("volume_id", "metric", "prob", "n", *r4(fits, *quantile_regression.coefficient_names(quantile_regression.CALENDAR), n=3))


_TOLD = " + ".join(f"b{i}*{v}" for i, v in enumerate(["1", *quantile_regression.CALENDAR]))
_SORTED = ", ".join(R(f"GREATEST(LIST_SORT([MAX(v) FILTER (WHERE metric = '{m}' AND prob = 0.5), MAX(v) FILTER (WHERE metric = '{m}' AND prob = 0.95), MAX(v) FILTER (WHERE metric = '{m}' AND prob = 0.99)])[{i + 1}], 0)", 3) + f" AS {m}_{p}"
                    for m in DM for i, p in enumerate(forecast.DEMAND_PROBS))


@query("forecast_demand_regression", f"""{DEMAND_FIT_SQL}, g AS (SELECT step, h, {CAL_SQL.format(t='h')} FROM steps),
tv AS (SELECT volume_id, step, h, metric, prob, {_TOLD} AS v FROM g, fit)
SELECT volume_id, step, h AS forecast_hour, {_SORTED} FROM tv GROUP BY 1, 2, 3""")
def _(spark, d):
    e, fits = demand_rows(spark, d)
    f = forecast.demand_regression(e, forecast.next_hour(e), DM, fits=fits)
    return f.select("volume_id", F.col("step").cast("bigint").alias("step"), "forecast_hour", *r4(f, *[f"{m}_{p}" for m in DM for p in forecast.DEMAND_PROBS], n=3))


# --- scenarios ------------------------------------------------------------------------

WIF_SQL = f"""{WC}, {TREND_SQL}, sc AS (SELECT fc.*, g AS added_gb, total_gb/(total_gb+g) AS f FROM fc, (VALUES (500.0::DOUBLE), (1000.0::DOUBLE)) q(g)),
ca AS (SELECT (volume_id, added_gb) AS key, current_pct, k, v FROM sc), cb AS (SELECT (volume_id, added_gb) AS key, current_pct*f AS current_pct, k, LEAST(1, GREATEST(0, v*f)) AS v FROM sc),
{dtf_sql('ca', 0.85, 'wa')}, {dtf_sql('cb', 0.85, 'wb')}, {dtf_sql('ca', 0.95, 'xa')}, {dtf_sql('cb', 0.95, 'xb')}"""


@query("whatif_add_capacity", f"""{WIF_SQL} SELECT s.volume_id, s.added_gb, {R('f', 6)} AS scaling_factor, {R('wa.d', 4)} AS dtf_warning_before, {R('wb.d', 4)} AS dtf_warning_after,
  {R('xa.d', 4)} AS dtf_critical_before, {R('xb.d', 4)} AS dtf_critical_after, {R('COALESCE(wb.d - wa.d, 0)', 4)} AS improvement_days
FROM (SELECT DISTINCT volume_id, added_gb, f FROM sc) s JOIN wa ON wa.key = (s.volume_id, s.added_gb) JOIN wb ON wb.key = wa.key JOIN xa ON xa.key = wa.key JOIN xb ON xb.key = wa.key""")
def _(spark, d):
    w = whatif.add_capacity(forecast.capacity_forecast(recent(spark, d)), [500, 1000])
    return w.select("volume_id", "added_gb", rnd(F.col("scaling_factor"), 6).alias("scaling_factor"),
                    *r4(w, "dtf_warning_before", "dtf_warning_after", "dtf_critical_before", "dtf_critical_after", "improvement_days"))


@query("whatif_migrations", f"""{WT}, {LATEST_SQL}, {UTIL}, c AS ({CAP_SQL}), lc AS (SELECT volume_id, capacity_used_gb FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY volume_id ORDER BY ts DESC) = 1),
q AS (SELECT event_id, user_id AS volume_id, event_id % 25 AS target_node FROM events WHERE event_type = 'click')
SELECT q.event_id, l.volume_id, l.node_id AS source_node, q.target_node, l.node_id <> q.target_node AND ut.total_iops + l.total_iops < 30000 AS safe,
  {R('l.total_iops/30000*100', 4)} AS target_increase_pct, FLOOR(capacity_used_gb*1024/50)::BIGINT AS transfer_seconds
FROM q JOIN l ON q.volume_id = l.volume_id JOIN ut ON ut.node_id = q.target_node LEFT JOIN lc ON lc.volume_id = l.volume_id""")
def _(spark, d):
    asked = table(spark, d, "events").where("event_type = 'click'").select(
        "event_id", F.col("user_id").alias("volume_id"), (F.col("event_id") % 25).alias("target_node"))
    live = latest_rows(telemetry(spark, d)).select("volume_id", "node_id", "total_iops")
    used = latest_rows(capacity(spark, d)).select("volume_id", "capacity_used_gb")
    m = whatif.migrations(asked, live.join(used, "volume_id", "left"), utilization(spark, d))
    return m.select("event_id", "volume_id", "source_node", "target_node", "safe", *r4(m, "target_increase_pct"), "transfer_seconds")


@query("whatif_iops_caps", f"""{WT}, {LATEST_SQL} SELECT volume_id, cap AS iops_limit, total_iops AS current_iops, {R('GREATEST(0, (total_iops-cap)/total_iops)*100', 4)} AS throttling_pct,
  {R('GREATEST(0, (total_iops-cap)/total_iops)*30', 4)} AS neighbor_relief_pct FROM l, (VALUES (10.0::DOUBLE), (30.0::DOUBLE), (3000.0::DOUBLE)) q(cap)""")
def _(spark, d):
    c = whatif.iops_caps(latest_rows(telemetry(spark, d)), [10, 30, 3000])
    return c.select("volume_id", "iops_limit", "current_iops", *r4(c, "throttling_pct", "neighbor_relief_pct"))


@query("whatif_tier_changes", f"""{WT}, {LATEST_SQL} SELECT volume_id, tier AS current_tier, n AS new_tier,
  CASE WHEN tier = n THEN 0 WHEN tier = 'HDD' AND n = 'SSD' THEN 80 WHEN tier = 'HDD' AND n = 'NVMe' THEN 95 WHEN tier = 'SSD' AND n = 'NVMe' THEN 50 ELSE -100 END AS latency_improvement_pct,
  CASE WHEN tier = n THEN 1 WHEN tier = 'HDD' AND n = 'SSD' THEN 5 WHEN tier = 'HDD' AND n = 'NVMe' THEN 15 WHEN tier = 'SSD' AND n = 'NVMe' THEN 3 ELSE 0.2 END AS throughput_factor
FROM l, (VALUES ('NVMe'), ('SSD'), ('HDD')) q(n)""")
def _(spark, d):
    return whatif.tier_changes(place(spark, d), ["NVMe", "SSD", "HDD"])
