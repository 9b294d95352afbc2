"""Quantile regression of many entities at once, by grouped sums.

For each entity, metric and quantile a linear model of the row's features is fitted to
the smoothed quantile loss ``q r + h log(1 + exp(-r / h))`` of the residual ``r``; the
bandwidth ``h`` falls from the metric's deviation to ``SMOOTHING`` of it, one Newton step
each. A step needs the gradient and the Hessian: 20 sums for five coefficients, combined
map-side, whatever the number of rows, and a system solved inside a row.

Every pass reads the staged rows and the coefficients of the pass before. Entities over
``rows_per_task`` rows are dealt to several parts, each joined to its own copy of the
coefficients, so that a hot entity is no task's; whether coefficients are broadcast is
left to their size. Rows without a time or a metric's value are not used for that
metric; an entity that saw one hour only, or one value, is kept solvable by a small ridge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.linear import solve_symmetric
from tidewatch.functions.times import calendar_parts
from tidewatch.operators.frames import ROWS_PER_TASK
from tidewatch.session import stage

#: Cyclic forms of the hour and the weekday.
CALENDAR = ["hour_sin", "hour_cos", "day_sin", "day_cos"]
STEPS, FALL, SMOOTHING, RIDGE = 18, 0.75, 0.05, 1e-3


def bandwidths(steps: int = STEPS) -> list[float]:
    """Bandwidth of each step, in deviations of the metric."""
    h = [1.0]
    while len(h) < steps:
        h.append(max(SMOOTHING, h[-1] * FALL))
    return h


def coefficient_names(features: list[str]) -> list[str]:
    return ["b_intercept", *[f"b_{f}" for f in features]]


def _long(df: DataFrame, metrics: list[str], features: list[str], entity: str) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("y")) for m in metrics]))
    long = df.select(entity, *features, pairs.alias("p")).select(entity, *features, "p.*")
    return long.dropna(subset=[entity, "y", *features])


def fit_quantiles(df: DataFrame, metrics: list[str], probs: list[float], features: list[str], entity: str = "volume_id",
                  min_rows: int = 10, steps: int = STEPS, rows_per_task: int | None = None) -> DataFrame:
    """``(entity, metric, prob, n, spread, b_intercept, b_<feature> ..)`` of each fit; entities under ``min_rows`` have none.

    ``n`` rows were used; ``spread`` is the metric's deviation, to which the smoothing is relative.
    """
    size = rows_per_task or ROWS_PER_TASK
    rows = _long(df, metrics, features, entity)
    spread = F.greatest(F.stddev_pop("y"), F.lit(1e-9) * F.greatest(F.abs(F.avg("y")), F.lit(1.0)))
    stats = rows.groupBy(entity, "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), spread.alias("spread")).where(F.col("n") >= min_rows)
    stats = stage(stats.withColumn("parts", F.ceil(F.col("n") / size)), "quantile-stats")
    dealt = F.pmod(F.xxhash64("y", *features), F.col("parts"))
    rows = stage(rows.join(stats.select(entity, "metric", "parts"), [entity, "metric"]).withColumn("part", dealt).drop("parts"), "quantile-rows")

    names = coefficient_names(features)
    fits = stats.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    fits = fits.withColumns({names[0]: F.col("mean") + F.col("spread") * F.signum(F.col("prob") - 0.5), **{name: F.lit(0.0) for name in names[1:]}})
    keys, carried = [entity, "metric", "prob"], ["n", "spread", "parts", *names]
    x = ["1.0D", *[f"`{f}`" for f in features]]
    n, b = len(x), [f"`{name}`" for name in names]
    # share of the loss's slope: 1 far below the fit, 0 far above it
    below = f"1 / (1 + exp((y - ({' + '.join(f'{c}*{v}' for c, v in zip(b, x))})) / (spread*h)))"
    sums = [f"sum((prob - _p)*{x[i]}) AS _s{i}" for i in range(n)]
    sums += [f"sum(_p*(1 - _p)/(spread*h)*{x[i]}*{x[j]})" + (f" + {RIDGE!r}D*first(n)/first(spread)" if i == j else "") + f" AS _h{i}_{j}" for i in range(n) for j in range(i + 1)]
    first = [f"first(`{c}`) AS `{c}`" for c in [*carried, "h"]]
    step = [f"_x{i}" for i in range(n)]
    # no step moves a coefficient by more than the deviation
    limit = f"least(1.0D, try_divide(spread, greatest({', '.join(f'abs({s})' for s in step)})))"
    moved = [f"{c} + {s}*{limit} AS {c}" for c, s in zip(b, step)]
    # the bandwidth is data, so that every pass runs the same compiled code
    fits = fits.withColumn("h", F.lit(1.0))
    for _ in range(steps):
        copies = fits.selectExpr(*[f"`{c}`" for c in [*keys, *carried]], "h", "explode(sequence(0L, parts - 1)) AS part")
        weighed = rows.join(copies, [entity, "metric", "part"]).selectExpr("*", f"{below} AS _p")
        system = weighed.groupBy(*keys).agg(*map(F.expr, [*first, *sums]))
        solved = solve_symmetric(system, [[f"_h{i}_{j}" for j in range(i + 1)] for i in range(n)], [f"_s{i}" for i in range(n)], step)
        fits = stage(solved.selectExpr(*[f"`{k}`" for k in keys], "n", "spread", "parts", f"greatest({SMOOTHING}D, h*{FALL}D) AS h", *moved), "quantile-fits")
    return fits.drop("parts", "h")


def predict_quantiles(grid: DataFrame, fits: DataFrame, features: list[str], entity: str = "volume_id") -> DataFrame:
    """The grid's rows with ``(metric, prob, value)`` of each fit of their entity."""
    value = sum((F.col(b) * F.col(f) for b, f in zip(coefficient_names(features)[1:], features)), F.col("b_intercept"))
    return grid.join(fits, entity).select(*[grid[c] for c in grid.columns], "metric", "prob", value.alias("value"))


def smoothed_loss(df: DataFrame, fits: DataFrame, metrics: list[str], features: list[str], entity: str = "volume_id") -> DataFrame:
    """``(entity, metric, prob, loss)``: mean quantile loss of the fits over the rows, not smoothed."""
    rows = predict_quantiles(_long(df, metrics, features, entity).withColumnRenamed("metric", "_metric"), fits, features, entity).where("metric = _metric")
    e = F.col("y") - F.col("value")
    return rows.groupBy(entity, "metric", "prob").agg(F.avg(F.greatest((F.col("prob") - 1) * e, F.col("prob") * e)).alias("loss"))


def with_calendar(df: DataFrame, ts: str) -> DataFrame:
    """The rows with the cyclic calendar features of a time column."""
    parts = calendar_parts(ts)
    return df.withColumns({c: parts[c] for c in CALENDAR})
