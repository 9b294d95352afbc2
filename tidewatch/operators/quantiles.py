"""Exact quantiles without collecting a group.

``percentile`` keeps every distinct value of a group in one buffer. Here equal
values are counted first, map-side combined. A monotone code puts the values of a
group into ranges (about a hundred-thousandth of their size wide, so their number
follows the values' magnitude, not the rows). Prefix sums over the ranges say which
of them hold a wanted rank, and only the distinct values of those are ranked. The
result is the exact quantile with linear interpolation; NULL groups are groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SKETCH_ACCURACY = 10_000
#: Ranges per e-fold of a value, and the size below which values share ranges.
RANGES, SMALLEST = 65_536, 2.0 ** -20
#: Ranges per e-fold where the rows are read twice: few enough to be counted in a task.
RESCAN_RANGES = 1024


def same(left: str, right: str, names: list[str]) -> Column:
    """NULL-safe equality of the columns ``names`` of two aliased tables."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names])


def value_range(value: str, ranges: int = RANGES) -> Column:
    """A whole number that does not decrease with ``value``."""
    size = F.log1p(F.least(F.abs(value), F.lit(1e300)) / F.lit(SMALLEST))
    return F.floor(F.signum(value) * size * ranges)


def quantile_rows(df: DataFrame, by: list[str], value: str, probs: list[float],
                  method: str = "exact", rescan: bool = False) -> DataFrame:
    """One row per group and probability: ``(*by, prob, quantile)``.

    ``rescan`` is for few groups of rows that are cheap to read again (staged ones): the
    first reading only counts the ranges, and no value is shuffled but those of the ranges
    that hold a rank.
    """
    vals = df.select(*by, F.col(value).cast("double").alias("_v")).where(
        F.col("_v").isNotNull() & ~F.isnan("_v"))
    if method == "approx":
        est = vals.groupBy(*by).agg(
            F.approx_percentile("_v", list(probs), SKETCH_ACCURACY).alias("_q"))
        return est.select(*by, F.explode(F.arrays_zip(
            F.array(*[F.lit(float(p)) for p in probs]).alias("prob"),
            F.col("_q").alias("quantile"))).alias("_e")).select(*by, "_e.prob", "_e.quantile")
    # -0.0 and 0.0 are one value
    one = vals.select(*by, (F.col("_v") + F.lit(0.0)).alias("_v"))
    if rescan:
        one = one.withColumn("_r", value_range("_v", RESCAN_RANGES))
        ranges = one.groupBy(*by, "_r").agg(F.count(F.lit(1)).alias("_c"))
    else:
        counted = one.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c")).withColumn("_r", value_range("_v"))
        ranges = counted.groupBy(*by, "_r").agg(F.sum("_c").alias("_c"))
    upto = W.partitionBy(*by).orderBy("_r").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranges = ranges.withColumns({"_end": F.sum("_c").over(upto), "_n": F.sum("_c").over(W.partitionBy(*by))})
    positions = [F.lit(float(p)) * (F.col("_n") - 1) for p in probs]
    holds = F.lit(False)
    for pos in positions:
        for rank in (F.floor(pos), F.ceil(pos)):
            holds = holds | ((F.col("_end") > rank) & (F.col("_end") - F.col("_c") <= rank))
    chosen = ranges.where(holds).select(*by, "_r", "_n", (F.col("_end") - F.col("_c")).alias("_before"))
    if rescan:
        held = one.alias("x").join(F.broadcast(chosen).alias("y"), same("x", "y", [*by, "_r"]), "left_semi")
        counted = held.groupBy(*by, "_r", "_v").agg(F.count(F.lit(1)).alias("_c"))
    near = counted.alias("x").join(chosen.alias("y"), same("x", "y", [*by, "_r"])).select(
        *[F.col(f"x.{c}").alias(c) for c in by], "x._r", "x._v", "x._c", "y._n", "y._before")
    within = W.partitionBy(*by, "_r").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    near = near.withColumn("_cum", F.col("_before") + F.sum("_c").over(within))

    def at_rank(rank: Column) -> Column:
        return F.min(F.when(F.col("_cum") > rank, F.struct("_cum", "_v")))

    aggs = []
    for i, pos in enumerate(positions):
        aggs += [at_rank(F.floor(pos)).alias(f"_a{i}"), at_rank(F.ceil(pos)).alias(f"_z{i}")]
    picked = near.groupBy(*by, "_n").agg(*aggs)

    def interpolated(i: int) -> Column:
        a, z = F.col(f"_a{i}._v"), F.col(f"_z{i}._v")
        return a + (z - a) * (positions[i] - F.floor(positions[i]))

    return picked.select(*by, F.explode(F.array(*[
        F.struct(F.lit(float(p)).alias("prob"), interpolated(i).alias("quantile"))
        for i, p in enumerate(probs)])).alias("_e")).select(*by, "_e.*")


def quantile_table(df: DataFrame, columns: list[str], probs: dict[str, float], by: list[str] | None = None,
                   method: str = "exact", rescan: bool = False) -> DataFrame:
    """One row per group and column: ``(*by, metric, <name per probability>)``."""
    by = by or []
    long = df.select(
        *by, F.explode(F.array(*[
            F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
            for c in columns])).alias("_m")).select(*by, "_m.metric", "_m.value")
    rows = quantile_rows(long, [*by, "metric"], "value", list(probs.values()), method, rescan)
    return rows.groupBy(*by, "metric").agg(*[
        F.max(F.when(F.col("prob") == float(p), F.col("quantile"))).alias(n) for n, p in probs.items()])


def quantile_struct(df: DataFrame, column: str, probs: dict[str, float], method: str = "exact", rescan: bool = False) -> Column:
    """Quantiles of a whole column as one scalar struct column."""
    rows = quantile_rows(df, [], column, list(probs.values()), method, rescan)
    one = rows.agg(*[
        F.max(F.when(F.col("prob") == float(p), F.col("quantile"))).alias(n) for n, p in probs.items()])
    return one.select(F.struct(*probs).alias("q")).scalar()
