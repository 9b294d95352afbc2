"""Top-k, urgency and category orders, band samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.frames import global_running
from tidewatch.operators.splits import with_key_bucket


def top(df: DataFrame, k: int, by: str, ties: list[str]) -> DataFrame:
    """The ``k`` largest; every task keeps only its own ``k``."""
    return df.orderBy(F.col(by).desc(), *ties).limit(k)


def by_urgency(df: DataFrame, days: str, ties: list[str]) -> DataFrame:
    """Fewest days first, unknown last."""
    return df.orderBy(F.col(days).asc_nulls_last(), *ties)


def category_rank(column: str, order: list[str]) -> Column:
    rank = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        rank = F.when(F.col(column) == name, i).otherwise(rank)
    return rank


def by_category(df: DataFrame, column: str, order: list[str], ties: list[str]) -> DataFrame:
    return df.orderBy(category_rank(column, order), *ties)


def first_per(df: DataFrame, category: str, order: list[str]) -> DataFrame:
    """The first row per category by ``order``; combined map-side."""
    rest = [c for c in df.columns if c != category and c not in order]
    first = df.groupBy(category).agg(F.min(F.struct(*order, *rest)).alias("_r"))
    return first.select(category, "_r.*")


def high_middle_low(df: DataFrame, value: str, key: str, each: int = 2) -> DataFrame:
    """Largest, middle and smallest ``each`` rows by ``value``, marked with ``band``; NULL and NaN values are in none."""
    df = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    minus = df.withColumn("_down", -F.col(value)).withColumn("_one", F.lit(1))
    minus = with_key_bucket(minus, "_down", "_range")
    ranked = global_running(minus, {"_one": "_i"}, ["_down", key], F.col("_range"))
    ranked = ranked.withColumn("_n", df.agg(F.count(F.lit(1))).scalar())
    n, i = F.col("_n"), F.col("_i")
    mid = F.floor(n / 2) - F.lit(each // 2)
    band = F.when(i <= each, "high").when(i > n - each, "low").when((i > mid) & (i <= mid + each), "middle")
    return ranked.withColumn("band", band).where("band IS NOT NULL").select(*df.columns, "band")
