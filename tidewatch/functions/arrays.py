"""Array and map expressions over short forecasts and windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_index_at_least(values: Column, threshold) -> Column:
    """0-based index of the first value >= threshold, -1 if none."""
    return (F.array_position(F.transform(values, lambda x: x >= threshold), True) - 1).cast("bigint")


def steps(values: Column) -> Column:
    """Differences between neighbours; one element shorter."""
    n = F.size(values)
    return F.zip_with(F.slice(values, 2, F.greatest(n - 1, F.lit(0))), F.slice(values, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b - a)


def last_n(values: Column, n: int) -> Column:
    """The last ``n`` values, all of them if there are fewer."""
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), n)


def median(values: Column) -> Column:
    """Median of an array, NULL if empty."""
    s, n = F.sort_array(values), F.size(values)
    low = F.get(s, F.floor((n - 1) / 2).cast("int"))
    high = F.get(s, F.floor(n / 2).cast("int"))
    return (low + high) / 2


def argmax(values: Column) -> Column:
    """0-based index of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("bigint")


def map_total(m: Column) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x)
