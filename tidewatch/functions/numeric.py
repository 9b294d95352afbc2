"""Numeric column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int) -> Column:
    """Round to ``digits`` places; ties go up.

    Decimal-half-up, half-even and binary rounding differ between engines on
    ties. ``floor(x * 10^n + 0.5)`` is the same IEEE arithmetic everywhere; the
    tiny extra keeps a tie from flipping on the last bit of a sum.
    """
    scale = float(10**digits)
    return F.when(x.isNotNull() & ~F.isnan(x.cast("double")),
                  F.floor(x * scale + 0.500001) / F.lit(scale))


def clip(x: Column, low, high) -> Column:
    """Bound ``x``; NULL and NaN stay (``greatest``/``least`` would drop a NULL)."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(F.isnan(x.cast("double")), x).when(x < low, low).when(x > high, high).otherwise(x)


def finite(x: Column) -> Column:
    """``x`` if it is a finite number, else NULL."""
    d = x.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def capacity_fraction(x: Column) -> Column:
    """One value on either scale (0-1 or 0-100) as a fraction."""
    return F.when(x < 0, 0.0).when(x <= 1, x).when(x <= 100, x / 100).when(x > 100, 1.0)


def severity(score: Column) -> Column:
    return (
        F.when(score < 40, "normal").when(score < 60, "warning")
        .when(score < 80, "high").otherwise("critical")
    )


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` with 0 where the denominator is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))
