"""Time expressions that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_seconds(ts: str) -> Column:
    return F.expr(f"timestampdiff(SECOND, {EPOCH}, `{ts}`)")


def epoch_micros(ts: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, `{ts}`)")


def from_epoch_seconds(seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, F.expr(EPOCH))


def floor_hour(ts: str) -> Column:
    return from_epoch_seconds(F.floor(epoch_seconds(ts) / 3600) * 3600)


def round_hour(ts: str) -> Column:
    """Nearest hour; a half hour goes to the even hour."""
    return from_epoch_seconds((F.bround(epoch_micros(ts) / 3.6e9) * 3600).cast("long"))


def day_start(ts: str) -> Column:
    return F.col(ts).cast("date").cast("timestamp_ntz")


def elapsed_minutes(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / 60e6


def calendar_parts(ts: str) -> dict[str, Column]:
    """hour, Monday-based weekday, weekend flag, day of month, cyclic forms."""
    t = F.col(ts)
    hour, dow = F.hour(t), F.weekday(t)
    two_pi = 2 * 3.141592653589793
    return {
        "hour": hour,
        "day_of_week": dow,
        "is_weekend": (dow >= 5).cast("int"),
        "day_of_month": F.dayofmonth(t),
        "hour_sin": F.sin(F.lit(two_pi) * hour / 24),
        "hour_cos": F.cos(F.lit(two_pi) * hour / 24),
        "day_sin": F.sin(F.lit(two_pi) * dow / 7),
        "day_cos": F.cos(F.lit(two_pi) * dow / 7),
    }
