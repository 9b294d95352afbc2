"""Unions and unpivots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.roles import DEFAULT_ROLES, Roles


def history_and_live(history: DataFrame, live: DataFrame, live_wins: bool = False,
                     roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """History and live rows over their shared columns.

    With ``live_wins`` a live row replaces the history row of the same entity
    and time; without it both stay.
    """
    common = [c for c in history.columns if c in live.columns]
    both = history.select(*common, F.lit(0).alias("_live")).unionByName(live.select(*common, F.lit(1).alias("_live")))
    if not live_wins:
        return both.drop("_live")
    key = [roles.entity, *roles.order]
    rest = [c for c in common if c not in key]
    best = both.groupBy(*key).agg(F.max(F.struct("_live", *rest)).alias("_r"))
    return best.select(*key, *[F.col(f"_r.{c}") for c in rest]).select(*common)


def splits(df: DataFrame, names: list[str], column: str = "split") -> DataFrame:
    """Rows of several splits; on a split table only those directories are read."""
    return df.where(F.col(column).isin(*names))


def unpivot(df: DataFrame, keys: list[str], columns: list[str], name: str = "score_type", value: str = "score") -> DataFrame:
    return df.unpivot(keys, columns, name, value)


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Union of rule results that share a schema."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
