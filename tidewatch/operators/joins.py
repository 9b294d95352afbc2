"""Joins along time and between detector results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.times import epoch_seconds
from tidewatch.operators.frames import forward_fill, has_hot_entity
from tidewatch.operators.windows import latest_rows, trailing_arrays
from tidewatch.roles import DEFAULT_ROLES, Roles


def join_flags(rows: DataFrame, results: DataFrame, flag: str, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Left-join a detector's flag by (entity, time); no result means False."""
    flags = results.select(roles.entity, roles.ts, flag)
    return rows.join(flags, [roles.entity, roles.ts], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def exact_or_latest(requests: DataFrame, history: DataFrame, columns: list[str],
                    roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """The row at the asked time, else the entity's newest row.

    Both sides are one row per key before the joins, so a hot entity only
    repeats on the request side.
    """
    row = F.struct(*roles.ties, *columns)
    exact = history.groupBy(roles.entity, roles.ts).agg(F.max(row).alias("_exact"))
    newest = latest_rows(history, roles, columns).select(roles.entity, row.alias("_newest"))
    out = requests.join(exact, [roles.entity, roles.ts], "left").join(newest, roles.entity, "left")
    picked = F.coalesce("_exact", "_newest")
    return out.select(*requests.columns, F.col("_exact").isNotNull().alias("is_exact"),
                      *[picked[c].alias(c) for c in columns])


def history_before(requests: DataFrame, history: DataFrame, key: str, columns: list[str], steps: int,
                   roles: Roles = DEFAULT_ROLES, **kw) -> DataFrame:
    """For each request the last ``steps`` rows at or before its time.

    Rather than a range join, each history row carries its own last ``steps``
    rows, requests are merged into the timeline, and the newest history row
    before each request is carried onto it.
    """
    kw.setdefault("hot", has_hot_entity(
        history.select(roles.entity).unionByName(requests.select(roles.entity)), roles, kw.get("rows_per_task")))
    seq = trailing_arrays(history, columns, roles, steps, **kw)
    line = seq.select(
        roles.entity, roles.ts, F.lit(0).alias("_kind"), *[F.col(t).alias(f"_t_{t}") for t in roles.ties],
        F.lit(None).cast(dict(requests.dtypes)[key]).alias(key), "sequence",
    ).unionByName(requests.select(
        roles.entity, roles.ts, F.lit(1).alias("_kind"),
        *[F.lit(None).cast(dict(history.dtypes)[t]).alias(f"_t_{t}") for t in roles.ties], key,
        F.lit(None).cast(seq.schema["sequence"].dataType).alias("sequence")))
    order = Roles(roles.entity, roles.ts, roles.group, ("_kind", *[f"_t_{t}" for t in roles.ties]))
    out = forward_fill(line, {"sequence": "history"}, order, **kw)
    return out.where("_kind = 1").select(key, roles.entity, roles.ts, "history")


def within_after(actions: DataFrame, samples: DataFrame, seconds: int, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Samples of the same entity from the action's time to ``seconds`` later.

    Time is cut into buckets of ``seconds``: an action meets two buckets, so the
    join is on (entity, bucket) and a hot entity is spread over its buckets.
    """
    at = f"{roles.ts}_action"
    bucket = F.floor(epoch_seconds(roles.ts) / seconds)
    left = actions.withColumn("_b", F.explode(F.array(bucket, bucket + 1))).withColumnRenamed(roles.ts, at)
    right = samples.withColumn("_b", bucket)
    end = F.col(at) + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))
    return left.join(right, [roles.entity, "_b"]).where(
        (F.col(roles.ts) >= F.col(at)) & (F.col(roles.ts) <= end)).drop("_b")
