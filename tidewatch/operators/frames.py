"""Time-ordered windows that survive a hot entity.

A window partitioned by the entity puts all rows of that entity into one task.
With one entity holding a third of the table that task never ends. So an entity
with more than ``rows_per_task`` rows is cut along time into chunks:

* rows are counted per (entity, time bucket), combined map-side;
* whole buckets are joined into chunks of about ``rows_per_task`` rows;
* a frame that looks back (or ahead) N rows needs the last N rows before (the
  first N rows after) its chunk: the buckets holding them are copied into the
  chunk as a halo and dropped again after the window ran.

Frames without a bound (running totals, forward fill) work per chunk and take
the totals of the earlier chunks from one small row per chunk.

Tables without a hot entity skip all of this and get the plain window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from tidewatch.functions.times import epoch_seconds
from tidewatch.operators.quantiles import same
from tidewatch.roles import DEFAULT_ROLES, Roles
from tidewatch.session import compiled

ROWS_PER_TASK = 2_000_000
BUCKET_SECONDS = 60
#: Rows of all its entities together that a task of a wide window should sort.
TASK_ROWS = 1 << 18
#: Rows that are worth a task.
LEAST_ROWS = 1 << 14

CHUNK, HALO, BUCKET = "_chunk", "_halo", "_bucket"


@dataclass(frozen=True)
class Framed:
    """A table ready for windows: partition by ``keys``, then ``finish``."""

    df: DataFrame
    roles: Roles
    split: bool

    @property
    def keys(self) -> list[str]:
        return [self.roles.entity, CHUNK] if self.split else [self.roles.entity]

    def window(self) -> WindowSpec:
        return W.partitionBy(*self.keys).orderBy(*self.roles.order)

    def finish(self, df: DataFrame) -> DataFrame:
        if not self.split:
            return df
        return df.where(~F.col(HALO)).drop(CHUNK, HALO)


def _chunk_table(df: DataFrame, roles: Roles, back: int, ahead: int,
                 rows: int, bucket_seconds: int) -> DataFrame:
    """(entity, bucket) -> chunks the bucket belongs to, hot entities only."""
    entity = roles.entity
    by_time = W.partitionBy(entity).orderBy(BUCKET)
    counts = (
        df.select(entity, F.floor(epoch_seconds(roles.ts) / bucket_seconds).alias(BUCKET))
        .groupBy(entity, BUCKET).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("total", F.sum("n").over(W.partitionBy(entity)))
        .where(F.col("total") > rows)
        .withColumn("end", F.sum("n").over(by_time))
        .withColumn("start", F.col("end") - F.col("n"))
        .withColumn("chunk", F.floor(F.col("start") / rows))
    )
    # A chunk that starts after this bucket begins at row `end`; one that ends
    # before this bucket ends at row `start`.
    marked = counts.withColumn(
        "next_chunk",
        F.when(F.lead("chunk").over(by_time) != F.col("chunk"), F.lead("chunk").over(by_time)),
    ).withColumn(
        "prev_chunk",
        F.when(F.lag("chunk").over(by_time) != F.col("chunk"), F.lag("chunk").over(by_time)),
    )
    none = F.array().cast("array<bigint>")
    # Chunks that begin less than `back` rows after this bucket ends.
    later = (
        F.collect_list("next_chunk").over(
            W.partitionBy(entity).orderBy("end").rangeBetween(0, back - 1))
        if back > 0 else none
    )
    # Chunks that end less than `ahead` rows before this bucket starts.
    earlier = (
        F.collect_list("prev_chunk").over(
            W.partitionBy(entity).orderBy("start").rangeBetween(-(ahead - 1), 0))
        if ahead > 0 else none
    )
    halo = F.array_distinct(F.concat(later, earlier))
    return marked.select(
        entity, BUCKET,
        F.concat(
            F.array(F.struct(F.col("chunk").alias(CHUNK), F.lit(False).alias(HALO))),
            F.transform(halo, lambda c: F.struct(c.alias(CHUNK), F.lit(True).alias(HALO))),
        ).alias("_copies"),
    )


def has_hot_entity(df: DataFrame, roles: Roles = DEFAULT_ROLES, rows_per_task: int | None = None) -> bool:
    """Whether any entity has more rows than one task should hold.

    One small job: entity counts, combined map-side. A table with at least as
    many rows per entity (say, before duplicates are dropped) may stand in.
    """
    counts = df.groupBy(roles.entity).agg(F.count(F.lit(1)).alias("n"))
    return not counts.where(F.col("n") > (rows_per_task or ROWS_PER_TASK)).isEmpty()


def spread(df: DataFrame, rows: int, roles: Roles = DEFAULT_ROLES, by: list[str] | None = None) -> DataFrame:
    """Deal entities to so many tasks that each has about ``TASK_ROWS`` of the ``rows`` rows.

    The number of a session's shuffle partitions does not follow the table, and small ones are
    joined by bytes, however many rows these are: the sorts of a task would grow with the table.
    ``by`` deals by other columns than the entity alone. With fewer tasks than a shuffle has, a
    join would deal the rows again: they are made as many where each still has ``LEAST_ROWS``.
    """
    spark = df.sparkSession
    tasks = max(-(-rows // TASK_ROWS), spark.sparkContext.defaultParallelism, min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // LEAST_ROWS))
    return df.repartition(tasks, *(by or [roles.entity]))


def framed(df: DataFrame, roles: Roles = DEFAULT_ROLES, back: int = 0, ahead: int = 0,
           rows_per_task: int | None = None, bucket_seconds: int = BUCKET_SECONDS,
           hot: bool | None = None) -> Framed:
    """Prepare ``df`` for windows that look ``back``/``ahead`` that many rows.

    ``hot`` passes on the answer of :func:`has_hot_entity` when it is known;
    otherwise it is asked here.
    """
    compiled(df.sparkSession)
    rows = rows_per_task or ROWS_PER_TASK
    if not (has_hot_entity(df, roles, rows) if hot is None else hot):
        return Framed(df, roles, False)
    chunks = _chunk_table(df, roles, back, ahead, rows, bucket_seconds)
    one = F.array(F.struct(F.lit(0).cast("bigint").alias(CHUNK), F.lit(False).alias(HALO)))
    out = (
        df.withColumn(BUCKET, F.floor(epoch_seconds(roles.ts) / bucket_seconds))
        .join(chunks, [roles.entity, BUCKET], "left")
        .withColumn("_copy", F.explode(F.coalesce("_copies", one)))
        .select(*df.columns, F.col(f"_copy.{CHUNK}").alias(CHUNK), F.col(f"_copy.{HALO}").alias(HALO))
    )
    return Framed(out, roles, True)


def with_frames(df: DataFrame, build, roles: Roles = DEFAULT_ROLES, back: int = 0, ahead: int = 0,
                **kw) -> DataFrame:
    """Add the columns ``build(window)`` returns, safe for hot entities."""
    f = framed(df, roles, back, ahead, **kw)
    return f.finish(f.df.withColumns(build(f.window())))


def _carry(f: Framed, aggregates: dict[str, Column], combine) -> DataFrame:
    """Per chunk the combination of ``aggregates`` over all earlier chunks."""
    ends = f.df.groupBy(*f.keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    before = W.partitionBy(f.roles.entity).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    return ends.select(*f.keys, *[combine(n).over(before).alias(n) for n in aggregates])


def forward_fill(df: DataFrame, columns: dict[str, str] | list[str], roles: Roles = DEFAULT_ROLES,
                 **kw) -> DataFrame:
    """Last non-NULL value so far per entity; ``columns`` maps source to output."""
    columns = columns if isinstance(columns, dict) else {c: c for c in columns}
    f = framed(df, roles, **kw)
    upto = f.window().rowsBetween(W.unboundedPreceding, W.currentRow)
    local = {o: F.last(c, ignorenulls=True).over(upto) for c, o in columns.items()}
    if not f.split:
        return f.df.withColumns(local)
    at = F.struct(*roles.order)
    carry = _carry(
        f,
        {f"_c_{c}": F.max_by(c, F.when(F.col(c).isNotNull(), at)) for c in columns},
        lambda n: F.last(n, ignorenulls=True),
    )
    out = f.df.withColumns(local).join(carry, f.keys, "left")
    out = out.withColumns({o: F.coalesce(o, f"_c_{c}") for c, o in columns.items()})
    return f.finish(out.drop(*[f"_c_{c}" for c in columns]))


def running_sum(df: DataFrame, columns: dict[str, str], roles: Roles = DEFAULT_ROLES, **kw) -> DataFrame:
    """Running total per entity in time order; ``columns`` maps source to output."""
    f = framed(df, roles, **kw)
    upto = f.window().rowsBetween(W.unboundedPreceding, W.currentRow)
    local = {o: F.sum(c).over(upto) for c, o in columns.items()}
    if not f.split:
        return f.df.withColumns(local)
    carry = _carry(f, {f"_s_{c}": F.sum(c) for c in columns}, lambda n: F.sum(n))
    out = f.df.withColumns(local).join(carry, f.keys, "left")
    out = out.withColumns({
        o: F.col(o) + F.coalesce(F.col(f"_s_{c}"), F.lit(0)) for c, o in columns.items()})
    return f.finish(out.drop(*[f"_s_{c}" for c in columns]))


def global_running(df: DataFrame, sums: dict[str, str], order: list[str], bucket: Column,
                   maxima: dict[str, str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """Running totals (and running maxima) over a whole table in ``order``.

    ``bucket`` must not decrease along ``order`` and must take few values (for
    example hours of the time span). Totals per bucket are combined over the
    buckets, rows only within their bucket, so no task sees the table.
    ``keys`` restarts the totals per key. Rows without a bucket are a bucket of
    their own, before all others.
    """
    keys = keys or []
    maxima = maxima or {}
    df = df.withColumn("_b", bucket)
    totals = df.groupBy(*keys, "_b").agg(
        *[F.sum(c).alias(f"_s_{o}") for c, o in sums.items()],
        *[F.max(c).alias(f"_m_{o}") for c, o in maxima.items()],
    )
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_b",
        *[F.coalesce(F.sum(f"_s_{o}").over(before), F.lit(0)).alias(f"_s_{o}") for o in sums.values()],
        *[F.max(f"_m_{o}").over(before).alias(f"_m_{o}") for o in maxima.values()],
    )
    within = W.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = df.withColumns({
        **{o: F.sum(c).over(within) for c, o in sums.items()},
        **{o: F.max(c).over(within) for c, o in maxima.items()},
    })
    out = out.alias("r").join(offsets.alias("o"), same("r", "o", [*keys, "_b"])).select(
        "r.*", *[f"o._s_{o}" for o in sums.values()], *[f"o._m_{o}" for o in maxima.values()])
    out = out.withColumns({
        **{o: F.col(o) + F.col(f"_s_{o}") for o in sums.values()},
        **{o: F.greatest(o, f"_m_{o}") for o in maxima.values()},
    })
    return out.drop("_b", *[f"_s_{o}" for o in sums.values()], *[f"_m_{o}" for o in maxima.values()])
