"""Micro-batch sinks that may be repeated without harm.

Every output is written under its batch id, replacing what an earlier attempt
left there, so a batch that is run again after a lost executor or driver gives
the same tables. The stream's checkpoint takes the place of acknowledgements.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.numeric import severity
from tidewatch.operators.windows import last_rows, latest_rows
from tidewatch.roles import DEFAULT_ROLES, Roles


def version_path(folder: str, version: int) -> str:
    return f"{folder}/version={version:012d}"


def write_version(df: DataFrame, folder: str, version: int) -> None:
    df.write.mode("overwrite").parquet(version_path(folder, version))


def read_version(spark: SparkSession, folder: str, version: int, schema: T.StructType) -> DataFrame:
    """The table as of ``version``; empty before the first."""
    try:
        return spark.read.schema(schema).parquet(version_path(folder, version))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_batches(spark: SparkSession, folder: str) -> DataFrame:
    """All batches of an append-only output."""
    return spark.read.parquet(folder).drop("version")


def read_newest(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """An update-mode output as it stands: for each key the row of its newest batch."""
    rows = spark.read.parquet(folder)
    rest = [c for c in rows.columns if c not in (*keys, "version")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("_r"))
    return newest.select(*keys, "_r.*")


def read_last(spark: SparkSession, folder: str) -> DataFrame:
    """A complete-mode output as it stands: the newest batch alone."""
    rows = spark.read.parquet(folder)
    return rows.where(F.col("version") == rows.agg(F.max("version")).scalar()).drop("version")


def keep_history(folder: str, n: int, roles: Roles = DEFAULT_ROLES) -> Callable[[DataFrame, int], None]:
    """foreachBatch: the newest ``n`` events per entity as one table per batch.

    Batch ids are consecutive, so the table before is the previous id's.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        before = read_version(batch.sparkSession, folder, batch_id - 1, batch.schema)
        write_version(last_rows(before.unionByName(batch), n, roles), folder, batch_id)

    return write


def fan_out(folder: str, n: int = 100, score: str = "hotspot_score", threshold: float = 40.0,
            roles: Roles = DEFAULT_ROLES) -> Callable[[DataFrame, int], None]:
    """foreachBatch: newest state, history and alerts out of one stream of scored events."""
    history = keep_history(f"{folder}/history", n, roles)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            history(batch, batch_id)
            before = read_version(spark, f"{folder}/latest", batch_id - 1, batch.schema)
            write_version(latest_rows(before.unionByName(batch), roles), f"{folder}/latest", batch_id)
            hot = batch.where(F.col(score) >= threshold).withColumn("severity", severity(F.col(score)))
            write_version(hot, f"{folder}/alerts", batch_id)
        finally:
            batch.unpersist()

    return write


#: Batches between two compactions of a table kept as deltas.
COMPACT_EVERY = 16


def _last_base(version: int, every: int) -> int:
    """The newest compaction up to ``version``; -1 before the first."""
    return (version + 1) // every * every - 1


def read_deltas(spark: SparkSession, folder: str, version: int, schema: T.StructType, reduce: Callable[[DataFrame], DataFrame],
                every: int = COMPACT_EVERY) -> DataFrame:
    """The table as of ``version``: its last compacted state and the batches since."""
    base = _last_base(version, every)
    rows = read_version(spark, f"{folder}/base", base, schema)
    for batch in range(base + 1, version + 1):
        rows = rows.unionByName(read_version(spark, f"{folder}/delta", batch, schema))
    return reduce(rows)


def keep_deltas(folder: str, reduce: Callable[[DataFrame], DataFrame], every: int = COMPACT_EVERY) -> Callable[[DataFrame, int], None]:
    """foreachBatch: a keyed table of which a batch writes what the batch itself leaves.

    ``reduce`` keeps the rows of the table among given ones (the newest of each entity, say)
    and must be repeatable. Every ``every`` batches the state is compacted, so over time a
    batch costs its own rows and its share of one rewrite of the table.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        write_version(reduce(batch), f"{folder}/delta", batch_id)
        if _last_base(batch_id, every) == batch_id:
            before = read_deltas(batch.sparkSession, folder, batch_id - 1, batch.schema, reduce, every)
            delta = read_version(batch.sparkSession, f"{folder}/delta", batch_id, batch.schema)
            write_version(reduce(before.unionByName(delta)), f"{folder}/base", batch_id)

    return write


def fan_out_deltas(folder: str, n: int = 100, score: str = "hotspot_score", threshold: float = 40.0, roles: Roles = DEFAULT_ROLES,
                   every: int = COMPACT_EVERY) -> Callable[[DataFrame, int], None]:
    """foreachBatch: newest state, history and alerts, each written as what the batch adds; read the first two by :func:`read_deltas`."""
    history, latest = (keep_deltas(f"{folder}/{name}", keep, every) for name, keep in (("history", newest(n, roles)), ("latest", newest(1, roles))))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            history(batch, batch_id)
            latest(batch, batch_id)
            hot = batch.where(F.col(score) >= threshold).withColumn("severity", severity(F.col(score)))
            write_version(hot, f"{folder}/alerts", batch_id)
        finally:
            batch.unpersist()

    return write


def newest(n: int, roles: Roles = DEFAULT_ROLES) -> Callable[[DataFrame], DataFrame]:
    """Keeps the newest ``n`` rows of each entity."""
    return (lambda df: latest_rows(df, roles)) if n == 1 else (lambda df: last_rows(df, n, roles))


def run_available(df: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> int:
    """Process what has arrived, then stop; returns the last batch id."""
    q = (df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
         .foreachBatch(write).trigger(availableNow=True).start())
    q.awaitTermination()
    return q.lastProgress["batchId"] if q.lastProgress else -1


def append_batches(folder: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch: each batch's rows under its id (append and update modes)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        write_version(batch, folder, batch_id)

    return write
