"""Stateful stream operators with bounded state per entity."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.operators.statistical import FULL_SCALE_Z, LATENCY_METRICS, WEIGHTS
from tidewatch.roles import DETECTOR_METRICS


def latest_state(events: DataFrame, entity: str = "volume_id", ts: str = "ts") -> DataFrame:
    """The newest event per entity (update mode): one struct of state per entity."""
    rest = [c for c in events.columns if c not in (entity, ts)]
    newest = events.groupBy(entity).agg(F.max(F.struct(ts, *rest)).alias("_r"))
    return newest.select(entity, "_r.*")


def tick_completeness(events: DataFrame, expected: int, entity: str = "volume_id", ts: str = "ts",
                      watermark: str = "10 minutes") -> DataFrame:
    """Different volumes seen per tick against the expected number; state is dropped behind the watermark.

    A tick's volumes are its state, one fleet's at most, and counted exactly.
    """
    seen = events.withWatermark(ts, watermark).groupBy(ts).agg(F.size(F.collect_set(entity)).cast("long").alias("seen"))
    return seen.withColumn("complete", F.col("seen") >= expected)


def latest_complete_tick(ticks: DataFrame, ts: str = "ts") -> DataFrame:
    """The newest tick that all expected volumes have reached, from the ticks as they stand."""
    return ticks.where("complete").agg(F.max(ts).alias(ts))


def ingest_by_volume(events: DataFrame, entity: str = "volume_id", ts: str = "ts") -> DataFrame:
    """Events so far and first and last event time of each volume (update mode): one row of state each."""
    return events.groupBy(entity).agg(F.count(F.lit(1)).alias("events"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def ingest_status(by_volume: DataFrame, entity: str = "volume_id") -> DataFrame:
    """Events, live volumes, first and last event time, exactly, from the volumes as they stand."""
    return by_volume.agg(F.coalesce(F.sum("events"), F.lit(0)).alias("events"), F.count(entity).alias("volumes"),
                         F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def throttle(events: DataFrame, seconds: int = 30, entity: str = "volume_id", ts: str = "ts",
             watermark: str = "10 minutes") -> DataFrame:
    """An event passes if ``seconds`` of event time went by since the entity's last one that passed.

    State is that last time. It expires when the watermark has gone past what it
    can hold back; events behind the watermark do not pass.
    """
    gap = seconds * 1_000_000
    schema = ", ".join(f"{c} {t}" for c, t in events.dtypes)

    def passed(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        new = pd.concat(list(batches)).sort_values(ts, kind="stable")
        times = new[ts].to_numpy().astype("datetime64[us]").astype("int64")
        behind = state.getCurrentWatermarkMs() * 1000
        at = int(np.searchsorted(times, max(behind, last + gap if last is not None else behind)))
        keep = []
        while at < len(times):
            keep.append(at)
            last = int(times[at])
            at = int(np.searchsorted(times, last + gap))
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(last + gap, behind + 1000) // 1000)
        yield new.iloc[keep]

    return events.withWatermark(ts, watermark).groupBy(entity).applyInPandasWithState(
        passed, schema, "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


# --- windowed aggregates ---------------------------------------------------------------

def _stats() -> list:
    return [F.count(F.lit(1)).alias("n"), F.avg("total_iops").alias("total_iops"), F.max("avg_latency_us").alias("max_latency_us")]


def tumbling(events: DataFrame, width: str = "1 hour", watermark: str = "10 minutes", entity: str = "volume_id", ts: str = "ts") -> DataFrame:
    return events.withWatermark(ts, watermark).groupBy(F.window(ts, width).alias("w"), entity).agg(*_stats()).select(
        F.col("w.start").alias("from"), entity, "n", "total_iops", "max_latency_us")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", watermark: str = "10 minutes",
            entity: str = "volume_id", ts: str = "ts") -> DataFrame:
    return events.withWatermark(ts, watermark).groupBy(F.window(ts, width, step).alias("w"), entity).agg(*_stats()).select(
        F.col("w.start").alias("from"), entity, "n", "total_iops", "max_latency_us")


def session(events: DataFrame, gap: str = "30 minutes", watermark: str = "10 minutes", entity: str = "volume_id", ts: str = "ts") -> DataFrame:
    return events.withWatermark(ts, watermark).groupBy(F.session_window(ts, gap).alias("w"), entity).agg(*_stats()).select(
        F.col("w.start").alias("from"), F.col("w.end").alias("to"), entity, "n", "total_iops", "max_latency_us")


# --- online detector -----------------------------------------------------------------------

def _block_sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the first 0, 1, .. rows of each block (blocks x rows x metrics): count, reference value, sum and sum of squares around it.

    The reference is the block's first value, so that a flat stretch has sums of exactly 0.
    NaN counts as absent.
    """
    known = ~np.isnan(x)
    first = np.take_along_axis(x, known.argmax(axis=1)[:, None, :], axis=1)
    first = np.where(np.isnan(first), 0.0, first)
    off = np.where(known, x - first, 0.0)
    none = np.zeros((len(x), 1, x.shape[2]))
    count, total, squares = (np.concatenate([none, np.cumsum(v, axis=1)], axis=1) for v in (known.astype(float), off, off * off))
    return count, first, total, squares


def trailing_moments(line: np.ndarray, since: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the ``rows`` rows (all, if fewer) before each row of ``line`` from ``since`` on; NaN are left out.

    A frame is the end of one block of ``rows`` and the start of the next: two running sums
    and one merge of moments, whatever ``rows`` is.
    """
    n, width = line.shape
    blocks = np.full((-(-n // rows) + 1, rows, width), np.nan)
    blocks.reshape(-1, width)[:n] = line
    at = np.arange(since, n)
    block, offset = at // rows, at % rows
    parts = []
    for sums, b, taken in ((_block_sums(blocks), block, offset), (_block_sums(blocks[:, ::-1]), block - 1, rows - offset)):
        there = b >= 0
        count, first, total, squares = (v[np.maximum(b, 0), taken if v.shape[1] > 1 else 0] for v in sums)
        count = np.where(there[:, None], count, 0.0)
        some = np.maximum(count, 1.0)
        parts.append((count, first + total / some, np.maximum(squares - total * total / some, 0.0)))
    (n1, mean1, m1), (n2, mean2, m2) = parts
    both = n1 + n2
    with np.errstate(invalid="ignore", divide="ignore"):
        away = mean2 - mean1
        mean = np.where(n1 == 0, mean2, mean1 + away * n2 / both)
        spread = np.where(n1 == 0, m2, np.where(n2 == 0, m1, m1 + m2 + away * away * n1 * n2 / both))
        return np.where(both > 0, mean, np.nan), np.where(both > 0, np.sqrt(spread / both), np.nan)


def online_scores(events: DataFrame, entity: str = "volume_id", ts: str = "ts", rows: int = 288, min_rows: int = 12,
                  buckets: int | None = None) -> DataFrame:
    """The statistical hotspot score of each event against the rows before it.

    State per entity: its last ``rows`` metric rows. For in-order input this
    equals the batch detector; within a micro-batch rows are put in time order.
    A row costs a merge of two running moments, not a frame of ``rows``.

    A call of a state function costs more than the few rows an entity has in a micro-batch:
    ``buckets`` keeps the states of entities of equal hash together, in one call. Choose it so
    that some dozens of entities share a bucket, and keep it as long as the checkpoint.
    """
    metrics = DETECTOR_METRICS
    width = len(metrics)
    lat = [metrics.index(m) for m in LATENCY_METRICS]
    iops, thr = metrics.index("total_iops"), metrics.index("total_throughput_mbps")

    def line_scores(values: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of one entity's rows after ``past``, and what is past then."""
        out = np.zeros(len(values))
        for a in range(0, len(values), 1 << 16):
            now = values[a:a + (1 << 16)]
            line = np.vstack([past, now])
            mean, std = trailing_moments(line, len(past), rows)
            seen = np.minimum(len(past) + np.arange(len(now)), rows)
            ok = (std >= 1e-6) & (seen >= min_rows)[:, None]
            z = np.where(ok, (now - mean) / np.where(ok, std, 1.0), 0.0)
            weighted = (WEIGHTS["latency"] * z[:, lat].max(axis=1) + WEIGHTS["iops"] * z[:, iops]
                        + WEIGHTS["throughput"] * z[:, thr])
            out[a:a + len(now)] = np.clip(weighted / FULL_SCALE_Z * 100, 0, 100)
            past = line[-rows:]
        return out, past

    def score(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept: dict[Any, bytes] = pickle.loads(state.get[0]) if state.exists else {}
        new = pd.concat(list(batches)).sort_values(ts, kind="stable")
        out = np.zeros(len(new))
        values = new[metrics].to_numpy(dtype=float)
        codes, ids = pd.factorize(new[entity], use_na_sentinel=False)
        lines = np.split(np.argsort(codes, kind="stable"), np.cumsum(np.bincount(codes))[:-1])
        for one, at in zip(ids.tolist(), lines):
            name = None if pd.isna(one) else one
            out[at], past = line_scores(values[at], np.frombuffer(kept.get(name, b"")).reshape(-1, width))
            kept[name] = past.tobytes()
        state.update((pickle.dumps(kept),))
        yield pd.DataFrame({entity: new[entity].to_numpy(), ts: new[ts].to_numpy(), "hotspot_score": out})

    types = dict(events.dtypes)
    dealt, by = events.select(entity, ts, *metrics), entity
    if buckets is not None:
        # no entity has a bucket of its own: beside it, whole numbers would come as doubles
        by = "_bucket"
        dealt = dealt.withColumn(by, F.when(F.col(entity).isNull(), -1).otherwise(F.pmod(F.xxhash64(entity), F.lit(buckets))))
    return dealt.groupBy(by).applyInPandasWithState(
        score, f"{entity} {types[entity]}, {ts} {types[ts]}, hotspot_score double", "past binary",
        "append", GroupStateTimeout.NoTimeout)


def online_hot_runs(scored: DataFrame, threshold: float, min_minutes: float = 2.0, score: str = "hotspot_score",
                    entity: str = "volume_id", ts: str = "ts", keep: tuple[str, ...] = ()) -> DataFrame:
    """How long each event's unbroken hot run has lasted; state is the run's start."""

    def track(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start = state.get[0] if state.exists else None
        new = pd.concat(list(batches)).sort_values([ts, *keep], kind="stable")
        times = new[ts].to_numpy().astype("datetime64[us]").astype("int64")
        minutes: list[float | None] = []
        for us, hot in zip(times.tolist(), (new[score] >= threshold).tolist()):
            if not hot:
                start = None
            elif start is None:
                start = us
            minutes.append((us - start) / 60e6 if hot else None)
        state.update((start,))
        m = pd.Series(minutes, dtype=float)
        status = np.where(m.isna(), "cold", np.where(m < min_minutes, "waiting_persistence", "verified"))
        out = new[[entity, ts, *keep]].reset_index(drop=True)
        yield out.assign(run_minutes=m, status=status)

    types = dict(scored.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in (entity, ts, *keep)) + ", run_minutes double, status string"
    return scored.select(entity, ts, *keep, score).groupBy(entity).applyInPandasWithState(
        track, schema, "start bigint", "append", GroupStateTimeout.NoTimeout)
