"""Adaptive windows over a model's hits: how far back its accuracy is that of today.

Hits are counted per time bucket (map-side combined), and a window of buckets keeps
growing as long as no point cuts it into two parts whose means differ by more than chance
allows; where one does, the oldest buckets are dropped. The window is an exponential
histogram: of each size (a power of two of rows) at most ``PER_SIZE`` cells are kept, the
oldest neighbours are merged beyond, so it has O(log rows) cells. Windows of adjoining
times can be merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.times import day_start

DELTA, PER_SIZE = 0.001, 32


def allowed(n_old: float, n_new: float, mean: float, delta: float) -> float:
    """How far two means may lie apart: a Bernstein bound at the window's variance, corrected for its cut points."""
    n = n_old + n_new
    part = 1.0 / (1.0 / n_old + 1.0 / n_new)
    weight = math.log(2.0 * math.log(max(n, 3.0)) / delta)
    return math.sqrt(2.0 / part * mean * (1.0 - mean) * weight) + 2.0 / (3.0 * part) * weight


@dataclass
class AdaptiveWindow:
    delta: float = DELTA
    per_size: int = PER_SIZE
    #: (rows, hits) of each cell, the oldest first.
    cells: list[tuple[int, float]] = field(default_factory=list)

    @property
    def rows(self) -> int:
        return sum(n for n, _ in self.cells)

    @property
    def hits(self) -> float:
        return sum(s for _, s in self.cells)

    def _compress(self) -> None:
        while True:
            first: dict[int, list[int]] = {}
            for i, (n, _) in enumerate(self.cells):
                first.setdefault(int(n).bit_length(), []).append(i)
            over = [places[0] for places in first.values() if len(places) > self.per_size]
            if not over:
                return
            i = min(over)
            (a, x), (b, y) = self.cells[i:i + 2]
            self.cells[i:i + 2] = [(a + b, x + y)]

    def _divided(self) -> bool:
        """Does some point cut the window into parts that differ?"""
        n, s, old_n, old_s = self.rows, self.hits, 0, 0.0
        for cell_n, cell_s in self.cells[:-1]:
            old_n, old_s = old_n + cell_n, old_s + cell_s
            if abs(old_s / old_n - (s - old_s) / (n - old_n)) > allowed(old_n, n - old_n, min(max(s / n, 0.0), 1.0), self.delta):
                return True
        return False

    def _shrink(self) -> int:
        dropped = 0
        while len(self.cells) > 1 and self._divided():
            dropped += self.cells.pop(0)[0]
        return dropped

    def add(self, n: int, hits: float) -> int:
        """Take a bucket; returns the rows dropped from the window's old end."""
        if n <= 0:
            return 0
        self.cells.append((int(n), float(hits)))
        self._compress()
        return self._shrink()

    def merge(self, later: AdaptiveWindow) -> int:
        """Take a later window's cells; returns the rows dropped."""
        self.cells += later.cells
        self._compress()
        return self._shrink()


def folded(window: AdaptiveWindow, buckets: Iterable[tuple[int, float]]) -> Iterator[tuple[int, float, bool]]:
    """(rows in the window, their mean, drift) after each bucket."""
    for n, hits in buckets:
        dropped = window.add(n, hits)
        rows = window.rows
        yield rows, window.hits / rows if rows else math.nan, dropped > 0


def bucket_hits(df: DataFrame, hit: Column, keys: list[str], ts: str = "ts", bucket: Column | None = None) -> DataFrame:
    """``(keys, bucket, n, hits)``: rows and hits per key and time bucket (a day, if none is given); null hits do not count."""
    at = day_start(ts) if bucket is None else bucket
    return (df.select(*keys, at.alias("bucket"), hit.cast("double").alias("_hit")).where(F.col("_hit").isNotNull() & F.col("bucket").isNotNull())
            .groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("_hit").alias("hits")))


def adaptive_windows(df: DataFrame, truth: str, predicted: str, keys: list[str], ts: str = "ts", bucket: Column | None = None,
                     delta: float = DELTA, per_size: int = PER_SIZE) -> DataFrame:
    """Per key and time bucket: ``n``, ``hits``, the window's ``window_n`` and ``window_mean`` after it, and ``drift``.

    What a task folds is one row per time bucket of a key, however many rows those count.
    """
    sums = bucket_hits(df, F.col(truth) == F.col(predicted), keys, ts, bucket)
    kinds = dict(sums.dtypes)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bucket")
        told = list(folded(AdaptiveWindow(delta, per_size), zip(rows["n"], rows["hits"])))
        return rows.assign(window_n=[t[0] for t in told], window_mean=[t[1] for t in told], drift=[t[2] for t in told])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in sums.columns) + ", window_n long, window_mean double, drift boolean"
    return sums.groupBy(*keys).applyInPandas(fold, schema)
