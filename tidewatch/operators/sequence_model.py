"""Sequence detector: how badly a linear autoencoder rebuilds the last steps.

Sequences are scaled, flattened and projected on their principal components;
the error is the mean square of what the projection loses. Spark computes the
covariance of all sequences; only that small matrix (steps x metrics squared)
reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.times import epoch_seconds
from tidewatch.operators.features import apply_scale, fit_standard_scale
from tidewatch.operators.quantiles import quantile_struct
from tidewatch.operators.windows import sequences
from tidewatch.roles import DEFAULT_ROLES, Roles

# Steps per sequence and size of the code.
STEPS = 12
CODE_SIZE = 8


@dataclass(frozen=True)
class SequenceModel:
    columns: list[str]
    scale: DataFrame
    components: np.ndarray  # one column per component, orthonormal
    steps: int

    def error(self, flat: Column) -> Column:
        """Mean square of what the components do not hold of a flat sequence."""
        components = self.components

        @F.pandas_udf("double")
        def lost(x: pd.Series) -> pd.Series:
            rows = np.stack(x.to_numpy()) if len(x) else np.empty((0, len(components)))
            energy = (rows**2).sum(axis=1) - ((rows @ components) ** 2).sum(axis=1)
            return pd.Series(np.maximum(energy, 0.0) / len(components))

        return lost(flat)


def _flat(df: DataFrame, columns: list[str], scale: DataFrame, steps: int, roles: Roles, **kw) -> DataFrame:
    seq = sequences(apply_scale(df, scale, columns), columns, roles, steps, **kw)
    return seq.withColumn("flat", F.flatten("sequence")).drop("sequence")


def fit_sequence_model(train: DataFrame, columns: list[str], roles: Roles = DEFAULT_ROLES, steps: int = STEPS,
                       code: int = CODE_SIZE, **kw) -> SequenceModel:
    scale = fit_standard_scale(train, columns)
    vectors = _flat(train, columns, scale, steps, roles, **kw).select(array_to_vector("flat").alias("x"))
    std = np.array(vectors.select(Summarizer.std(F.col("x"))).head()[0].toArray())
    correlation = Correlation.corr(vectors, "x").head()[0].toArray()
    # A constant position has no correlation; its variance is 0 anyway.
    covariance = np.nan_to_num(correlation) * np.outer(std, std)
    _, axes = np.linalg.eigh(covariance)
    return SequenceModel(columns, scale, axes[:, ::-1][:, :code].copy(), steps)


def sequence_errors(df: DataFrame, model: SequenceModel, roles: Roles = DEFAULT_ROLES, **kw) -> DataFrame:
    """(entity, time, error) for every row with a full sequence."""
    rows = _flat(df, model.columns, model.scale, model.steps, roles, **kw)
    return rows.select(roles.entity, *roles.order, model.error(F.col("flat")).alias("error"))


def last_share(df: DataFrame, share: float = 0.15, ts: str = "ts", rescan: bool = False) -> DataFrame:
    """The newest ``share`` of rows by time, to calibrate on."""
    timed = df.withColumn("_s", epoch_seconds(ts))
    q = quantile_struct(timed, "_s", {"cut": 1.0 - share}, rescan=rescan)
    return timed.where(F.col("_s") >= q["cut"]).drop("_s")
