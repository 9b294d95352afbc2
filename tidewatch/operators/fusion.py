"""Score normalisation, fusion, the consensus gate and detector evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.numeric import clip, severity
from tidewatch.operators.joins import join_flags
from tidewatch.operators.quantiles import quantile_struct
from tidewatch.operators.splits import three_sigma_truth
from tidewatch.operators.summaries import binary_metrics
from tidewatch.roles import DEFAULT_ROLES, Roles

# Weights of the statistical, forest and sequence scores.
WEIGHTS = {"stat_score": 0.35, "forest_score": 0.35, "sequence_score": 0.30}
ALARM = 40.0


def normalise_forest(df: DataFrame, train: DataFrame, raw: str = "raw_score", contamination: float = 0.05, rescan: bool = False) -> DataFrame:
    """Raw scores (lower is stranger) to 0-100, and a flag.

    The training data's 98th percentile maps to 0 and its 2nd to 100; a row is
    flagged below the ``contamination`` quantile. A zero span maps to 0.
    """
    q = quantile_struct(train, raw, {"strange": 0.02, "cut": contamination, "normal": 0.98}, rescan=rescan)
    span = F.col("_q.normal") - F.col("_q.strange")
    score = F.when(span == 0, 0.0).otherwise(
        clip(F.try_divide(F.col("_q.normal") - F.col(raw), span) * 100.0, 0.0, 100.0))
    return df.withColumn("_q", q).withColumns({
        "forest_score": score, "forest_flagged": F.col(raw) < F.col("_q.cut")}).drop("_q")


def normalise_errors(df: DataFrame, calibration: DataFrame, error: str = "error", top: float = 0.99,
                     flag_at: float = 0.95, rescan: bool = False) -> DataFrame:
    """Reconstruction errors to 0-100 against the calibration data's ``top`` quantile."""
    q = quantile_struct(calibration, error, {"cut": flag_at, "cap": top}, rescan=rescan)
    return df.withColumn("_q", q).withColumns({
        "sequence_score": clip(F.try_divide(F.col(error), F.col("_q.cap")) * 100.0, 0.0, 100.0),
        "sequence_flagged": F.col(error) > F.col("_q.cut")}).drop("_q")


def add_sequence_scores(rows: DataFrame, scored: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Join sequence results; rows without a sequence score 0, not flagged."""
    s = scored.select(roles.entity, roles.ts, "sequence_score", "sequence_flagged")
    return rows.join(s, [roles.entity, roles.ts], "left").withColumns({
        "sequence_score": F.coalesce("sequence_score", F.lit(0.0)),
        "sequence_flagged": F.coalesce("sequence_flagged", F.lit(False))})


def fuse(columns: list[str], weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted mean of the scores at hand; weights of absent ones are shared out."""
    total = sum(weights[c] for c in columns)
    return clip(sum(F.col(c) * (weights[c] / total) for c in columns), 0.0, 100.0)


def consensus(df: DataFrame, flags: list[str], alarm: float = ALARM, min_agreement: int = 1) -> DataFrame:
    """Add ``n_agreeing``, ``is_anomaly`` and ``severity`` to rows with ``ensemble_score``."""
    agreeing = sum((F.coalesce(F.col(f), F.lit(False)).cast("int") for f in flags), F.lit(0))
    hit = (F.col("ensemble_score") >= alarm) & (F.col("n_agreeing") >= min_agreement)
    return df.withColumn("n_agreeing", agreeing).withColumn("is_anomaly", hit).withColumn(
        "severity", F.when(F.col("is_anomaly"), severity(F.col("ensemble_score"))).otherwise("normal"))


def ensemble(df: DataFrame, alarm: float = ALARM, min_agreement: int = 1,
             weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Fuse whichever score columns ``df`` has, and apply the gate."""
    names = [c for c in weights if c in df.columns]
    flags = [c.replace("_score", "_flagged") for c in names]
    out = df.withColumn("ensemble_score", fuse(names, weights))
    if "stat_score" in names:
        out = out.withColumn("stat_flagged", F.col("stat_score") >= alarm)
    return consensus(out, flags, alarm, min_agreement)


def evaluate_detectors(rows: DataFrame, detectors: dict[str, DataFrame], roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Counts and figures per detector against the three-sigma pseudo-truth.

    ``detectors`` maps a name to a table with (entity, ts, flag). All flags are
    joined to the rows once and turned to long form, so the truth is computed once.
    """
    truth = three_sigma_truth(rows).select(roles.entity, roles.ts, "truth")
    out = truth
    for name, table in detectors.items():
        out = join_flags(out, table.withColumnRenamed("flag", name), name, roles)
    long = out.unpivot(["truth"], list(detectors), "detector", "flag")
    return binary_metrics(long, "truth", "flag", ["detector"])
