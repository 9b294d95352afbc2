"""The whole detector run: fit on the past, calibrate, score the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import fusion
from tidewatch.operators.clean import impute_median
from tidewatch.operators.features import apply_scale, fit_standard_scale
from tidewatch.operators.forest import TREES, fit_forest
from tidewatch.operators.sequence_model import fit_sequence_model, last_share, sequence_errors
from tidewatch.operators.splits import fractional_split
from tidewatch.operators.statistical import hotspot_scores
from tidewatch.roles import DEFAULT_ROLES, DETECTOR_METRICS, Roles
from tidewatch.session import release_shuffles, stage

# The metrics the forest and the sequence model see.
MODEL_METRICS = [
    "total_iops", "avg_latency_us", "total_throughput_mbps", "read_latency_p99_us", "write_latency_p99_us",
    "queue_depth", "read_write_ratio", "sequential_ratio", "read_iops", "write_iops",
]


def mark_train(df: DataFrame, by_entity: bool, fraction: float, roles: Roles) -> DataFrame:
    """Add ``in_train``: the first ``fraction`` of the time span, or of rows in entity order."""
    if by_entity:
        return fractional_split(df, fraction, roles)
    span = df.agg(F.struct(F.min(roles.ts).alias("a"), F.max(roles.ts).alias("z")).alias("s")).scalar()
    seconds = F.timestamp_diff("SECOND", span["a"], span["z"]) * fraction
    return df.withColumn("in_train", F.timestamp_diff("SECOND", span["a"], F.col(roles.ts)) < seconds)


def run_ensemble(telemetry: DataFrame, columns: list[str] = MODEL_METRICS, fraction: float = 0.7, alarm: float = 40.0,
                 min_agreement: int = 1, trees: int = TREES, by_entity: bool = False,
                 roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Scores, flags, agreement and severity of every row after the training part.

    Inputs that several passes read are staged once in the shared folder, and the shuffles of
    a step go before the next begins. Only the columns that a detector reads are kept.
    """
    kept = dict.fromkeys([roles.entity, *roles.order, *columns, *DETECTOR_METRICS])
    given = stage(telemetry.select(*kept), "ensemble-given", release=True)
    data = stage(mark_train(impute_median(given, columns, rescan=True), by_entity, fraction, roles), "ensemble-input", release=True)
    train = data.where("in_train")
    scale = fit_standard_scale(train, columns)
    forest = fit_forest(apply_scale(train, scale, columns), columns, [roles.entity, *roles.order], trees)
    raw = stage(apply_scale(data, scale, columns).select(
        roles.entity, *roles.order, "in_train", forest.score(data.sparkSession).alias("raw_score")), "ensemble-forest", release=True)
    forest_scores = fusion.normalise_forest(raw, raw.where("in_train"), rescan=True).where("NOT in_train").drop("in_train", "raw_score")

    model = fit_sequence_model(train, columns, roles)
    release_shuffles(data.sparkSession)
    lost = stage(sequence_errors(data, model, roles), "ensemble-errors", release=True)
    errors = stage(lost.join(data.select(roles.entity, *roles.order, "in_train"), [roles.entity, *roles.order]), "ensemble-sequences", release=True)
    calibration = last_share(errors.where("in_train"), 0.15, roles.ts, rescan=True)
    sequence_scores = fusion.normalise_errors(errors.where("NOT in_train"), calibration, rescan=True)

    stat = stage(hotspot_scores(data, roles).where("NOT in_train").select(
        roles.entity, *roles.order, F.col("hotspot_score").alias("stat_score")), "ensemble-statistics", release=True)
    rows = stat.join(forest_scores, [roles.entity, *roles.order])
    return fusion.ensemble(fusion.add_sequence_scores(rows, sequence_scores, roles), alarm, min_agreement)
