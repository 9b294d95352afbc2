"""Figures over given predictions: agreement, drift, pseudo-labels, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.numeric import ratio
from tidewatch.functions.times import day_start
from tidewatch.operators.summaries import averaged_metrics, class_metrics


def agreement(latest: DataFrame, first: str, second: str) -> DataFrame:
    """One row: volumes both models classified, how many agree, in percent."""
    both = latest.where(F.col(first).isNotNull() & F.col(second).isNotNull())
    same = F.count_if(F.col(first) == F.col(second))
    n = F.count(F.lit(1))
    return both.agg(n.alias("volumes"), same.alias("agreeing"), ratio(same * 100.0, n).alias("agreement_pct"))


def disagreeing(latest: DataFrame, first: str, second: str) -> DataFrame:
    return latest.where(F.col(first) != F.col(second))


def drift_signal(df: DataFrame, truth: str, predicted: str, ts: str = "ts", delta: float = 0.001) -> DataFrame:
    """Accuracy per day, flagged where it moved more than chance allows.

    Neighbouring days are compared with the Hoeffding bound for two means; one
    row per day enters the window.
    """
    hit = (F.col(truth) == F.col(predicted)).cast("double")
    days = df.groupBy(day_start(ts).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))
    w = W.orderBy("bucket")
    out = days.withColumns({"_n0": F.lag("n").over(w), "_a0": F.lag("accuracy").over(w)})
    bound = F.sqrt(0.5 * (1 / F.col("n") + 1 / F.col("_n0")) * F.log(F.lit(4.0 / delta)))
    return out.withColumn("bound", bound).withColumn(
        "drift", F.coalesce(F.abs(F.col("accuracy") - F.col("_a0")) > F.col("bound"), F.lit(False))).drop("_n0", "_a0")


def pseudo_labels(df: DataFrame, probabilities: str, predicted: str, minimum: float = 0.85) -> DataFrame:
    """Rows whose largest class probability exceeds ``minimum``, labelled by the model."""
    return df.where(F.array_max(probabilities) > minimum).withColumn("label", F.col(predicted))


def compare(df: DataFrame, truth: str, first: str, second: str) -> DataFrame:
    """F1 per class of two models; both are scored in one pass over long rows."""
    long = df.unpivot([truth], [first, second], "model", "predicted")
    m = class_metrics(long, truth, "predicted", ["model"])
    return m.groupBy("class").agg(F.max(F.when(F.col("model") == first, F.col("f1"))).alias("first_f1"),
                                  F.max(F.when(F.col("model") == second, F.col("f1"))).alias("second_f1"))


def performance(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per-class figures with the overall accuracy and sample count beside them."""
    per = class_metrics(df, truth, predicted)
    total = averaged_metrics(per).select(F.struct("accuracy", F.col("support").alias("sample_count")).alias("t")).scalar()
    return per.withColumn("_t", total).select("class", "precision", "recall", "f1", "support", "_t.*")
