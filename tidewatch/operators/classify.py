"""Workload classification with MLlib, and its explanations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import (
    LogisticRegression, LogisticRegressionModel, RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.features import apply_scale, fit_standard_scale
from tidewatch.operators.summaries import averaged_metrics, class_metrics
from tidewatch.session import stage


def assemble(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(df)


@dataclass(frozen=True)
class Classifier:
    columns: list[str]
    model: RandomForestClassificationModel

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``predicted`` (label) and ``probabilities`` (one per label)."""
        out = self.model.transform(assemble(df, self.columns))
        return out.withColumns({
            "predicted": F.col("prediction").cast("int"), "probabilities": vector_to_array("probability"),
        }).drop("features", "rawPrediction", "probability", "prediction")

    def importances(self, k: int = 20) -> DataFrame:
        """The ``k`` most important features; one row per feature exists at most."""
        rows = [(c, float(v)) for c, v in zip(self.columns, self.model.featureImportances.toArray())]
        df = SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double")
        return df.orderBy(F.col("importance").desc(), "feature").limit(k)


def fit_classifier(train: DataFrame, columns: list[str], label: str = "label", trees: int = 50, depth: int = 8,
                   seed: int = 42) -> Classifier:
    forest = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)
    return Classifier(columns, forest.fit(assemble(train, columns)))


def tune_classifier(train: DataFrame, validation: DataFrame, columns: list[str], label: str = "label",
                    trees=(20, 50), depths=(5, 8), seed: int = 42) -> tuple[Classifier, list[dict]]:
    """Search on the given validation rows by weighted F1, refit on train and validation.

    The validation rows are a later time range, so a random re-split would leak.
    """
    base = RandomForestClassifier(featuresCol="features", labelCol=label, seed=seed)
    grid = ParamGridBuilder().addGrid(base.numTrees, list(trees)).addGrid(base.maxDepth, list(depths)).build()
    judge = MulticlassClassificationEvaluator(labelCol=label, metricName="weightedFMeasure")
    fit_on, check_on = assemble(train, columns).cache(), assemble(validation, columns).cache()
    trials = []
    for params in grid:
        f1 = judge.evaluate(base.fit(fit_on, params).transform(check_on))
        trials.append({"trees": params[base.numTrees], "depth": params[base.maxDepth], "weighted_f1": f1})
    fit_on.unpersist()
    check_on.unpersist()
    best = max(trials, key=lambda t: t["weighted_f1"])
    return fit_classifier(train.unionByName(validation), columns, label, best["trees"], best["depth"], seed), trials


#: Configurations of the search by halving.
HALVING_GRID = [{"depth": d, "min_rows": m, "subset": s} for d in (5, 8, 10) for m in (1, 20, 100) for s in ("sqrt", "0.8")]


def binned(train: DataFrame, others: list[DataFrame], columns: list[str], bins: int = 32) -> list[DataFrame]:
    """The tables with each column as the number of its bin, cut at quantiles of the training rows; each staged once.

    One sketch gives the cuts of all columns; NULL and NaN have a bin of their own. Bins
    are so small that files of a usual size would hold too many rows for a task: the rows
    are dealt over all cores.
    """
    files = 2 * train.sparkSession.sparkContext.defaultParallelism
    cuts = train.approxQuantile(columns, [i / bins for i in range(1, bins)], 1 / (8 * bins))
    splits = [[-math.inf, *sorted(set(c)), math.inf] for c in cuts]
    names = [f"_bin_{c}" for c in columns]
    cut = Bucketizer(inputCols=columns, outputCols=names, splitsArray=splits, handleInvalid="keep")
    out = []
    for df in [train, *others]:
        numbered = cut.transform(df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(math.nan)) for c in columns}))
        out.append(stage(numbered.withColumns({c: F.col(n) for c, n in zip(columns, names)}).drop(*names).repartition(files), "binned"))
    return out


def tune_by_halving(train: DataFrame, validation: DataFrame, columns: list[str], label: str = "label", grid: list[dict] | None = None,
                    trees: int = 5, eta: int = 3, rungs: int = 3, bins: int = 32, seed: int = 42) -> tuple[Classifier, list[dict]]:
    """Successive halving on the given validation rows by weighted F1, refitted on train and validation.

    All configurations start with ``trees`` trees; the best one in ``eta`` go on with
    ``eta`` times as many, until one is left or ``rungs`` are done. All rows count at each
    rung: what grows is the forest. Columns are binned once for all trials.
    """
    tried, trials = list(grid or HALVING_GRID), []
    fit_on, check_on = binned(train, [validation], columns, bins)
    fit_on, check_on = assemble(fit_on, columns), assemble(check_on, columns)
    judge = MulticlassClassificationEvaluator(labelCol=label, metricName="weightedFMeasure")

    def forest(c: dict, n: int) -> RandomForestClassifier:
        return RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=n, maxDepth=c["depth"], minInstancesPerNode=c["min_rows"],
                                      featureSubsetStrategy=c["subset"], maxBins=max(bins + 1, 2), seed=seed)

    for rung in range(rungs):
        scored = [(judge.evaluate(forest(c, trees).fit(fit_on).transform(check_on)), -i, c) for i, c in enumerate(tried)]
        scored.sort(key=lambda x: x[:2], reverse=True)
        left = max(1, len(tried) // eta)
        trials += [{"rung": rung, "trees": trees, **c, "weighted_f1": f1, "kept": at < left} for at, (f1, _, c) in enumerate(scored)]
        tried = [c for _, _, c in scored[:left]]
        if len(tried) == 1:
            break
        trees *= eta
    whole = assemble(train.unionByName(validation), columns).repartition(2 * train.sparkSession.sparkContext.defaultParallelism)
    return Classifier(columns, forest(tried[0], trees).fit(whole)), trials


def split_metrics(predicted: DataFrame, label: str = "label", split: str = "split") -> DataFrame:
    """Averaged figures per split, and how far training accuracy lies above each."""
    m = averaged_metrics(class_metrics(predicted, label, "predicted", [split]), [split])
    train = m.where(F.col(split) == "train").select("accuracy").scalar()
    return m.withColumn("gap_to_train", train - F.col("accuracy"))


# --- explanations -----------------------------------------------------------------------

@dataclass(frozen=True)
class Explainer:
    columns: list[str]
    scale: DataFrame
    model: LogisticRegressionModel


def fit_explainer(train: DataFrame, columns: list[str], label: str = "predicted") -> Explainer:
    """A linear stand-in for the classifier, fitted to its predictions."""
    scale = fit_standard_scale(train, columns)
    model = LogisticRegression(featuresCol="features", labelCol=label, family="multinomial", maxIter=50, regParam=0.01)
    return Explainer(columns, scale, model.fit(assemble(apply_scale(train, scale, columns), columns)))


def explain(df: DataFrame, explainer: Explainer, names: list[str], predicted: str = "predicted", k: int = 3) -> DataFrame:
    """Add ``contributions`` (largest first) and a sentence naming the top ``k``.

    A contribution is coefficient times scaled value for the predicted class.
    """
    scaled = apply_scale(df, explainer.scale, explainer.columns)
    coef = explainer.model.coefficientMatrix.toArray().tolist()
    table = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in coef])
    mine = scaled.withColumn("_w", F.get(table, F.col(predicted).cast("int")))
    parts = F.array(*[
        F.struct(F.abs(F.get("_w", F.lit(i)) * F.col(c)).alias("size"), F.lit(c).alias("feature"),
                 (F.get("_w", F.lit(i)) * F.col(c)).alias("contribution")) for i, c in enumerate(explainer.columns)])
    text = F.transform(F.slice("contributions", 1, k), lambda p: F.concat(
        p["feature"], F.when(p["contribution"] > 0, " is high (").otherwise(" is low ("),
        F.format_number(p["contribution"], 3), F.lit(")")))
    label = F.get(F.array(*[F.lit(n) for n in names]), F.col(predicted).cast("int"))
    out = mine.withColumn("contributions", F.sort_array(parts, asc=False))
    out = out.withColumn("explanation", F.concat(F.lit("Classified as "), label, F.lit(" because: "), F.array_join(text, ", ")))
    keep = [c for c in df.columns if c not in explainer.columns]
    return out.select(*keep, "contributions", "explanation")


# --- meta-learner -------------------------------------------------------------------------

SCORES = ["stat_score", "forest_score", "sequence_score"]


@dataclass(frozen=True)
class MetaLearner:
    scale: DataFrame
    model: LogisticRegressionModel

    def score(self, df: DataFrame) -> DataFrame:
        """Replace ``ensemble_score`` by the learned probability, 0-100."""
        raw = df.withColumns({f"_raw_{c}": F.col(c) for c in SCORES})
        out = self.model.transform(assemble(apply_scale(raw, self.scale, SCORES), SCORES))
        out = out.withColumn("ensemble_score", vector_to_array("probability")[1] * 100.0)
        out = out.drop("features", "rawPrediction", "probability", "prediction")
        return out.withColumns({c: F.col(f"_raw_{c}") for c in SCORES}).drop(*[f"_raw_{c}" for c in SCORES])


def fit_meta_learner(df: DataFrame, label: str = "truth") -> MetaLearner:
    """Balanced logistic regression on the three standardised scores."""
    y = F.col(label).cast("double")
    counts = df.agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos")).alias("c")).scalar()
    weight = F.when(y == 1, counts["n"] / (2 * counts["pos"])).otherwise(counts["n"] / (2 * (counts["n"] - counts["pos"])))
    scale = fit_standard_scale(df, SCORES)
    rows = assemble(apply_scale(df.withColumns({"_y": y, "_w": weight}), scale, SCORES), SCORES)
    model = LogisticRegression(featuresCol="features", labelCol="_y", weightCol="_w", maxIter=100)
    return MetaLearner(scale, model.fit(rows))
