"""Fitted models: determinism, ranges, and that they find what is there."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import classify, fusion
from tidewatch.operators.forest import _grow, average_path, fit_forest
from tidewatch.operators.sequence_model import fit_sequence_model, last_share, sequence_errors
from tidewatch.plans.ensemble import run_ensemble
from tidewatch.plans.fixtures import telemetry


@pytest.fixture(scope="module")
def points(spark):
    """A cloud around 0 and one point far away."""
    x = (F.xxhash64("id") % 1000) / 1000.0
    y = (F.xxhash64("id", F.lit(1)) % 1000) / 1000.0
    far = F.col("id") == 4999
    return spark.range(5000).select("id", F.when(far, 9.0).otherwise(x).alias("x"), F.when(far, 9.0).otherwise(y).alias("y"))


def scores(df, forest):
    return {r["id"]: r["s"] for r in df.select("id", forest.score(df.sparkSession).alias("s")).collect()}


def test_forest_is_deterministic_and_finds_the_outlier(spark, points):
    a = fit_forest(points, ["x", "y"], ["id"], trees=40, rows_per_tree=128)
    b = fit_forest(points.repartition(7, "x"), ["x", "y"], ["id"], trees=40, rows_per_tree=128)
    sa, sb = scores(points, a), scores(points.repartition(3), b)
    assert sa == sb
    assert all(-1 <= s <= 0 for s in sa.values())
    assert min(sa, key=sa.get) == 4999
    assert a.rows_per_tree == 128


def test_forest_on_few_rows(spark, points):
    f = fit_forest(points.limit(30), ["x", "y"], ["id"], trees=10, rows_per_tree=16)
    assert len(f.trees) == 10 and f.rows_per_tree >= 15


def test_tree_paths():
    tree = _grow(np.arange(8, dtype=float).reshape(-1, 1), np.random.default_rng(0), 10)
    assert min(c for c in tree["child"] if c >= 0) == 1 and max(tree["path"]) <= 10
    flat = _grow(np.ones((5, 2)), np.random.default_rng(0), 10)
    assert flat["path"] == [average_path(5)]


def test_sequence_errors_flag_a_jump(spark):
    rows = [(v, i, float(np.sin(i / 3 + v)), float(np.cos(i / 3 + v))) for v in range(4) for i in range(200)]
    rows[350] = (1, 150, 30.0, -30.0)
    df = spark.createDataFrame(rows, "volume_id int, i int, x double, y double").withColumn(
        "ts", F.timestamp_add("MINUTE", F.col("i") * 5, F.expr("TIMESTAMP_NTZ'2026-04-01 00:00:00'")))
    train = df.where("volume_id <> 1")
    model = fit_sequence_model(train, ["x", "y"], code=4)
    e = sequence_errors(df, model)
    assert e.count() == 4 * (200 - 11) and e.agg(F.min("error")).first()[0] >= 0
    worst = {(r["volume_id"], (r["ts"].hour * 60 + r["ts"].minute) // 5) for r in e.orderBy(F.col("error").desc()).limit(12).collect()}
    assert {v for v, _ in worst} == {1} and {i for _, i in worst} == set(range(150, 162))
    cal = last_share(e.where("volume_id <> 1"), 0.15)
    n = fusion.normalise_errors(e, cal)
    assert n.where("sequence_score < 0 OR sequence_score > 100").count() == 0
    assert n.where("volume_id = 1 AND sequence_flagged").count() >= 12


@pytest.fixture(scope="module")
def classes(spark):
    k = (F.col("id") % 3).cast("int")
    noise = (F.xxhash64("id") % 100) / 1000.0
    return spark.range(900).select(
        "id", k.alias("label"), (k * 5 + noise).alias("x"), (-k * 3 + noise).alias("y"),
        F.when(F.col("id") < 600, "train").when(F.col("id") < 750, "val").otherwise("test").alias("split"))


def test_classifier_tuning_and_split_metrics(classes):
    c, trials = classify.tune_classifier(classes.where("split = 'train'"), classes.where("split = 'val'"), ["x", "y"], trees=(3, 5), depths=(2, 3))
    assert len(trials) == 4 and max(t["weighted_f1"] for t in trials) > 0.99
    p = c.predict(classes)
    m = {r["split"]: r for r in classify.split_metrics(p).collect()}
    assert set(m) == {"train", "val", "test"} and m["test"]["accuracy"] > 0.99 and abs(m["test"]["gap_to_train"]) < 0.02
    assert p.where(F.abs(F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-6).count() == 0
    top = c.importances().collect()
    assert {r["feature"] for r in top} == {"x", "y"} and abs(sum(r["importance"] for r in top) - 1) < 1e-6


def test_explanations_name_features(classes):
    p = classes.withColumn("predicted", F.col("label"))
    e = classify.fit_explainer(p, ["x", "y"])
    r = classify.explain(p, e, ["low", "middle", "high"]).where("label = 2").first()
    assert r["explanation"].startswith("Classified as high because: ") and len(r["contributions"]) == 2
    assert r["contributions"][0]["size"] >= r["contributions"][1]["size"]


def test_meta_learner_follows_truth(spark):
    i = F.col("id")
    df = spark.range(400).select(
        ((i % 100)).cast("double").alias("stat_score"), (i * 7 % 100).cast("double").alias("forest_score"),
        (i * 3 % 100).cast("double").alias("sequence_score"), (i % 100 >= 90).alias("truth"))
    s = classify.fit_meta_learner(df).score(df)
    m = {r["truth"]: r["avg(ensemble_score)"] for r in s.groupBy("truth").avg("ensemble_score").collect()}
    assert m[True] > 80 > 30 > m[False] and s.where("stat_score > 99 OR stat_score < 0").count() == 0


def test_ensemble_run_ranges(spark, small):
    t = telemetry(spark, small).where("volume_id <= 4")
    r = run_ensemble(t, trees=10)
    assert r.where("ensemble_score NOT BETWEEN 0 AND 100 OR n_agreeing NOT BETWEEN 0 AND 3").count() == 0
    assert r.where("is_anomaly AND (ensemble_score < 40 OR n_agreeing < 1)").count() == 0
    assert r.count() == r.select("volume_id", "ts").distinct().count()
    by_entity = run_ensemble(t, trees=5, by_entity=True)
    assert by_entity.select("volume_id").distinct().count() < 4


def test_rows_without_a_sequence_score_nothing(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "volume_id int, ts int")
    scored = spark.createDataFrame([(1, 2, 70.0, True)], "volume_id int, ts int, sequence_score double, sequence_flagged boolean")
    out = fusion.add_sequence_scores(rows, scored)
    assert {(r["volume_id"], r["ts"]): (r["sequence_score"], r["sequence_flagged"]) for r in out.collect()} == {
        (1, 1): (0.0, False), (1, 2): (70.0, True), (2, 1): (0.0, False)}
