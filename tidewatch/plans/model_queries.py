"""Queries of fitted models.

Fitted scores differ from fit to fit, so the SQL checks the rows and what must hold of
the scores: ranges, sums, agreement with the columns beside them.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tidewatch.operators import attribution, classify, drift, features, fusion, splits
from tidewatch.operators.forest import EULER, Forest, average_path, fit_forest
from tidewatch.operators.sequence_model import STEPS, fit_sequence_model, sequence_errors
from tidewatch.operators.windows import latest_rows
from tidewatch.plans.ensemble import MODEL_METRICS, run_ensemble
from tidewatch.plans.data_queries import LABEL_CASE, SPLIT_CASE
from tidewatch.plans.fixtures import CLASSES, E_SQL, EVENTS, R, RULE_COLUMNS, RULE_DEPTH, RULE_SQL, RULE_TREES, T_SQL, events, rule_inside_sql, rule_nodes, table, telemetry
from tidewatch.functions.numeric import round_half_up as rnd
from tidewatch.plans.registry import query
from tidewatch.session import stage

KEYS = ["volume_id", "ts"]


def staged(spark, d):
    return stage(telemetry(spark, d), "telemetry")


def between(column, low: float, high: float):
    """Whether a fitted figure is there and in its range."""
    return F.coalesce(F.col(column).between(low, high), F.lit(False))


@query("detector_isolation_forest", f"SELECT volume_id, ts, TRUE AS in_range FROM ({T_SQL}) t")
def _(spark, d):
    t = staged(spark, d)
    train = splits.chronological_split(t, train_days=1500, val_days=300).where("split = 'train'")
    forest = fit_forest(train, MODEL_METRICS, KEYS)
    return t.select("volume_id", "ts", forest.score(spark).alias("raw_score")).select("volume_id", "ts", between("raw_score", -1, 0).alias("in_range"))


@query("detector_sequence_errors", f"SELECT volume_id, ts, TRUE AS in_range FROM ({T_SQL}) t QUALIFY ROW_NUMBER() OVER (PARTITION BY volume_id ORDER BY ts) >= {STEPS}")
def _(spark, d):
    t = staged(spark, d)
    train = splits.chronological_split(t, train_days=1500, val_days=300).where("split = 'train'")
    errors = sequence_errors(t, fit_sequence_model(train, MODEL_METRICS))
    return errors.select("volume_id", "ts", between("error", 0, 1e12).alias("in_range"))


def ensemble_results(spark, d):
    return run_ensemble(telemetry(spark, d))


#: The rows after the first 70 % of the time span.
LATER_SQL = f"""t AS ({T_SQL}), z AS (SELECT MIN(ts) AS a, MAX(ts) AS b FROM t),
later AS (SELECT t.* FROM t, z WHERE DATE_DIFF('second', a, ts) >= DATE_DIFF('second', a, b) * 0.7)"""
SCORED = ["stat_score", "forest_score", "sequence_score", "ensemble_score"]


def held(df):
    """Keys, and whether scores are in range and the gate follows from the columns beside it."""
    flags = sum((F.coalesce(F.col(f"{c}_flagged"), F.lit(False)).cast("int") for c in ("stat", "forest", "sequence")), F.lit(0))
    fine = F.lit(True)
    for c in SCORED:
        fine = fine & (F.col(c).isNull() | F.col(c).between(0, 100))
    gate = F.col("is_anomaly") == ((F.col("ensemble_score") >= 40) & (F.col("n_agreeing") >= 1))
    return df.select(*KEYS, fine.alias("in_range"), (flags == F.col("n_agreeing")).alias("agreement_ok"), gate.alias("gate_ok"),
                     (F.col("is_anomaly") == (F.col("severity") != "normal")).alias("severity_ok"))


HELD_SQL = f"WITH {LATER_SQL} SELECT volume_id, ts, TRUE AS in_range, TRUE AS agreement_ok, TRUE AS gate_ok, TRUE AS severity_ok FROM later"


@query("detector_ensemble_run", HELD_SQL)
def _(spark, d):
    return held(ensemble_results(spark, d))


@query("detector_meta_learner", HELD_SQL)
def _(spark, d):
    truth = splits.three_sigma_truth(telemetry(spark, d)).select("volume_id", "ts", "truth")
    labelled = stage(ensemble_results(spark, d).join(truth, KEYS), "labelled")
    meta = classify.fit_meta_learner(labelled)
    return held(fusion.consensus(meta.score(labelled), ["stat_flagged", "forest_flagged", "sequence_flagged"]))


def class_table(spark, d):
    e = features.calendar_features(splits.chronological_split(events(spark, d)))
    return e.withColumn("label", features.encode_label("workload_type", {c: i for i, c in enumerate(CLASSES)}))


CLASS_COLUMNS = ["total_iops", "avg_latency_us", "hour", "day_of_week", "hour_sin", "hour_cos"]


@query("classify_workload", f"WITH e AS ({E_SQL}) SELECT event_id, {SPLIT_CASE} AS split, {LABEL_CASE} AS label, TRUE AS known_class, TRUE AS sums_to_one, TRUE AS top_is_largest FROM e")
def _(spark, d):
    t = class_table(spark, d)
    c = classify.fit_classifier(t.where("split = 'train'"), CLASS_COLUMNS, trees=20, depth=5)
    p = c.predict(t)
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x)
    return p.select("event_id", "split", "label", F.col("predicted").isin(*range(len(CLASSES))).alias("known_class"), (F.abs(total - 1) < 1e-9).alias("sums_to_one"),
                    (F.get("probabilities", F.col("predicted").cast("int")) == F.array_max("probabilities")).alias("top_is_largest"))


@query("classify_tuned_split_metrics", f"WITH e AS ({E_SQL}) SELECT DISTINCT {SPLIT_CASE} AS split, TRUE AS in_range FROM e")
def _(spark, d):
    t = class_table(spark, d)
    c, _ = classify.tune_classifier(t.where("split = 'train'"), t.where("split = 'val'"), CLASS_COLUMNS, trees=(10, 20), depths=(3, 5))
    return classify.split_metrics(c.predict(t)).select("split", (between("accuracy", 0, 1) & between("gap_to_train", -1, 1)).alias("in_range"))


@query("classify_halving_rungs", "SELECT UNNEST([0, 1]) AS rung, UNNEST([5, 15]) AS trees, UNNEST([9, 3])::BIGINT AS tried, UNNEST([3, 1])::BIGINT AS kept, TRUE AS best_go_on")
def _(spark, d):
    t = class_table(spark, d)
    grid = [{"depth": depth, "min_rows": rows, "subset": "sqrt"} for depth in (5, 8, 10) for rows in (1, 20, 100)]
    _, trials = classify.tune_by_halving(t.where("split = 'train'"), t.where("split = 'val'"), CLASS_COLUMNS, grid=grid)
    rows = spark.createDataFrame([(x["rung"], x["trees"], x["weighted_f1"], x["kept"]) for x in trials], "rung int, trees int, f1 double, kept boolean")
    best = F.min(F.when(F.col("kept"), F.col("f1"))) >= F.coalesce(F.max(F.when(~F.col("kept"), F.col("f1"))), F.lit(0.0))
    return rows.groupBy("rung", "trees").agg(F.count(F.lit(1)).alias("tried"), F.count_if("kept").alias("kept"), best.alias("best_go_on"))


@query("rank_feature_importance", "SELECT UNNEST(['total_iops', 'avg_latency_us', 'hour', 'day_of_week', 'hour_sin', 'hour_cos']) AS feature, TRUE AS in_range, TRUE AS sums_to_one")
def _(spark, d):
    t = class_table(spark, d).where("split = 'train'")
    ranked = classify.fit_classifier(t, CLASS_COLUMNS, trees=20, depth=5).importances()
    total = ranked.agg(F.sum("importance")).scalar()
    return ranked.select("feature", between("importance", 0, 1).alias("in_range"), (F.abs(total - 1) < 1e-9).alias("sums_to_one"))


@query("classify_explanations", f"SELECT event_id, {len(CLASS_COLUMNS)}::INT AS parts, TRUE AS named, TRUE AS largest_first FROM events")
def _(spark, d):
    t = class_table(spark, d)
    c = classify.fit_classifier(t.where("split = 'train'"), CLASS_COLUMNS, trees=20, depth=5)
    predicted = stage(c.predict(t), "predicted")
    explainer = classify.fit_explainer(predicted.where("split = 'train'"), CLASS_COLUMNS)
    return classify.explain(predicted, explainer, CLASSES).select(
        "event_id", F.size("contributions").alias("parts"),
        F.col("explanation").startswith(F.concat(F.lit("Classified as "), F.get(F.array(*[F.lit(c) for c in CLASSES]), F.col("predicted").cast("int")))).alias("named"),
        (F.get("contributions", F.lit(0)) == F.array_max("contributions")).alias("largest_first"))


@query("view_volume_classes", "SELECT DISTINCT user_id AS volume_id, TRUE AS sums_to_one, TRUE AS agreement_ok FROM events")
def _(spark, d):
    t = class_table(spark, d)
    train = t.where("split = 'train'")
    first = classify.fit_classifier(train, CLASS_COLUMNS, trees=20, depth=5)
    second = classify.fit_classifier(train, CLASS_COLUMNS, trees=20, depth=3, seed=7)
    newest = latest_rows(t, EVENTS)
    out = first.predict(newest).join(
        second.predict(newest).select("volume_id", F.col("predicted").alias("second")), "volume_id")
    out = out.select("volume_id", "predicted", "probabilities", "second", (F.col("predicted") == F.col("second")).alias("agrees"))
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x)
    return out.select("volume_id", (F.abs(total - 1) < 1e-9).alias("sums_to_one"), (F.col("agrees") == (F.col("predicted") == F.col("second"))).alias("agreement_ok"))


# --- models in a table -------------------------------------------------------------------

#: The events with the stored forest's columns x0 .. x3.
RULE_ROWS = f"ev AS (SELECT event_id, total_iops AS x0, avg_latency_us AS x1, HOUR(ts)::DOUBLE AS x2, (ISODOW(ts) - 1)::DOUBLE AS x3 FROM ({E_SQL}) e)"


def rule_rows(spark, d):
    return features.calendar_features(events(spark, d)).select("event_id", *[F.col(c).cast("double").alias(c) for c in RULE_COLUMNS])


def stored_forest() -> Forest:
    """The stored nodes as an isolation forest: a leaf's path is its depth and what its rows would add."""
    trees = []
    for t in range(RULE_TREES):
        nodes = [n for n in rule_nodes() if n["tree"] == t]
        trees.append((np.array([n["feature"] for n in nodes]), np.array([n["cut"] or 0.0 for n in nodes]), np.array([n["left"] for n in nodes]),
                      np.array([RULE_DEPTH + average_path(n["cover"]) if n["feature"] < 0 else 0.0 for n in nodes])))
    return Forest(list(RULE_COLUMNS), trees, 256.0)


def path_sql(n: str) -> str:
    return f"CASE WHEN {n} <= 1 THEN 0 WHEN {n} = 2 THEN 1 ELSE 2*(LN({n} - 1) + {EULER}::DOUBLE) - 2*({n} - 1)::DOUBLE/{n} END"


@query("detector_forest_scores", f"""WITH {RULE_SQL}, {RULE_ROWS}
SELECT event_id, {R(f"-POW(2, -SUM({RULE_DEPTH} + {path_sql('n')})/{RULE_TREES}/({path_sql('256.0::DOUBLE')}))", 6)} AS raw_score
FROM ev, rl WHERE {' AND '.join(rule_inside_sql(f, f'x{f}') for f in range(len(RULE_COLUMNS)))} GROUP BY event_id""")
def _(spark, d):
    rows = rule_rows(spark, d)
    return rows.select("event_id", rnd(stored_forest().score(spark), 6).alias("raw_score"))


_N = len(RULE_COLUMNS)
_SHAPLEY = ", ".join(
    R(f"SUM(CASE WHEN (s >> {f}) & 1 = 1 THEN {{w}} * v ELSE -{{u}} * v END)", 6).replace(
        "{w}", "[" + ", ".join(f"{math.factorial(k) * math.factorial(_N - 1 - k) / math.factorial(_N)!r}::DOUBLE" for k in range(_N)) + "][greatest(BIT_COUNT(s::INT), 1)]").replace(
        "{u}", "[" + ", ".join(f"{math.factorial(k) * math.factorial(_N - 1 - k) / math.factorial(_N)!r}::DOUBLE" for k in range(_N)) + "][least(BIT_COUNT(s::INT) + 1, 4)]") + f" AS {c}"
    for f, c in enumerate(RULE_COLUMNS))


@query("classify_attributions", f"""WITH {RULE_SQL}, {RULE_ROWS},
fx AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN p ELSE 1 - p END AS value, {', '.join(f"CASE WHEN {rule_inside_sql(f, f'x{f}')} THEN 1 ELSE 0 END AS o{f}, z{f}" for f in range(_N))} FROM ev, rl),
vs AS (SELECT event_id, s, SUM(value * {' * '.join(f'(CASE WHEN (s >> {f}) & 1 = 1 THEN o{f} ELSE z{f} END)' for f in range(_N))})/{RULE_TREES} AS v FROM fx, (SELECT UNNEST(RANGE(0, {1 << _N})) AS s) s GROUP BY 1, 2)
SELECT event_id, {R(f'SUM(v) FILTER (WHERE s = 0)', 6)} AS base, {R(f'SUM(v) FILTER (WHERE s = {(1 << _N) - 1})', 6)} AS probability, {_SHAPLEY} FROM vs GROUP BY 1""")
def _(spark, d):
    nodes = spark.createDataFrame([tuple(n.values()) for n in rule_nodes()], attribution.NODES)
    out = attribution.attribute(rule_rows(spark, d).withColumn("target", F.col("event_id") % 2), nodes, list(RULE_COLUMNS), "target")
    return out.select("event_id", rnd(F.col("base"), 6).alias("base"), rnd(F.col("probability"), 6).alias("probability"),
                      *[rnd(F.get("contribution", F.lit(i)), 6).alias(c) for i, c in enumerate(RULE_COLUMNS)])


@query("classify_attribution_sums", f"SELECT event_id, {len(CLASS_COLUMNS)}::INT AS parts, TRUE AS of_the_model, TRUE AS sums_up, TRUE AS largest_first FROM events")
def _(spark, d):
    t = class_table(spark, d)
    c = classify.fit_classifier(t.where("split = 'train'"), CLASS_COLUMNS)
    out = attribution.explained(attribution.attribute(c.predict(t), attribution.forest_nodes(c.model), CLASS_COLUMNS, "predicted"), CLASS_COLUMNS, CLASSES)
    total = F.aggregate("contribution", F.lit(0.0), lambda a, x: a + x)
    return out.select("event_id", F.size("contributions").alias("parts"),
                      (F.abs(F.get("probabilities", F.col("predicted")) - F.col("probability")) < 1e-9).alias("of_the_model"),
                      (F.abs(F.col("base") + total - F.col("probability")) < 1e-9).alias("sums_up"),
                      (F.get("contributions", F.lit(0)) == F.array_max("contributions")).alias("largest_first"))


#: Predictions that get worse in the second half of the month, and worse still for two classes.
_HIT = "CASE WHEN DAY(ts) <= 15 THEN event_id % 7 <> 0 WHEN event_type IN ('click', 'view') THEN event_id % 2 <> 0 ELSE event_id % 6 <> 0 END"


@query("classify_drift_windows", f"""WITH RECURSIVE b AS (SELECT event_type AS truth, DATE_TRUNC('day', ts)::TIMESTAMP AS bucket, COUNT(*) AS n, COUNT_IF({_HIT})::DOUBLE AS hits FROM events GROUP BY 1, 2),
i AS (SELECT *, ROW_NUMBER() OVER w AS i, SUM(n) OVER w AS cn, SUM(hits) OVER w AS cs FROM b WINDOW w AS (PARTITION BY truth ORDER BY bucket)),
z AS (SELECT truth, i, cn, cs FROM i UNION ALL SELECT DISTINCT truth, 0, 0, 0 FROM i),
c AS (SELECT a.truth, a.i AS a, e.i AS e, (m.cn - a.cn)::DOUBLE AS n0, (m.cs - a.cs)::DOUBLE AS s0, (e.cn - m.cn)::DOUBLE AS n1, (e.cs - m.cs)::DOUBLE AS s1
  FROM z a JOIN z m ON m.truth = a.truth AND m.i > a.i JOIN z e ON e.truth = a.truth AND e.i > m.i),
k AS (SELECT *, n0*n1/(n0 + n1) AS part, (s0 + s1)/(n0 + n1) AS mean, LN(2*LN(GREATEST(n0 + n1, 3))/{drift.DELTA}::DOUBLE) AS weight FROM c),
bad AS (SELECT DISTINCT truth, a, e FROM k WHERE ABS(s0/n0 - s1/n1) > SQRT(2/part*mean*(1 - mean)*weight) + 2/(3*part)*weight),
fine AS (SELECT a.truth, e.i AS e, LIST(a.i) AS l FROM z a JOIN z e ON e.truth = a.truth AND e.i > a.i ANTI JOIN bad ON bad.truth = a.truth AND bad.a = a.i AND bad.e = e.i GROUP BY 1, 2),
r AS (SELECT DISTINCT truth, 0::BIGINT AS e, 0::BIGINT AS a FROM i
  UNION ALL SELECT r.truth, f.e, LIST_MIN(LIST_FILTER(f.l, lambda x: x >= r.a)) FROM r JOIN fine f ON f.truth = r.truth AND f.e = r.e + 1),
g AS (SELECT truth, e, a, LAG(a, 1, 0) OVER (PARTITION BY truth ORDER BY e) AS was FROM r)
SELECT i.truth, i.bucket, i.n, i.hits, (i.cn - z.cn)::BIGINT AS window_n, {R('(i.cs - z.cs)::DOUBLE/(i.cn - z.cn)::DOUBLE', 6)} AS window_mean, g.a > g.was AS drift
FROM i JOIN g ON g.truth = i.truth AND g.e = i.i JOIN z ON z.truth = i.truth AND z.i = g.a""")
def _(spark, d):
    e = table(spark, d, "events")
    hit = F.expr("CASE WHEN day(ts) <= 15 THEN event_id % 7 <> 0 WHEN event_type IN ('click', 'view') THEN event_id % 2 <> 0 ELSE event_id % 6 <> 0 END")
    told = e.select("ts", F.col("event_type").alias("truth"), F.when(hit, F.col("event_type")).otherwise("none").alias("predicted"))
    out = drift.adaptive_windows(told, "truth", "predicted", ["truth"])
    return out.withColumn("window_mean", rnd(F.col("window_mean"), 6))
