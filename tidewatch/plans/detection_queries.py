"""Queries of the detectors and their summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewatch.functions.numeric import round_half_up as rnd
from tidewatch.functions.numeric import severity
from tidewatch.operators import fusion, statistical, summaries
from tidewatch.plans.data_queries import TRUTH_SQL as TRUTH_SQL_G
from tidewatch.plans.fixtures import R, T_SQL, cool, telemetry
from tidewatch.plans.registry import query
from tidewatch.roles import DETECTOR_METRICS
from tidewatch.session import shared_folder, stage
from tidewatch.sources import files


def _z_in(m: str) -> str:
    return (f"CASE WHEN COUNT(*) OVER f >= 12 AND STDDEV_POP({m}) OVER f >= 1e-6 "
            f"THEN ({m} - AVG({m}) OVER f) / STDDEV_POP({m}) OVER f ELSE 0 END AS {m}_z")


SCORES_SQL = f"""
z AS (SELECT *, {', '.join(_z_in(m) for m in DETECTOR_METRICS)},
    CASE WHEN COUNT(*) OVER f >= 12 THEN AVG(avg_latency_us) OVER f END AS base_latency
  FROM t WINDOW f AS (PARTITION BY volume_id ORDER BY ts ROWS BETWEEN 288 PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, GREATEST(avg_latency_us_z, read_latency_p99_us_z, write_latency_p99_us_z) AS latency_z,
    LEAST(100.0, GREATEST(0.0, (0.5*GREATEST(avg_latency_us_z, read_latency_p99_us_z, write_latency_p99_us_z)
      + 0.3*total_iops_z + 0.2*total_throughput_mbps_z)/7.0*100)) AS hotspot_score FROM z)
"""
SEV = ("CASE WHEN {0} < 40 THEN 'normal' WHEN {0} < 60 THEN 'warning' "
       "WHEN {0} < 80 THEN 'high' ELSE 'critical' END")
WITH_SCORES = f"WITH t AS ({T_SQL}), {SCORES_SQL}"


def scores(spark, d):
    return statistical.hotspot_scores(telemetry(spark, d), **cool(spark, d))


@query("hotspot_alerts_by_severity", f"""{WITH_SCORES}
SELECT {SEV.format('hotspot_score')} AS severity, COUNT(*) AS n,
  {R('AVG(hotspot_score)', 4)} AS mean_score FROM s WHERE hotspot_score >= 40 GROUP BY 1""")
def _(spark, d):
    return (scores(spark, d).where("hotspot_score >= 40")
            .groupBy(severity(F.col("hotspot_score")).alias("severity"))
            .agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("hotspot_score"), 4).alias("mean_score")))


@query("statistical_scores", f"""{WITH_SCORES}
SELECT volume_id, ts, {', '.join(R(m + '_z', 4) + f' AS {m}_z' for m in DETECTOR_METRICS)},
  {R('hotspot_score', 4)} AS hotspot_score FROM s""")
def _(spark, d):
    return scores(spark, d).select(
        "volume_id", "ts", *[rnd(F.col(f"{m}_z"), 4).alias(f"{m}_z") for m in DETECTOR_METRICS],
        rnd(F.col("hotspot_score"), 4).alias("hotspot_score"))


@query("statistical_alerts", f"""{WITH_SCORES}
SELECT volume_id, ts, {R('hotspot_score', 2)} AS hotspot_score, {SEV.format('hotspot_score')} AS severity,
  CONCAT_WS(',', {', '.join(f"CASE WHEN {m}_z > 3 THEN '{m}' END" for m in DETECTOR_METRICS)}) AS triggered,
  {R('latency_z', 2)} AS latency_z_score, {R('total_iops_z', 2)} AS iops_z_score,
  {R('base_latency', 2)} AS baseline_latency_us
FROM s WHERE hotspot_score >= 40""")
def _(spark, d):
    a = statistical.hotspot_alerts(scores(spark, d))
    return a.select(
        "volume_id", "ts", rnd(F.col("hotspot_score"), 2).alias("hotspot_score"), "severity",
        F.array_join("triggered_metrics", ",").alias("triggered"),
        rnd(F.col("details.latency_z_score"), 2).alias("latency_z_score"),
        rnd(F.col("details.iops_z_score"), 2).alias("iops_z_score"),
        rnd(F.col("details.baseline_latency_us"), 2).alias("baseline_latency_us"))


# --- normalisation, fusion, evaluation -------------------------------------------------

RAW_SQL = f"""{WITH_SCORES}, w AS (SELECT volume_id, ts, hotspot_score AS stat_score, -avg_latency_us AS raw_score, ABS(total_iops - 25.5) AS error,
  ts < (SELECT DATE_TRUNC('day', MIN(ts)) + INTERVAL 1500 DAY FROM t) AS train FROM s),
qa AS (SELECT QUANTILE_CONT(raw_score, 0.02) AS a, QUANTILE_CONT(raw_score, 0.05) AS b, QUANTILE_CONT(raw_score, 0.98) AS c,
  QUANTILE_CONT(error, 0.95) AS e95, QUANTILE_CONT(error, 0.99) AS e99 FROM w WHERE train),
nm AS (SELECT volume_id, ts, stat_score, train, LEAST(100, GREATEST(0, (c - raw_score)/(c - a)*100)) AS forest_score, raw_score < b AS forest_flagged,
  LEAST(100, GREATEST(0, error/e99*100)) AS sequence_score, error > e95 AS sequence_flagged FROM w, qa),
sq AS (SELECT volume_id, ts, stat_score, forest_score, forest_flagged, stat_score >= 40 AS stat_flagged,
  sequence_score, sequence_flagged FROM nm),
en AS (SELECT *, 0.35*stat_score + 0.35*forest_score + 0.30*sequence_score AS ensemble_score, stat_flagged::INT + forest_flagged::INT + sequence_flagged::INT AS n_agreeing FROM sq),
ez AS (SELECT *, ensemble_score >= 25 AND n_agreeing >= 2 AS is_anomaly FROM en)"""


def raw_scores(spark, d):
    """Stand-ins for the two fitted detectors, so fusion can be checked in SQL."""
    from tidewatch.operators.splits import chronological_split
    s = chronological_split(scores(spark, d), train_days=1500, val_days=300)
    return stage(s.select(
        "volume_id", "ts", F.col("hotspot_score").alias("stat_score"), (-F.col("avg_latency_us")).alias("raw_score"),
        F.abs(F.col("total_iops") - 25.5).alias("error"), (F.col("split") == "train").alias("train")), "scores")


def normalised(spark, d):
    w = raw_scores(spark, d)
    train = w.where("train")
    return fusion.normalise_errors(fusion.normalise_forest(w, train), train)


@query("detector_forest_normalisation", f"{RAW_SQL} SELECT volume_id, ts, {R('forest_score', 4)} AS forest_score, forest_flagged FROM nm")
def _(spark, d):
    w = raw_scores(spark, d)
    n = fusion.normalise_forest(w, w.where("train"))
    return n.select("volume_id", "ts", rnd(F.col("forest_score"), 4).alias("forest_score"), "forest_flagged")


@query("detector_error_normalisation", f"{RAW_SQL} SELECT volume_id, ts, {R('sequence_score', 4)} AS sequence_score, sequence_flagged FROM sq")
def _(spark, d):
    w = raw_scores(spark, d)
    n = fusion.normalise_errors(w, w.where("train"))
    out = fusion.add_sequence_scores(w.select("volume_id", "ts"), n)
    return out.select("volume_id", "ts", rnd(F.col("sequence_score"), 4).alias("sequence_score"), "sequence_flagged")


def fused(spark, d):
    n = normalised(spark, d)
    n = n.withColumn("ensemble_score", fusion.fuse(list(fusion.WEIGHTS))).withColumn("stat_flagged", F.col("stat_score") >= 40)
    return fusion.consensus(n, ["stat_flagged", "forest_flagged", "sequence_flagged"], 25.0, 2)


@query("detector_fusion", f"""{RAW_SQL} SELECT volume_id, ts, {R('ensemble_score', 4)} AS ensemble_score,
  {R('LEAST(100, GREATEST(0, 0.35*stat_score/0.7 + 0.35*forest_score/0.7))', 4)} AS without_sequence FROM en""")
def _(spark, d):
    f = fused(spark, d)
    return f.select("volume_id", "ts", rnd(F.col("ensemble_score"), 4).alias("ensemble_score"),
                    rnd(fusion.fuse(["stat_score", "forest_score"]), 4).alias("without_sequence"))


@query("detector_consensus_gate", f"""{RAW_SQL} SELECT volume_id, ts, n_agreeing, is_anomaly, CASE WHEN is_anomaly THEN {SEV.format('ensemble_score')} ELSE 'normal' END AS severity FROM ez""")
def _(spark, d):
    return fused(spark, d).select("volume_id", "ts", "n_agreeing", "is_anomaly", "severity")


@query("detector_alerts_by_agreement", f"{RAW_SQL} SELECT n_agreeing, COUNT(*) AS n, SUM(is_anomaly::INT) AS anomalies FROM ez WHERE n_agreeing >= 1 GROUP BY 1")
def _(spark, d):
    return fused(spark, d).where("n_agreeing >= 1").groupBy("n_agreeing").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_anomaly").alias("anomalies"))


@query("detector_flag_rates", f"""{RAW_SQL} SELECT d AS detector, SUM(f::INT) AS alerts, {R('AVG(f::INT)', 6)} AS rate FROM (
  SELECT UNNEST(['statistical', 'forest', 'sequence']) AS d, UNNEST([stat_flagged, forest_flagged, sequence_flagged]) AS f FROM ez) q GROUP BY 1""")
def _(spark, d):
    r = summaries.flag_rates(fused(spark, d), {"statistical": "stat_flagged", "forest": "forest_flagged", "sequence": "sequence_flagged"})
    return r.select("detector", "alerts", rnd(F.col("rate"), 6).alias("rate"))


EVAL = ("tp", "fp", "tn", "fn")


@query("detector_evaluation", f"""{RAW_SQL}, {TRUTH_SQL_G}, jj AS (SELECT truth, UNNEST(['statistical', 'forest', 'sequence']) AS detector,
  UNNEST([COALESCE(stat_score > 60, FALSE), COALESCE(forest_flagged, FALSE), COALESCE(sequence_flagged, FALSE)]) AS flag
  FROM g LEFT JOIN ez USING (volume_id, ts)),
cc AS (SELECT detector, SUM((truth AND flag)::INT) AS tp, SUM((NOT truth AND flag)::INT) AS fp, SUM((NOT truth AND NOT flag)::INT) AS tn, SUM((truth AND NOT flag)::INT) AS fn FROM jj GROUP BY 1),
pp AS (SELECT *, (tp+tn)::DOUBLE/(tp+fp+tn+fn) AS accuracy, COALESCE(tp::DOUBLE/NULLIF(tp+fp,0),0) AS precision, COALESCE(tp::DOUBLE/NULLIF(tp+fn,0),0) AS recall FROM cc)
SELECT detector, tp, fp, tn, fn, {R('accuracy', 6)} AS accuracy, {R('precision', 6)} AS precision, {R('recall', 6)} AS recall,
  {R('COALESCE(2*precision*recall/NULLIF(precision+recall,0),0)', 6)} AS f1 FROM pp""")
def _(spark, d):
    f = stage(fused(spark, d), "fused")
    e = fusion.evaluate_detectors(telemetry(spark, d), {
        "statistical": f.select("volume_id", "ts", (F.col("stat_score") > 60).alias("flag")),
        "forest": f.select("volume_id", "ts", F.col("forest_flagged").alias("flag")),
        "sequence": f.select("volume_id", "ts", F.col("sequence_flagged").alias("flag"))})
    return e.select("detector", *EVAL, *[rnd(F.col(c), 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("detector_scores_by_truth", f"""{WITH_SCORES}, {TRUTH_SQL_G} SELECT truth, COUNT(*) AS n, {R('AVG(hotspot_score)', 4)} AS mean, {R('MEDIAN(hotspot_score)', 4)} AS median
FROM g JOIN s USING (volume_id, ts) GROUP BY 1""")
def _(spark, d):
    from tidewatch.operators.splits import three_sigma_truth
    s = stage(three_sigma_truth(scores(spark, d)).select("truth", "hotspot_score"), "truth")
    s = summaries.score_by_truth(s, "hotspot_score", "truth")
    return s.select("truth", "n", rnd(F.col("mean"), 4).alias("mean"), rnd(F.col("median"), 4).alias("median"))


# --- sinks of nested results -----------------------------------------------------------

ALERT_ROWS = f"""{WITH_SCORES} SELECT volume_id, ts, {SEV.format('hotspot_score')} AS severity, {{extra}} FROM s WHERE hotspot_score >= 40"""


@query("sink_alerts_json", ALERT_ROWS.format(extra=f"""CONCAT_WS(',', {', '.join(f"CASE WHEN {m}_z > 3 THEN '{m}' END" for m in DETECTOR_METRICS)}) AS triggered, avg_latency_us AS current_latency_us"""))
def _(spark, d):
    """Nested alerts written as JSON and read back with their schema."""
    path = f"{shared_folder(spark)}/alerts-{uuid.uuid4().hex}"
    a = statistical.hotspot_alerts(scores(spark, d))
    files.write_json(a, path)
    back = spark.read.schema(a.schema).json(path)
    return back.select("volume_id", "ts", "severity", F.array_join("triggered_metrics", ",").alias("triggered"), "details.current_latency_us")


@query("sink_report_csv", ALERT_ROWS.format(extra=f"{R('hotspot_score', 4)} AS hotspot_score"))
def _(spark, d):
    """The flat columns of alerts written as CSV; the nested ones are dropped."""
    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    files.write_csv(statistical.hotspot_alerts(scores(spark, d)), path)
    back = files.read_csv(spark, path, "volume_id bigint, ts timestamp_ntz, hotspot_score double, severity string")
    return back.withColumn("hotspot_score", rnd(F.col("hotspot_score"), 4))
