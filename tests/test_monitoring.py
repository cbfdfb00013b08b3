"""Evaluation edge cases, drift verdicts, health, alerts, time series."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtide.operators import alerts, drift, evaluation, experiments, health, series
from loomtide.plans import monitoring

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(7)
    rows = []
    for model, shift in (("calm", 0.0), ("moved", 10.0)):
        for side, n in (("reference", 200), ("current", 100)):
            move = shift if side == "current" else 0.0
            for i in range(n):
                y = int(rng.integers(0, 2))
                rows.append((model, side, float(rng.normal(move, 1 + move / 2)), "new" if move and i % 2 else "abc"[i % 3], i % 2 == 0, y, y))
    return spark.createDataFrame(rows, "model_name string, dataset string, x double, c string, b boolean, target int, prediction int")


def test_auto_methods_and_verdicts(pairs):
    stats = drift.drift_statistics(pairs, ["x"], ["c", "b"], ["model_name"])
    tests = F.when(F.col("column_name") == "b", "z").otherwise(drift.method_by_kind("ks", "chi_square"))
    got = {(r["model_name"], r["column_name"]): r for r in drift.drift_scores(stats, tests, by=["model_name"]).collect()}
    assert got["calm", "x"]["method"] == "ks" and got["calm", "c"]["method"] == "chi_square" and got["calm", "b"]["method"] == "z"
    assert not any(r["drift_detected"] for (m, _), r in got.items() if m == "calm")
    assert got["moved", "x"]["drift_detected"] and got["moved", "c"]["drift_detected"] and not got["moved", "b"]["drift_detected"]
    assert got["moved", "c"]["drift_score"] == 0.0  # a category the reference does not have


def test_monitoring_of_all_models_at_once(spark, pairs, tmp_path):
    models = spark.createDataFrame([("calm",), ("moved",), ("silent",)], "model_name string")
    out = monitoring.run_checks(
        models, pairs, F.lit(T0), ["x"], ["c", "b"], "target", "prediction", history=str(tmp_path / "runs")
    )
    got = {r["model_name"]: r for r in out.collect()}
    assert got["calm"]["health_status"] == "healthy" and got["calm"]["current_f1"] == 1.0
    assert got["moved"]["health_status"] == "critical" and got["moved"]["drifted_columns"] == ["c", "x"]
    assert got["silent"]["status"] == "skipped"
    assert health.check_summary(out).first().asDict() == {"total": 3, "completed": 2, "healthy": 1, "warning": 0, "critical": 1, "errors": 0}
    monitoring.run_checks(models, pairs, F.lit(T0 + timedelta(hours=1)), ["x"], [], history=str(tmp_path / "runs")).count()
    for _ in range(2):  # a repeated run replaces its records
        monitoring.run_checks(models, pairs, F.lit(T0 + timedelta(hours=1)), ["x"], [], history=str(tmp_path / "runs")).count()
    history = spark.read.parquet(str(tmp_path / "runs"))
    assert history.groupBy("model_name").count().where("count = 2").count() == 2
    health.export_latest_json(history, str(tmp_path / "latest"))
    assert spark.read.json(str(tmp_path / "latest")).count() == 2
    with pytest.raises(ValueError):
        health.export_latest_json(history.where("false"), str(tmp_path / "none"))


@pytest.mark.parametrize("drifted, share, loss, want", [
    (True, 0.51, 0, "critical"), (True, 0.31, 0, "warning"), (True, 0.5, 0, "warning"), (True, 0.3, 0, "healthy"),
    (False, 0.9, 0, "healthy"), (False, 0.9, 20.1, "critical"), (None, None, 20.0, "warning"), (None, None, 10.0, "healthy"),
    (True, 0.2, 11.0, "warning"), (None, None, None, "unknown"), (False, 0.0, None, "healthy"),
])
def test_health_limits(spark, drifted, share, loss, want):
    row = spark.createDataFrame([(drifted, share, None if loss is None else float(loss))], "d boolean, s double, l double")
    assert row.select(health.health_status(F.col("d"), F.col("s"), F.col("l"))).first()[0] == want


def test_empty_current_is_no_drift(pairs):
    stats = drift.drift_statistics(pairs.where("dataset = 'reference'"), ["x"], ["c"], ["model_name"])
    scores = drift.drift_scores(stats, by=["model_name"])
    assert all(r["drift_score"] is None and r["drift_detected"] is None for r in scores.collect())
    assert {tuple(r) for r in drift.drift_summary(scores, ["model_name"]).select("number_of_columns", "drift_share", "dataset_drift").collect()} == {(0, None, None)}


def test_metrics_edge_cases(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "b")], "y string, p string")
    m = evaluation.classification_metrics(evaluation.confusion_matrix(df, "y", "p")).first()
    assert (m["accuracy"], m["precision"], m["recall"]) == pytest.approx((1 / 3, 1.0, 1 / 3))
    one = evaluation.roc_auc(df.withColumn("s", F.lit(1.0)), F.col("y") == "a", "s").first()
    assert one["roc_auc"] is None
    zero = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "t double, p double")
    assert evaluation.regression_metrics(zero, "t", "p").first()["mape"] is None
    with pytest.raises(ValueError):
        evaluation.classification_metrics(evaluation.confusion_matrix(df, "y", "p"), average="odd")
    stats = evaluation.inference_stats(spark.createDataFrame([], "predictions long, seconds double, failed boolean")).first()
    assert stats["error_rate"] == 0 and stats["seconds_per_prediction"] == 0


def test_counter_reset_and_rate(spark):
    rows = [("s", T0 + timedelta(seconds=60 * i), float(v)) for i, v in enumerate([0, 5, 9, 2, 4])]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    d = series.counter_deltas(df, ["k"], "ts", "v")
    assert [r["delta"] for r in d.orderBy("ts").collect()] == [0, 5, 4, 2, 2]
    got = {r["eval_ts"]: r["increase"] for r in series.increase(d, ["k"], "ts", 120, 60).collect()}
    # the window is open on the left: the sample two minutes back does not count
    assert got[T0 + timedelta(minutes=2)] == 9 and got[T0 + timedelta(minutes=3)] == 6
    assert max(got) == T0 + timedelta(minutes=5)
    with pytest.raises(ValueError):
        series.increase(d, ["k"], "ts", 100, 60)


def test_histogram_edges(spark):
    b = spark.createDataFrame(
        [("top", 1.0, 0), ("top", 2.0, 0), ("top", float("inf"), 4), ("none", 1.0, 0), ("none", float("inf"), 0),
         ("low", 1.0, 4), ("low", 2.0, 4), ("low", float("inf"), 4)], "k string, le double, n long")
    got = {r["k"]: r["q"] for r in series.histogram_quantile(b, ["k"], {"q": 0.5}).collect()}
    assert got == {"top": 2.0, "none": None, "low": 0.5}


def test_alert_states_and_gap(spark):
    on = [1, 1, 0, 1, 1, 1]
    rows = [("s", T0 + timedelta(minutes=i + (60 if i > 4 else 0)), bool(v)) for i, v in enumerate(on)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, active boolean")
    plain = [r["state"] for r in alerts.alert_states(df, ["k"], "ts", for_seconds=60).orderBy("ts").collect()]
    assert plain == ["pending", "firing", "inactive", "pending", "firing", "firing"]
    broken = alerts.alert_states(df, ["k"], "ts", for_seconds=60, max_gap_seconds=120).orderBy("ts").collect()
    assert broken[-1]["state"] == "pending" and broken[-1]["since"] == rows[-1][1]


def test_threshold_met_exactly_and_matchers(spark):
    df = spark.createDataFrame([(0.3, {"job": "mlflow-server", "status": "503"})], "v double, l map<string,string>")
    row = df.select(
        series.threshold(F.col("v"), ">", 0.3), series.threshold(F.col("v"), "==", 0.3),
        series.matches(F.col("l"), {"status": "~5.."}), series.matches(F.col("l"), {"job": "~server"}),
        series.matches(F.col("l"), {"absent": "x"}),
    ).first()
    assert list(row) == [False, True, True, False, False]


def test_catalogue_on_derived_series(spark):
    rows = [("http_requests:error_ratio_5m", {"job": job}, T0 + timedelta(minutes=5 * i), v)
            for job, v in (("kserve", 0.2), ("mlflow-server", 0.01)) for i in range(3)]
    rows += [("ml_model_accuracy", {"model_name": "m"}, T0 + timedelta(minutes=10 * i), 0.6) for i in range(2)]
    samples = spark.createDataFrame(rows, "metric string, labels map<string,string>, ts timestamp_ntz, value double")
    evals = alerts.evaluate_rules(samples).withColumn("series", series.series_key(F.col("labels")))
    states = alerts.alert_states(evals, ["rule", "metric", "series"], "ts", for_seconds=F.col("for_seconds"))
    got = {(r["rule"], r["series"]) for r in states.where("state = 'firing'").collect()}
    assert got == {("KServeHighErrorRate", "job=kserve"), ("LowModelAccuracy", "model_name=m"), ("ModelRetrainingRequired", "model_name=m")}


def test_conditions_are_trees(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    rows = [("ml_data_drift_share", {"model_name": "m"}, at(i), v) for i, v in ((0, 0.5), (10, 0.1), (20, 0.1), (30, None))]
    rows += [("ml_model_accuracy", {"model_name": "m"}, at(i), v) for i, v in ((10, 0.6), (20, 0.9))]
    rows += [("kserve_canary_traffic_percent", {"traffic_percent": p, "inference_service": s}, at(i), float(p))
             for p, s in (("10", "a"), ("10", "b"), ("50", "a"), ("10", "c")) for i in (0, 10)]
    start = at(-61).timestamp()
    rows += [("kserve_canary_deployment_start_time", {"inference_service": "a", "pod": "x"}, at(i), start) for i in (0, 10)]
    rows += [("kserve_canary_deployment_start_time", {"inference_service": "a", "pod": "y"}, at(i), start + 9e3) for i in (0, 10)]
    rows += [("kserve_canary_deployment_start_time", {"inference_service": "b"}, at(i), start + 300) for i in (0, 10)]
    samples = spark.createDataFrame(rows, "metric string, labels map<string,string>, ts timestamp_ntz, value double")
    evals = alerts.evaluate_conditions(samples)
    states = alerts.alert_states(evals, ["group", "rule", "series"], "ts", for_seconds=F.col("for_seconds"))
    got = {}
    for r in states.orderBy("ts").collect():
        got.setdefault((r["rule"], r["series"]), []).append(r["state"])
    # one timer over both parts: drift at first, accuracy after that
    assert got["ModelRetrainingRequired", "model_name=m"] == ["pending", "firing", "inactive", "inactive"]
    canary = {k[1]: v for k, v in got.items() if k[0] == "CanaryDeploymentStuck"}
    assert canary == {
        "inference_service=a,traffic_percent=10": ["pending", "firing"],
        "inference_service=b,traffic_percent=10": ["inactive", "pending"],
        "inference_service=c,traffic_percent=10": ["inactive", "inactive"],
    }
    own = alerts.Alert("g", "n", alerts.Compare("m", ">", 1.0, {"job": "~a.c", "zone": ""}), 0, "warning", None)
    other = [("m", {"job": j}, at(0), 2.0) for j in ("abc", "xabc", "ac")] + [("m", {"job": "abc", "zone": "z"}, at(0), 2.0)]
    found = alerts.evaluate_conditions(spark.createDataFrame(other, samples.schema), [own]).collect()
    assert [(r["series"], r["active"]) for r in found] == [("job=abc", True)]
    with pytest.raises(ValueError):
        alerts.evaluate_conditions(samples, [alerts.Alert("g", "n", alerts.Or((alerts.Or(()),)), 0, "warning", None)])


def test_routing_and_inhibition(spark):
    schema = "alertname string, namespace string, severity string, category string"
    df = spark.createDataFrame([
        ("A", "n", "critical", "ml_monitoring"), ("A", "n", "warning", "ml_monitoring"), ("B", "n", "warning", "x"),
        ("C", "m", "info", "x"), ("MonitoringServiceDown", "q", "critical", "x"), ("D", "q", "critical", "x"),
    ], schema)
    kept = {(r["alertname"], r["severity"]) for r in alerts.inhibit(df).collect()}
    assert kept == {("A", "critical"), ("B", "warning"), ("C", "info"), ("MonitoringServiceDown", "critical")}
    routed = {}
    for r in alerts.route(df).collect():
        routed.setdefault((r["alertname"], r["severity"]), []).append(r["receiver"])
    assert routed["A", "critical"] == ["pagerduty-critical", "slack-mlops"]
    assert routed["B", "warning"] == ["slack-notifications"] and routed["C", "info"] == ["slack-notifications"]


def test_experiment_decisions(spark):
    rng = np.random.default_rng(42)
    rows = [(float(a), float(b)) for a, b in zip(rng.normal(0.85, 0.02, 100), rng.normal(0.87, 0.02, 100))]
    wide = spark.createDataFrame(rows, "m_a double, m_b double")
    tested = experiments.welch_test(experiments.variant_summary(wide, "m"))
    assert experiments.winner(tested, "old", "new").first()["better_model"] == "new"
    few = experiments.welch_test(experiments.variant_summary(wide.limit(19), "m"))
    row = experiments.winner(few, "old", "new").first()
    assert (row["better_model"], row["p_value"], row["t"]) == ("none", 1.0, None)
    models = spark.createDataFrame([("m", -1.0, True)], "model_name string, current_accuracy double, drift_detected boolean")
    assert experiments.retrain_decision(models).first()["reasons"] == ["low_accuracy", "no_evaluation", "drift"]
