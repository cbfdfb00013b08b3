"""Model health: monitoring runs, their history, metric export, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtide.functions.columns import join_on
from loomtide.operators import drift, evaluation, profile
from loomtide.operators.ordered import carry_forward

MODEL = ("model_name", "model_version")


def health_status(dataset_drift: Column, drift_share: Column, degradation: Column) -> Column:
    """critical, warning or healthy from the drift share (only with dataset drift), then from degradation.

    Without a drift verdict and without a degradation nothing is known: unknown, never healthy.
    """
    drifted = F.coalesce(dataset_drift, F.lit(False))
    share, loss = F.coalesce(drift_share, F.lit(0.0)), F.coalesce(degradation, F.lit(0.0))
    return (
        F.when(drifted & (share > 0.5), "critical")
        .when(drifted & (share > 0.3), "warning")
        .when(loss > 20, "critical")
        .when(loss > 10, "warning")
        .when(dataset_drift.isNull() & degradation.isNull(), "unknown")
        .otherwise("healthy")
    )


def health_value(status: Column) -> Column:
    """0 healthy or unknown, 1 warning, 2 critical."""
    return F.when(status == "critical", 2).when(status == "warning", 1).otherwise(0).cast("double")


def monitoring_run(
    df: DataFrame,
    run_ts: Column,
    numeric: Sequence[str],
    categorical: Sequence[str],
    label: str | None = None,
    prediction: str | None = None,
    model_type: str = "classification",
    by: Sequence[str] = ("model_name",),
    dataset: str = "dataset",
    average: str = "macro",
    method: Column | None = None,
    methods: Sequence[str] | None = None,
) -> DataFrame:
    """One monitoring record per model: drift, missing values, performance against the reference, health.

    ``method`` and ``methods`` are those of ``drift_scores``. ``df`` holds reference and current rows of every model, a
    null name is a model; performance is left out without a label column. What could not be tested stays null.
    """
    by = list(by)
    current = df.where(F.col(dataset) == drift.CURRENT)
    statistics = drift.drift_statistics(df, numeric, categorical, by, dataset)
    scores = drift.drift_scores(statistics, method, by=by, methods=methods)
    record = drift.drift_summary(scores, by)
    gaps = profile.missing_values(current, [*numeric, *categorical], by)
    record = join_on(gaps, record, by, "left")
    performance: list[Column] = []
    loss = F.lit(None).cast("double")
    if label and prediction and label in df.columns:
        if model_type == "classification":
            matrix = evaluation.confusion_matrix(df, label, prediction, [*by, dataset])
            metrics = evaluation.classification_metrics(matrix, [*by, dataset], average)
            names, main = ["accuracy", "precision", "recall", "f1"], "f1"
        else:
            metrics = evaluation.regression_metrics(df, label, prediction, [*by, dataset])
            names, main = ["rmse", "mae", "r2"], "r2"
        side = lambda name, which: F.max(F.when(F.col(dataset) == which, F.col(name)))
        wide = metrics.groupBy(*by).agg(
            *[side(n, drift.CURRENT).alias(f"current_{n}") for n in names],
            side(main, drift.REFERENCE).alias(f"reference_{main}"),
        )
        record = join_on(record, wide, by, "left")
        loss = evaluation.degradation(F.col(f"reference_{main}"), F.col(f"current_{main}"))
        performance = [F.col(f"current_{n}") for n in names] + [F.col(f"reference_{main}")]
    return record.select(
        *by,
        run_ts.alias("run_ts"),
        F.lit(model_type).alias("model_type"),
        F.col("n_rows").alias("samples_analyzed"),
        "dataset_drift",
        "drift_share",
        F.coalesce("number_of_drifted_columns", F.lit(0)).alias("number_of_drifted_columns"),
        "drifted_columns",
        "share_missing",
        *performance,
        loss.alias("performance_degradation"),
        health_status(F.col("dataset_drift"), F.col("drift_share"), loss).alias("health_status"),
    )


# fixed values: exported gauge name and the run column it comes from
GAUGES = {
    "ml_data_drift_share": "drift_share",
    "ml_drifted_columns_count": "number_of_drifted_columns",
    "ml_missing_values_share": "share_missing",
    "ml_model_accuracy": "current_accuracy",
    "ml_model_f1_score": "current_f1",
    "ml_model_precision": "current_precision",
    "ml_model_recall": "current_recall",
    "ml_performance_degradation_percent": "performance_degradation",
}


def metric_samples(runs: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Samples (ts, metric, labels, value) a monitoring history exports; absent values give no sample.

    Gauges show each run's value; counters are running totals over a model's runs, counted per health status for
    the run counter. ``runs`` has one row per model and run, so a model's history is as long as its runs are many,
    whatever they looked at.
    """
    order = W.partitionBy(*MODEL).orderBy("run_ts").rowsBetween(W.unboundedPreceding, W.currentRow)
    order_by_status = W.partitionBy(*MODEL, "health_status").orderBy("run_ts").rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    with_totals = runs.withColumn("_samples", F.sum("samples_analyzed").over(order)).withColumn(
        "_runs", F.count(F.lit(1)).over(order_by_status)
    )
    labels = F.create_map(
        F.lit("model_name"), F.col("model_name"), F.lit("model_version"), F.col("model_version")
    )
    status = F.map_concat(labels, F.create_map(F.lit("status"), F.col("health_status")))
    sample = lambda name, tags, value: F.struct(
        F.lit(name).alias("metric"), tags.alias("labels"), value.cast("double").alias("value")
    )
    rows = [
        sample("ml_data_drift_detected", labels, F.col("dataset_drift").cast("int")),
        *[sample(name, labels, F.col(c)) for name, c in GAUGES.items() if c in runs.columns],
        sample("ml_model_health_status", labels, health_value(F.col("health_status"))),
        sample("ml_samples_analyzed_total", labels, F.col("_samples")),
        sample("ml_monitoring_runs_total", status, F.col("_runs")),
    ]
    if "duration_seconds" in runs.columns:
        seconds = F.sum("duration_seconds").over(order)
        with_totals = with_totals.withColumn("_seconds", seconds).withColumn("_count", F.count(F.lit(1)).over(order))
        rows += [
            sample("ml_monitoring_duration_seconds_sum", labels, F.col("_seconds")),
            sample("ml_monitoring_duration_seconds_count", labels, F.col("_count")),
        ]
    out = with_totals.select(F.col("run_ts").alias("ts"), F.inline(F.array(*rows))).where("value is not null")
    if scores is not None:
        tags = F.map_concat(labels, F.create_map(F.lit("column_name"), F.col("column_name")))
        out = out.unionByName(
            scores.select(
                F.col("run_ts").alias("ts"), F.lit("ml_column_drift_score").alias("metric"), tags.alias("labels"),
                F.col("drift_score").alias("value"),
            )
        )
    return out


def exposition_lines(samples: DataFrame) -> DataFrame:
    """Samples in the text exposition format, labels in name order."""
    quote = lambda v: F.regexp_replace(v, r'(["\\])', r"\\$1")
    pairs = F.transform(
        F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), quote(e["value"]), F.lit('"'))
    )
    return samples.select(
        F.concat("metric", F.lit("{"), F.array_join(pairs, ","), F.lit("} "), F.col("value").cast("string")).alias("line")
    )


def check_summary(runs: DataFrame) -> DataFrame:
    """Checks in total, completed, by health, and failed."""
    is_health = lambda s: F.count_if(F.coalesce(F.col("health_status") == s, F.lit(False)))
    return runs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        is_health("healthy").alias("healthy"),
        is_health("warning").alias("warning"),
        is_health("critical").alias("critical"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )


def check_list(models: DataFrame, runs: DataFrame) -> DataFrame:
    """Every registered model with its run; models without data are marked skipped instead of getting made-up data."""
    return join_on(models, runs, ["model_name"], "left").withColumn(
        "status", F.when(F.col("health_status").isNull(), "skipped").otherwise("completed")
    )


def critical_alerts(runs: DataFrame) -> DataFrame:
    """Models to alert on, with the first five drifted columns for the message."""
    return runs.where(F.col("health_status") == "critical").select(
        "model_name",
        "drift_share",
        "number_of_drifted_columns",
        F.array_join(F.slice(F.coalesce("drifted_columns", F.array().cast("array<string>")), 1, 5), ", ").alias("drifted_features"),
    )


def latest_run(runs: DataFrame, by: Sequence[str] = ("model_name",)) -> DataFrame:
    """The newest record per model."""
    rest = [c for c in runs.columns if c not in by]
    return runs.groupBy(*by).agg(F.max_by(F.struct(*rest), "run_ts").alias("_run")).select(*by, "_run.*")


def export_latest_json(runs: DataFrame, path: str) -> None:
    """Write the newest record per model as JSON; raises when there is none."""
    newest = latest_run(runs)
    if newest.isEmpty():
        raise ValueError("no monitoring runs to export")
    newest.write.mode("overwrite").json(path)


def run_history(runs: DataFrame, by: Sequence[str] = ("model_name",)) -> DataFrame:
    """Runs with the drift share of the run before and the change since."""
    out = carry_forward(runs, by, "run_ts", {"previous_drift_share": F.col("drift_share")}, include_current=False)
    return out.withColumn("drift_share_change", F.col("drift_share") - F.col("previous_drift_share"))


def model_inventory(reference: DataFrame, model_type: str, features: int) -> DataFrame:
    """Models with their key, type, feature count and reference rows."""
    return reference.groupBy("model_name", "model_version").agg(F.count(F.lit(1)).alias("reference_rows")).select(
        F.concat_ws(":", "model_name", "model_version").alias("model_key"),
        F.lit(model_type).alias("model_type"),
        F.lit(features).cast("long").alias("n_features"),
        "reference_rows",
    )


def find_model(inventory: DataFrame, name: str) -> DataFrame:
    """Models asked for by full key, or by name in any version."""
    return inventory.where((F.col("model_key") == name) | F.col("model_key").startswith(f"{name}:"))
