"""Experiment decisions: A/B comparison, retraining, model comparison, notification records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtide.functions.columns import ratio
from loomtide.functions.stats import student_p

MIN_SAMPLES = 20


def snapshots(events: DataFrame, tick: Column, variant: str, success: Column, latency: str, by: Sequence[str] = ()) -> DataFrame:
    """One wide row per tick: success ratio, mean latency and requests of variants a and b.

    Conditional aggregates replace one join per series; a variant without requests in a tick gets nulls.
    """
    columns = []
    for name in ("a", "b"):
        mine = F.col(variant) == name
        requests = F.count_if(mine)
        columns += [
            ratio(F.count_if(mine & success), requests).alias(f"success_ratio_{name}"),
            F.avg(F.when(mine, F.col(latency))).alias(f"latency_{name}"),
            requests.alias(f"requests_{name}"),
        ]
    return events.groupBy(*by, tick.alias("tick")).agg(*columns)


def variant_summary(wide: DataFrame, metric: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, sample deviation and number of snapshots of both variants, and the relative improvement in percent."""
    a, b = f"{metric}_a", f"{metric}_b"
    return wide.groupBy(*by).agg(
        F.avg(a).alias("mean_a"), F.stddev_samp(a).alias("std_a"), F.count(a).alias("n_a"),
        F.avg(b).alias("mean_b"), F.stddev_samp(b).alias("std_b"), F.count(b).alias("n_b"),
    ).withColumn("relative_improvement", ratio(F.col("mean_b") - F.col("mean_a"), F.col("mean_a")) * 100)


def welch_test(summary: DataFrame) -> DataFrame:
    """Add Welch's t, its degrees of freedom and the two-sided p-value (p = 1 below 20 snapshots per variant)."""
    va, vb = F.col("std_a") ** 2 / F.col("n_a"), F.col("std_b") ** 2 / F.col("n_b")
    enough = (F.col("n_a") >= MIN_SAMPLES) & (F.col("n_b") >= MIN_SAMPLES)
    tested = summary.withColumn(
        "t", F.when(enough, ratio(F.col("mean_a") - F.col("mean_b"), F.sqrt(va + vb)))
    ).withColumn(
        "dof",
        F.when(enough, ratio((va + vb) ** 2, va**2 / (F.col("n_a") - 1) + vb**2 / (F.col("n_b") - 1))),
    )
    return tested.withColumn("p_value", F.coalesce(student_p(F.col("t"), F.col("dof")), F.lit(1.0)))


def winner(tested: DataFrame, name_a: str, name_b: str, significance: float = 0.95) -> DataFrame:
    """Add ``better_model``: the variant with the higher mean when the difference is significant, else none."""
    better = F.when(F.col("mean_b") > F.col("mean_a"), name_b).otherwise(name_a)
    return tested.withColumn(
        "better_model", F.when(F.col("p_value") < 1.0 - significance, better).otherwise("none")
    )


def retrain_decision(models: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Whether to retrain, with the codes of the reasons; an accuracy of -1 marks a failed evaluation and gives two."""
    accuracy = F.col("current_accuracy")
    low, failed, drifted = accuracy < threshold, accuracy < 0, F.col("drift_detected")
    codes = [F.when(low, "low_accuracy"), F.when(failed, "no_evaluation"), F.when(drifted, "drift")]
    return models.withColumn("should_retrain", low | failed | drifted).withColumn("reasons", F.array_compact(F.array(*codes)))


def compare_models(old: DataFrame, new: DataFrame, metric: str = "accuracy", on: Sequence[str] = ("model_name",)) -> DataFrame:
    """Old against new metric per model: improvement, its percentage (0 without a positive old value), verdict."""
    pair = old.select(*on, F.col(metric).alias("old_value")).join(
        new.select(*on, F.col(metric).alias("new_value")), list(on)
    )
    gain = F.col("new_value") - F.col("old_value")
    return pair.select(
        *on, "old_value", "new_value",
        gain.alias("improvement"),
        F.when(F.col("old_value") > 0, F.try_divide(gain, F.col("old_value")) * 100).otherwise(0.0).alias("improvement_percent"),
        (gain > 0).alias("new_model_better"),
    )


def approvals(compared: DataFrame, approved: Column, auto_deploy: Column) -> DataFrame:
    """Gates: register only what is approved, deploy only what is also better and allowed to deploy by itself."""
    return compared.withColumn("register", approved).withColumn(
        "deploy", approved & F.col("new_model_better") & auto_deploy
    )


def notification(decisions: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Message record per model: severity from drift, accuracy and the decision, with the reasons as codes."""
    drifted, low = F.col("drift_detected"), F.col("current_accuracy") < threshold
    severity = F.when(drifted & low, "critical").when(drifted, "warning").when(F.col("should_retrain"), "info").otherwise("ok")
    deployed = F.coalesce(F.col("new_model_better"), F.lit(False))
    return decisions.select(
        "model_name", "current_accuracy", "drift_detected",
        F.col("should_retrain").alias("retraining_triggered"),
        F.when(F.col("should_retrain"), F.col("new_accuracy")).alias("new_accuracy"),
        deployed.alias("new_model_deployed"),
        severity.alias("severity"),
        F.concat_ws(",", "reasons", F.when(deployed, "deployed")).alias("codes"),
    )
