"""Evaluation metrics as aggregations over prediction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtide.functions.columns import ratio
from loomtide.operators.ordered import HOT_ROWS, hot_keys, running_totals


def confusion_matrix(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per (label, prediction)."""
    return df.groupBy(*by, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_scores(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of each class; a zero denominator gives 0."""
    hit = F.when(F.col("label").eqNullSafe(F.col("prediction")), F.col("n")).otherwise(F.lit(0))
    as_label = matrix.select(*by, F.col("label").alias("class"), hit.alias("tp"), F.col("n").alias("support"),
                             F.lit(0).cast("long").alias("predicted"))
    as_prediction = matrix.select(*by, F.col("prediction").alias("class"), F.lit(0).cast("long").alias("tp"),
                                  F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"))
    sums = as_label.unionByName(as_prediction).groupBy(*by, "class").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted")
    )
    tp = F.col("tp")
    return sums.select(
        *by,
        "class",
        ratio(tp, F.col("predicted"), 0.0).alias("precision"),
        ratio(tp, F.col("support"), 0.0).alias("recall"),
        ratio(tp * 2, F.col("predicted") + F.col("support"), 0.0).alias("f1"),
        "support",
        "tp",
    )


def classification_metrics(
    matrix: DataFrame, by: Sequence[str] = (), average: str = "weighted", positive: object = None
) -> DataFrame:
    """Accuracy with precision, recall and F1 averaged by support, over classes, or of the positive class."""
    scores = class_scores(matrix, by)
    total = F.sum("support")
    if average == "weighted":
        mean = lambda c: ratio(F.sum(F.col(c) * F.col("support")), total, 0.0)
    elif average == "macro":
        mean = lambda c: F.avg(c)
    elif average == "positive":
        mean = lambda c: F.coalesce(F.max(F.when(F.col("class") == F.lit(positive), F.col(c))), F.lit(0.0))
    else:
        raise ValueError("average is one of weighted, macro, positive")
    return scores.groupBy(*by).agg(
        ratio(F.sum("tp"), total, 0.0).alias("accuracy"),
        mean("precision").alias("precision"),
        mean("recall").alias("recall"),
        mean("f1").alias("f1"),
        total.alias("n"),
    )


def class_report(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per-class scores followed by their plain and support-weighted averages."""
    scores = class_scores(matrix, by)
    keep = ["precision", "recall", "f1", "support"]
    total = F.sum("support")
    plain = scores.groupBy(*by).agg(*[F.avg(c).alias(c) for c in keep[:3]], total.alias("support"))
    weighted = scores.groupBy(*by).agg(
        *[ratio(F.sum(F.col(c) * F.col("support")), total, 0.0).alias(c) for c in keep[:3]], total.alias("support")
    )
    return (
        scores.select(*by, F.col("class").cast("string").alias("class"), *keep)
        .unionByName(plain.withColumn("class", F.lit("macro avg")))
        .unionByName(weighted.withColumn("class", F.lit("weighted avg")))
    )


def roc_auc(
    df: DataFrame, is_positive: Column, score: str, by: Sequence[str] = (), hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Exact area under the ROC curve: the share of (positive, negative) pairs in right order, ties counting half.

    Rows without a label (``is_positive`` null) or without a score (null or NaN) are left out. Computed from prefix sums over distinct scores; null when a group lacks one of the two classes.
    """
    one = F.when(is_positive, 1).otherwise(0)
    counts = (
        df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & is_positive.isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("_score"))
        .agg(F.sum(one).alias("pos"), F.sum(1 - one).alias("neg"))
    )
    ordered = running_totals(counts, by, "_score", ["pos", "neg"], hot_keys(df, by, hot_rows))
    below = F.col("cum_neg") - F.col("neg") + F.col("neg") / F.lit(2.0)
    pairs = F.max("total_pos").cast("double") * F.max("total_neg")
    return ordered.groupBy(*by).agg(
        F.max("total_pos").alias("n_positive"),
        F.max("total_neg").alias("n_negative"),
        ratio(F.sum(F.col("pos") * below), pairs).alias("roc_auc"),
    )


def regression_metrics(df: DataFrame, target: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """MSE, RMSE, MAE, R2 and, when no target is zero, MAPE; one aggregation over rows with target and prediction."""
    error = F.col(target) - F.col(prediction)
    y = F.when(error.isNotNull(), F.col(target).cast("double"))
    mse = F.avg(error * error)
    return df.groupBy(*by).agg(
        F.count(error).alias("n"),
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (F.lit(1.0) - ratio(mse, F.var_pop(y))).alias("r2"),
        F.when(F.count_if(y == 0) == 0, F.avg(F.abs(ratio(error, y)))).alias("mape"),
    )


def error_report(df: DataFrame, target: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Summary of prediction minus target: mean, deviation, extremes, shares of under- and over-estimates."""
    error = F.col(prediction) - F.col(target)
    n = F.count(error)
    return df.groupBy(*by).agg(
        n.alias("n"),
        F.avg(error).alias("mean_error"),
        F.stddev_samp(error).alias("error_std"),
        F.avg(F.abs(error)).alias("mae"),
        F.max(F.abs(error)).alias("max_abs_error"),
        F.when(F.count_if(F.col(target) == 0) == 0, F.avg(F.abs(ratio(error, F.col(target))))).alias("mape"),
        ratio(F.count_if(error < 0), n, 0.0).alias("under_share"),
        ratio(F.count_if(error > 0), n, 0.0).alias("over_share"),
    )


def degradation(reference: Column, current: Column) -> Column:
    """Loss against the reference in percent; 0 when the reference is 0."""
    return F.when(reference == 0, F.lit(0.0)).otherwise(F.try_divide(reference - current, reference) * 100)


def cross_validation_summary(folds: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation over folds."""
    return folds.groupBy(*by).agg(
        *[a for m in metrics for a in (F.avg(m).alias(f"cv_{m}_mean"), F.stddev_pop(m).alias(f"cv_{m}_std"))]
    )


def confidence_gate(df: DataFrame, probabilities: str, prediction: str, threshold: float) -> DataFrame:
    """Add the largest probability, whether it reaches the threshold, and the prediction or -1."""
    return (
        df.withColumn("max_probability", F.array_max(probabilities))
        .withColumn("is_confident", F.col("max_probability") >= threshold)
        .withColumn(
            "confident_prediction", F.when(F.col("is_confident"), F.col(prediction).cast("double")).otherwise(-1.0)
        )
    )


def inference_stats(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals of a scoring log, time per prediction and error rate (0 without predictions).

    ``runs`` has columns predictions, seconds and failed.
    """
    total = F.coalesce(F.sum("predictions"), F.lit(0))
    errors = F.count_if("failed")
    seconds = F.coalesce(F.sum("seconds"), F.lit(0.0))
    return runs.groupBy(*by).agg(
        total.alias("total_predictions"),
        seconds.alias("total_seconds"),
        errors.alias("error_count"),
        ratio(seconds, total, 0.0).alias("seconds_per_prediction"),
        ratio(errors, total, 0.0).alias("error_rate"),
    )


def prediction_mix(df: DataFrame, model: str, prediction: str, confidence: str) -> DataFrame:
    """Predictions and mean confidence per model and class."""
    return df.groupBy(F.col(model).alias("model_name"), F.col(prediction).alias("prediction_class")).agg(
        F.count(F.lit(1)).alias("predictions"), F.avg(confidence).alias("confidence")
    )
