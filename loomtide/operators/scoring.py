"""Batch scoring: prepare, predict, gate, write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtide.operators.encoding import Preprocessor
from loomtide.operators.evaluation import confidence_gate
from loomtide.operators.models import TrainedModel
from loomtide.sources.files import write_table


def score(
    df: DataFrame, model: TrainedModel, preprocessor: Preprocessor | None = None, threshold: float | None = None
) -> DataFrame:
    """Input columns with ``prediction``, class probabilities and, given a threshold, the confidence columns.

    The input row travels next to the prepared features, so that it comes out as it was.
    """
    if preprocessor is None:
        scored, inputs = model.predict(df), [F.col(c) for c in df.columns]
    else:
        whole = F.struct(*df.columns).alias("_input")
        prepared = preprocessor.transform(df.select("*", whole), keep=["_input"])
        scored = model.predict(prepared.select("_input", *model.features))
        inputs = [F.col("_input")[c].alias(c) for c in df.columns]
    if threshold is not None and "probabilities" in scored.columns:
        scored = scored.withColumn("_index", F.array_position("probabilities", F.array_max("probabilities")) - 1)
        scored = confidence_gate(scored, "probabilities", "_index", threshold).drop("_index")
    added = [c for c in ("prediction", "probabilities", "max_probability", "is_confident", "confident_prediction") if c in scored.columns]
    return scored.select(*inputs, *added)


def with_class_columns(scored: DataFrame, classes: int) -> DataFrame:
    """The array of probabilities as columns ``probability_class_i``."""
    return scored.select(
        *[c for c in scored.columns if c != "probabilities"],
        *[F.get("probabilities", F.lit(i)).alias(f"probability_class_{i}") for i in range(classes)],
    )


def score_to(
    df: DataFrame, model: TrainedModel, path: str, preprocessor: Preprocessor | None = None, fmt: str | None = None
) -> None:
    """Write input, predictions and class probabilities; the format follows the name's ending."""
    scored = score(df, model, preprocessor).withColumnRenamed("prediction", "predictions")
    if "probabilities" in scored.columns:
        scored = with_class_columns(scored, len(model.labels))
    write_table(scored, path, fmt)


def with_metadata(scored: DataFrame, model: TrainedModel, scored_at: Column) -> DataFrame:
    """Predictions with their model's description as one JSON value per row."""
    about = F.struct(
        F.lit(model.algorithm).alias("algorithm"), F.lit(model.task).alias("task"),
        F.lit(len(model.features)).alias("n_features"), scored_at.alias("scored_at"),
    )
    return scored.select(F.to_json(F.struct(F.struct(*scored.columns).alias("row"), about.alias("model"))).alias("value"))
