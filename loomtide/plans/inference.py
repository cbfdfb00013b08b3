"""The batch inference job: load a saved model and its preparation, score a table, write the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtide.operators import scoring
from loomtide.operators.encoding import Preprocessor
from loomtide.operators.models import TrainedModel
from loomtide.sources.files import read_table


def run_inference(
    spark: SparkSession, data: DataFrame | str, model_path: str, output: str | None = None, threshold: float | None = None
) -> DataFrame:
    """Score a table or a path with what ``run_training`` saved below ``model_path``."""
    df = read_table(spark, data) if isinstance(data, str) else data
    model = TrainedModel.load(spark, f"{model_path}/model")
    prep = Preprocessor.load(spark, f"{model_path}/preprocessor")
    if output:
        scoring.score_to(df, model, output, prep)
    return scoring.score(df, model, prep, threshold)
