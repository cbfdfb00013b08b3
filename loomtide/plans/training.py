"""The training job: load, validate, split, prepare, select, fit, evaluate, save."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from loomtide.operators import models, rules, selection, splitting
from loomtide.operators.encoding import Preprocessor
from loomtide.sources.files import read_table, write_table

log = logging.getLogger(__name__)


@dataclass
class TrainingConfig:
    target: str
    key: Sequence[str]
    task: str = "classification"
    algorithm: str = "random_forest"
    params: dict = field(default_factory=dict)
    numeric_strategy: str = "standard"
    categorical_strategy: str = "onehot"
    selection: str | None = None
    n_features: int = 10
    test_size: float = 0.2
    validation_size: float = 0.1
    seed: int = 42
    fail_on_validation_error: bool = False
    rules: Sequence[rules.Rule] | None = None


@dataclass
class TrainingResult:
    model: models.TrainedModel
    preprocessor: Preprocessor
    validation: DataFrame
    validation_metrics: DataFrame
    test_metrics: DataFrame
    run: DataFrame


def run_training(spark: SparkSession, data: DataFrame | str, config: TrainingConfig, name: str, output: str | None = None) -> TrainingResult:
    """Train a model on a table or a path.

    A failed validation is logged, or raised with ``fail_on_validation_error``. The preparation is fitted on the
    training rows only. With ``output``, the model, the preparation and the run record are saved below it.
    """
    df = read_table(spark, data) if isinstance(data, str) else data
    found = rules.validate(df, config.rules or rules.derive_rules(df, name), name)
    if config.fail_on_validation_error:
        rules.require_valid(found)
    elif not rules.validation_summary(found).first()["success"]:
        log.warning("validation of %s failed; training goes on", name)

    if config.task == "classification":
        marked = splitting.stratified_split(df, config.key, config.target, config.test_size, config.validation_size, config.seed)
    else:
        cut = lambda n: [_ceil(n, config.test_size), _ceil(n, config.test_size + config.validation_size)]
        marked = splitting.assign_parts(df, config.key, config.seed, cut, name="_part").selectExpr(
            "* except (_part)", "element_at(array('test', 'validation', 'train'), _part + 1) as split"
        )
    part = lambda label: marked.where(marked["split"] == label).drop("split")

    aside = [config.target, *[k for k in config.key if k != config.target]]
    prep = Preprocessor(numeric_strategy=config.numeric_strategy, categorical_strategy=config.categorical_strategy)
    prep.fit(part("train"), exclude=aside)
    prep.remainder = [c for c in prep.remainder if dict(df.dtypes)[c] == "boolean"]
    prepared = {label: prep.transform(part(label), keep=aside) for label in ("train", "validation", "test")}
    features = prep.output_names()
    if config.selection:
        features = selection.select_features(
            prepared["train"], features, config.target, config.selection, config.task, k=min(config.n_features, len(features))
        )
    model = models.train(prepared["train"], features, config.target, config.task, config.algorithm, **config.params)
    on_validation = models.evaluate(model, prepared["validation"])
    on_test = models.evaluate(model, prepared["test"])
    run = models.training_run(spark, model, on_test, config.params, name)
    if output:
        model.save(spark, f"{output}/model")
        prep.save(spark, f"{output}/preprocessor")
        write_table(run, f"{output}/training_runs", "parquet", mode="append")
    return TrainingResult(model, prep, found, on_validation, on_test, run)


def _ceil(n, share: float):
    from pyspark.sql import functions as F

    return F.ceil(n * F.lit(share))
