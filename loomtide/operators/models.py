"""Training and model use with Spark ML estimators, on plain double feature columns."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtide.functions.columns import join_on, present
from loomtide.operators import evaluation, splitting

INPUT = {"featuresCol": "_features", "labelCol": "_label"}


def _forest(kind: type, p: dict) -> Estimator:
    if "min_samples_split" in p:
        raise ValueError("Spark's trees bound the rows of a leaf, not of a split: give min_samples_leaf")
    extra = {"minInstancesPerNode": p["min_samples_leaf"]} if "min_samples_leaf" in p else {}
    return kind(numTrees=p.get("n_estimators", 100), maxDepth=p.get("max_depth", 10), seed=p.get("random_state", 42), **INPUT, **extra)


def _boosted(kind: type, p: dict) -> Estimator:
    return kind(
        maxIter=p.get("n_estimators", 100), maxDepth=p.get("max_depth", 6), stepSize=p.get("learning_rate", 0.1),
        seed=p.get("random_state", 42), **INPUT,
    )


def _boosted_classifier(p: dict, classes: int) -> Estimator:
    one = _boosted(GBTClassifier, p)
    return one if classes <= 2 else OneVsRest(classifier=one, **INPUT)


def _linear(reg: float, elastic: float) -> LinearRegression:
    return LinearRegression(regParam=reg, elasticNetParam=elastic, standardization=False, maxIter=1000, tol=1e-10, **INPUT)


# (task, algorithm) -> builder from parameters and the size of the problem (number of classes)
ALGORITHMS: dict[tuple[str, str], Callable[[dict, float], Estimator]] = {
    ("classification", "random_forest"): lambda p, n: _forest(RandomForestClassifier, p),
    ("classification", "logistic_regression"): lambda p, n: LogisticRegression(
        maxIter=p.get("max_iter", 1000), regParam=p.get("reg_param", 0.0), **INPUT
    ),
    ("classification", "boosted_trees"): _boosted_classifier,
    ("regression", "random_forest"): lambda p, n: _forest(RandomForestRegressor, p),
    ("regression", "linear"): lambda p, n: _linear(0.0, 0.0),
    # size: target deviation per row. Spark ML penalises the mean squared error of a target scaled to deviation 1, the
    # usual ridge definition penalises the sum of squared errors
    ("regression", "ridge"): lambda p, n: _linear(p.get("alpha", 1.0) * n, 0.0),
    ("regression", "lasso"): lambda p, n: _linear(p.get("alpha", 1.0), 1.0),
    ("regression", "boosted_trees"): lambda p, n: _boosted(GBTRegressor, p),
}


def create_model(task: str, algorithm: str, size: float, **params: object) -> Estimator:
    if (task, algorithm) not in ALGORITHMS:
        known = sorted(a for t, a in ALGORITHMS if t == task)
        raise ValueError(f"unknown {task} algorithm {algorithm}; known are {known}")
    return ALGORITHMS[task, algorithm](params, size)


@dataclass
class TrainedModel:
    """A fitted model with what is needed to use it: feature names, class labels, target type."""

    task: str
    algorithm: str
    features: list[str]
    target: str
    model: Transformer
    labels: list[str] | None = None
    target_type: str = "double"

    def _assembled(self, df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.features, outputCol="_features", handleInvalid="keep").transform(
            df.withColumns({f: F.col(f).cast("double") for f in self.features})
        )

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` and, for classifiers, ``probabilities`` in label order."""
        scored = self.model.transform(self._assembled(df))
        if self.task == "regression":
            return scored.select(*df.columns, F.col("prediction"))
        if "probability" in scored.columns:
            shares = vector_to_array("probability")
        else:
            odds = F.transform(vector_to_array("rawPrediction"), lambda x: 1.0 / (1.0 + F.exp(-2.0 * x)))
            whole = F.aggregate(odds, F.lit(0.0), lambda a, b: a + b)
            shares = F.transform(odds, lambda x: x / whole)
        names = F.array(*[F.lit(v) for v in self.labels])
        label = F.get(names, F.col("prediction").cast("int")).cast(self.target_type)
        return scored.select(*df.columns, label.alias("prediction"), shares.alias("probabilities"))

    def importance(self) -> DataFrame:
        """Features by importance, or by the size of their coefficient for linear models."""
        spark = SparkSession.getActiveSession()
        if hasattr(self.model, "featureImportances"):
            values = self.model.featureImportances.toArray().tolist()
            return spark.createDataFrame(list(zip(self.features, values)), "feature string, importance double").orderBy(
                F.desc("importance"), "feature"
            )
        if self.task == "regression" and hasattr(self.model, "coefficients"):
            values = [float(v) for v in self.model.coefficients]
            rows = [(f, v, abs(v)) for f, v in zip(self.features, values)]
            return spark.createDataFrame(rows, "feature string, coefficient double, abs_coefficient double").orderBy(
                F.desc("abs_coefficient"), "feature"
            )
        raise ValueError(f"{self.algorithm} has no feature importance")

    def predict_interval(self, df: DataFrame, confidence: float = 0.95) -> DataFrame:
        """Forest prediction with percentiles and population deviation of its trees' predictions."""
        if self.task != "regression" or self.algorithm != "random_forest":
            raise ValueError("intervals need a regression forest")
        scored = self.model.transform(self._assembled(df))
        names = []
        for i, tree in enumerate(self.model.trees):
            names.append(f"_tree{i}")
            scored = tree.copy().setPredictionCol(names[-1]).transform(scored)
        votes = F.array_sort(F.array(*names))
        k = len(names)
        mean = F.aggregate("_votes", F.lit(0.0), lambda a, b: a + b) / k
        square = F.aggregate(
            F.transform("_votes", lambda v: (v - F.col("_mean")) ** 2), F.lit(0.0), lambda a, b: a + b
        )

        def percentile(p: float):
            at = p * (k - 1)
            low = int(at)
            lo, hi = F.get("_votes", F.lit(low)), F.get("_votes", F.lit(min(low + 1, k - 1)))
            return lo + (hi - lo) * (at - low)

        tail = (1.0 - confidence) / 2.0
        return (
            scored.select(*df.columns, "prediction", votes.alias("_votes"))
            .withColumn("_mean", mean)
            .select(
                *df.columns, "prediction", percentile(tail).alias("lower_bound"), percentile(1.0 - tail).alias("upper_bound"),
                F.sqrt(square / k).alias("prediction_std"),
            )
        )

    def save(self, spark: SparkSession, path: str) -> None:
        PipelineModel([self.model]).write().overwrite().save(f"{path}/model")
        state = {k: getattr(self, k) for k in ("task", "algorithm", "features", "target", "labels", "target_type")}
        spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/state")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TrainedModel:
        state = json.loads(spark.read.text(f"{path}/state").first()["value"])
        return TrainedModel(model=PipelineModel.load(f"{path}/model").stages[0], **state)


def train(
    df: DataFrame, features: Sequence[str], target: str, task: str, algorithm: str = "random_forest", **params: object
) -> TrainedModel:
    """Fit a model; rows without a target are left out."""
    features = list(features)
    data = df.where(F.col(target).isNotNull()).select(*[F.col(f).cast("double").alias(f) for f in features], target)
    labels, target_type = None, "double"
    if task == "classification":
        target_type = df.schema[target].dataType.simpleString()
        text = data.withColumn("_text", F.col(target).cast("string"))
        indexer: StringIndexerModel = StringIndexer(inputCol="_text", outputCol="_label", stringOrderType="alphabetAsc").fit(text)
        labels = list(indexer.labels)
        data, size = indexer.transform(text), len(labels)
    else:
        data = data.withColumn("_label", F.col(target).cast("double"))
        size = 0.0
        if algorithm == "ridge":
            size = data.agg(F.stddev_pop("_label") / F.count("_label")).first()[0] or 0.0
    estimator = create_model(task, algorithm, size, **params)
    assembled = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="keep").transform(data)
    return TrainedModel(task, algorithm, features, target, estimator.fit(assembled.select("_features", "_label")), labels, target_type)


def evaluate(model: TrainedModel, df: DataFrame) -> DataFrame:
    """The task's metrics of the model on a table, as one row; two-class models also get the ROC area."""
    scored = model.predict(df)
    if model.task == "regression":
        return evaluation.regression_metrics(scored, model.target, "prediction")
    matrix = evaluation.confusion_matrix(scored, model.target, "prediction")
    metrics = evaluation.classification_metrics(matrix)
    if len(model.labels) == 2:
        positive = F.col(model.target).cast("string") == model.labels[1]
        ranked = scored.withColumn("_score", F.get("probabilities", F.lit(1)))
        area = evaluation.roc_auc(ranked, positive, "_score").first()
        metrics = metrics.withColumn("roc_auc", F.lit(area["roc_auc"] if area else None).cast("double"))
    return metrics


def training_run(spark: SparkSession, model: TrainedModel, metrics: DataFrame, params: dict, name: str) -> DataFrame:
    """One record of a training run: id, time, parameters and metrics as maps."""
    values = {k: float(v) for k, v in metrics.first().asDict().items() if v is not None}
    row = (uuid.uuid4().hex, name, {k: str(v) for k, v in {"algorithm": model.algorithm, **params}.items()}, values)
    return spark.createDataFrame(
        [row], "run_id string, model_name string, params map<string,string>, metrics map<string,double>"
    ).withColumn("run_ts", F.current_timestamp())


def cross_validate(
    df: DataFrame, key: str | Sequence[str], features: Sequence[str], target: str, task: str,
    algorithm: str = "random_forest", folds: int = 5, **params: object,
) -> DataFrame:
    """Metrics per fold; each fold is fitted once and all metrics come from one scoring.

    Linear regressions are fitted from the moments of one pass and scored in a second one, for all folds at once.
    """
    marked = splitting.cv_folds(df, key, folds)
    if (task, algorithm) == ("regression", "linear"):
        return _linear_folds(marked, list(features), target, folds)
    parts = []
    for fold in range(folds):
        fitted = train(marked.where(F.col("fold") != fold), features, target, task, algorithm, **params)
        parts.append(evaluate(fitted, marked.where(F.col("fold") == fold)).withColumn("fold", F.lit(fold)))
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class Moments:
    """Count, means and centred products of some columns; those of two parts add up to those of both."""

    n: float
    mean: np.ndarray
    products: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        gap = other.mean - self.mean
        mean = self.mean + gap * (other.n / n)
        return Moments(n, mean, self.products + other.products + np.outer(gap, gap) * (self.n * other.n / n))

    def fit(self, features: Sequence[int], target: int = -1, alpha: float = 0.0) -> tuple[np.ndarray, float]:
        """Coefficients and intercept of the (ridge) regression of the target on some of the columns."""
        at = list(features)
        x = self.products[np.ix_(at, at)] + alpha * np.eye(len(at))
        # in units of each column's deviation, so that a column of small numbers does not pass for a dependent one
        unit = np.sqrt(np.diag(x))
        unit[unit == 0] = 1.0
        weights = np.linalg.lstsq(x / np.outer(unit, unit), self.products[at, target] / unit, rcond=None)[0] / unit
        return weights, float(self.mean[target] - weights @ self.mean[at])


def column_moments(df: DataFrame, columns: Sequence[str], by: str | None = None) -> dict[object, Moments]:
    """``Moments`` of the rows that have a value in every column, in one pass; one entry per value of ``by``.

    The pass returns a row per group with as many numbers as there are pairs of columns, however many rows there are.
    """
    x = [present(df, c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)]
    kept = df.select(*([F.col(by).alias("_by")] if by else []), *x).dropna(subset=[f"_x{i}" for i in range(len(columns))])
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = kept.groupBy(*(["_by"] if by else [])).agg(
        F.count(F.lit(1)).alias("_n"), F.array(*[F.avg(f"_x{i}") for i in range(len(columns))]).alias("_mean"),
        F.array(*[F.covar_pop(f"_x{i}", f"_x{j}") for i, j in pairs]).alias("_products"),
    )
    out = {}
    for r in row.collect():
        if r["_n"]:
            products = np.zeros((len(columns), len(columns)))
            for (i, j), v in zip(pairs, r["_products"]):
                products[i, j] = products[j, i] = v * r["_n"]
            out[r["_by"] if by else None] = Moments(float(r["_n"]), np.array(r["_mean"]), products)
    return out


def _left_out_fits(parts: dict[object, Moments], alpha: float = 0.0) -> dict[object, tuple[np.ndarray, float]]:
    """Per fold, coefficients and intercept fitted on the rows of the other folds, where there are any."""
    rest = {fold: [m for f, m in parts.items() if f != fold] for fold in sorted(parts)}
    return {
        fold: reduce(Moments.__add__, others).fit(range(len(others[0].mean) - 1), alpha=alpha)
        for fold, others in rest.items() if others
    }


def _linear_folds(marked: DataFrame, features: Sequence[str], target: str, folds: int) -> DataFrame:
    """Regression metrics per ``fold`` of linear models that leave the fold out; rows that lack a value are left out."""
    prediction = F.lit(None).cast("double")
    for fold, (weights, intercept) in _left_out_fits(column_moments(marked, [*features, target], "fold")).items():
        terms = [F.lit(float(w)) * present(marked, f).cast("double") for w, f in zip(weights, features)]
        prediction = F.when(F.col("fold") == fold, sum(terms, F.lit(intercept))).otherwise(prediction)
    scored = marked.select("fold", present(marked, target).cast("double").alias("_y"), prediction.alias("_p"))
    metrics = evaluation.regression_metrics(scored, "_y", "_p", ["fold"])
    every = marked.sparkSession.range(folds).select(F.col("id").cast("int").alias("fold"))
    out = join_on(every, metrics, ["fold"], "left")
    return out.select(F.coalesce("n", F.lit(0)).alias("n"), *[c for c in metrics.columns if c not in ("fold", "n")], "fold")


def cross_validate_linear(
    df: DataFrame, key: str | Sequence[str], features: Sequence[str], target: str, folds: int = 5, alpha: float = 0.0
) -> DataFrame:
    """Metrics per fold of linear (with ``alpha``: ridge) regression: ``fold``, ``n``, ``mse``, ``rmse``, ``r2``.

    One pass over the data gives the moments of every fold. The model that leaves a fold out is fitted from the sum of
    the others' moments, and its errors on the fold follow from the fold's own; rows are read once for any number of
    folds. Rows that lack a value are left out.
    """
    parts = column_moments(splitting.cv_folds(df, key, folds), [*features, target], "fold")
    at, rows = list(range(len(features))), []
    for fold, (weights, intercept) in _left_out_fits(parts, alpha).items():
        own = parts[fold]
        xx, xy, yy = own.products[np.ix_(at, at)], own.products[at, -1], own.products[-1, -1]
        spread = (yy - 2 * weights @ xy + weights @ xx @ weights) / own.n
        mse = float(max(0.0, spread) + (own.mean[-1] - intercept - weights @ own.mean[at]) ** 2)
        rows.append((int(fold), int(own.n), mse, mse**0.5, float(1 - mse * own.n / yy) if yy else None))
    return df.sparkSession.createDataFrame(rows, "fold int, n long, mse double, rmse double, r2 double")


def linear_elimination(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Recursive elimination by linear models: ``feature`` and ``rank``, 1 for the one that stays longest.

    Each round drops the feature with the smallest coefficient in units of the feature's deviation; all rounds are fitted
    from the moments of one pass.
    """
    moments = column_moments(df, [*features, target])
    left, ranks = list(range(len(features))), []
    while left and moments:
        found = moments[None]
        weights, _ = found.fit(left)
        effect = np.abs(weights) * np.sqrt(np.diag(found.products)[left])
        ranks.append((features[left[int(np.argmin(effect))]], len(left)))
        left.pop(int(np.argmin(effect)))
    return df.sparkSession.createDataFrame(ranks, "feature string, rank int")


def eliminate_features(
    df: DataFrame, features: Sequence[str], target: str, task: str, keep: int, n_estimators: int = 50, max_depth: int = 5
) -> list[str]:
    """Recursive elimination: drop the least important feature of a forest until ``keep`` are left."""
    left = list(features)
    while len(left) > keep:
        model = train(df, left, target, task, n_estimators=n_estimators, max_depth=max_depth)
        scores = model.model.featureImportances.toArray()
        left.pop(min(range(len(left)), key=lambda i: (scores[i], -i)))
    return left


def eliminate_features_cv(
    df: DataFrame, features: Sequence[str], target: str, task: str, key: str | Sequence[str],
    folds: int = 5, n_estimators: int = 50, max_depth: int = 5,
) -> list[str]:
    """Elimination with the number of features chosen by cross-validated accuracy (R2 for regression)."""
    metric = "accuracy" if task == "classification" else "r2"
    left, best, best_score = list(features), list(features), float("-inf")
    while left:
        scores = cross_validate(df, key, left, target, task, folds=folds, n_estimators=n_estimators, max_depth=max_depth)
        score = scores.agg(F.avg(metric)).first()[0]
        if score is not None and score >= best_score:
            best, best_score = list(left), score
        if len(left) == 1:
            break
        left = eliminate_features(df, left, target, task, len(left) - 1, n_estimators, max_depth)
    return best
