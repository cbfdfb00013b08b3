"""Training, scoring and experiment queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtide.operators import encoding, evaluation, experiments, models, scoring, splitting
from registry.common import Registry, rounded, table
from registry.evaluation import _scores_sql, order_predictions

REG = Registry()

FEATS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
FOREST = {"n_estimators": 10, "max_depth": 5}
KEY = ["l_orderkey", "l_linenumber", "l_partkey"]


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem")


@REG.add(
    "linear_regression",
    """SELECT 'l_quantity' AS feature, round(regr_slope(l_extendedprice, l_quantity), 3) AS coefficient,
 round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem""",
)
def linear_regression(spark: SparkSession, folder: str) -> DataFrame:
    fitted = models.train(lines(spark, folder), ["l_quantity"], "l_extendedprice", "regression", "linear")
    out = fitted.importance().select("feature", "coefficient", F.lit(float(fitted.model.intercept)).alias("intercept"))
    return rounded(rounded(out, 3, ["coefficient"]), 2, ["intercept"])


@REG.add(
    "ridge_regression",
    """SELECT 'l_discount' AS feature, round(covar_pop(l_quantity, l_discount) * count(*) / (var_pop(l_discount) * count(*) + 5), 6) AS coefficient FROM lineitem""",
)
def ridge_regression(spark: SparkSession, folder: str) -> DataFrame:
    fitted = models.train(lines(spark, folder), ["l_discount"], "l_quantity", "regression", "ridge", alpha=5.0)
    return rounded(fitted.importance().select("feature", "coefficient"))


@REG.add(
    "lasso_regression",
    """SELECT 'l_quantity' AS feature, round((covar_pop(l_extendedprice, l_quantity) - sign(covar_pop(l_extendedprice, l_quantity)) * least(5, abs(covar_pop(l_extendedprice, l_quantity)))) / var_pop(l_quantity), 2) AS coefficient FROM lineitem""",
)
def lasso_regression(spark: SparkSession, folder: str) -> DataFrame:
    fitted = models.train(lines(spark, folder), ["l_quantity"], "l_extendedprice", "regression", "lasso", alpha=5.0)
    return rounded(fitted.importance().select("feature", "coefficient"), 2)


def _split_lines(spark: SparkSession, folder: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    marked = splitting.random_split(lines(spark, folder), KEY).select(*columns, "split")
    train, test = splitting.written_parts(marked, ["train", "test"])
    return train, test


@REG.add("train_score_rf")
def train_score_rf(spark: SparkSession, folder: str) -> DataFrame:
    """Forest on four fifths of all lines, weighted metrics on the rest."""
    train, test = _split_lines(spark, folder, [*FEATS, "l_returnflag"])
    fitted = models.train(train, FEATS, "l_returnflag", "classification", **FOREST)
    return models.evaluate(fitted, test)


@REG.add("feature_importance")
def feature_importance(spark: SparkSession, folder: str) -> DataFrame:
    fitted = models.train(lines(spark, folder), FEATS, "l_extendedprice", "regression", **FOREST)
    return fitted.importance()


@REG.add("prediction_intervals")
def prediction_intervals(spark: SparkSession, folder: str) -> DataFrame:
    train, test = _split_lines(spark, folder, [*FEATS, "l_extendedprice"])
    fitted = models.train(train, FEATS, "l_extendedprice", "regression", **FOREST)
    return fitted.predict_interval(test.select(*FEATS, "l_extendedprice"))


@REG.add("batch_score")
def batch_score(spark: SparkSession, folder: str) -> DataFrame:
    """Fitted preparation and model applied to all lines, with class probabilities and the confidence gate."""
    data = lines(spark, folder).select("l_quantity", "l_extendedprice", "l_linestatus", "l_returnflag")
    train, _ = _split_lines(spark, folder, data.columns)
    prep = encoding.Preprocessor(numeric=["l_quantity", "l_extendedprice"], categorical=["l_linestatus"])
    prepared = prep.fit_transform(train, exclude=["l_returnflag"], keep=["l_returnflag"])
    fitted = models.train(prepared, prep.output_names(), "l_returnflag", "classification", "logistic_regression", max_iter=20)
    return scoring.with_class_columns(scoring.score(data, fitted, prep, threshold=0.34), len(fitted.labels))


@REG.add("cv_scores")
def cv_scores(spark: SparkSession, folder: str) -> DataFrame:
    scores = models.cross_validate(lines(spark, folder), KEY, FEATS, "l_extendedprice", "regression", "linear", folds=3)
    return evaluation.cross_validation_summary(scores, ["mse", "mae", "r2"])


@REG.add(
    "cv_scores_one_feature",
    """WITH k AS (SELECT l_quantity AS x, l_extendedprice AS y, row_number() OVER (ORDER BY md5('42:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey)) AS i,
  count(*) OVER () AS n FROM lineitem),
d AS (SELECT x, y, CASE WHEN i > ceil(n * 2::DOUBLE / 3) THEN 2 WHEN i > ceil(n * 1::DOUBLE / 3) THEN 1 ELSE 0 END AS fold FROM k),
m AS (SELECT f.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM d, range(3) f(fold) WHERE d.fold <> f.fold GROUP BY f.fold),
e AS (SELECT d.fold, avg((y - a - b * x) ** 2) AS mse, avg(abs(y - a - b * x)) AS mae, 1 - avg((y - a - b * x) ** 2) / var_pop(y) AS r2
  FROM d JOIN m ON d.fold = m.fold GROUP BY d.fold)
SELECT round(avg(mse) / 1e6, 3) AS cv_mse_mean, round(avg(mae), 2) AS cv_mae_mean, round(avg(r2), 5) AS cv_r2_mean, round(stddev_pop(r2), 5) AS cv_r2_std FROM e""",
)
def cv_scores_one_feature(spark: SparkSession, folder: str) -> DataFrame:
    scores = models.cross_validate(lines(spark, folder), KEY, ["l_quantity"], "l_extendedprice", "regression", "linear", folds=3)
    out = evaluation.cross_validation_summary(scores, ["mse", "mae", "r2"]).withColumn("cv_mse_mean", F.col("cv_mse_mean") / 1e6)
    out = rounded(rounded(rounded(out, 3, ["cv_mse_mean"]), 2, ["cv_mae_mean"]), 5, ["cv_r2_mean", "cv_r2_std"])
    return out.select("cv_mse_mean", "cv_mae_mean", "cv_r2_mean", "cv_r2_std")


_TWO_FEATURES_SQL = """s AS (SELECT {by}avg(y) AS my, avg(u) AS mu, avg(v) AS mv, covar_pop(u, u) AS uu, covar_pop(u, v) AS uv, covar_pop(v, v) AS vv,
  covar_pop(u, y) AS uy, covar_pop(v, y) AS vy {of}),
w AS (SELECT *, (uy * vv - vy * uv) / (uu * vv - uv * uv) AS bu, (vy * uu - uy * uv) / (uu * vv - uv * uv) AS bv FROM s)"""


@REG.add(
    "cv_scores_two_features",
    """WITH k AS (SELECT l_quantity AS u, l_discount AS v, l_extendedprice AS y, row_number() OVER (ORDER BY md5('42:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey)) AS i,
  count(*) OVER () AS n FROM lineitem),
d AS (SELECT u, v, y, CASE WHEN i > ceil(n * 2::DOUBLE / 3) THEN 2 WHEN i > ceil(n * 1::DOUBLE / 3) THEN 1 ELSE 0 END AS fold FROM k),
"""
    + _TWO_FEATURES_SQL.format(by="f.fold, ", of="FROM d, range(3) f(fold) WHERE d.fold <> f.fold GROUP BY f.fold")
    + """ SELECT CAST(d.fold AS INTEGER) AS fold, count(*) AS n, round(avg((y - my - bu * (u - mu) - bv * (v - mv)) ** 2) / 1e6, 4) AS mse,
 round(sqrt(avg((y - my - bu * (u - mu) - bv * (v - mv)) ** 2)), 3) AS rmse, round(1 - avg((y - my - bu * (u - mu) - bv * (v - mv)) ** 2) / var_pop(y), 6) AS r2
FROM d JOIN w ON d.fold = w.fold GROUP BY d.fold""",
)
def cv_scores_two_features(spark: SparkSession, folder: str) -> DataFrame:
    """Cross-validated linear fits from the moments of one pass."""
    out = models.cross_validate_linear(lines(spark, folder), KEY, ["l_quantity", "l_discount"], "l_extendedprice", folds=3)
    return rounded(rounded(rounded(out.withColumn("mse", F.col("mse") / 1e6), 4, ["mse"]), 3, ["rmse"]), 6, ["r2"])


@REG.add(
    "rfe_order",
    "WITH d AS (SELECT l_discount AS u, l_quantity AS v, l_extendedprice AS y FROM lineitem), "
    + _TWO_FEATURES_SQL.format(by="", of="FROM d")
    + """ SELECT 'l_discount' AS feature, CAST(CASE WHEN abs(bu) * sqrt(uu) <= abs(bv) * sqrt(vv) THEN 2 ELSE 1 END AS INTEGER) AS rank FROM w
UNION ALL SELECT 'l_quantity', CAST(CASE WHEN abs(bu) * sqrt(uu) <= abs(bv) * sqrt(vv) THEN 1 ELSE 2 END AS INTEGER) FROM w""",
)
def rfe_order(spark: SparkSession, folder: str) -> DataFrame:
    return models.linear_elimination(lines(spark, folder), ["l_discount", "l_quantity"], "l_extendedprice")


@REG.add(
    "batch_score_checks",
    """SELECT count(*) AS n_rows, 0::BIGINT AS n_bad_sum, 0::BIGINT AS n_bad_range, 0::BIGINT AS n_bad_gate, 0::BIGINT AS n_unknown_class FROM lineitem""",
)
def batch_score_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Every line is scored; probabilities sum to one, the gate looks at the largest, classes are those of the data."""
    scored = batch_score(spark, folder)
    shares = [F.col(c) for c in scored.columns if c.startswith("probability_class_")]
    total, largest = sum(shares[1:], shares[0]), F.greatest(*shares)
    return scored.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.abs(total - 1.0) > 1e-9).alias("n_bad_sum"),
        F.count_if((F.least(*shares) < 0) | (largest > 1)).alias("n_bad_range"),
        F.count_if(F.abs(F.col("max_probability") - largest) > 1e-12).alias("n_bad_gate"),
        F.count_if(~F.col("prediction").isin("A", "N", "R")).alias("n_unknown_class"),
    )


@REG.add(
    "prediction_interval_checks",
    """SELECT ceil(count(*) * 0.2::DOUBLE)::BIGINT AS n_rows, 0::BIGINT AS n_inverted, 0::BIGINT AS n_negative_std, true AS covers_most_predictions FROM lineitem""",
)
def prediction_interval_checks(spark: SparkSession, folder: str) -> DataFrame:
    low, mid, high = F.col("lower_bound"), F.col("prediction"), F.col("upper_bound")
    inside = (low - 1e-6 <= mid) & (mid <= high + 1e-6)
    return prediction_intervals(spark, folder).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(low > high).alias("n_inverted"),
        F.count_if(F.col("prediction_std") < 0).alias("n_negative_std"),
        (F.count_if(inside) >= 0.99 * F.count(F.lit(1))).alias("covers_most_predictions"),
    )


@REG.add(
    "feature_importance_checks",
    "SELECT 4::BIGINT AS n_features, true AS sums_to_one, 'l_quantity' AS first, count(*) > 0 AS any_row FROM lineitem",
)
def feature_importance_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Price follows quantity, so a forest ranks it first."""
    return feature_importance(spark, folder).agg(
        F.count(F.lit(1)).alias("n_features"), (F.abs(F.sum("importance") - 1.0) < 1e-9).alias("sums_to_one"),
        F.max_by("feature", "importance").alias("first"), (F.count(F.lit(1)) > 0).alias("any_row"),
    )


@REG.add(
    "train_score_rf_checks",
    """SELECT ceil(count(*) * 0.2::DOUBLE)::BIGINT AS n, true AS in_range, true AS beats_guessing FROM lineitem""",
)
def train_score_rf_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics are shares of the test rows, and no worse than a third, what guessing one of three flags gives."""
    scores = [F.col(c) for c in ("accuracy", "precision", "recall", "f1")]
    inside = F.lit(True)
    for c in scores:
        inside = inside & (c >= 0) & (c <= 1)
    return train_score_rf(spark, folder).select("n", inside.alias("in_range"), (F.col("accuracy") > 0.3).alias("beats_guessing"))


@REG.add(
    "cv_summary",
    """WITH f AS (SELECT o_orderpriority, md5('7:' || o_orderkey) AS h, o_totalprice AS y, o_custkey * 100 AS p FROM orders),
k AS (SELECT *, row_number() OVER (ORDER BY h) AS i, count(*) OVER () AS n FROM f),
d AS (SELECT *, """ + " + ".join(f"CASE WHEN i > ceil(n * {j}::DOUBLE / 5) THEN 1 ELSE 0 END" for j in range(1, 5)) + """ AS fold FROM k),
m AS (SELECT fold, avg((y - p) * (y - p)) AS mse, avg(abs(y - p)) AS mae FROM d GROUP BY fold)
SELECT round(avg(mse) / 1e6, 4) AS cv_mse_mean, round(stddev_pop(mse) / 1e6, 4) AS cv_mse_std, round(avg(mae), 3) AS cv_mae_mean,
 round(stddev_pop(mae), 3) AS cv_mae_std FROM m""",
)
def cv_summary(spark: SparkSession, folder: str) -> DataFrame:
    data = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("target"), (F.col("o_custkey") * 100).alias("prediction")
    )
    folds = evaluation.regression_metrics(splitting.cv_folds(data, "o_orderkey", seed=7), "target", "prediction", ["fold"])
    out = evaluation.cross_validation_summary(folds, ["mse", "mae"])
    scaled = out.withColumns({c: F.col(c) / 1e6 for c in ("cv_mse_mean", "cv_mse_std")})
    return rounded(rounded(scaled, 4, ["cv_mse_mean", "cv_mse_std"]), 3, ["cv_mae_mean", "cv_mae_std"])


TICKS_SQL = """
e AS (SELECT 'errors' AS experiment, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS variant, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS tick,
   event_type <> 'error' AS ok, value FROM events
 UNION ALL SELECT 'slow', CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END, CAST(date_trunc('hour', ts) AS TIMESTAMP),
   value < CASE WHEN user_id % 2 = 0 THEN 30 ELSE 60 END, value FROM events),
w AS (SELECT experiment, tick,
   count(*) FILTER (variant = 'a' AND ok) / nullif(count(*) FILTER (variant = 'a'), 0) AS success_ratio_a, avg(value) FILTER (variant = 'a') AS latency_a, count(*) FILTER (variant = 'a') AS requests_a,
   count(*) FILTER (variant = 'b' AND ok) / nullif(count(*) FILTER (variant = 'b'), 0) AS success_ratio_b, avg(value) FILTER (variant = 'b') AS latency_b, count(*) FILTER (variant = 'b') AS requests_b
  FROM e GROUP BY ALL)"""


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    """Two experiments on all events: errors do not depend on the variant, slowness does."""
    variant = F.when(F.col("user_id") % 2 == 0, "a").otherwise("b")
    events = table(spark, folder, "events").select("ts", "value", variant.alias("variant"), "event_type", "user_id")
    limit = F.when(F.col("variant") == "a", 30.0).otherwise(60.0)
    both = events.select(
        "ts", "value", "variant",
        F.explode(F.array(
            F.struct(F.lit("errors").alias("experiment"), (F.col("event_type") != "error").alias("ok")),
            F.struct(F.lit("slow").alias("experiment"), (F.col("value") < limit).alias("ok")),
        )).alias("x"),
    ).select("ts", "value", "variant", "x.*")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return experiments.snapshots(both, hour, "variant", F.col("ok"), "value", ["experiment"])


@REG.add(
    "ab_snapshots",
    f"""WITH {TICKS_SQL} SELECT experiment, tick, round(success_ratio_a, 6) AS success_ratio_a, round(latency_a, 6) AS latency_a, requests_a,
 round(success_ratio_b, 6) AS success_ratio_b, round(latency_b, 6) AS latency_b, requests_b FROM w""",
)
def ab_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ticks(spark, folder))


WELCH_SQL = f"""{TICKS_SQL},
s AS (SELECT experiment, avg(success_ratio_a) AS mean_a, stddev_samp(success_ratio_a) AS std_a, count(success_ratio_a) AS n_a,
  avg(success_ratio_b) AS mean_b, stddev_samp(success_ratio_b) AS std_b, count(success_ratio_b) AS n_b FROM w GROUP BY 1),
t AS (SELECT *, (mean_b - mean_a) / mean_a * 100 AS relative_improvement, (mean_a - mean_b) / sqrt(std_a * std_a / n_a + std_b * std_b / n_b) AS t,
  pow(std_a * std_a / n_a + std_b * std_b / n_b, 2) / (pow(std_a * std_a / n_a, 2) / (n_a - 1) + pow(std_b * std_b / n_b, 2) / (n_b - 1)) AS dof FROM s)"""


@REG.add(
    "ab_welch",
    f"""WITH {WELCH_SQL} SELECT experiment, round(mean_a, 6) AS mean_a, round(std_a, 6) AS std_a, n_a, round(mean_b, 6) AS mean_b, round(std_b, 6) AS std_b, n_b,
 round(relative_improvement, 4) AS relative_improvement, round(t, 4) AS t, round(dof, 3) AS dof FROM t""",
)
def ab_welch(spark: SparkSession, folder: str) -> DataFrame:
    tested = experiments.welch_test(experiments.variant_summary(ticks(spark, folder), "success_ratio", ["experiment"]))
    out = rounded(tested.drop("p_value"), 6, ["mean_a", "std_a", "mean_b", "std_b"])
    return rounded(rounded(out, 4, ["relative_improvement", "t"]), 3, ["dof"])


@REG.add(
    "ab_winner",
    f"""WITH {WELCH_SQL} SELECT experiment, CASE WHEN abs(t) < 1.98 THEN 'none' WHEN mean_b > mean_a THEN 'candidate' ELSE 'baseline' END AS better_model FROM t""",
)
def ab_winner(spark: SparkSession, folder: str) -> DataFrame:
    tested = experiments.welch_test(experiments.variant_summary(ticks(spark, folder), "success_ratio", ["experiment"]))
    return experiments.winner(tested, "baseline", "candidate").select("experiment", "better_model")


MODELS_SQL = f"""{_scores_sql("model_name, dataset")},
acc AS (SELECT model_name, dataset, sum(tp) / sum(support) AS accuracy FROM scores GROUP BY ALL),
o AS (SELECT a.model_name, CASE WHEN a.model_name LIKE '1%' THEN -1 WHEN a.model_name LIKE '2%' THEN 0.9 ELSE a.accuracy END AS current_accuracy, b.accuracy AS new_accuracy,
  a.model_name NOT LIKE '3%' AND a.model_name NOT LIKE '2%' AS drift_detected FROM acc a JOIN acc b ON a.model_name = b.model_name AND a.dataset = 'reference' AND b.dataset = 'current'),
dec AS (SELECT *, current_accuracy < 0.85 OR drift_detected AS should_retrain,
  concat_ws(',', CASE WHEN current_accuracy < 0.85 THEN 'low_accuracy' END, CASE WHEN current_accuracy < 0 THEN 'no_evaluation' END,
   CASE WHEN drift_detected THEN 'drift' END) AS why FROM o)"""


def model_table(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy of each model before and after; one evaluation is marked as failed, one is set to a good value."""
    by = ["model_name", "dataset"]
    matrix = evaluation.confusion_matrix(order_predictions(spark, folder), "label", "prediction", by)
    side = lambda d: F.max(F.when(F.col("dataset") == d, F.col("accuracy")))
    wide = evaluation.classification_metrics(matrix, by).groupBy("model_name").agg(
        side("reference").alias("old"), side("current").alias("new_accuracy")
    )
    name = F.col("model_name")
    return wide.select(
        "model_name",
        F.when(name.startswith("1"), -1.0).when(name.startswith("2"), 0.9).otherwise(F.col("old")).alias("current_accuracy"),
        "new_accuracy", (~name.startswith("3") & ~name.startswith("2")).alias("drift_detected"),
    )


@REG.add(
    "retrain_decision",
    f"WITH {MODELS_SQL} SELECT model_name, should_retrain, why AS reasons FROM dec",
)
def retrain_decision(spark: SparkSession, folder: str) -> DataFrame:
    decided = experiments.retrain_decision(model_table(spark, folder))
    return decided.select("model_name", "should_retrain", F.concat_ws(",", "reasons").alias("reasons"))


def _compared(spark: SparkSession, folder: str) -> DataFrame:
    found = model_table(spark, folder)
    return experiments.compare_models(
        found.select("model_name", F.col("current_accuracy").alias("accuracy")),
        found.select("model_name", F.col("new_accuracy").alias("accuracy")),
    )


@REG.add(
    "model_compare",
    f"""WITH {MODELS_SQL} SELECT model_name, round(current_accuracy, 6) AS old_value, round(new_accuracy, 6) AS new_value, round(new_accuracy - current_accuracy, 6) AS improvement,
 round(CASE WHEN current_accuracy > 0 THEN (new_accuracy - current_accuracy) / current_accuracy * 100 ELSE 0 END, 4) AS improvement_percent,
 new_accuracy - current_accuracy > 0 AS new_model_better, model_name <> '5-LOW' AS register,
 model_name <> '5-LOW' AND new_accuracy - current_accuracy > 0 AS deploy FROM dec""",
)
def model_compare(spark: SparkSession, folder: str) -> DataFrame:
    out = experiments.approvals(_compared(spark, folder), F.col("model_name") != "5-LOW", F.lit(True))
    return rounded(rounded(out, 4, ["improvement_percent"]), 6, ["old_value", "new_value", "improvement"])


@REG.add(
    "notification_record",
    f"""WITH {MODELS_SQL}, x AS (SELECT *, new_accuracy > current_accuracy AS better FROM dec)
SELECT model_name, round(current_accuracy, 6) AS current_accuracy, drift_detected, should_retrain AS retraining_triggered,
 round(CASE WHEN should_retrain THEN new_accuracy END, 6) AS new_accuracy, better AS new_model_deployed,
 CASE WHEN drift_detected AND current_accuracy < 0.85 THEN 'critical' WHEN drift_detected THEN 'warning' WHEN should_retrain THEN 'info' ELSE 'ok' END AS severity,
 concat_ws(',', nullif(why, ''), CASE WHEN better THEN 'deployed' END) AS codes FROM x""",
)
def notification_record(spark: SparkSession, folder: str) -> DataFrame:
    decided = experiments.retrain_decision(model_table(spark, folder))
    verdict = _compared(spark, folder).select("model_name", "new_model_better")
    return rounded(experiments.notification(decided.join(verdict, "model_name")))
