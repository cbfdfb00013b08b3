"""Evaluation queries.

Roles: orders are labelled predictions of several models (priority names the model); lineitem joined with part is a
regression set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtide.operators import evaluation as ev
from loomtide.operators.ordered import exact_quantiles
from registry.common import Registry, rounded, table

REG = Registry()

ORDER_PREDICTIONS_SQL = """
preds AS (SELECT o_orderkey, o_orderpriority AS model_name, o_orderstatus AS label, o_orderdate, o_totalprice,
  CASE WHEN o_totalprice < 170000 THEN 'F' WHEN o_totalprice < 340000 THEN 'O' ELSE 'P' END AS prediction,
  CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'reference' ELSE 'current' END AS dataset FROM orders)"""

PRICE_PREDICTIONS_SQL = """
priced AS (SELECT l_extendedprice AS target, l_quantity * p_retailprice AS prediction, l_returnflag,
  CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 'reference' ELSE 'current' END AS dataset
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def order_predictions(spark: SparkSession, folder: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.col("o_orderpriority").alias("model_name"),
        F.col("o_orderstatus").alias("label"),
        "o_orderdate",
        "o_totalprice",
        F.when(price < 170000, "F").when(price < 340000, "O").otherwise("P").alias("prediction"),
        F.when(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"), "reference").otherwise("current")
        .alias("dataset"),
    )


def price_predictions(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select("p_partkey", "p_retailprice")
    return table(spark, folder, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_extendedprice").alias("target"),
        (F.col("l_quantity") * F.col("p_retailprice")).alias("prediction"),
        "l_returnflag",
        F.when(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"), "reference").otherwise("current")
        .alias("dataset"),
    )


def _scores_sql(by: str) -> str:
    return f"""{ORDER_PREDICTIONS_SQL},
cm AS (SELECT {by}, label, prediction, count(*) AS n FROM preds GROUP BY ALL),
cls AS (SELECT {by}, label AS class FROM cm UNION SELECT {by}, prediction FROM cm),
sc AS (SELECT {", ".join(f"c.{x.strip()}" for x in by.split(","))}, c.class,
  coalesce(sum(n) FILTER (label = c.class AND prediction = c.class), 0) AS tp,
  coalesce(sum(n) FILTER (label = c.class), 0) AS support,
  coalesce(sum(n) FILTER (prediction = c.class), 0) AS predicted
  FROM cls c JOIN cm ON {" AND ".join(f"cm.{x.strip()} = c.{x.strip()}" for x in by.split(","))} GROUP BY ALL),
scores AS (SELECT {by}, class, tp, support, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
  CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall, 2.0 * tp / (predicted + support) AS f1 FROM sc)"""


@REG.add("confusion_matrix", f"WITH {ORDER_PREDICTIONS_SQL} SELECT model_name, label, prediction, count(*) AS n FROM preds GROUP BY ALL")
def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return ev.confusion_matrix(order_predictions(spark, folder), "label", "prediction", ["model_name"])


@REG.add(
    "classification_metrics",
    f"""WITH {_scores_sql("model_name, dataset")}
SELECT model_name, dataset, round(sum(tp) / sum(support), 6) AS accuracy,
 round(sum(precision * support) / sum(support), 6) AS precision, round(sum(recall * support) / sum(support), 6) AS recall,
 round(sum(f1 * support) / sum(support), 6) AS f1, CAST(sum(support) AS BIGINT) AS n FROM scores GROUP BY ALL""",
)
def classification_metrics(spark: SparkSession, folder: str) -> DataFrame:
    by = ["model_name", "dataset"]
    matrix = ev.confusion_matrix(order_predictions(spark, folder), "label", "prediction", by)
    return rounded(ev.classification_metrics(matrix, by))


@REG.add(
    "classification_metrics_macro",
    f"""WITH {_scores_sql("dataset")}
SELECT dataset, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS precision,
 round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, CAST(sum(support) AS BIGINT) AS n FROM scores GROUP BY ALL""",
)
def classification_metrics_macro(spark: SparkSession, folder: str) -> DataFrame:
    matrix = ev.confusion_matrix(order_predictions(spark, folder), "label", "prediction", ["dataset"])
    return rounded(ev.classification_metrics(matrix, ["dataset"], average="macro"))


@REG.add(
    "classification_metrics_positive",
    """WITH b AS (SELECT quality AS label, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS prediction
      FROM labels JOIN documents USING (doc_id)),
    s AS (SELECT count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (prediction = 1) AS p,
      count(*) FILTER (label = 1) AS t, count(*) FILTER (label = prediction) AS ok, count(*) AS n FROM b)
    SELECT round(ok / n, 6) AS accuracy, round(tp / p, 6) AS precision, round(tp / t, 6) AS recall,
      round(2.0 * tp / (p + t), 6) AS f1, n FROM s""",
)
def classification_metrics_positive(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", (F.col("n_chars") > 1000).cast("int").alias("prediction"))
    pairs = table(spark, folder, "labels").join(docs, "doc_id")
    matrix = ev.confusion_matrix(pairs, "quality", "prediction")
    return rounded(ev.classification_metrics(matrix, average="positive", positive=1))


@REG.add(
    "class_report",
    f"""WITH {_scores_sql("dataset")}
SELECT dataset, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  CAST(support AS BIGINT) AS support FROM scores
UNION ALL SELECT dataset, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT)
  FROM scores GROUP BY dataset
UNION ALL SELECT dataset, 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM scores GROUP BY dataset""",
)
def class_report(spark: SparkSession, folder: str) -> DataFrame:
    matrix = ev.confusion_matrix(order_predictions(spark, folder), "label", "prediction", ["dataset"])
    return rounded(ev.class_report(matrix, ["dataset"]))


_AUC_SQL = """WITH r AS (SELECT l_linestatus, l_returnflag = 'R' AS pos,
  rank() OVER (PARTITION BY l_linestatus ORDER BY {s}) + (count(*) OVER (PARTITION BY l_linestatus, {s}) - 1) / 2.0 AS rk FROM lineitem)
SELECT l_linestatus, count(*) FILTER (pos) AS n_positive, count(*) FILTER (NOT pos) AS n_negative,
  round((sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0)
    / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)), 6) AS roc_auc FROM r GROUP BY l_linestatus"""


@REG.add("roc_auc", _AUC_SQL.format(s="l_extendedprice"))
def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        ev.roc_auc(table(spark, folder, "lineitem"), F.col("l_returnflag") == "R", "l_extendedprice", ["l_linestatus"])
    )


@REG.add("roc_auc_tied_scores", _AUC_SQL.format(s="l_quantity"))
def roc_auc_tied_scores(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        ev.roc_auc(table(spark, folder, "lineitem"), F.col("l_returnflag") == "R", "l_quantity", ["l_linestatus"])
    )


@REG.add(
    "roc_auc_null_labels",
    _AUC_SQL.format(s="l_extendedprice").replace("FROM lineitem)", "FROM lineitem WHERE l_returnflag <> 'N' AND l_quantity > 3)"),
)
def roc_auc_null_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Rows without a label, and those whose score is null or not a number, are left out; tiny slices."""
    lines = table(spark, folder, "lineitem").select(
        "l_linestatus", F.nullif("l_returnflag", F.lit("N")).alias("flag"),
        F.when(F.col("l_quantity") > 3, F.col("l_extendedprice")).when(F.col("l_quantity") > 1, float("nan")).alias("score"),
    )
    return rounded(ev.roc_auc(lines, F.col("flag") == "R", "score", ["l_linestatus"], hot_rows=500))


_REG_SQL = """count(*) AS n, round(avg((target - prediction) * (target - prediction)), 4) AS mse,
 round(sqrt(avg((target - prediction) * (target - prediction))), 4) AS rmse, round(avg(abs(target - prediction)), 4) AS mae,
 round(1 - avg((target - prediction) * (target - prediction)) / var_pop(target), 4) AS r2,
 round(CASE WHEN count(*) FILTER (target = 0) = 0 THEN avg(abs((target - prediction) / target)) END, 4) AS mape"""


@REG.add("regression_metrics", f"WITH {PRICE_PREDICTIONS_SQL} SELECT l_returnflag, {_REG_SQL} FROM priced GROUP BY 1")
def regression_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ev.regression_metrics(price_predictions(spark, folder), "target", "prediction", ["l_returnflag"]), 4)


@REG.add(
    "regression_metrics_null_predictions",
    f"WITH {PRICE_PREDICTIONS_SQL} SELECT l_returnflag, {_REG_SQL} FROM priced WHERE target >= 20000 GROUP BY 1",
)
def regression_metrics_null_predictions(spark: SparkSession, folder: str) -> DataFrame:
    priced = price_predictions(spark, folder).withColumn("prediction", F.when(F.col("target") >= 20000, F.col("prediction")))
    return rounded(ev.regression_metrics(priced, "target", "prediction", ["l_returnflag"]), 4)


@REG.add(
    "error_report",
    f"""WITH {PRICE_PREDICTIONS_SQL}, e AS (SELECT *, prediction - target AS err FROM priced)
SELECT dataset, count(*) AS n, round(avg(err), 4) AS mean_error, round(stddev_samp(err), 4) AS error_std,
 round(avg(abs(err)), 4) AS mae, round(max(abs(err)), 4) AS max_abs_error, round(avg(abs(err / target)), 4) AS mape,
 round(count(*) FILTER (err < 0) / count(*), 4) AS under_share, round(count(*) FILTER (err > 0) / count(*), 4) AS over_share
FROM e GROUP BY dataset""",
)
def error_report(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ev.error_report(price_predictions(spark, folder), "target", "prediction", ["dataset"]), 4)


@REG.add(
    "residuals",
    f"WITH {PRICE_PREDICTIONS_SQL} SELECT dataset, l_returnflag, round(sum(target - prediction), 2) AS residual_sum, "
    "round(min(target - prediction), 4) AS residual_min, round(max(target - prediction), 4) AS residual_max FROM priced GROUP BY ALL",
)
def residuals(spark: SparkSession, folder: str) -> DataFrame:
    residual = F.col("target") - F.col("prediction")
    return rounded(rounded(
        price_predictions(spark, folder).groupBy("dataset", "l_returnflag").agg(
            F.sum(residual).alias("residual_sum"), F.min(residual).alias("residual_min"), F.max(residual).alias("residual_max")
        ), 4, ["residual_min", "residual_max"]), 2, ["residual_sum"])


@REG.add(
    "degradation",
    f"""WITH {_scores_sql("model_name, dataset")}, m AS (SELECT model_name, dataset, sum(f1 * support) / sum(support) AS f1
 FROM scores GROUP BY ALL)
SELECT a.model_name, round(a.f1, 6) AS reference_f1, round(b.f1, 6) AS current_f1,
 round(CASE WHEN a.f1 = 0 THEN 0 ELSE (a.f1 - b.f1) / a.f1 * 100 END, 4) AS degradation
FROM m a JOIN m b ON a.model_name = b.model_name AND a.dataset = 'reference' AND b.dataset = 'current'""",
)
def degradation(spark: SparkSession, folder: str) -> DataFrame:
    by = ["model_name", "dataset"]
    matrix = ev.confusion_matrix(order_predictions(spark, folder), "label", "prediction", by)
    wide = (
        ev.classification_metrics(matrix, by).groupBy("model_name").pivot("dataset", ["reference", "current"])
        .agg(F.first("f1"))
    )
    out = wide.select(
        "model_name", F.col("reference").alias("reference_f1"), F.col("current").alias("current_f1"),
        ev.degradation(F.col("reference"), F.col("current")).alias("degradation"),
    )
    return rounded(rounded(out, 4, ["degradation"]), 6, ["reference_f1", "current_f1"])


PROBS_SQL = """probs AS (SELECT o_orderkey, o_orderpriority AS model_name, o_totalprice / 500000 AS p0,
 (1 - o_totalprice / 500000) * 0.75 AS p1, (1 - o_totalprice / 500000) * 0.25 AS p2 FROM orders)"""


def probabilities(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("o_totalprice") / 500000
    return table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("model_name"),
        F.array(p, (1 - p) * 0.75, (1 - p) * 0.25).alias("probabilities"),
    ).withColumn("prediction", (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("double"))


@REG.add(
    "confidence_gate",
    f"""WITH {PROBS_SQL}, m AS (SELECT *, greatest(p0, p1, p2) AS mp FROM probs)
SELECT o_orderkey, CAST(CASE WHEN p0 = mp THEN 0 WHEN p1 = mp THEN 1 ELSE 2 END AS DOUBLE) AS prediction,
 round(mp, 10) AS max_probability, mp >= 0.6 AS is_confident,
 CAST(CASE WHEN mp < 0.6 THEN -1 WHEN p0 = mp THEN 0 WHEN p1 = mp THEN 1 ELSE 2 END AS DOUBLE) AS confident_prediction FROM m""",
)
def confidence_gate(spark: SparkSession, folder: str) -> DataFrame:
    gated = ev.confidence_gate(probabilities(spark, folder), "probabilities", "prediction", 0.6)
    return rounded(gated.drop("probabilities", "model_name"), 10)


@REG.add(
    "prediction_mix",
    f"""WITH {PROBS_SQL}, m AS (SELECT *, greatest(p0, p1, p2) AS mp FROM probs)
SELECT model_name, CAST(CASE WHEN p0 = mp THEN 0 WHEN p1 = mp THEN 1 ELSE 2 END AS DOUBLE) AS prediction_class,
 count(*) AS predictions, round(avg(mp), 6) AS confidence FROM m GROUP BY ALL""",
)
def prediction_mix(spark: SparkSession, folder: str) -> DataFrame:
    scored = probabilities(spark, folder).withColumn("confidence", F.array_max("probabilities"))
    return rounded(ev.prediction_mix(scored, "model_name", "prediction", "confidence"))


@REG.add(
    "inference_stats",
    """WITH runs AS (SELECT event_type, user_id AS predictions, value / 1000 AS seconds, value > 150 AS failed FROM events)
SELECT event_type, CAST(sum(predictions) AS BIGINT) AS total_predictions, round(sum(seconds), 6) AS total_seconds,
 count(*) FILTER (failed) AS error_count, round(sum(seconds) / sum(predictions), 6) AS seconds_per_prediction,
 round(count(*) FILTER (failed) / sum(predictions), 6) AS error_rate FROM runs GROUP BY 1""",
)
def inference_stats(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "events").select(
        "event_type", F.col("user_id").alias("predictions"), (F.col("value") / 1000).alias("seconds"),
        (F.col("value") > 150).alias("failed"),
    )
    return rounded(ev.inference_stats(runs, ["event_type"]))


@REG.add(
    "latency_quantiles",
    """SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
 round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""",
)
def latency_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return rounded(exact_quantiles(events, ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}))


@REG.add(
    "target_distribution",
    "SELECT o_orderstatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1",
)
def target_distribution(spark: SparkSession, folder: str) -> DataFrame:
    from loomtide.operators.profile import class_counts

    return rounded(class_counts(table(spark, folder, "orders"), "o_orderstatus"))
