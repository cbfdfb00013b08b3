"""Drift and health queries.

Role: orders before 1998 are the reference, later ones the current data, order priority names the model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtide.operators import drift, health
from loomtide.session import shared_folder
from registry.common import Registry, rounded, table
from registry.evaluation import ORDER_PREDICTIONS_SQL, _scores_sql, order_predictions

REG = Registry()

NUMERIC = ["o_totalprice", "order_day", "price_band"]
CATEGORICAL = ["label", "order_year", "is_large"]

FEATURES_SQL = f"""{ORDER_PREDICTIONS_SQL},
feats AS (SELECT *, CAST(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS DOUBLE) AS order_day,
  floor(o_totalprice / 125000) AS price_band, CAST(year(o_orderdate) AS VARCHAR) AS order_year,
  CAST(o_totalprice > 250000 AS VARCHAR) AS is_large FROM preds)"""

NUM_LONG_SQL = f"""{FEATURES_SQL},
num AS (SELECT model_name, dataset, 'o_totalprice' AS column_name, o_totalprice AS value FROM feats
  UNION ALL SELECT model_name, dataset, 'order_day', order_day FROM feats
  UNION ALL SELECT model_name, dataset, 'price_band', price_band FROM feats),
nc AS (SELECT model_name, column_name, value, count(*) FILTER (dataset = 'reference') AS r,
  count(*) FILTER (dataset = 'current') AS c FROM num GROUP BY ALL),
cum AS (SELECT *, sum(r) OVER w / sum(r) OVER p AS fr, sum(c) OVER w / sum(c) OVER p AS fc,
  lead(value) OVER w AS nxt, sum(r) OVER p AS tr, sum(c) OVER p AS tc
  FROM nc WINDOW w AS (PARTITION BY model_name, column_name ORDER BY value), p AS (PARTITION BY model_name, column_name))"""

CAT_LONG_SQL = f"""{FEATURES_SQL},
cat AS (SELECT model_name, dataset, 'label' AS column_name, label AS value FROM feats
  UNION ALL SELECT model_name, dataset, 'order_year', order_year FROM feats
  UNION ALL SELECT model_name, dataset, 'is_large', is_large FROM feats),
cc AS (SELECT model_name, column_name, value, count(*) FILTER (dataset = 'reference') AS r,
  count(*) FILTER (dataset = 'current') AS c FROM cat GROUP BY ALL),
ct AS (SELECT *, sum(r) OVER p AS tr, sum(c) OVER p AS tc, r / sum(r) OVER p AS p, c / sum(c) OVER p AS q FROM cc
  WINDOW p AS (PARTITION BY model_name, column_name))"""


def order_features(spark: SparkSession, folder: str) -> DataFrame:
    day = F.datediff(F.col("o_orderdate"), F.lit("1995-01-01"))
    return order_predictions(spark, folder).select(
        "*",
        day.cast("double").alias("order_day"),
        F.floor(F.col("o_totalprice") / 125000).cast("double").alias("price_band"),
        F.year("o_orderdate").cast("string").alias("order_year"),
        (F.col("o_totalprice") > 250000).cast("string").alias("is_large"),
    )


@REG.add(
    "ks_drift",
    f"""WITH {NUM_LONG_SQL}, k AS (SELECT model_name, column_name, max(abs(fr - fc)) AS d, max(tr) AS n, max(tc) AS m
  FROM cum GROUP BY ALL),
s AS (SELECT *, d * sqrt(n * m / (n + m)) AS l FROM k)
SELECT model_name, column_name, round(d, 6) AS ks, CAST(n AS BIGINT) AS n_ref, CAST(m AS BIGINT) AS n_cur,
 round(CASE WHEN l < 0.2 THEN 1 ELSE least(1, greatest(0, 2 * (SELECT sum(CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * i * i * l * l))
   FROM range(1, 101) t(i)))) END, 6) AS p_value FROM s""",
)
def ks_drift(spark: SparkSession, folder: str) -> DataFrame:
    stats = drift.numeric_drift(order_features(spark, folder), NUMERIC, ["model_name"])
    return rounded(
        stats.select(
            "model_name", "column_name", "ks", "n_ref", "n_cur",
            drift.kolmogorov_p(F.col("ks"), F.col("n_ref"), F.col("n_cur")).alias("p_value"),
        )
    )


@REG.add(
    "ks_drift_sliced",
    f"""WITH {NUM_LONG_SQL}
SELECT nullif(model_name, '1-URGENT') AS model_name, column_name, round(max(abs(fr - fc)), 6) AS ks FROM cum GROUP BY ALL""",
)
def ks_drift_sliced(spark: SparkSession, folder: str) -> DataFrame:
    """Every model is a hot key, cut into slices; one has no name."""
    stats = drift.numeric_drift(unnamed_model(spark, folder), NUMERIC, ["model_name"], hot_rows=200)
    return rounded(stats.select("model_name", "column_name", "ks"))


@REG.add(
    "wasserstein_drift",
    f"""WITH {NUM_LONG_SQL}, sd AS (SELECT model_name, column_name, stddev_pop(value) AS s FROM num
  WHERE dataset = 'reference' GROUP BY ALL)
SELECT cum.model_name, cum.column_name, round(coalesce(sum(abs(fr - fc) * (nxt - value)), 0) / greatest(max(s), 0.001), 6) AS wasserstein
FROM cum JOIN sd ON cum.model_name = sd.model_name AND cum.column_name = sd.column_name GROUP BY ALL""",
)
def wasserstein_drift(spark: SparkSession, folder: str) -> DataFrame:
    stats = drift.numeric_drift(order_features(spark, folder), NUMERIC, ["model_name"])
    return rounded(stats.select("model_name", "column_name", "wasserstein"))


EXACT_ROWS = 60


@REG.add(
    "ks_exact_p",
    f"""WITH RECURSIVE v AS (SELECT c_nationkey AS model_name, c_acctbal AS value, (c_mktsegment = 'BUILDING')::INT AS r, (c_mktsegment = 'MACHINERY')::INT AS c
  FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
cum AS (SELECT model_name, sum(r) OVER o / sum(r) OVER p AS fr, sum(c) OVER o / sum(c) OVER p AS fc, sum(r) OVER p AS n, sum(c) OVER p AS m FROM v
  WINDOW o AS (PARTITION BY model_name ORDER BY value RANGE UNBOUNDED PRECEDING), p AS (PARTITION BY model_name)),
ks AS (SELECT model_name, max(abs(fr - fc)) AS d, max(n)::BIGINT AS n, max(m)::BIGINT AS m FROM cum GROUP BY 1 HAVING max(n) > 0 AND max(m) > 0),
paths AS (
  SELECT model_name, n, m, round(d * n * m)::BIGINT AS h, 0::BIGINT AS i, 0::BIGINT AS j, 1.0::DOUBLE AS p FROM ks WHERE n <= {EXACT_ROWS} AND m <= {EXACT_ROWS}
  UNION ALL SELECT model_name, n, m, h, i, j, sum(w) AS p FROM (
    SELECT model_name, n, m, h, i + move AS i, j + 1 - move AS j, p * CASE move WHEN 1 THEN i + 1 ELSE j + 1 END / (i + j + 1) AS w
    FROM (SELECT *, unnest([0, 1]) AS move FROM paths)) WHERE i <= n AND j <= m AND abs(i * m - j * n) < h GROUP BY model_name, n, m, h, i, j),
done AS (SELECT model_name, p AS inside FROM paths WHERE i = n AND j = m),
series AS (SELECT model_name, d * sqrt(n * m / (n + m)) AS x FROM ks)
SELECT ks.model_name, CASE WHEN n <= {EXACT_ROWS} AND m <= {EXACT_ROWS} THEN round(greatest(0, 1 - coalesce(inside, 0)), 6)
  ELSE round(CASE WHEN x < 0.2 THEN 1 ELSE least(1, greatest(0, 2 * list_sum([CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * k * k * x * x) FOR k IN range(1, 101)]))) END, 6) END AS drift_score,
 n AS n_ref, m AS n_cur FROM ks LEFT JOIN done ON ks.model_name = done.model_name JOIN series ON ks.model_name = series.model_name""",
)
def ks_exact_p(spark: SparkSession, folder: str) -> DataFrame:
    """Balances of two market segments per nation: exact p-values of small samples, the series for large ones."""
    customers = table(spark, folder, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(
        F.col("c_nationkey").alias("model_name"), F.col("c_acctbal").alias("value"),
        F.when(F.col("c_mktsegment") == "BUILDING", "reference").otherwise("current").alias("dataset"),
    )
    stats = drift.numeric_drift(customers, ["value"], ["model_name"])
    scores = drift.drift_scores(stats, F.lit("ks"), by=["model_name"], methods=["ks"], exact_rows=EXACT_ROWS)
    both = scores.where("drift_score is not null").select("model_name", "drift_score").join(stats.select("model_name", "n_ref", "n_cur"), "model_name")
    return rounded(both)


@REG.add(
    "chi2_drift",
    f"""WITH {CAT_LONG_SQL}
SELECT model_name, column_name, count(*) AS n_distinct, count(*) FILTER (r = 0 AND c > 0) AS unseen_categories,
 round(sum(CASE WHEN p > 0 THEN (c - p * tc) * (c - p * tc) / (p * tc) END), 4) AS chi_square FROM ct GROUP BY ALL""",
)
def chi2_drift(spark: SparkSession, folder: str) -> DataFrame:
    stats = drift.categorical_drift(order_features(spark, folder), CATEGORICAL, ["model_name"])
    return rounded(stats.select("model_name", "column_name", "n_distinct", "unseen_categories", "chi_square"), 4)


@REG.add(
    "z_drift",
    f"""WITH {CAT_LONG_SQL}
SELECT model_name, column_name, round(max(abs((p - q) / sqrt((r + c) / (tr + tc) * (1 - (r + c) / (tr + tc)) * (1 / tr + 1 / tc)))), 6) AS z
FROM ct WHERE column_name = 'is_large' GROUP BY ALL""",
)
def z_drift(spark: SparkSession, folder: str) -> DataFrame:
    stats = drift.categorical_drift(order_features(spark, folder), ["is_large"], ["model_name"])
    return rounded(stats.select("model_name", "column_name", "z"))


_JS = """sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END
 + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2))"""


@REG.add("js_drift", f"WITH {CAT_LONG_SQL} SELECT model_name, column_name, round({_JS}, 6) AS jensen_shannon FROM ct GROUP BY ALL")
def js_drift(spark: SparkSession, folder: str) -> DataFrame:
    stats = drift.categorical_drift(order_features(spark, folder), CATEGORICAL, ["model_name"])
    return rounded(stats.select("model_name", "column_name", "jensen_shannon"))


_SCORES_SQL = f"""{NUM_LONG_SQL},
sd AS (SELECT model_name, column_name, stddev_pop(value) AS s FROM num WHERE dataset = 'reference' GROUP BY ALL),
cat AS (SELECT model_name, dataset, 'label' AS column_name, label AS value FROM feats
  UNION ALL SELECT model_name, dataset, 'order_year', order_year FROM feats
  UNION ALL SELECT model_name, dataset, 'is_large', is_large FROM feats
  UNION ALL SELECT model_name, dataset, 'price_band', CAST(price_band AS VARCHAR) FROM feats),
ct AS (SELECT *, r / sum(r) OVER p AS p, c / sum(c) OVER p AS q FROM
  (SELECT model_name, column_name, value, count(*) FILTER (dataset = 'reference') AS r,
   count(*) FILTER (dataset = 'current') AS c FROM cat GROUP BY ALL) WINDOW p AS (PARTITION BY model_name, column_name)),
scores AS (SELECT cum.model_name, cum.column_name, 'wasserstein' AS method,
   coalesce(sum(abs(fr - fc) * (nxt - value)), 0) / greatest(max(s), 0.001) AS score
  FROM cum JOIN sd ON cum.model_name = sd.model_name AND cum.column_name = sd.column_name
  WHERE cum.column_name <> 'price_band' GROUP BY ALL
  UNION ALL SELECT model_name, column_name, 'jensen_shannon', {_JS} FROM ct GROUP BY ALL)"""


def _distance():
    return drift.method_by_kind(categories=["price_band"])


def _scored(stats: DataFrame, method) -> DataFrame:
    return drift.drift_scores(stats, method, by=["model_name"], methods=["wasserstein", "jensen_shannon"])


def _distance_scores(spark: SparkSession, folder: str) -> DataFrame:
    stats = drift.drift_statistics(order_features(spark, folder), NUMERIC, CATEGORICAL, ["model_name"])
    return _scored(stats, _distance())


@REG.add(
    "column_drift_scores",
    f"WITH {_SCORES_SQL} SELECT model_name, column_name, method, round(score, 6) AS drift_score, CAST(0.1 AS DOUBLE) AS threshold, score >= 0.1 AS drift_detected FROM scores",
)
def column_drift_scores(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_distance_scores(spark, folder))


@REG.add(
    "drift_requested_columns",
    f"""WITH {_SCORES_SQL} SELECT model_name, column_name, method, round(score, 6) AS drift_score, CAST(0.1 AS DOUBLE) AS threshold, score >= 0.1 AS drift_detected
 FROM scores WHERE column_name IN ('order_day', 'label', 'is_large')""",
)
def drift_requested_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Drift of the columns that were asked for, of which the table lacks one."""
    data = order_features(spark, folder)
    numeric, categorical = drift.compared_columns(data, ["order_day", "label", "is_large", "not_there"])
    return rounded(_scored(drift.drift_statistics(data, numeric, categorical, ["model_name"]), _distance()))


_SUMMARY_SQL = """SELECT model_name, count(*) AS number_of_columns, count(*) FILTER (score >= 0.1) AS number_of_drifted_columns,
 count(*) FILTER (score >= 0.1) / count(*) AS drift_share, count(*) FILTER (score >= 0.1) / count(*) >= 0.5 AS dataset_drift,
 count(*) FILTER (score >= 0.1) / count(*) > 0.1 AS drift_gate,
 string_agg(column_name, ',' ORDER BY column_name) FILTER (score >= 0.1) AS drifted_columns FROM scores GROUP BY model_name"""


@REG.add("dataset_drift", f"WITH {_SCORES_SQL}, x AS ({_SUMMARY_SQL}) SELECT * REPLACE (round(drift_share, 6) AS drift_share) FROM x")
def dataset_drift(spark: SparkSession, folder: str) -> DataFrame:
    out = drift.drift_gate(drift.drift_summary(_distance_scores(spark, folder), ["model_name"]))
    return rounded(out.withColumn("drifted_columns", F.array_join("drifted_columns", ",")))


@REG.add(
    "target_drift",
    f"""WITH {FEATURES_SQL}, cat AS (SELECT dataset, 'label' AS column_name, label AS value FROM feats
  UNION ALL SELECT dataset, 'prediction', prediction FROM feats),
ct AS (SELECT *, r / sum(r) OVER p AS p, c / sum(c) OVER p AS q FROM (SELECT column_name, value,
  count(*) FILTER (dataset = 'reference') AS r, count(*) FILTER (dataset = 'current') AS c FROM cat GROUP BY ALL)
  WINDOW p AS (PARTITION BY column_name))
SELECT column_name, round({_JS}, 6) AS jensen_shannon FROM ct GROUP BY ALL""",
)
def target_drift(spark: SparkSession, folder: str) -> DataFrame:
    stats = drift.categorical_drift(order_features(spark, folder), ["label", "prediction"])
    return rounded(stats.select("column_name", "jensen_shannon"))


@REG.add(
    "document_source_drift",
    f"""WITH cat AS (SELECT CASE WHEN n_chars < 1500 THEN 'reference' ELSE 'current' END AS dataset, lang, source FROM documents),
l AS (SELECT dataset, 'lang' AS column_name, lang AS value FROM cat UNION ALL SELECT dataset, 'source', source FROM cat),
ct AS (SELECT *, r / sum(r) OVER p AS p, c / sum(c) OVER p AS q FROM (SELECT column_name, value,
  count(*) FILTER (dataset = 'reference') AS r, count(*) FILTER (dataset = 'current') AS c FROM l GROUP BY ALL)
  WINDOW p AS (PARTITION BY column_name))
SELECT column_name, count(*) AS n_distinct, round({_JS}, 6) AS jensen_shannon FROM ct GROUP BY ALL""",
)
def document_source_drift(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(
        "lang", "source", F.when(F.col("n_chars") < 1500, "reference").otherwise("current").alias("dataset")
    )
    return rounded(drift.categorical_drift(docs, ["lang", "source"]).select("column_name", "n_distinct", "jensen_shannon"))


# one model without a name; methods by kind of column
_DEFAULT_SCORES_SQL = _SCORES_SQL.replace("\n  WHERE cum.column_name <> 'price_band' GROUP BY ALL", " GROUP BY ALL").replace(
    "\n  UNION ALL SELECT model_name, dataset, 'price_band', CAST(price_band AS VARCHAR) FROM feats", ""
)


def unnamed_model(spark: SparkSession, folder: str) -> DataFrame:
    return order_features(spark, folder).withColumn("model_name", F.nullif("model_name", F.lit("1-URGENT")))


@REG.add(
    "drift_tests_auto",
    f"""WITH {_DEFAULT_SCORES_SQL} SELECT nullif(model_name, '1-URGENT') AS model_name, column_name, method, round(score, 6) AS drift_score,
 CAST(0.1 AS DOUBLE) AS threshold, score >= 0.1 AS drift_detected FROM scores""",
)
def drift_tests_auto(spark: SparkSession, folder: str) -> DataFrame:
    """Methods by kind of column, a model without a name included."""
    stats = drift.drift_statistics(unnamed_model(spark, folder), NUMERIC, CATEGORICAL, ["model_name"])
    return rounded(drift.drift_scores(stats, by=["model_name"]))


_RUN_SQL = f"""{_SCORES_SQL}, summ AS ({_SUMMARY_SQL}), {{scores2}},
perf AS (SELECT model_name, dataset, sum(tp) / sum(support) AS accuracy, avg(f1) AS f1 FROM pscores GROUP BY ALL),
curr AS (SELECT model_name, count(*) AS n FROM feats WHERE dataset = 'current' GROUP BY 1),
run AS (SELECT s.model_name, n AS samples_analyzed, dataset_drift, drift_share, number_of_drifted_columns,
  CAST(0 AS DOUBLE) AS share_missing, a.accuracy AS current_accuracy, a.f1 AS current_f1, b.f1 AS reference_f1,
  CASE WHEN b.f1 = 0 THEN 0 ELSE (b.f1 - a.f1) / b.f1 * 100 END AS performance_degradation
  FROM summ s JOIN curr USING (model_name) JOIN perf a ON a.model_name = s.model_name AND a.dataset = 'current'
  JOIN perf b ON b.model_name = s.model_name AND b.dataset = 'reference')"""
_PSCORES = _scores_sql("model_name, dataset").split(",\ncm AS", 1)[1].replace("scores AS", "pscores AS")
_RUN_SQL = _RUN_SQL.replace("{scores2}", "cm AS" + _PSCORES)

_HEALTH = """CASE WHEN dataset_drift AND drift_share > 0.5 THEN 'critical' WHEN dataset_drift AND drift_share > 0.3 THEN 'warning'
 WHEN performance_degradation > 20 THEN 'critical' WHEN performance_degradation > 10 THEN 'warning' ELSE 'healthy' END"""


@REG.add(
    "monitoring_run",
    f"""WITH {_RUN_SQL} SELECT model_name, samples_analyzed, dataset_drift, round(drift_share, 6) AS drift_share,
 number_of_drifted_columns, share_missing, round(current_accuracy, 6) AS current_accuracy, round(current_f1, 6) AS current_f1,
 round(reference_f1, 6) AS reference_f1, round(performance_degradation, 4) AS performance_degradation,
 {_HEALTH} AS health_status FROM run""",
)
def monitoring_run(spark: SparkSession, folder: str) -> DataFrame:
    out = health.monitoring_run(
        order_features(spark, folder), F.lit("2002-01-01").cast("timestamp_ntz"), NUMERIC, CATEGORICAL, "label", "prediction",
        method=_distance(), methods=["wasserstein", "jensen_shannon"],
    ).drop("run_ts", "model_type", "drifted_columns", "current_precision", "current_recall")
    return rounded(rounded(out, 4, ["performance_degradation"]))


_DEFAULT_RUN_SQL = _RUN_SQL.replace(_SCORES_SQL, _DEFAULT_SCORES_SQL)


@REG.add(
    "monitoring_run_default",
    f"""WITH {_DEFAULT_RUN_SQL} SELECT nullif(model_name, '1-URGENT') AS model_name, samples_analyzed, dataset_drift, round(drift_share, 6) AS drift_share,
 number_of_drifted_columns, share_missing, round(current_accuracy, 6) AS current_accuracy, round(current_f1, 6) AS current_f1,
 round(reference_f1, 6) AS reference_f1, round(performance_degradation, 4) AS performance_degradation,
 {_HEALTH} AS health_status FROM run""",
)
def monitoring_run_default(spark: SparkSession, folder: str) -> DataFrame:
    """The run as jobs get it without options, on models of which one has no name."""
    out = health.monitoring_run(
        unnamed_model(spark, folder), F.lit("2002-01-01").cast("timestamp_ntz"), NUMERIC, CATEGORICAL, "label", "prediction"
    ).drop("run_ts", "model_type", "drifted_columns", "current_precision", "current_recall")
    return rounded(rounded(out, 4, ["performance_degradation"]))


RUNS_SQL = """
runs AS (SELECT event_type AS model_name, '1.0' AS model_version, date_trunc('day', ts)::TIMESTAMP AS run_ts, count(*) AS samples_analyzed,
  avg(CASE WHEN value > 60 THEN 1.0 ELSE 0.0 END) AS drift_share, avg(CASE WHEN value > 60 THEN 1.0 ELSE 0.0 END) >= 0.3 AS dataset_drift,
  count(*) FILTER (value > 200) AS number_of_drifted_columns, avg(CASE WHEN value < 1 THEN 1.0 ELSE 0.0 END) AS share_missing,
  avg(CASE WHEN value < 80 THEN 1.0 ELSE 0.0 END) AS current_accuracy, avg(value) - 40 AS performance_degradation
  FROM events GROUP BY ALL),
hruns AS (SELECT *, """ + _HEALTH + """ AS health_status FROM runs)"""


def daily_runs(spark: SparkSession, folder: str) -> DataFrame:
    """A monitoring history: one record per event type and day."""
    value = F.col("value")
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    runs = (
        table(spark, folder, "events")
        .groupBy(F.col("event_type").alias("model_name"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("run_ts"))
        .agg(
            F.lit("1.0").alias("model_version"),
            F.count(F.lit(1)).alias("samples_analyzed"),
            share(value > 60).alias("drift_share"),
            (share(value > 60) >= 0.3).alias("dataset_drift"),
            F.count_if(value > 200).alias("number_of_drifted_columns"),
            share(value < 1).alias("share_missing"),
            share(value < 80).alias("current_accuracy"),
            (F.avg(value) - 40).alias("performance_degradation"),
        )
    )
    status = health.health_status(F.col("dataset_drift"), F.col("drift_share"), F.col("performance_degradation"))
    return runs.withColumn("health_status", status)


@REG.add(
    "health_status",
    f"""WITH {RUNS_SQL} SELECT model_name, run_ts, health_status,
  CAST(CASE health_status WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END AS DOUBLE) AS health_value FROM hruns""",
)
def health_status(spark: SparkSession, folder: str) -> DataFrame:
    return daily_runs(spark, folder).select(
        "model_name", "run_ts", "health_status", health.health_value(F.col("health_status")).alias("health_value")
    )


_SAMPLES_SQL = f"""{RUNS_SQL},
tot AS (SELECT *, sum(samples_analyzed) OVER (PARTITION BY model_name ORDER BY run_ts) AS samples_total,
  count(*) OVER (PARTITION BY model_name, health_status ORDER BY run_ts) AS runs_total FROM hruns),
base AS (SELECT *, 'model_name=' || model_name || ',model_version=' || model_version AS l FROM tot),
samples AS (
  SELECT run_ts AS ts, 'ml_data_drift_detected' AS metric, l AS labels, CAST(CAST(dataset_drift AS INT) AS DOUBLE) AS value FROM base
  UNION ALL SELECT run_ts, 'ml_data_drift_share', l, drift_share FROM base
  UNION ALL SELECT run_ts, 'ml_drifted_columns_count', l, number_of_drifted_columns FROM base
  UNION ALL SELECT run_ts, 'ml_missing_values_share', l, share_missing FROM base
  UNION ALL SELECT run_ts, 'ml_model_accuracy', l, current_accuracy FROM base
  UNION ALL SELECT run_ts, 'ml_performance_degradation_percent', l, performance_degradation FROM base
  UNION ALL SELECT run_ts, 'ml_model_health_status', l, CASE health_status WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END FROM base
  UNION ALL SELECT run_ts, 'ml_samples_analyzed_total', l, samples_total FROM base
  UNION ALL SELECT run_ts, 'ml_monitoring_runs_total', l || ',status=' || health_status, runs_total FROM base)"""


@REG.add("metric_export", f"WITH {_SAMPLES_SQL} SELECT ts, metric, labels, round(CAST(value AS DOUBLE), 6) AS value FROM samples")
def metric_export(spark: SparkSession, folder: str) -> DataFrame:
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rounded(health.metric_samples(daily_runs(spark, folder)).withColumn("labels", F.array_join(pairs, ",")))


FULL_RUNS_SQL = """
full_runs AS (SELECT event_type AS model_name, '1.0' AS model_version, date_trunc('day', ts)::TIMESTAMP AS run_ts,
  avg(CASE WHEN value < 70 THEN 1.0 ELSE 0.0 END) AS f1, avg(CASE WHEN value < 90 THEN 1.0 ELSE 0.0 END) AS prec,
  avg(CASE WHEN value < 60 THEN 1.0 ELSE 0.0 END) AS rec, count(*) / 4.0 AS secs,
  avg(value) / 70 AS value_score, avg(user_id % 10) / 7 AS user_score FROM events GROUP BY ALL),
full_base AS (SELECT *, 'model_name=' || model_name || ',model_version=' || model_version AS l,
  sum(secs) OVER (PARTITION BY model_name ORDER BY run_ts) AS total_secs, count(*) OVER (PARTITION BY model_name ORDER BY run_ts) AS n_runs
  FROM full_runs)"""

_ALL_SAMPLES_SQL = f"""{_SAMPLES_SQL}, {FULL_RUNS_SQL},
every AS (SELECT * FROM samples
  UNION ALL SELECT run_ts, 'ml_model_f1_score', l, f1 FROM full_base
  UNION ALL SELECT run_ts, 'ml_model_precision', l, prec FROM full_base
  UNION ALL SELECT run_ts, 'ml_model_recall', l, rec FROM full_base
  UNION ALL SELECT run_ts, 'ml_monitoring_duration_seconds_sum', l, total_secs FROM full_base
  UNION ALL SELECT run_ts, 'ml_monitoring_duration_seconds_count', l, n_runs FROM full_base
  UNION ALL SELECT run_ts, 'ml_column_drift_score', 'column_name=value,' || l, value_score FROM full_base
  UNION ALL SELECT run_ts, 'ml_column_drift_score', 'column_name=user,' || l, user_score FROM full_base)"""


def full_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Samples of all exported series: daily runs with every measure, their duration and the scores of two columns."""
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    value = F.col("value")
    more = table(spark, folder, "events").groupBy(
        F.col("event_type").alias("model_name"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("run_ts")
    ).agg(
        share(value < 70).alias("current_f1"), share(value < 90).alias("current_precision"), share(value < 60).alias("current_recall"),
        (F.count(F.lit(1)) / 4.0).alias("duration_seconds"), (F.avg(value) / 70).alias("value_score"),
        (F.avg(F.col("user_id") % 10) / 7).alias("user_score"),
    )
    runs = daily_runs(spark, folder).join(more, ["model_name", "run_ts"])
    entry = lambda name, c: F.struct(F.lit(name).alias("column_name"), F.col(c).alias("drift_score"))
    scores = runs.select(
        "model_name", "model_version", "run_ts", F.inline(F.array(entry("value", "value_score"), entry("user", "user_score")))
    )
    return health.metric_samples(runs, scores)


@REG.add("metric_export_full", f"WITH {_ALL_SAMPLES_SQL} SELECT ts, metric, labels, round(CAST(value AS DOUBLE), 6) AS value FROM every")
def metric_export_full(spark: SparkSession, folder: str) -> DataFrame:
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rounded(full_samples(spark, folder).withColumn("labels", F.array_join(pairs, ",")))


@REG.add(
    "exposition_lines",
    f"""WITH {_ALL_SAMPLES_SQL} SELECT metric || '{{' || array_to_string([split_part(x, '=', 1) || '="' || split_part(x, '=', 2) || '"' FOR x IN string_split(labels, ',')], ',')
   || '}} ' || CAST(round(CAST(value AS DOUBLE), 9) AS VARCHAR) AS line FROM every""",
)
def exposition_lines(spark: SparkSession, folder: str) -> DataFrame:
    return health.exposition_lines(rounded(full_samples(spark, folder), 9))


@REG.add(
    "check_summary",
    f"""WITH {RUNS_SQL}, m AS (SELECT DISTINCT o_orderpriority AS model_name FROM orders UNION SELECT model_name FROM hruns),
l AS (SELECT m.model_name, health_status, CASE WHEN health_status IS NULL THEN 'skipped' ELSE 'completed' END AS status
  FROM m LEFT JOIN hruns ON m.model_name = hruns.model_name)
SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (health_status = 'healthy') AS healthy,
 count(*) FILTER (health_status = 'warning') AS warning, count(*) FILTER (health_status = 'critical') AS critical,
 count(*) FILTER (status = 'error') AS errors FROM l""",
)
def check_summary(spark: SparkSession, folder: str) -> DataFrame:
    runs = daily_runs(spark, folder)
    models = (
        table(spark, folder, "orders").select(F.col("o_orderpriority").alias("model_name"))
        .unionByName(runs.select("model_name")).distinct()
    )
    return health.check_summary(health.check_list(models, runs))


@REG.add(
    "critical_alerts",
    f"""WITH {_SCORES_SQL}, x AS ({_SUMMARY_SQL.replace("FROM scores", "FROM scores WHERE column_name IN ('order_day', 'order_year', 'label')")})
 SELECT model_name, round(drift_share, 6) AS drift_share, number_of_drifted_columns,
  replace(drifted_columns, ',', ', ') AS drifted_features FROM x WHERE dataset_drift AND drift_share > 0.5""",
)
def critical_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Models watched by three columns, of which two drift."""
    stats = drift.drift_statistics(order_features(spark, folder), ["order_day"], ["order_year", "label"], ["model_name"])
    found = drift.drift_summary(_scored(stats, _distance()), ["model_name"])
    runs = found.withColumn(
        "health_status", health.health_status(F.col("dataset_drift"), F.col("drift_share"), F.lit(0.0))
    )
    return rounded(health.critical_alerts(runs))


@REG.add(
    "run_history",
    f"""WITH {RUNS_SQL} SELECT model_name, run_ts, round(drift_share, 6) AS drift_share,
 round(lag(drift_share) OVER w, 6) AS previous_drift_share, round(drift_share - lag(drift_share) OVER w, 6) AS drift_share_change
 FROM hruns WINDOW w AS (PARTITION BY model_name ORDER BY run_ts)""",
)
def run_history(spark: SparkSession, folder: str) -> DataFrame:
    out = health.run_history(daily_runs(spark, folder))
    return rounded(out.select("model_name", "run_ts", "drift_share", "previous_drift_share", "drift_share_change"))


@REG.add(
    "latest_run",
    f"""WITH {RUNS_SQL} SELECT model_name, run_ts, samples_analyzed, health_status FROM hruns
 QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY run_ts DESC) = 1""",
)
def latest_run(spark: SparkSession, folder: str) -> DataFrame:
    return health.latest_run(daily_runs(spark, folder)).select("model_name", "run_ts", "samples_analyzed", "health_status")


@REG.add(
    "exported_latest_run",
    f"""WITH {RUNS_SQL} SELECT model_name, samples_analyzed, round(drift_share, 6) AS drift_share, health_status FROM hruns
 QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY run_ts DESC) = 1""",
)
def exported_latest_run(spark: SparkSession, folder: str) -> DataFrame:
    """The newest run of each model, written as JSON and read again."""
    path = shared_folder(spark, "export")
    health.export_latest_json(daily_runs(spark, folder), path)
    found = spark.read.schema("model_name string, samples_analyzed long, drift_share double, health_status string").json(path)
    return rounded(found)


@REG.add(
    "model_inventory",
    """SELECT o_orderpriority || ':' || o_orderstatus AS model_key, 'classification' AS model_type, CAST(6 AS BIGINT) AS n_features,
  count(*) AS reference_rows FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' AND o_orderpriority = '1-URGENT' GROUP BY ALL""",
)
def model_inventory(spark: SparkSession, folder: str) -> DataFrame:
    reference = order_features(spark, folder).where("dataset = 'reference'").withColumn("model_version", F.col("label"))
    inventory = health.model_inventory(reference, "classification", len(NUMERIC) + len(CATEGORICAL))
    return health.find_model(inventory, "1-URGENT")


@REG.add(
    "regression_degradation",
    """WITH p AS (SELECT l_returnflag AS model_name, l_extendedprice AS t, l_quantity * 1500 AS y,
   CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 'r' ELSE 'c' END AS d FROM lineitem),
 m AS (SELECT model_name, d, sqrt(avg((t - y) * (t - y))) AS rmse, avg(abs(t - y)) AS mae,
   1 - avg((t - y) * (t - y)) / var_pop(t) AS r2 FROM p GROUP BY ALL)
 SELECT a.model_name, round(b.rmse, 4) AS current_rmse, round(b.mae, 4) AS current_mae, round(b.r2, 4) AS current_r2,
  round(a.r2, 4) AS reference_r2, round(CASE WHEN a.r2 = 0 THEN 0 ELSE (a.r2 - b.r2) / a.r2 * 100 END, 3) AS performance_degradation
 FROM m a JOIN m b ON a.model_name = b.model_name AND a.d = 'r' AND b.d = 'c'""",
)
def regression_degradation(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("model_name"), F.col("l_extendedprice").alias("target"),
        (F.col("l_quantity") * 1500).alias("prediction"), "l_discount",
        F.when(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"), "reference").otherwise("current")
        .alias("dataset"),
    )
    out = health.monitoring_run(
        lines, F.lit("2002-01-01").cast("timestamp_ntz"), ["l_discount"], [], "target", "prediction", "regression",
        method=_distance(), methods=["wasserstein", "jensen_shannon"],
    )
    return rounded(rounded(
        out.select("model_name", "current_rmse", "current_mae", "current_r2", "reference_r2", "performance_degradation"),
        3, ["performance_degradation"]), 4, ["current_rmse", "current_mae", "current_r2", "reference_r2"])
