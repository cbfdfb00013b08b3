"""Metric time series and alert queries.

Roles: each event is a sample of the counter of its type (the event id modulo 500, so it resets now and then); its
value is a latency; hourly means are gauges; suppliers are pods with requests, nations are namespaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtide.operators import alerts, series
from registry.common import Registry, rounded, table
from registry.monitoring import _SAMPLES_SQL, daily_runs
from loomtide.operators import health

REG = Registry()

COUNTER_SQL = """
raw AS (SELECT event_type, user_id % 3 AS shard, ts, event_id % 500 AS v,
  CASE WHEN user_id % 7 = 0 THEN '500' WHEN user_id % 7 = 1 THEN '503' ELSE '200' END AS status FROM events),
d AS (SELECT *, CASE WHEN lag(v) OVER w IS NULL THEN 0 WHEN v >= lag(v) OVER w THEN v - lag(v) OVER w ELSE v END AS delta
  FROM raw WINDOW w AS (PARTITION BY event_type ORDER BY ts))"""


def counters(spark: SparkSession, folder: str) -> DataFrame:
    user = F.col("user_id") % 7
    return table(spark, folder, "events").select(
        "event_type", "ts", (F.col("event_id") % 500).alias("v"),
        F.when(user == 0, "500").when(user == 1, "503").otherwise("200").alias("status"),
    )


def deltas(spark: SparkSession, folder: str) -> DataFrame:
    return series.counter_deltas(counters(spark, folder), ["event_type"], "ts", "v")


def _grid_sql(range_s: int, step: int, agg: str, by: str = "event_type") -> str:
    return f"""b AS (SELECT {by}, CAST(ceil(epoch_us(ts) / {step * 1000000}.0) AS BIGINT) AS i, sum(delta) AS x,
  sum(CASE WHEN regexp_full_match(status, '5..') THEN delta ELSE 0 END) AS bad FROM d GROUP BY ALL),
g AS (SELECT {by}, i + o AS e, x, bad FROM b, range(0, {range_s // step}) t(o))
SELECT {by}, make_timestamp(e * {step} * 1000000) AS eval_ts, {agg} FROM g GROUP BY ALL"""


@REG.add(
    "rate_5m",
    f"WITH {COUNTER_SQL}, " + _grid_sql(300, 60, "round(CAST(sum(x) AS DOUBLE), 6) AS increase, round(sum(x) / 300.0, 6) AS rate"),
)
def rate_5m(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(series.increase(deltas(spark, folder), ["event_type"], "ts", 300, 60))


@REG.add("increase_2h", f"WITH {COUNTER_SQL}, " + _grid_sql(7200, 900, "round(CAST(sum(x) AS DOUBLE), 6) AS increase"))
def increase_2h(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(series.increase(deltas(spark, folder), ["event_type"], "ts", 7200, 900).drop("rate"))


@REG.add(
    "increase_fine_grid",
    f"""WITH {COUNTER_SQL}, b AS (SELECT event_type, CAST(ceil(epoch_us(ts) / 15000000.0) AS BIGINT) AS i, sum(delta) AS x FROM d GROUP BY ALL),
g AS (SELECT event_type, i + o AS e, sum(x) AS x FROM b, range(0, 480) t(o) GROUP BY ALL)
SELECT event_type, CAST(date_trunc('day', make_timestamp(e * 15000000)) AS TIMESTAMP) AS day, count(*) AS evaluations,
 round(avg(x), 6) AS mean_increase, round(CAST(max(x) AS DOUBLE), 6) AS max_increase FROM g GROUP BY ALL""",
)
def increase_fine_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The increase over two hours at every 15 seconds, by day."""
    fine = series.increase(deltas(spark, folder), ["event_type"], "ts", 7200, 15)
    day = F.date_trunc("day", "eval_ts").cast("timestamp_ntz").alias("day")
    return rounded(fine.groupBy("event_type", day).agg(
        F.count(F.lit(1)).alias("evaluations"), F.avg("increase").alias("mean_increase"), F.max("increase").alias("max_increase"),
    ))


@REG.add(
    "error_ratio",
    f"WITH {COUNTER_SQL}, " + _grid_sql(3600, 300, "round(CASE WHEN sum(x) > 0 THEN sum(bad) / sum(x) END, 6) AS ratio"),
)
def error_ratio(spark: SparkSession, folder: str) -> DataFrame:
    failed = series.matches(F.create_map(F.lit("status"), F.col("status")), {"status": "~5.."})
    return rounded(series.rate_ratio(deltas(spark, folder), ["event_type"], "ts", failed, 3600, 300))


@REG.add(
    "request_rate_total",
    f"WITH {COUNTER_SQL}, " + _grid_sql(900, 300, "round(sum(x) / 900.0, 6) AS rate", "status"),
)
def request_rate_total(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(series.increase(deltas(spark, folder), ["status"], "ts", 900, 300).drop("increase"))


EDGES = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0]
_EDGE_ROWS = ", ".join(f"({e})" for e in EDGES) + ", ('infinity'::DOUBLE)"


@REG.add(
    "hist_quantile",
    f"""WITH e(le) AS (VALUES {_EDGE_ROWS}),
h AS (SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, le, count(*) FILTER (value <= le) AS n FROM events, e GROUP BY ALL),
l AS (SELECT *, coalesce(lag(n) OVER w, 0) AS n0, lag(le) OVER w AS l0, max(n) OVER (PARTITION BY event_type, hour) AS t FROM h
  WINDOW w AS (PARTITION BY event_type, hour ORDER BY le)),
"""
    + ", ".join(
        f"""q{p} AS (SELECT event_type, hour, CASE WHEN le = 'infinity'::DOUBLE THEN l0 ELSE coalesce(l0, 0) + (le - coalesce(l0, 0))
  * CASE WHEN n = n0 THEN 0 ELSE (0.{p} * t - n0) / (n - n0) END END AS v FROM l WHERE n >= 0.{p} * t
  QUALIFY row_number() OVER (PARTITION BY event_type, hour ORDER BY le) = 1)"""
        for p in ("50", "95", "99")
    )
    + """ SELECT event_type, hour, round(q50.v, 6) AS p50, round(q95.v, 6) AS p95, round(q99.v, 6) AS p99
FROM q50 JOIN q95 USING (event_type, hour) JOIN q99 USING (event_type, hour)""",
)
def hist_quantile(spark: SparkSession, folder: str) -> DataFrame:
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    samples = table(spark, folder, "events").select("event_type", hour, "value")
    buckets = series.histogram_buckets(samples, ["event_type", "hour"], "value", EDGES)
    return rounded(series.histogram_quantile(buckets, ["event_type", "hour"], {"p50": 0.5, "p95": 0.95, "p99": 0.99}))


def _rate_quantiles_sql(edges: list[float]) -> str:
    n = len(edges) + 1
    columns = lambda expr: ", ".join(expr.format(i=i) for i in range(n))
    fell = " OR ".join(f"c{i} < lag(c{i}) OVER w" for i in range(n))
    ends = [*map(str, edges), "'infinity'::DOUBLE"]
    long = " UNION ALL ".join(f"SELECT event_type, e, {ends[i]}::DOUBLE AS le, x{i} AS n FROM g" for i in range(n))
    counts = ", ".join(
        f"count(*) FILTER (value <= {ends[i]}) AS k{i}" if i < n - 1 else f"count(*) AS k{i}" for i in range(n)
    )
    quantile = lambda p: f"""q{p} AS (SELECT event_type, e, CASE WHEN le = 'infinity'::DOUBLE THEN l0 ELSE coalesce(l0, 0) + (le - coalesce(l0, 0))
  * CASE WHEN n = n0 THEN 0 ELSE (0.{p} * t - n0) / (n - n0) END END AS v FROM lined WHERE n >= 0.{p} * t AND t > 0
  QUALIFY row_number() OVER (PARTITION BY event_type, e ORDER BY le) = 1)"""  # noqa: E731
    return f"""WITH quarter AS (SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) AS q, {counts} FROM events GROUP BY ALL),
c AS (SELECT event_type, q AS ts, {columns("sum(k{i}) OVER w AS c{i}")} FROM quarter
  WINDOW w AS (PARTITION BY event_type, date_trunc('day', q) ORDER BY q)),
d AS (SELECT event_type, ts, {columns(f"CASE WHEN lag(c{{i}}) OVER w IS NULL THEN 0 WHEN {fell} THEN c{{i}} ELSE c{{i}} - lag(c{{i}}) OVER w END AS x{{i}}")}
  FROM c WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
b AS (SELECT event_type, CAST(ceil(epoch_us(ts) / 900000000.0) AS BIGINT) AS i, {columns("sum(x{i}) AS x{i}")} FROM d GROUP BY ALL),
g AS (SELECT event_type, i + o AS e, {columns("sum(x{i}) AS x{i}")} FROM b, range(0, 8) t(o) GROUP BY ALL),
long AS ({long}),
lined AS (SELECT *, coalesce(lag(n) OVER w, 0) AS n0, lag(le) OVER w AS l0, max(n) OVER (PARTITION BY event_type, e) AS t FROM long
  WINDOW w AS (PARTITION BY event_type, e ORDER BY le)),
{quantile("50")}, {quantile("95")}, {quantile("99")}
SELECT event_type, make_timestamp(e * 900000000) AS eval_ts, round(q50.v, 6) AS p50, round(q95.v, 6) AS p95, round(q99.v, 6) AS p99
FROM (SELECT DISTINCT event_type, e FROM g) LEFT JOIN q50 USING (event_type, e) LEFT JOIN q95 USING (event_type, e) LEFT JOIN q99 USING (event_type, e)"""


def histogram_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Counters of an exported histogram: cumulative counts of an event type's latencies by edge, read every 15 minutes,
    of a process that is restarted every day."""
    quarter = F.window(F.col("ts").cast("timestamp"), "15 minutes")["start"].cast("timestamp_ntz").alias("ts")
    names = [f"c{i}" for i in range(len(EDGES) + 1)]
    counts = [F.count_if(F.col("value") <= e).alias(n) for e, n in zip(EDGES, names)] + [F.count(F.lit(1)).alias(names[-1])]
    per_quarter = table(spark, folder, "events").groupBy("event_type", quarter).agg(*counts)
    since_start = W.partitionBy("event_type", F.to_date("ts")).orderBy("ts").rowsBetween(W.unboundedPreceding, W.currentRow)
    return per_quarter.select("event_type", "ts", F.array(*[F.sum(n).over(since_start) for n in names]).alias("counts"))


@REG.add("hist_quantile_rate", _rate_quantiles_sql(EDGES))
def hist_quantile_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Quantiles of what the buckets grew by over two hours, every 15 minutes."""
    grown = series.bucket_deltas(histogram_counters(spark, folder), ["event_type"], "ts", "counts")
    buckets = series.bucket_increase(grown, ["event_type"], "ts", EDGES, 7200, 900)
    return rounded(series.histogram_quantile(buckets, ["event_type", "eval_ts"], {"p50": 0.5, "p95": 0.95, "p99": 0.99}))


@REG.add(
    "instant_vector",
    """SELECT event_type, user_id, ts, value FROM events WHERE ts <= TIMESTAMP '2024-01-20 12:00:00' AND ts > TIMESTAMP '2024-01-20 00:00:00'
QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC) = 1""",
)
def instant_vector(spark: SparkSession, folder: str) -> DataFrame:
    at = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    return series.instant_vector(table(spark, folder, "events"), ["event_type", "user_id"], "ts", "value", at, 12 * 3600)


@REG.add(
    "resampled_gauge",
    """WITH b AS (SELECT event_type, CAST(ceil(epoch_us(ts) / 300000000.0) AS BIGINT) AS i, arg_max(value, ts) AS v, max(ts) AS t FROM events GROUP BY ALL),
g AS (SELECT event_type, i + o AS e, v, t FROM b, range(0, 12) t(o))
SELECT event_type, make_timestamp(e * 300000000) AS eval_ts, arg_max(v, t) AS value FROM g GROUP BY ALL""",
)
def resampled_gauge(spark: SparkSession, folder: str) -> DataFrame:
    return series.resample(table(spark, folder, "events"), ["event_type"], "ts", "value", 300, 3600)


@REG.add(
    "avg_over_time",
    """WITH b AS (SELECT event_type, CAST(ceil(epoch_us(ts) / 300000000.0) AS BIGINT) AS i, arg_max(value, ts) AS v FROM events GROUP BY ALL),
g AS (SELECT event_type, i + o AS e, v FROM b, range(0, 12) t(o))
SELECT event_type, make_timestamp(e * 300000000) AS eval_ts, round(avg(v), 6) AS value FROM g GROUP BY ALL""",
)
def avg_over_time(spark: SparkSession, folder: str) -> DataFrame:
    grid = series.resample(table(spark, folder, "events"), ["event_type"], "ts", "value", 300, 300)
    return rounded(series.over_time(grid, ["event_type"], "value", 3600, 300))


COST_SQL = """pods AS (SELECT s_name AS pod, n_name AS namespace, s_acctbal / 1000 AS cpu, s_acctbal * 1048576 AS memory
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def pods(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    return table(spark, folder, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_name").alias("pod"), F.col("n_name").alias("namespace"), (F.col("s_acctbal") / 1000).alias("cpu"),
        (F.col("s_acctbal") * 1048576).alias("memory"),
    )


@REG.add(
    "cost_by_namespace",
    f"WITH {COST_SQL} SELECT namespace, round(sum(cpu * 0.0416 + memory / 1073741824.0 * 0.00405), 6) AS cost FROM pods GROUP BY 1",
)
def cost_by_namespace(spark: SparkSession, folder: str) -> DataFrame:
    cost = series.unit_cost(F.col("cpu"), F.col("memory"))
    return rounded(pods(spark, folder).groupBy("namespace").agg(F.sum(cost).alias("cost")))


@REG.add(
    "topk_cost",
    f"WITH {COST_SQL} SELECT pod, namespace, round(sum(cpu * 0.0416), 6) AS cost FROM pods GROUP BY ALL ORDER BY cost DESC, pod LIMIT 10",
)
def topk_cost(spark: SparkSession, folder: str) -> DataFrame:
    per_pod = pods(spark, folder).groupBy("pod", "namespace").agg(F.sum(F.col("cpu") * series.CPU_PRICE).alias("cost"))
    return series.top_k(rounded(per_pod), "cost", 10, ["pod"])


HOURLY_SQL = """hourly AS (SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, avg(value) AS v FROM events GROUP BY ALL)"""


def hourly_gauge(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy(
        "event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    ).agg(F.avg("value").alias("v"))


_FOR_SQL = """r AS (SELECT *, CASE WHEN active AND NOT coalesce(lag(active) OVER w, false)
   OR active AND {gap} THEN {t} END AS rise FROM evals WINDOW w AS (PARTITION BY {k} ORDER BY {t})),
s AS (SELECT *, CASE WHEN active THEN last_value(rise IGNORE NULLS) OVER (PARTITION BY {k} ORDER BY {t} ROWS UNBOUNDED PRECEDING) END AS since FROM r)"""


@REG.add(
    "alert_for",
    f"""WITH {HOURLY_SQL}, evals AS (SELECT *, v > 45 AS active FROM hourly),
{_FOR_SQL.format(k="event_type", t="hour", gap="date_diff('second', lag(hour) OVER w, hour) > 7200")}
SELECT event_type, hour, since, CASE WHEN NOT active THEN 'inactive' WHEN date_diff('second', since, hour) >= 7200 THEN 'firing' ELSE 'pending' END AS state FROM s""",
)
def alert_for(spark: SparkSession, folder: str) -> DataFrame:
    evals = hourly_gauge(spark, folder).withColumn("active", series.threshold(F.col("v"), ">", 45.0))
    out = alerts.alert_states(evals, ["event_type"], "hour", for_seconds=7200, max_gap_seconds=7200)
    return out.select("event_type", "hour", "since", "state")


def _rule_rows() -> str:
    return ", ".join(
        f"('{r.name}', '{r.metric}', '{r.op}', {r.threshold}, {r.for_seconds}, '{r.severity}', '{r.category}')"
        for r in alerts.ALERT_RULES if not r.matcher
    )


CATALOGUE_SQL = f"""{_SAMPLES_SQL}, rules(rule, metric, op, threshold, for_seconds, severity, category) AS (VALUES {_rule_rows()}),
evals AS (SELECT rule, metric, labels, ts, value, for_seconds, severity, category,
  CASE op WHEN '==' THEN value = threshold WHEN '>' THEN value > threshold ELSE value < threshold END AS active
  FROM samples JOIN rules USING (metric)),
{_FOR_SQL.format(k="rule, metric, labels", t="ts", gap="false")},
states AS (SELECT *, CASE WHEN NOT active THEN 'inactive' WHEN date_diff('second', since, ts) >= for_seconds THEN 'firing' ELSE 'pending' END AS state FROM s)"""


def catalogue_states(spark: SparkSession, folder: str) -> DataFrame:
    samples = health.metric_samples(daily_runs(spark, folder))
    evals = alerts.evaluate_rules(samples).withColumn("series", series.series_key(F.col("labels")))
    return alerts.alert_states(evals, ["rule", "metric", "series"], "ts", for_seconds=F.col("for_seconds"))


@REG.add("alert_catalogue", f"WITH {CATALOGUE_SQL} SELECT rule, metric, labels AS series, ts, since, state, severity FROM states WHERE state <> 'inactive'")
def alert_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    states = catalogue_states(spark, folder).where("state != 'inactive'")
    return states.select("rule", "metric", "series", "ts", "since", "state", "severity")


_FLAG = "CASE WHEN v > 45 THEN 1.0 ELSE 0.0 END"
_DOWN = "CASE WHEN v > 60 THEN 0.0 ELSE 1.0 END"

#: Samples of every metric the catalogue names, made from the hourly mean (v) and the time (t) of each event type.
METRIC_ROLES = (
    ("ml_data_drift_detected", {}, _FLAG),
    ("ml_data_drift_share", {}, "v / 150"),
    ("ml_model_health_status", {}, "CASE WHEN v > 55 THEN 2.0 WHEN v > 45 THEN 1.0 ELSE 0.0 END"),
    ("ml_performance_degradation_percent", {}, "v - 35"),
    ("ml_model_accuracy", {}, "1.0 - v / 180"),
    ("ml_missing_values_share", {}, "v / 500"),
    ("ml_monitoring_runs:increase_2h", {}, "CASE WHEN v > 45 THEN 0.0 ELSE 2.0 END"),
    *[("up", {"job": job}, _DOWN) for job in (
        "evidently-monitoring", "mlflow-server", "mlflow-postgresql", "kserve-controller", "mlflow-server-metrics",
        "postgres-metrics", "kserve-controller-metrics", "kserve-inference-metrics", "unwatched",
    )],
    *[("http_request_duration_seconds:p95_5m", {"job": job}, "v / 25") for job in ("mlflow-server", "mlflow-server-metrics", "other")],
    *[("http_requests:error_ratio_5m", {"job": job}, "v / 700") for job in ("mlflow-server", "kserve", "mlflow-server-metrics")],
    ("pg_stat_activity_count", {"datname": "mlflow"}, "v * 1.5"), ("pg_stat_activity_count", {"datname": "postgres"}, "v * 9"),
    ("pg_stat_replication_flush_lag_seconds", {}, "v - 20"),
    ("pg_connections:usage", {}, "v / 60"),
    ("kserve_inference_service_status", {"status": "False"}, _FLAG), ("kserve_inference_service_status", {"status": "True"}, _FLAG),
    ("kserve_inference_duration_seconds:p95_5m", {}, "v / 9"),
    ("kserve_request_duration_seconds:p95_5m", {}, "v / 50"),
    ("kserve_requests:error_ratio_5m", {}, "v / 900"),
    ("kserve_model_loading_failures:increase_5m", {}, "CASE WHEN v > 50 THEN v - 50 ELSE 0.0 END"),
    ("kube_pod_container_status_restarts:rate_15m", {}, "CASE WHEN v > 55 THEN 0.5 ELSE 0.0 END"),
    ("kube_pod_status_phase", {"phase": "Pending"}, _FLAG), ("kube_pod_status_phase", {"phase": "Running"}, _FLAG),
    ("kube_node_status_condition", {"condition": "DiskPressure", "status": "true"}, _FLAG),
    ("kube_node_status_condition", {"condition": "DiskPressure", "status": "unknown"}, _FLAG),
    ("kserve_canary_traffic_percent", {"traffic_percent": "10"}, "10.0"), ("kserve_canary_traffic_percent", {"traffic_percent": "50"}, "50.0"),
    ("kserve_canary_deployment_start_time", {"pod": "a"}, "t - v * 70"), ("kserve_canary_deployment_start_time", {"pod": "b"}, "t - v * 65"),
)


def role_samples(spark: SparkSession, folder: str) -> DataFrame:
    """A sample of each role per event type and hour; the type is the label ``inference_service``."""
    gauge = hourly_gauge(spark, folder).withColumn("t", F.unix_timestamp(F.col("hour").cast("timestamp")).cast("double"))
    rows = []
    for metric, extra, value in METRIC_ROLES:
        labels = [F.lit("inference_service"), F.col("event_type"), *[F.lit(x) for pair in extra.items() for x in pair]]
        rows.append(F.struct(F.lit(metric).alias("metric"), F.create_map(*labels).alias("labels"), F.expr(value).cast("double").alias("value")))
    return gauge.select(F.col("hour").alias("ts"), F.inline(F.array(*rows)))


def _condition_sql() -> str:
    def side(no, node, name):
        out = []
        for c in alerts._leaves(node):
            value = "epoch(ts) - value" if c.age else "value"
            holds = "true" if c.op == "any" else f"{value} {c.op} {c.limit}"
            fits = "".join(f" AND labels['{k}'] = '{v}'" for k, v in c.matcher.items())
            out.append(f"SELECT {no} AS no, '{name}' AS side, series, labels['inference_service'] AS service, ts, {holds} AS holds FROM samples WHERE metric = '{c.metric}'{fits}")
        return out

    roles = " UNION ALL ".join(
        f"SELECT '{metric}' AS metric, MAP {{'inference_service': event_type{''.join(f', {k!r}: {x!r}' for k, x in extra.items())}}} AS labels, "
        f"'{','.join(sorted(f'{k}={x}' for k, x in [*extra.items(), ('inference_service', '@')]))}' AS pattern, event_type, hour AS ts, CAST({value} AS DOUBLE) AS value "
        "FROM (SELECT *, epoch(hour) AS t FROM hourly)"
        for metric, extra, value in METRIC_ROLES
    )
    leaves, rules = [], []
    for no, a in enumerate(alerts.CATALOGUE):
        both = isinstance(a.when, alerts.AndOn)
        leaves += side(no, a.when.left, "left") + side(no, a.when.right, "right") if both else side(no, a.when, "left")
        rules.append(f"({no}, '{a.group}', '{a.name}', {a.for_seconds}, '{a.severity}', {both})")
    return f"""{HOURLY_SQL}, roles AS ({roles}),
samples AS (SELECT *, replace(pattern, '@', event_type) AS series FROM roles),
leaves AS ({" UNION ALL ".join(leaves)}),
rules(no, grp, rule, for_seconds, severity, needs_right) AS (VALUES {", ".join(rules)}),
rights AS (SELECT no, service, ts, bool_or(holds) AS holds FROM leaves WHERE side = 'right' GROUP BY ALL),
lefts AS (SELECT no, service, series, ts, bool_or(holds) AS holds FROM leaves WHERE side = 'left' GROUP BY ALL),
evals AS (SELECT grp, rule, series, lefts.ts, for_seconds, severity, lefts.holds AND (NOT needs_right OR coalesce(rights.holds, false)) AS active
  FROM lefts JOIN rules USING (no) LEFT JOIN rights ON lefts.no = rights.no AND lefts.service = rights.service AND lefts.ts = rights.ts)"""


@REG.add(
    "alert_catalogue_all",
    f"""WITH {_condition_sql()},
{_FOR_SQL.format(k="grp, rule, series", t="ts", gap="false")}
SELECT grp AS rule_group, rule, series, ts, since, severity, CASE WHEN date_diff('second', since, ts) >= for_seconds THEN 'firing' ELSE 'pending' END AS state
FROM s WHERE active""",
)
def alert_catalogue_all(spark: SparkSession, folder: str) -> DataFrame:
    """Every alert of the catalogue: label matchers, ``or`` with one timer, ``and on`` with an age."""
    evals = alerts.evaluate_conditions(role_samples(spark, folder))
    states = alerts.alert_states(evals, ["group", "rule", "series"], "ts", for_seconds=F.col("for_seconds"))
    return states.where("state != 'inactive'").select(
        F.col("group").alias("rule_group"), "rule", "series", "ts", "since", "severity", "state"
    )


FIRING_SQL = f"""{CATALOGUE_SQL}, firing AS (SELECT CASE WHEN rule = 'HighMissingValues' THEN 'MonitoringServiceDown'
   WHEN rule LIKE 'ModelHealth%' THEN 'ModelHealth' ELSE rule END AS alertname,
   split_part(split_part(labels, ',', 1), '=', 2) || '-' || (day(ts) % 4) AS namespace, severity, category, ts FROM states WHERE state = 'firing')"""


def firing(spark: SparkSession, folder: str) -> DataFrame:
    """Firing alerts; the two health rules share a name, so that one can inhibit the other."""
    name = (
        F.when(F.col("rule") == "HighMissingValues", "MonitoringServiceDown")
        .when(F.col("rule").startswith("ModelHealth"), "ModelHealth").otherwise(F.col("rule"))
    )
    space = F.concat(F.col("labels")["model_name"], F.lit("-"), (F.dayofmonth("ts") % 4).cast("string"))
    states = catalogue_states(spark, folder).where("state = 'firing'")
    return states.select(name.alias("alertname"), space.alias("namespace"), "severity", "category", "ts")


@REG.add(
    "alert_inhibition",
    f"""WITH {FIRING_SQL} SELECT alertname, namespace, severity, category, ts FROM firing f
 WHERE NOT (severity = 'warning' AND EXISTS (SELECT 1 FROM firing c WHERE c.severity = 'critical' AND c.alertname = f.alertname AND c.namespace = f.namespace))
 AND NOT (alertname <> 'MonitoringServiceDown' AND EXISTS (SELECT 1 FROM firing c WHERE c.alertname = 'MonitoringServiceDown' AND c.namespace = f.namespace))""",
)
def alert_inhibition(spark: SparkSession, folder: str) -> DataFrame:
    return alerts.inhibit(firing(spark, folder))


@REG.add(
    "alert_routing",
    f"""WITH {FIRING_SQL} SELECT alertname, namespace, severity, category, ts, receiver FROM firing,
 (SELECT unnest(['pagerduty-critical', 'slack-notifications', 'slack-mlops']) AS receiver)
 WHERE (receiver = 'pagerduty-critical' AND severity = 'critical') OR (receiver = 'slack-notifications' AND severity = 'warning')
 OR (receiver = 'slack-mlops' AND severity <> 'warning' AND category = 'ml_monitoring')""",
)
def alert_routing(spark: SparkSession, folder: str) -> DataFrame:
    return alerts.route(firing(spark, folder))


@REG.add(
    "alert_groups",
    f"""WITH {FIRING_SQL} SELECT alertname, namespace, severity, count(*) AS alerts, min(ts) AS first_ts, max(ts) AS last_ts,
 make_timestamp(CAST(floor(epoch(ts) / 14400) AS BIGINT) * 14400 * 1000000) AS slot_start FROM firing GROUP BY alertname, namespace, severity, slot_start""",
)
def alert_groups(spark: SparkSession, folder: str) -> DataFrame:
    return alerts.group_alerts(firing(spark, folder), "ts")


@REG.add(
    "canary_semi_join",
    """WITH started AS (SELECT user_id AS inference_service, min(ts) AS s FROM events GROUP BY 1)
SELECT event_id, user_id AS inference_service, value FROM events WHERE event_type = 'signup'
 AND user_id IN (SELECT inference_service FROM started WHERE epoch(TIMESTAMP '2024-01-02') - epoch(s) > 3600)""",
)
def canary_semi_join(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    started = events.groupBy(F.col("user_id").alias("inference_service")).agg(F.min("ts").alias("s"))
    now = F.unix_timestamp(F.lit("2024-01-02 00:00:00").cast("timestamp"))
    old = started.where(now - F.unix_micros(F.col("s").cast("timestamp")) / 1e6 > 3600)
    canary = events.where("event_type = 'signup'").select("event_id", F.col("user_id").alias("inference_service"), "value")
    return alerts.both(canary, old, ["inference_service"])


@REG.add(
    "vector_or",
    f"""WITH {HOURLY_SQL}, a AS (SELECT * FROM hourly WHERE v > 60), b AS (SELECT * FROM hourly WHERE v < 70)
SELECT event_type, hour, round(v, 8) AS v FROM a UNION ALL
SELECT event_type, hour, round(v, 8) FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.event_type = b.event_type AND a.hour = b.hour)""",
)
def vector_or(spark: SparkSession, folder: str) -> DataFrame:
    gauge = hourly_gauge(spark, folder)
    return rounded(alerts.either(gauge.where("v > 60"), gauge.where("v < 70"), ["event_type", "hour"]), 8)


@REG.add(
    "silent_series",
    """SELECT DISTINCT o_custkey AS user_id FROM orders WHERE o_custkey NOT IN
 (SELECT user_id FROM events WHERE ts > TIMESTAMP '2024-01-30 22:00:00' AND ts <= TIMESTAMP '2024-01-31 00:00:00')""",
)
def silent_series(spark: SparkSession, folder: str) -> DataFrame:
    known = table(spark, folder, "orders").select(F.col("o_custkey").alias("user_id")).distinct()
    at = F.lit("2024-01-31").cast("timestamp_ntz")
    recent = table(spark, folder, "events").where((F.col("ts") <= at) & (F.col("ts") > at - F.expr("INTERVAL 2 HOUR")))
    grown = recent.groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("increase"))
    return series.absent_series(known, grown, ["user_id"], "increase")


@REG.add(
    "recording_rules",
    f"""WITH {_SAMPLES_SQL}, i AS (SELECT metric, split_part(split_part(labels, ',', 1), '=', 2) AS model_name, ts, value FROM samples
  WHERE metric IN ('ml_data_drift_share', 'ml_data_drift_detected', 'ml_model_health_status'))
SELECT 'drift_share_avg' AS record, model_name AS grp, round(avg(value), 6) AS value FROM i WHERE metric = 'ml_data_drift_share' GROUP BY model_name
UNION ALL SELECT 'drifted_models', strftime(ts, '%Y-%m-%d'), CAST(count(*) AS DOUBLE) FROM i WHERE metric = 'ml_data_drift_detected' AND value = 1 GROUP BY ts
UNION ALL SELECT 'models_by_health', CAST(CAST(value AS BIGINT) AS VARCHAR), CAST(count(*) AS DOUBLE) FROM i WHERE metric = 'ml_model_health_status' GROUP BY value""",
)
def recording_rules(spark: SparkSession, folder: str) -> DataFrame:
    samples = health.metric_samples(daily_runs(spark, folder))
    of = lambda metric: samples.where(F.col("metric") == metric)
    record = lambda df, name, group, value: df.groupBy(group.alias("grp")).agg(value.cast("double").alias("value")).select(
        F.lit(name).alias("record"), "grp", "value"
    )
    share = record(of("ml_data_drift_share"), "drift_share_avg", F.col("labels")["model_name"], F.avg("value"))
    drifted = record(of("ml_data_drift_detected").where("value = 1"), "drifted_models", F.date_format("ts", "yyyy-MM-dd"), F.count(F.lit(1)))
    by_health = record(of("ml_model_health_status"), "models_by_health", F.col("value").cast("long").cast("string"), F.count(F.lit(1)))
    return rounded(share.unionByName(drifted).unionByName(by_health))
