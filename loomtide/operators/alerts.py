"""Alert evaluation over metric samples: rules as data, pending and firing states, inhibition, routing, grouping."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtide.functions.columns import epoch_seconds
from loomtide.operators.series import series_key


@dataclass(frozen=True)
class Compare:
    """A comparison of the samples of a metric whose labels fit; ``any`` holds for every such sample.

    Matcher values are equal or, beginning with ``~``, anchored patterns. ``age`` compares the seconds since the time that
    the sample's value names.
    """

    metric: str
    op: str = "any"
    limit: float = 0.0
    matcher: dict[str, str] = field(default_factory=dict)
    age: bool = False


@dataclass(frozen=True)
class Or:
    """Holds for a label set if any part does."""

    parts: tuple[Compare, ...]


@dataclass(frozen=True)
class AndOn:
    """Holds for a label set of the left side if a label set of the right side with the same ``labels`` holds."""

    left: Compare | Or
    right: Compare | Or
    labels: tuple[str, ...]


@dataclass(frozen=True)
class Alert:
    """A condition that fires after it has held for some time."""

    group: str
    name: str
    when: Compare | Or | AndOn
    for_seconds: int
    severity: str
    category: str | None


def _alert(group, name, when, minutes, severity, category="ml_monitoring") -> Alert:
    return Alert(group, name, when, minutes * 60, severity, category)


def _is(metric, op, limit, **matcher) -> Compare:
    return Compare(metric, op, float(limit), matcher)


# fixed values: the alert catalogue. Conditions on rates, ratios and quantiles refer to samples derived with the functions
# in series.py, named by what they hold. Names repeat between groups, with other limits
CATALOGUE = (
    _alert("monitoring", "DataDriftDetected", _is("ml_data_drift_detected", "==", 1), 5, "warning"),
    _alert("monitoring", "HighDriftShare", _is("ml_data_drift_share", ">", 0.3), 5, "critical"),
    _alert("monitoring", "ModelHealthCritical", _is("ml_model_health_status", "==", 2), 5, "critical"),
    _alert("monitoring", "ModelHealthWarning", _is("ml_model_health_status", "==", 1), 15, "warning"),
    _alert("monitoring", "ModelPerformanceDegraded", _is("ml_performance_degradation_percent", ">", 10), 10, "warning"),
    _alert("monitoring", "ModelPerformanceSeverelyDegraded", _is("ml_performance_degradation_percent", ">", 20), 5, "critical"),
    _alert("monitoring", "LowModelAccuracy", _is("ml_model_accuracy", "<", 0.7), 10, "warning"),
    _alert("monitoring", "HighMissingValues", _is("ml_missing_values_share", ">", 0.1), 5, "warning"),
    _alert("monitoring", "MonitoringServiceDown", _is("up", "==", 0, job="evidently-monitoring"), 5, "critical"),
    _alert("monitoring", "NoRecentMonitoringRuns", _is("ml_monitoring_runs:increase_2h", "==", 0), 120, "warning"),
    _alert("mlops", "MLflowDown", _is("up", "==", 0, job="mlflow-server"), 2, "critical", "infrastructure"),
    _alert("mlops", "MLflowHighLatency", _is("http_request_duration_seconds:p95_5m", ">", 2, job="mlflow-server"), 5, "warning", "infrastructure"),
    _alert("mlops", "MLflowHighErrorRate", _is("http_requests:error_ratio_5m", ">", 0.05, job="mlflow-server"), 5, "critical", "infrastructure"),
    _alert("mlops", "PostgreSQLDown", _is("up", "==", 0, job="mlflow-postgresql"), 1, "critical", "infrastructure"),
    _alert("mlops", "PostgreSQLHighConnections", _is("pg_stat_activity_count", ">", 80, datname="mlflow"), 5, "warning", "infrastructure"),
    _alert("mlops", "PostgreSQLReplicationLag", _is("pg_stat_replication_flush_lag_seconds", ">", 30), 5, "warning", "infrastructure"),
    _alert("mlops", "KServeControllerDown", _is("up", "==", 0, job="kserve-controller"), 3, "critical", "infrastructure"),
    _alert("mlops", "InferenceServiceDown", _is("kserve_inference_service_status", "==", 1, status="False"), 3, "critical", "ml_serving"),
    _alert("mlops", "KServeHighErrorRate", _is("http_requests:error_ratio_5m", ">", 0.05, job="kserve"), 5, "critical", "ml_serving"),
    _alert("mlops", "InferenceServiceHighLatency", _is("kserve_inference_duration_seconds:p95_5m", ">", 5), 10, "warning", "ml_serving"),
    _alert("mlops", "ModelDriftDetected", _is("ml_data_drift_detected", "==", 1), 5, "warning"),
    _alert("mlops", "ModelRetrainingRequired", Or((_is("ml_data_drift_share", ">", 0.3), _is("ml_model_accuracy", "<", 0.7))), 10, "warning"),
    _alert("mlops", "PodCrashLooping", _is("kube_pod_container_status_restarts:rate_15m", ">", 0), 5, "warning", "kubernetes"),
    _alert("mlops", "PodPendingLong", _is("kube_pod_status_phase", "==", 1, phase="Pending"), 15, "warning", "kubernetes"),
    _alert("mlops", "NodeDiskPressure", _is("kube_node_status_condition", "==", 1, condition="DiskPressure", status="true"), 5, "critical", "kubernetes"),
    _alert("mlflow", "MLflowServerDown", _is("up", "==", 0, job="mlflow-server-metrics"), 5, "critical", None),
    _alert("mlflow", "MLflowHighLatency", _is("http_request_duration_seconds:p95_5m", ">", 2, job="mlflow-server-metrics"), 10, "warning", None),
    _alert("mlflow", "MLflowHighErrorRate", _is("http_requests:error_ratio_5m", ">", 0.1, job="mlflow-server-metrics"), 5, "warning", None),
    _alert("mlflow", "PostgreSQLDown", _is("up", "==", 0, job="postgres-metrics"), 2, "critical", None),
    _alert("mlflow", "PostgreSQLHighConnections", _is("pg_connections:usage", ">", 0.8), 5, "warning", None),
    _alert("kserve", "KServeControllerDown", _is("up", "==", 0, job="kserve-controller-metrics"), 5, "critical", None),
    _alert("kserve", "InferenceServiceDown", _is("up", "==", 0, job="kserve-inference-metrics"), 2, "warning", None),
    _alert("kserve", "InferenceServiceHighLatency", _is("kserve_request_duration_seconds:p95_5m", ">", 1), 10, "warning", None),
    _alert("kserve", "InferenceServiceHighErrorRate", _is("kserve_requests:error_ratio_5m", ">", 0.05), 5, "warning", None),
    _alert("kserve", "ModelLoadingFailure", _is("kserve_model_loading_failures:increase_5m", ">", 0), 1, "critical", None),
    _alert("kserve", "CanaryDeploymentStuck", AndOn(
        Compare("kserve_canary_traffic_percent", matcher={"traffic_percent": "10"}),
        Compare("kserve_canary_deployment_start_time", ">", 3600.0, age=True), ("inference_service",),
    ), 5, "warning", None),
)


def _leaves(node: Compare | Or) -> tuple[Compare, ...]:
    if isinstance(node, Compare):
        return (node,)
    if isinstance(node, Or) and all(isinstance(p, Compare) for p in node.parts):
        return node.parts
    raise ValueError("a side of a condition is a comparison or several joined by or")


@dataclass(frozen=True)
class AlertRule:
    """One comparison with its own timer."""

    name: str
    metric: str
    matcher: dict[str, str]
    op: str
    threshold: float
    for_seconds: int
    severity: str
    category: str


#: The catalogue's single comparisons of the monitoring and platform groups; an ``or`` gives one rule for each part.
ALERT_RULES = tuple(
    AlertRule(a.name, c.metric, c.matcher, c.op, c.limit, a.for_seconds, a.severity, a.category)
    for a in CATALOGUE if a.group in ("monitoring", "mlops") and not isinstance(a.when, AndOn) for c in _leaves(a.when)
)

RULE_SCHEMA = (
    "rule string, metric string, matcher map<string,string>, op string, threshold double, for_seconds long, "
    "severity string, category string"
)


def rules_frame(spark: SparkSession, rules: Sequence[AlertRule] = ALERT_RULES) -> DataFrame:
    return spark.createDataFrame(
        [(r.name, r.metric, r.matcher, r.op, r.threshold, r.for_seconds, r.severity, r.category) for r in rules],
        RULE_SCHEMA,
    )


def evaluate_rules(samples: DataFrame, rules: Sequence[AlertRule] = ALERT_RULES) -> DataFrame:
    """Whether each rule's condition holds at each sample of its metric.

    ``samples`` has ts, metric, labels and value. The rule table is a literal of a few dozen rows, hence broadcast.
    """
    catalogue = F.broadcast(rules_frame(samples.sparkSession, rules))
    fits = F.forall(
        F.map_entries("matcher"), lambda e: F.coalesce(F.try_element_at(F.col("labels"), e["key"]) == e["value"], F.lit(False))
    )
    active = (
        F.when(F.col("op") == "==", F.col("value") == F.col("threshold"))
        .when(F.col("op") == ">", F.col("value") > F.col("threshold"))
        .otherwise(F.col("value") < F.col("threshold"))
    )
    return samples.join(catalogue, "metric").where(fits).select(
        "rule", "metric", "labels", "ts", "value", active.alias("active"), "for_seconds", "severity", "category"
    )


LEAF_SCHEMA = (
    "rule_no int, leaf int, metric string, matcher map<string,string>, op string, limit double, age boolean, "
    "on array<string>"
)


def evaluate_conditions(samples: DataFrame, catalogue: Sequence[Alert] = CATALOGUE) -> DataFrame:
    """Whether each alert's whole condition holds, one truth value per alert, label set and time.

    ``samples`` has ts, metric, labels and value. Columns: ``group``, ``rule``, ``series`` (labels as text), ``ts``,
    ``active``, ``for_seconds``, ``severity``, ``category``. Each sample meets the comparisons of its metric once (they are
    literals of some dozens of rows, hence broadcast); the comparisons that hold for a label set are bits of one number,
    and the tree is evaluated on it. Only ``and on`` looks at other label sets, those with the same ``on`` labels.
    """
    spark = samples.sparkSession
    leaves, rules = [], []
    for no, alert in enumerate(catalogue):
        sides = (alert.when.left, alert.when.right) if isinstance(alert.when, AndOn) else (alert.when,)
        on, masks, at = list(alert.when.labels) if len(sides) > 1 else None, [0, 0], 0
        for i, side in enumerate(sides):
            for c in _leaves(side):
                masks[i] |= 1 << at
                leaves.append((no, at, c.metric, c.matcher, c.op, c.limit, c.age, on))
                at += 1
        rules.append((no, alert.group, alert.name, *masks, alert.for_seconds, alert.severity, alert.category))
    fits = F.forall(F.map_entries("matcher"), lambda e: _label_fits(F.coalesce(F.try_element_at(F.col("labels"), e["key"]), F.lit("")), e["value"]))
    compared = F.when(F.col("age"), epoch_seconds(F.col("ts")) - F.col("value")).otherwise(F.col("value"))
    holds = (
        F.when(F.col("op") == "any", True).when(F.col("op") == "==", compared == F.col("limit"))
        .when(F.col("op") == ">", compared > F.col("limit")).when(F.col("op") == "<", compared < F.col("limit"))
    )
    bit = F.call_function("shiftleft", F.lit(1), F.col("leaf"))
    key = F.concat_ws("\u0001", F.transform("on", lambda n: F.coalesce(F.try_element_at(F.col("labels"), n), F.lit(""))))
    seen = samples.join(F.broadcast(spark.createDataFrame(leaves, LEAF_SCHEMA)), "metric").where(fits).select(
        "rule_no", series_key(F.col("labels")).alias("series"), F.when(F.col("on").isNotNull(), key).alias("_on"), "ts",
        bit.alias("_seen"), F.when(holds, bit).otherwise(0).alias("_bits"),
    ).groupBy("rule_no", "series", "_on", "ts").agg(F.bit_or("_seen").alias("_seen"), F.bit_or("_bits").alias("_bits"))
    table = spark.createDataFrame(
        rules, "rule_no int, group string, rule string, left int, right int, for_seconds long, severity string, category string"
    )
    known = seen.join(F.broadcast(table), "rule_no")
    left = F.col("_bits").bitwiseAND(F.col("left")) != 0
    other = F.max(F.col("_bits").bitwiseAND(F.col("right")) != 0).over(W.partitionBy("rule_no", "_on", "ts"))
    alone = known.where(F.col("_on").isNull()).withColumn("active", left)
    joined = known.where(F.col("_on").isNotNull()).withColumn("active", left & other)
    out = alone.unionByName(joined.where(F.col("_seen").bitwiseAND(F.col("left")) != 0))
    return out.select("group", "rule", "series", "ts", "active", "for_seconds", "severity", "category")


def _label_fits(value: Column, wanted: Column) -> Column:
    pattern = F.concat(F.lit("^(?:"), F.substring(wanted, F.lit(2), F.length(wanted)), F.lit(")$"))
    return F.when(wanted.startswith("~"), F.regexp_like(value, pattern)).otherwise(value == wanted)


def alert_states(
    evaluations: DataFrame,
    keys: Sequence[str],
    ts: str,
    active: str = "active",
    for_seconds: Column | int = 0,
    max_gap_seconds: int | None = None,
) -> DataFrame:
    """Add ``since`` (start of the unbroken active stretch) and ``state``: inactive, pending or firing.

    A stretch breaks where the condition is false, and at gaps longer than ``max_gap_seconds`` if given. There is one
    row per key and evaluation time, so a key has as many rows as the period has evaluations, however much was measured:
    one shuffle and one sort serve both looks back, and nothing runs before the result is asked for.
    """
    on = F.coalesce(F.col(active), F.lit(False))
    order = W.partitionBy(*keys).orderBy(ts)
    before = F.lag(F.struct(F.col(ts).alias("t"), on.alias("on"))).over(order)
    seen = evaluations.withColumn("_before", before)
    fresh = F.col("_before").isNull() | ~F.col("_before.on")
    if max_gap_seconds is not None:
        fresh = fresh | (epoch_seconds(F.col(ts)) - epoch_seconds(F.col("_before.t")) > max_gap_seconds)
    rise = F.when(on & fresh, F.col(ts))
    held = seen.withColumn("_rise", rise).withColumn(
        "_start", F.last("_rise", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    )
    wait = F.lit(for_seconds) if isinstance(for_seconds, int) else for_seconds
    age = epoch_seconds(F.col(ts)) - epoch_seconds(F.col("_start"))
    return held.select(
        *evaluations.columns,
        F.when(on, F.col("_start")).alias("since"),
        F.when(~on, "inactive").when(age >= wait, "firing").otherwise("pending").alias("state"),
    )


def both(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """``and on(labels)``: rows of the left whose labels also occur on the right."""
    return left.join(right.select(*on), list(on), "left_semi")


def either(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """``or``: the left rows and those right rows whose labels do not occur on the left."""
    return left.unionByName(right.join(left.select(*on), list(on), "left_anti"))


def inhibit(alerts: DataFrame, mute_all: str = "MonitoringServiceDown") -> DataFrame:
    """Drop warnings with a critical twin (same name and namespace), and all others where ``mute_all`` fires."""
    twins = alerts.where("severity = 'critical'").select("alertname", "namespace").distinct()
    warnings = F.col("severity") == "warning"
    flagged = alerts.join(twins.withColumn("_twin", F.lit(True)), ["alertname", "namespace"], "left")
    kept = flagged.where(~warnings | F.col("_twin").isNull()).drop("_twin")
    muted = alerts.where(F.col("alertname") == mute_all).select("namespace").distinct().withColumn("_muted", F.lit(True))
    return (
        kept.join(muted, "namespace", "left")
        .where(F.col("_muted").isNull() | (F.col("alertname") == mute_all))
        .select(*alerts.columns)
    )


@dataclass(frozen=True)
class Route:
    match: dict[str, str]
    receiver: str
    carry_on: bool = False


# fixed values: routing table, first match wins unless it carries on
ROUTES = (
    Route({"severity": "critical"}, "pagerduty-critical", carry_on=True),
    Route({"severity": "warning"}, "slack-notifications"),
    Route({"category": "ml_monitoring"}, "slack-mlops"),
    Route({"alertname": "MLflowDown"}, "pagerduty-critical"),
    Route({"alertname": "KServeHighErrorRate"}, "pagerduty-critical"),
)
DEFAULT_RECEIVER = "slack-notifications"


def route(alerts: DataFrame, routes: Sequence[Route] = ROUTES, default: str = DEFAULT_RECEIVER) -> DataFrame:
    """One row per alert and receiver. The routing table becomes column expressions, no join is needed."""
    stopped = F.lit(False)
    receivers = []
    for entry in routes:
        hit = F.lit(True)
        for column, value in entry.match.items():
            hit = hit & F.coalesce(F.col(column) == value, F.lit(False))
        hit = hit & ~stopped
        receivers.append(F.when(hit, F.lit(entry.receiver)))
        if not entry.carry_on:
            stopped = stopped | hit
    found = F.array_distinct(F.array_compact(F.array(*receivers)))
    return alerts.withColumn(
        "receiver", F.explode(F.when(F.size(found) == 0, F.array(F.lit(default))).otherwise(found))
    )


def group_alerts(alerts: DataFrame, ts: str, repeat_seconds: int = 4 * 3600) -> DataFrame:
    """Notification groups: one per (alertname, namespace, severity) and repeat interval."""
    slot = F.floor(epoch_seconds(F.col(ts)) / repeat_seconds) * repeat_seconds
    return (
        alerts.groupBy("alertname", "namespace", "severity", slot.alias("_slot"))
        .agg(F.count(F.lit(1)).alias("alerts"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
        .withColumn("slot_start", F.timestamp_seconds("_slot").cast("timestamp_ntz"))
        .drop("_slot")
    )
