"""Feature store queries."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtide.operators import feature_store as fs
from loomtide.operators import snapshots
from loomtide.session import shared_folder
from registry.common import Registry, as_doubles, rounded, table

REG = Registry()

TRANSACTION_SQL = """
daily AS (SELECT user_id, date_trunc('day', ts) AS d, avg(value) AS amount_mean, stddev_samp(value) AS amount_std,
                 count(*) AS transaction_count
          FROM events WHERE event_type = 'purchase' GROUP BY 1, 2),
stats AS (SELECT user_id, CAST(d AS TIMESTAMP) + INTERVAL 1 DAY AS event_timestamp, amount_mean, amount_std,
                 transaction_count,
                 CAST(date_diff('day', lag(d) OVER (PARTITION BY user_id ORDER BY d), d) AS DOUBLE) AS days_since_last
          FROM daily)"""

HOURLY_SQL = """
hourly AS (SELECT user_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) + INTERVAL 1 HOUR AS event_timestamp,
                  CAST(count(*) AS DOUBLE) AS feature_1, avg(value) AS feature_2, min(value) AS feature_3,
                  max(value) AS feature_4, stddev_samp(value) AS feature_5
           FROM events GROUP BY 1, 2)"""

PROFILE_SQL = """
activity AS (SELECT o_custkey, min(o_orderdate) AS f, count(*) AS n, sum(o_totalprice) AS spend
             FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01' GROUP BY 1),
profile AS (SELECT c_custkey AS user_id, TIMESTAMP '2001-01-01' AS event_timestamp,
                   CASE WHEN c_acctbal < 0 THEN 'negative' WHEN c_acctbal < 3000 THEN 'low'
                        WHEN c_acctbal < 7000 THEN 'middle' ELSE 'high' END AS age_group,
                   coalesce(date_diff('day', f, TIMESTAMP '2001-01-01'), 0) AS account_tenure_days,
                   CAST(CASE WHEN spend > 1000000 THEN 1 ELSE 0 END AS BIGINT) AS has_premium,
                   coalesce(n * 30.0 / nullif(CAST(date_diff('day', f, TIMESTAMP '2001-01-01') AS DOUBLE), 0), 0.0)
                     AS engagement_score
            FROM customer LEFT JOIN activity ON c_custkey = o_custkey)"""


def purchases(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").where("event_type = 'purchase'").select("user_id", "ts", "value")


def transaction_view(spark: SparkSession, folder: str) -> fs.FeatureView:
    return fs.FeatureView(
        "transaction_stats",
        ("user_id",),
        timedelta(days=1),
        ("amount_mean", "amount_std", "transaction_count", "days_since_last"),
        fs.transaction_stats(purchases(spark, folder), "user_id", "ts", "value"),
        unique=True,
    )


def hourly_view(spark: SparkSession, folder: str) -> fs.FeatureView:
    return fs.FeatureView(
        "model_features",
        ("user_id",),
        timedelta(hours=6),
        tuple(f"feature_{i}" for i in range(1, 6)),
        fs.hourly_features(table(spark, folder, "events"), "user_id", "ts", "value"),
        unique=True,
    )


def raw_view(spark: SparkSession, folder: str) -> fs.FeatureView:
    """Every event as a feature row, with an ingest id that decides between rows of one instant."""
    rows = table(spark, folder, "events").select(
        "user_id", F.col("ts").alias("event_timestamp"), "value", "event_type", F.col("event_id").alias("ingest_id")
    )
    return fs.FeatureView("raw_events", ("user_id",), None, ("value", "event_type", "ingest_id"), rows,
                          tie_break=("ingest_id",))


@REG.add(
    "pit_transaction_stats",
    f"""WITH {TRANSACTION_SQL}
SELECT e.event_id, e.user_id, e.ts AS event_timestamp,
       round(CASE WHEN s.event_timestamp + INTERVAL 1 DAY >= e.ts THEN s.amount_mean END, 8) AS amount_mean,
       round(CASE WHEN s.event_timestamp + INTERVAL 1 DAY >= e.ts THEN s.amount_std END, 8) AS amount_std,
       CASE WHEN s.event_timestamp + INTERVAL 1 DAY >= e.ts THEN CAST(s.transaction_count AS DOUBLE) END AS transaction_count,
       round(CASE WHEN s.event_timestamp + INTERVAL 1 DAY >= e.ts THEN s.days_since_last END, 8) AS days_since_last
FROM (SELECT * FROM events WHERE event_type = 'error') e
ASOF LEFT JOIN stats s ON e.user_id = s.user_id AND e.ts >= s.event_timestamp""",
)
def pit_transaction_stats(spark: SparkSession, folder: str) -> DataFrame:
    entities = (
        table(spark, folder, "events").where("event_type = 'error'")
        .select("event_id", "user_id", F.col("ts").alias("event_timestamp"))
    )
    out = fs.point_in_time_join(entities, [transaction_view(spark, folder)])
    return rounded(as_doubles(out, ["transaction_count"]), 8)


@REG.add(
    "pit_multi_view",
    f"""WITH {TRANSACTION_SQL}, {HOURLY_SQL},
a AS (SELECT e.event_id, e.user_id, e.ts AS event_timestamp, e.value AS label,
             CASE WHEN s.event_timestamp + INTERVAL 1 DAY >= e.ts THEN s.amount_mean END AS am,
             CASE WHEN s.event_timestamp + INTERVAL 1 DAY >= e.ts THEN CAST(s.transaction_count AS DOUBLE) END AS tc
      FROM events e ASOF LEFT JOIN stats s ON e.user_id = s.user_id AND e.ts >= s.event_timestamp)
SELECT a.event_id, a.user_id, a.event_timestamp, a.label, round(am, 8) AS transaction_stats__amount_mean,
       tc AS transaction_stats__transaction_count,
       round(CASE WHEN h.event_timestamp + INTERVAL 6 HOUR >= a.event_timestamp THEN h.feature_1 END, 8)
         AS model_features__feature_1,
       round(CASE WHEN h.event_timestamp + INTERVAL 6 HOUR >= a.event_timestamp THEN h.feature_2 END, 8)
         AS model_features__feature_2,
       round(CASE WHEN h.event_timestamp + INTERVAL 6 HOUR >= a.event_timestamp THEN h.feature_5 END, 8)
         AS model_features__feature_5
FROM a ASOF LEFT JOIN hourly h ON a.user_id = h.user_id AND a.event_timestamp >= h.event_timestamp""",
)
def pit_multi_view(spark: SparkSession, folder: str) -> DataFrame:
    entities = table(spark, folder, "events").select(
        "event_id", "user_id", F.col("ts").alias("event_timestamp"), F.col("value").alias("label")
    )
    views = [transaction_view(spark, folder), hourly_view(spark, folder)]
    out = fs.point_in_time_join(entities, views, prefix=True)
    return rounded(
        as_doubles(out, ["transaction_stats__transaction_count"]).select(
            "event_id", "user_id", "event_timestamp", "label", "transaction_stats__amount_mean",
            "transaction_stats__transaction_count", "model_features__feature_1", "model_features__feature_2",
            "model_features__feature_5",
        ),
        8,
    )


@REG.add(
    "transaction_stats_view",
    f"""WITH {TRANSACTION_SQL}
SELECT user_id, event_timestamp, round(amount_mean, 8) AS amount_mean, round(amount_std, 8) AS amount_std,
       transaction_count, days_since_last FROM stats""",
)
def transaction_stats_view(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(transaction_view(spark, folder).source, 8)


@REG.add(
    "user_profile",
    f"""WITH {PROFILE_SQL}
SELECT user_id, event_timestamp, age_group, account_tenure_days, has_premium,
       round(engagement_score, 8) AS engagement_score FROM profile""",
)
def user_profile(spark: SparkSession, folder: str) -> DataFrame:
    as_of = F.lit("2001-01-01").cast("timestamp_ntz")
    return rounded(fs.user_profile(table(spark, folder, "customer"), table(spark, folder, "orders"), as_of), 8)


@REG.add(
    "pit_user_profile",
    f"""WITH {PROFILE_SQL}
SELECT o_orderkey, o_custkey AS user_id, o_orderdate AS event_timestamp,
       CASE WHEN p.event_timestamp + INTERVAL 7 DAY >= o_orderdate THEN age_group END AS age_group,
       CASE WHEN p.event_timestamp + INTERVAL 7 DAY >= o_orderdate THEN CAST(account_tenure_days AS DOUBLE) END AS account_tenure_days,
       CASE WHEN p.event_timestamp + INTERVAL 7 DAY >= o_orderdate THEN CAST(has_premium AS DOUBLE) END AS has_premium,
       round(CASE WHEN p.event_timestamp + INTERVAL 7 DAY >= o_orderdate THEN engagement_score END, 8)
         AS engagement_score
FROM orders ASOF LEFT JOIN profile p ON o_custkey = p.user_id AND o_orderdate >= p.event_timestamp""",
)
def pit_user_profile(spark: SparkSession, folder: str) -> DataFrame:
    as_of = F.lit("2001-01-01").cast("timestamp_ntz")
    orders = table(spark, folder, "orders")
    view = fs.FeatureView(
        "user_profile", ("user_id",), timedelta(days=7),
        ("age_group", "account_tenure_days", "has_premium", "engagement_score"),
        fs.user_profile(table(spark, folder, "customer"), orders, as_of), unique=True,
    )
    entities = orders.select(
        "o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("event_timestamp")
    )
    out = fs.point_in_time_join(entities, [view])
    return rounded(as_doubles(out, ["account_tenure_days", "has_premium"]), 8)


LATEST_SQL = """
SELECT user_id, ts AS event_timestamp, value, event_type, event_id AS ingest_id
FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < {end}
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""


@REG.add("online_latest", LATEST_SQL.format(end="TIMESTAMP '2024-01-20'"))
def online_latest(spark: SparkSession, folder: str) -> DataFrame:
    start, end = (F.lit(d).cast("timestamp_ntz") for d in ("2024-01-01", "2024-01-20"))
    return fs.materialize(raw_view(spark, folder), start, end)


@REG.add("materialize_incremental", LATEST_SQL.format(end="TIMESTAMP '2024-01-25'"))
def materialize_incremental(spark: SparkSession, folder: str) -> DataFrame:
    view = raw_view(spark, folder)
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    old = fs.materialize(view, day("2024-01-01"), day("2024-01-20"))
    return fs.materialize_incremental(view, old, day("2024-01-20"), day("2024-01-25"))


@REG.add("materialize_since_mark", LATEST_SQL.format(end="TIMESTAMP '2024-01-25'"))
def materialize_since_mark(spark: SparkSession, folder: str) -> DataFrame:
    """Three runs, each from where the last one stopped; the last is repeated."""
    view = raw_view(spark, folder)
    store = snapshots.store_of(view, shared_folder(spark, "snapshot"), buckets=16)
    for day in ("2024-01-08", "2024-01-20", "2024-01-25", "2024-01-25"):
        out = snapshots.materialize_since_mark(view, store, F.lit(day).cast("timestamp_ntz"))
    return out


@REG.add(
    "online_lookup",
    f"""WITH snap AS ({LATEST_SQL.format(end="TIMESTAMP '2024-02-01'")})
SELECT c_custkey AS user_id, c_mktsegment, value, event_type FROM customer LEFT JOIN snap ON c_custkey = user_id""",
)
def online_lookup(spark: SparkSession, folder: str) -> DataFrame:
    view = raw_view(spark, folder)
    start, end = (F.lit(d).cast("timestamp_ntz") for d in ("2024-01-01", "2024-02-01"))
    asked = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return fs.online_lookup(asked, fs.materialize(view, start, end), ["user_id"], ["value", "event_type"])
