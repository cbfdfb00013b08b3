"""Structured Streaming queries: the whole events table is streamed, results are compared with batch SQL.

One pass over one file is one micro-batch, so the final watermark is the newest event time minus the delay, and
exactly the windows that ended by then are closed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtide.operators import encoding, models, rules
from loomtide.operators.snapshots import SnapshotStore
from loomtide.session import shared_folder
from loomtide.streaming import alert_state, core, drift_windows, feature_push, rollups
from registry.common import Registry, rounded, table

REG = Registry()

DELAY = "10 minutes"
CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


def events_stream(spark: SparkSession, folder: str) -> DataFrame:
    return core.read_stream(spark, f"{folder}/events.parquet")


@REG.add(
    "stream_rollup",
    f"""WITH w AS (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(avg(value), 8) AS mean_value, max(value) AS max_value
 FROM events GROUP BY ALL) SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, n, mean_value, max_value
 FROM w WHERE window_start + INTERVAL 1 HOUR <= {CLOSED}""",
)
def stream_rollup(spark: SparkSession, folder: str) -> DataFrame:
    stream = core.with_event_time(events_stream(spark, folder), "ts", DELAY)
    out = rollups.tumbling(
        stream, "ts", "1 hour", ["event_type"],
        {"n": F.count(F.lit(1)), "mean_value": F.avg("value"), "max_value": F.max("value")},
    )
    return rounded(core.run_to_table(rollups.flat_window(out), "rollup"), 8)


@REG.add(
    "stream_sliding_rate",
    f"""WITH s AS (SELECT event_type, value, floor(epoch_us(ts) / 900000000.0) - o AS i FROM events, range(0, 4) t(o)),
w AS (SELECT make_timestamp(CAST(i AS BIGINT) * 900000000) AS window_start, event_type, sum(value) AS x FROM s GROUP BY ALL)
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, round(x, 6) AS increase, round(x / 3600, 6) AS rate
FROM w WHERE window_start + INTERVAL 1 HOUR <= {CLOSED}""",
)
def stream_sliding_rate(spark: SparkSession, folder: str) -> DataFrame:
    stream = core.with_event_time(events_stream(spark, folder), "ts", DELAY)
    out = rollups.sliding_rate(stream, "ts", "1 hour", "15 minutes", 3600.0, ["event_type"], F.col("value"))
    return rounded(core.run_to_table(rollups.flat_window(out), "sliding"))


@REG.add(
    "stream_quarantine",
    "SELECT event_id, value <= 100 AND event_type <> 'error' AS is_valid FROM events",
)
def stream_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """Valid and quarantined rows in one sink, divided by partition."""
    stream = events_stream(spark, folder).withColumn("checked", F.when(F.col("event_type") != "error", 1))
    limits = [rules.Rule("events", 1, "not_null", "checked"), rules.Rule("events", 2, "between", "value", 0.0, 100.0)]
    bad = F.lit(False)
    for rule in limits:
        bad = bad | rules.row_is_bad(stream, rule)
    marked = stream.withColumn("is_valid", ~bad)
    return core.run_to_table(marked, "quarantine", partition_by=["is_valid"]).select("event_id", "is_valid")


#: Events in three files: by time, but of ten one comes a file later than it should and one two files later. The mark
#: that closes windows in one batch turns rows away in the next: only the third file has rows that come too late.
FILES_SQL = """arrived AS (SELECT *, least(3, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 1 WHEN ts < TIMESTAMP '2024-01-21' THEN 2 ELSE 3 END
  + CASE event_id % 10 WHEN 3 THEN 1 WHEN 7 THEN 2 ELSE 0 END) AS f FROM events),
marks AS (SELECT max(ts) FILTER (f = 1) - INTERVAL 10 MINUTE AS first_mark, max(ts) - INTERVAL 10 MINUTE AS last_mark FROM arrived)"""


def three_files(spark: SparkSession, folder: str) -> DataFrame:
    """The events as a stream of three files, one per trigger; rows of the first two thirds partly come late."""
    arrived = shared_folder(spark, "arrived")
    ts = lambda day: F.lit(f"2024-01-{day}").cast("timestamp_ntz")
    own = F.when(F.col("ts") < ts(11), 1).when(F.col("ts") < ts(21), 2).otherwise(3)
    late = F.when(F.col("event_id") % 10 == 3, 1).when(F.col("event_id") % 10 == 7, 2).otherwise(0)
    events = table(spark, folder, "events").withColumn("_file", F.least(F.lit(3), own + late))
    # one after the other: the file source takes older files first
    for i in (1, 2, 3):
        events.where(F.col("_file") == i).drop("_file").coalesce(1).write.parquet(f"{arrived}/{i}")
    return core.read_stream(spark, f"{arrived}/*/*.parquet", events.drop("_file").schema, files_per_trigger=1)


@REG.add(
    "stream_push",
    """SELECT user_id, ts AS event_timestamp, value, event_type, event_id AS ingest_id FROM events
 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def stream_push(spark: SparkSession, folder: str) -> DataFrame:
    """The newest event of each user, from three files of which two hold older rows than the one before."""
    rows = three_files(spark, folder).select(
        "user_id", F.col("ts").alias("event_timestamp"), "value", "event_type", F.col("event_id").alias("ingest_id")
    )
    push = feature_push.FeaturePush(SnapshotStore(
        shared_folder(spark, "push"), ["user_id"], "event_timestamp", ["value", "event_type", "ingest_id"], rows.schema,
        ["ingest_id"], buckets=16,
    ))
    core.run_batches(rows, push, "push-progress")
    return push.snapshot(spark)


REFERENCE_END = "2024-01-04"


@REG.add(
    "stream_drift_windows",
    f"""WITH {FILES_SQL},
kept AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS w, event_type, value FROM arrived, marks
  WHERE f < 3 OR time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY > first_mark),
cur AS (SELECT * FROM kept WHERE w + INTERVAL 1 DAY <= (SELECT last_mark FROM marks)),
ref AS (SELECT event_type, value FROM events WHERE ts < TIMESTAMP '{REFERENCE_END}'),
slots AS (SELECT DISTINCT w FROM cur),
num AS (SELECT w, value, sum(r) AS r, sum(c) AS c FROM (SELECT w, value, 0 AS r, 1 AS c FROM cur
  UNION ALL SELECT w, value, 1, 0 FROM slots, ref) GROUP BY ALL),
cum AS (SELECT w, sum(r) OVER o / sum(r) OVER p AS fr, sum(c) OVER o / sum(c) OVER p AS fc, lead(value) OVER o - value AS d
  FROM num WINDOW o AS (PARTITION BY w ORDER BY value), p AS (PARTITION BY w)),
cat AS (SELECT w, r / sum(r) OVER p AS p, c / sum(c) OVER p AS q FROM (SELECT w, event_type, sum(r) AS r, sum(c) AS c FROM
  (SELECT w, event_type, 0 AS r, 1 AS c FROM cur UNION ALL SELECT w, event_type, 1, 0 FROM slots, ref) GROUP BY ALL)
  WINDOW p AS (PARTITION BY w)),
scores AS (SELECT w, 'value' AS column_name, 'wasserstein' AS method, sum(abs(fr - fc) * d) / (SELECT stddev_pop(value) FROM ref) AS score FROM cum GROUP BY w
  UNION ALL SELECT w, 'event_type', 'jensen_shannon', sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END
 + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2)) FROM cat GROUP BY w)
SELECT w AS window_start, column_name, method, round(score, 6) AS drift_score, CAST(0.1 AS DOUBLE) AS threshold, score >= 0.1 AS drift_detected FROM scores""",
)
def stream_drift_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Days of a stream against the first three days; rows that come after their day was closed don't count."""
    reference = table(spark, folder, "events").where(F.col("ts") < F.lit(REFERENCE_END).cast("timestamp_ntz"))
    job = drift_windows.DriftWindows(shared_folder(spark, "drift"), reference, ["value"], ["event_type"])
    return rounded(job.run(core.with_event_time(three_files(spark, folder), "ts", DELAY), "ts", "1 day"))


@REG.add("stream_dedup", "SELECT DISTINCT user_id, ts FROM events")
def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every event sent twice, kept once."""
    stream = core.with_event_time(events_stream(spark, folder).select("user_id", "ts"), "ts", DELAY)
    twice = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    once = rollups.first_of_each(twice, ["user_id", "ts"])
    return core.run_to_table(once.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "dedup")


@REG.add(
    "stream_sessions",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g),
t AS (SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 6 HOUR AS window_end, count(*) AS n FROM s GROUP BY user_id, sid)
SELECT user_id, window_start, window_end, n FROM t WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
)
def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    stream = core.with_event_time(events_stream(spark, folder), "ts", DELAY)
    out = rollups.sessions(stream, "ts", "6 hours", ["user_id"], {"n": F.count(F.lit(1))})
    return core.run_to_table(rollups.flat_window(out), "sessions")


@REG.add(
    "stream_alert_state",
    """WITH a AS (SELECT event_type AS series, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, avg(value) > 45 AS active FROM events GROUP BY 1, 2),
h AS (SELECT series, hour AS ts, active FROM a WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE),
r AS (SELECT *, CASE WHEN active AND NOT coalesce(lag(active) OVER w, false) THEN ts END AS rise FROM h WINDOW w AS (PARTITION BY series ORDER BY ts)),
s AS (SELECT *, CASE WHEN active THEN last_value(rise IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING) END AS since FROM r),
st AS (SELECT *, CASE WHEN NOT active THEN 'inactive' WHEN date_diff('second', since, ts) >= 7200 THEN 'firing' ELSE 'pending' END AS state FROM s),
c AS (SELECT *, coalesce(lag(state) OVER w, 'inactive') AS was, lag(since) OVER w AS was_since FROM st WINDOW w AS (PARTITION BY series ORDER BY ts))
SELECT series, ts, CASE WHEN state = 'inactive' THEN was_since ELSE since END AS since, CASE WHEN state = 'inactive' THEN 'resolved' ELSE state END AS event
FROM c WHERE (state = 'pending' AND was = 'inactive') OR (state = 'firing' AND was <> 'firing') OR (state = 'inactive' AND was = 'firing')""",
)
def stream_alert_state(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly means of a stream through the alert life cycle; times are the starts of the hours."""
    stream = core.with_event_time(events_stream(spark, folder), "ts", DELAY)
    evaluations = alert_state.hourly_evaluations(stream, "ts", "event_type", "value", 45.0)
    with alert_state.rocksdb(spark):
        events = alert_state.alert_events(evaluations, 7200, repeat_seconds=10**8, stale_seconds=10**8)
        out = core.run_to_table(events, "alert-state")
    hour = lambda c: F.date_trunc("hour", c).cast("timestamp_ntz").alias(c)
    return out.select("series", hour("ts"), hour("since"), "event")


@REG.add("stream_score")
def stream_score(spark: SparkSession, folder: str) -> DataFrame:
    """A fitted model applied to a stream of all events."""
    events = table(spark, folder, "events")
    prep = encoding.Preprocessor(numeric=["value", "user_id"], categorical=[])
    fitted = models.train(
        prep.fit_transform(events.select("value", "user_id", "event_type"), exclude=["event_type"], keep=["event_type"]),
        prep.output_names(), "event_type", "classification", "logistic_regression", max_iter=10,
    )
    stream = events_stream(spark, folder)
    prepared = prep.transform(stream.select("event_id", "value", "user_id", "event_type"), keep=["event_id"])
    return core.run_to_table(fitted.predict(prepared).select("event_id", "prediction", "probabilities"), "scored")


@REG.add("stream_score_checks", "SELECT count(*) AS n_rows, count(DISTINCT event_id) AS n_events, 0::BIGINT AS n_bad_sum FROM events")
def stream_score_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Every event is scored once, with probabilities that sum to one."""
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, b: a + b)
    return stream_score(spark, folder).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("event_id").alias("n_events"),
        F.count_if(F.abs(total - 1.0) > 1e-9).alias("n_bad_sum"),
    )
