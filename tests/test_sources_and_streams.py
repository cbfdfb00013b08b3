"""Files, catalog and streams that arrive in several batches."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomtide.operators import drift, snapshots
from loomtide.operators import feature_store as fs
from loomtide.operators.snapshots import SnapshotStore
from loomtide.sources import catalog, files
from loomtide.streaming import alert_state, core, drift_windows, feature_push, rollups

T0 = datetime(2024, 1, 1)


def test_formats_and_dispatch(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, 2.5)], "i int, s string, d double")
    for fmt in files.FORMATS:
        path = str(tmp_path / f"t.{fmt}")
        files.write_table(df, path)
        assert sorted(map(tuple, files.read_table(spark, path, schema=df.schema).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert files.read_table(spark, str(tmp_path / "t.csv")).schema["d"].dataType.simpleString() == "double"
    with pytest.raises(ValueError, match="unsupported"):
        files.read_table(spark, "x.xlsx")
    with pytest.raises(ValueError, match="unsupported"):
        files.write_table(df, str(tmp_path / "t"), "feather")


def test_listing_and_existence(spark, tmp_path):
    df = spark.range(10)
    df.repartition(3).write.parquet(str(tmp_path / "a/deep"))
    assert files.data_exists(spark, str(tmp_path), "*.parquet") == 3
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        files.data_exists(spark, str(tmp_path / "empty"))
    assert files.read_all(spark, str(tmp_path)).count() == 10
    spark.range(4).write.option("header", True).csv(str(tmp_path / "empty/x"))
    assert files.read_all(spark, str(tmp_path / "empty")).count() == 4


def test_current_data_and_inline(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "c.parquet"))
    assert files.current_data(spark, str(tmp_path / "c.parquet")).count() == 3
    assert files.current_data(spark, query="select 1 as x").count() == 1
    assert files.current_data(spark) is None
    assert files.inline_records(spark, [{"x": 1.0}, {"x": 2.0}], "x double").count() == 2


def test_jdbc_options():
    got = files.jdbc_options("jdbc:x:y", "t", "id", 0, 100, 8)
    assert got["numPartitions"] == "8" and got["partitionColumn"] == "id"
    with pytest.raises(ValueError):
        files.jdbc_options("jdbc:x:y", "t", "id", 5, 1, 8)


def test_catalog_discovers_new_columns(spark, tmp_path):
    path = str(tmp_path / "tbl")
    spark.range(5).select(F.col("id").cast("double").alias("feature_1")).write.parquet(path)
    catalog.register_database(spark, "raw")
    catalog.register_table(spark, "raw", "training", spark.read.parquet(path).schema, "parquet", path)
    assert spark.table("raw.training").count() == 5
    spark.range(2).select(F.col("id").cast("double").alias("feature_1"), F.lit("x").alias("extra")).write.mode("append").parquet(path)
    changes = catalog.crawl(spark, "raw.training", path, "parquet").collect()
    assert [(r["column_name"], r["change"]) for r in changes] == [("extra", "added")]
    assert spark.table("raw.training").columns == ["feature_1", "extra"]
    old, new = spark.createDataFrame([], "a int, b int").schema, spark.createDataFrame([], "a long, c int").schema
    got = {r["column_name"]: r["change"] for r in catalog.schema_changes(spark, old, new).collect()}
    assert got == {"a": "type_changed", "b": "removed", "c": "added"}


def test_partitioned_catalog_table(spark, tmp_path):
    path = str(tmp_path / "part")
    spark.range(6).select("id", (F.col("id") % 2).cast("string").alias("day")).write.partitionBy("day").parquet(path)
    catalog.register_database(spark, "raw")
    schema = spark.createDataFrame([], "id long, day string").schema
    catalog.register_table(spark, "raw", "daily", schema, "parquet", path, partitioned_by=["day"])
    assert spark.table("raw.daily").where("day = '1'").count() == 3


def batches(spark, path, parts, schema):
    """One file per part, oldest first; the stream takes one file per micro-batch."""
    import os
    import time

    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        newest = max((os.path.join(path, f) for f in os.listdir(path) if f.endswith(".parquet")), key=os.path.getmtime)
        os.utime(newest, (time.time() - 1000 + i, time.time() - 1000 + i))
    return core.read_stream(spark, f"{path}/*.parquet", spark.createDataFrame([], schema).schema, files_per_trigger=1)


def test_push_keeps_the_newest(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    parts = [[(1, at(5), 1.0), (2, at(1), 2.0)], [(1, at(3), 9.0)], [(2, at(7), 3.0), (3, at(0), 4.0)]]
    stream = batches(spark, str(tmp_path / "in"), parts, "user_id int, event_timestamp timestamp_ntz, v double")
    store = SnapshotStore(str(tmp_path / "view"), ["user_id"], "event_timestamp", ["v"], stream.schema, buckets=4)
    push = feature_push.FeaturePush(store)
    core.run_batches(stream, push, "push")
    newest = {1: 1.0, 2: 3.0, 3: 4.0}
    assert {r["user_id"]: r["v"] for r in push.snapshot(spark).collect()} == newest
    assert push.offline(spark).count() == 5
    for batch in (2, 2, 1, 2):  # repeated batches change nothing, also if the stream starts again from an older one
        push(spark.createDataFrame(parts[batch], push.offline(spark).schema), batch)
        assert push.offline(spark).count() == 5
    assert {r["user_id"]: r["v"] for r in push.snapshot(spark).collect()} == newest


def test_snapshot_rewrites_touched_buckets_only(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    schema = "user_id int, event_timestamp timestamp_ntz, v double"
    df = lambda rows: spark.createDataFrame(rows, schema)
    store = SnapshotStore(str(tmp_path / "s"), ["user_id"], "event_timestamp", ["v"], df([]).schema, buckets=8)
    assert store.read(spark).count() == 0 and store.mark(spark) is None and store.last_batch(spark) == -1
    store.merge(df([(i, at(0), float(i)) for i in range(100)] + [(None, at(0), 0.0)]), 0)
    store.merge(df([(7, at(1), -7.0), (7, at(0), 5.0)]), 1)
    assert [p.name for p in sorted((tmp_path / "s/rows/version=1").glob("bucket=*"))] != []
    assert len(list((tmp_path / "s/rows/version=1").glob("bucket=*"))) == 1
    assert len(list((tmp_path / "s/rows/version=0").glob("bucket=*"))) == 8
    store.merge(df([]), 2)
    store.merge(df([(7, at(1), 70.0), (8, at(-1), 1.0)]), 3)  # equal times: the later batch
    got = {r["user_id"]: r["v"] for r in store.read(spark).collect()}
    assert got == {**{i: float(i) for i in range(100)}, 7: 70.0}


def test_materialisation_goes_on_from_the_mark(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    schema = "user_id int, event_timestamp timestamp_ntz, v double"
    seen = []
    view = lambda rows: fs.FeatureView("v", ("user_id",), None, ("v",), spark.createDataFrame(rows, schema))
    rows = [(1, at(0), 1.0), (2, at(5), 2.0), (1, at(10), 3.0), (3, at(20), 4.0)]
    store = snapshots.store_of(view(rows), str(tmp_path / "s"), 4)
    end = lambda m: F.lit(at(m)).cast("timestamp_ntz")
    for until in (6, 10, 11, 5):
        out = snapshots.materialize_since_mark(view(rows), store, end(until))
        seen.append({r["user_id"]: r["v"] for r in out.collect()})
    assert seen == [{1: 1.0, 2: 2.0}, {1: 1.0, 2: 2.0}, {1: 3.0, 2: 2.0}, {1: 3.0, 2: 2.0}]
    assert store.mark(spark) == at(11)
    late = snapshots.materialize_since_mark(view(rows + [(9, at(2), 9.0)]), store, end(30))
    assert {r["user_id"] for r in late.collect()} == {1, 2, 3}  # rows older than the mark are not looked for
    other = snapshots.store_of(view(rows), str(tmp_path / "o"), 4)
    assert snapshots.materialize_since_mark(view(rows), other, end(30), end(9)).count() == 2


def test_late_rows_are_dropped_after_the_watermark(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    # the watermark of a batch closes windows in the next one and turns rows away from the one after
    parts = [[(at(1),), (at(2),)], [(at(40),)], [(at(41),)], [(at(3),), (at(42),)], [(at(90),)]]
    stream = batches(spark, str(tmp_path / "in"), parts, "ts timestamp_ntz")
    timed = core.with_event_time(stream, "ts", "10 minutes")
    out = core.run_to_table(rollups.flat_window(rollups.tumbling(timed, "ts", "10 minutes", [], {"n": F.count(F.lit(1))})), "late")
    assert {r["window_start"]: r["n"] for r in out.collect()} == {T0: 2, at(40): 3}


def test_alert_life_cycle_over_batches(spark, tmp_path):
    at = lambda h: T0 + timedelta(hours=h)
    on = [1] * 8 + [0, 1, 0]
    rows = [("s", at(i), bool(v)) for i, v in enumerate(on)]
    parts = [rows[:3], rows[3:7], rows[7:]]
    stream = batches(spark, str(tmp_path / "in"), parts, "series string, ts timestamp_ntz, active boolean")
    timed = core.with_event_time(stream, "ts", "0 seconds")
    with alert_state.rocksdb(spark):
        out = core.run_to_table(alert_state.alert_events(timed, 7200, repeat_seconds=4 * 3600), "life")
    got = [(r["ts"].hour, r["event"]) for r in out.orderBy("ts").collect()]
    assert got == [(0, "pending"), (2, "firing"), (6, "repeated"), (8, "resolved"), (9, "pending")]


def test_drift_of_closed_windows(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    reference = spark.createDataFrame([(float(i % 50), "ab"[i % 2]) for i in range(300)], "x double, c string")
    parts = [
        [(at(i % 60), float(i % 50), "ab"[i % 2]) for i in range(200)],
        [(at(60 + i % 60), float(i % 50 + 80), "b") for i in range(200)] + [(at(70), None, None), (at(71), float("nan"), "a")],
        [(at(200), 1.0, "a")],
        [(at(5), 1e9, "late"), (at(201), 1.0, "a")],
    ]
    stream = batches(spark, str(tmp_path / "in"), parts, "ts timestamp_ntz, x double, c string")
    job = drift_windows.DriftWindows(str(tmp_path / "drift"), reference, ["x"], ["c"])
    got = {(r["window_start"], r["column_name"]): r for r in job.run(core.with_event_time(stream, "ts", "10 minutes"), "ts", "1 hour").collect()}
    assert {k: r["drift_detected"] for k, r in got.items()} == {
        (at(0), "x"): False, (at(0), "c"): False, (at(60), "x"): True, (at(60), "c"): True,
    }
    # the scores are those of the rows themselves; the late row of the first window was turned away
    both = reference.withColumn("dataset", F.lit("reference")).unionByName(
        spark.createDataFrame([(x, c) for _, x, c in parts[0]], "x double, c string").withColumn("dataset", F.lit("current"))
    )
    plain = {r["column_name"]: r["drift_score"] for r in drift.drift_scores(drift.drift_statistics(both, ["x"], ["c"])).collect()}
    assert plain == pytest.approx({c: got[at(0), c]["drift_score"] for c in "xc"})


def test_drift_windows_without_rows(spark, tmp_path):
    reference = spark.createDataFrame([(1.0,)], "x double")
    schema = "ts timestamp_ntz, x double"
    job = drift_windows.DriftWindows(str(tmp_path / "drift"), reference, ["x"])
    first = [[], [(T0, 1.0)], [(T0 + timedelta(hours=5), None)], [(T0 + timedelta(hours=9), 2.0)]]
    out = job.run(core.with_event_time(batches(spark, str(tmp_path / "in"), first, schema), "ts", "1 minute"), "ts", "1 hour")
    assert [r["window_start"] for r in out.collect()] == [T0]  # a window without values is none
    job(spark.createDataFrame([], drift_windows.closed_counts(
        spark.createDataFrame([], schema).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", ["x"], []
    ).schema), 99)
    assert job.scores(spark).count() == 1


def test_push_schema_is_checked(spark, tmp_path):
    rows = spark.createDataFrame([(1, T0, 1.0)], "user_id int, event_timestamp timestamp_ntz, v double")
    view = fs.FeatureView("v", ("user_id",), None, ("v",), rows)
    fs.append_to_view(rows, view, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == 1
    for _ in range(2):  # a repeated push counts once
        fs.append_to_view(rows, view, str(tmp_path / "pushes"), push_id="p1")
    fs.append_to_view(rows, view, str(tmp_path / "pushes"), push_id="p2")
    assert spark.read.parquet(str(tmp_path / "pushes")).count() == 2
    newer = fs.FeatureView("v", ("user_id",), None, ("v",), rows.withColumn("v", F.lit(-5.0)))
    start, end = (F.lit(T0 + timedelta(days=d)).cast("timestamp_ntz") for d in (-1, 1))
    assert fs.materialize_incremental(newer, rows, start, end).first()["v"] == -5.0
    with pytest.raises(ValueError, match="another type"):
        fs.check_push(rows.withColumn("v", F.lit("x")), view)


def test_point_in_time_keeps_maps(spark):
    e = spark.createDataFrame([(1, T0, {"a": 1}), (None, T0, {"b": 2})], "user_id int, event_timestamp timestamp_ntz, m map<string,int>")
    f = spark.createDataFrame([(1, T0, 3.0)], "user_id int, event_timestamp timestamp_ntz, v double")
    view = fs.FeatureView("v", ("user_id",), timedelta(0), ("v",), f)
    got = {tuple(r["m"]): r["v"] for r in fs.point_in_time_join(e, [view]).collect()}
    assert got == {("a",): 3.0, ("b",): None}


def test_folders_of_several_schemas_are_one_table(spark, tmp_path):
    spark.sql("select cast(1 as int) as a, cast(1.5 as float) as b, 'x' as old").write.parquet(str(tmp_path / "1"))
    spark.sql("select cast(5000000000 as long) as a, 2.5D as b, true as fresh").write.parquet(str(tmp_path / "2"))
    spark.sql("select cast(3 as short) as a").write.parquet(str(tmp_path / "3"))
    got = catalog.read_versions(spark, [str(tmp_path / i) for i in "123"])
    assert dict(got.dtypes) == {"a": "bigint", "b": "double", "old": "string", "fresh": "boolean"}
    assert sorted(map(tuple, got.collect())) == [(1, 1.5, "x", None), (3, None, None, None), (5000000000, 2.5, None, True)]
    spark.sql("select 'text' as a").write.parquet(str(tmp_path / "4"))
    with pytest.raises(ValueError, match="column a changed from bigint to string"):
        catalog.read_versions(spark, [str(tmp_path / i) for i in "24"])
    with pytest.raises(ValueError):
        catalog.read_versions(spark, [])
