"""Order-dependent building blocks against brute force, with and without slicing of hot groups."""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtide.operators import drift, evaluation
from loomtide.operators import ordered as o
from loomtide.operators.feature_store import FeatureView, point_in_time_join

START = datetime(2024, 1, 1)


@pytest.mark.parametrize("hot_rows", [10**9, 20, 3])
def test_running_totals(spark, hot_rows):
    rng = random.Random(1)
    # one group holds most rows, and one value most of those
    rows = [("hot", float(rng.choice([1, 1, 1, rng.randrange(60)]))) for _ in range(400)]
    rows += [(f"g{i % 7}", float(rng.randrange(9))) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = o.running_totals(o.value_counts(df, ["g"], "v"), ["g"], "v", ["n"], o.hot_keys(df, ["g"], hot_rows)).collect()
    seen = {}
    for g, v in rows:
        seen.setdefault(g, []).append(v)
    assert len(got) == sum(len(set(vs)) for vs in seen.values())
    for r in got:
        values = seen[r["g"]]
        assert r["cum_n"] == sum(x <= r["v"] for x in values)
        assert r["total_n"] == len(values)
        assert r["next_value"] == min((x for x in values if x > r["v"]), default=None)


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_cut_points_do_not_grow_with_the_rows(spark, monkeypatch, keys):
    rows = 3000
    df = spark.range(rows).select(F.lit("hot").alias("g"), (F.col("id") % 1500).cast("double").alias("v"))
    counts = o.value_counts(df, keys, "v")
    for hot_rows, most_rows, slices in ((2, o.HOT_ROWS, 256), (2, 6, 500), (100, 6, 30)):
        monkeypatch.setattr(o, "HOT_ROWS", most_rows)
        heavy = o.hot_keys(df, keys, hot_rows)
        assert heavy.slices == slices
        got = {r["v"]: (r["cum_n"], r["total_n"], r["next_value"]) for r in o.running_totals(counts, keys, "v", ["n"], heavy).collect()}
        assert got == {float(v): (2 * v + 2, rows, v + 1.0 if v < 1499 else None) for v in range(1500)}


@pytest.mark.parametrize("hot_rows", [10**9, 10])
def test_quantiles(spark, hot_rows):
    rng = np.random.default_rng(2)
    values = np.round(rng.normal(size=301), 1)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
    wanted = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.937, "e": 1.0}
    for found in (o.exact_quantiles(df, [], "v", wanted, hot_rows).first(), o.column_quantiles(df, ["v"], wanted, hot_rows).first()):
        for name, p in wanted.items():
            assert found[name] == pytest.approx(np.quantile(values, p))


@pytest.mark.parametrize("include", [True, False])
@pytest.mark.parametrize("hot_rows", [None, 10**9, 15])
def test_carry_forward(spark, include, hot_rows):
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 else f"k{i % 5}", START + timedelta(minutes=i), rng.choice([None, i])) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, k string, ts timestamp_ntz, v int")
    got = o.carry_forward(df, ["k"], "ts", {"last": F.col("v")}, include_current=include, hot_rows=hot_rows)
    for r in got.collect():
        before = [v for i, k, t, v in rows if k == r["k"] and v is not None and (t <= r["ts"] if include else t < r["ts"])]
        assert r["last"] == (before[-1] if before else None)


def brute(entities, features, ttl):
    out = {}
    for i, k, t in entities:
        past = [f for f in features if k is not None and f[0] == k and f[1] <= t]
        best = max(past, key=lambda f: (f[1], f[2]), default=None)
        out[i] = best[2] if best and (ttl is None or best[1] + ttl >= t) else None
    return out


def join(spark, entities, features, ttl, hot_rows):
    e = spark.createDataFrame([(i, k, t) for i, k, t in entities], "id int, user_id int, event_timestamp timestamp_ntz")
    f = spark.createDataFrame(features, "user_id int, event_timestamp timestamp_ntz, v int")
    view = FeatureView("v", ("user_id",), ttl, ("v",), f, tie_break=("v",))
    rows = point_in_time_join(e, [view], hot_rows=hot_rows).collect()
    assert len(rows) == len(entities)
    return {r["id"]: r["v"] for r in rows}


@pytest.mark.parametrize("hot_rows", [10**9, 25])
def test_point_in_time_with_hot_key_and_ties(spark, hot_rows):
    rng = random.Random(4)
    at = lambda m: START + timedelta(minutes=m)
    # user 1 holds most rows and one instant holds most of those; keys may be null or without features
    entities = [(i, 1, at(rng.choice([30, 30, rng.randrange(90)]))) for i in range(300)]
    entities += [(300 + i, rng.choice([None, 2, 3, 99]), at(rng.randrange(90))) for i in range(60)]
    features = [(1, at(rng.choice([30, rng.randrange(90)])), rng.randrange(1000)) for _ in range(120)]
    features += [(2, at(m), m) for m in range(0, 90, 20)] + [(3, at(30), 5), (3, at(30), 6)]
    for ttl in (None, timedelta(minutes=7)):
        assert join(spark, entities, features, ttl, hot_rows) == brute(entities, features, ttl)


minutes = st.integers(0, 12)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.tuples(st.sampled_from([1, 2, None]), minutes), min_size=1, max_size=25),
    st.lists(st.tuples(st.sampled_from([1, 2]), minutes, st.integers(0, 9)), min_size=1, max_size=25),
)
def test_point_in_time_property(spark, entity_rows, feature_rows):
    entities = [(i, k, START + timedelta(minutes=m)) for i, (k, m) in enumerate(entity_rows)]
    features = [(k, START + timedelta(minutes=m), v) for k, m, v in feature_rows]
    ttl = timedelta(minutes=4)
    assert join(spark, entities, features, ttl, 5) == brute(entities, features, ttl)


@pytest.mark.parametrize("hot_rows", [10**9, 10])
def test_roc_auc_counts_pairs(spark, hot_rows):
    rng = random.Random(5)
    rows = [(rng.random() < 0.3, float(rng.randrange(15))) for _ in range(150)]
    df = spark.createDataFrame(rows, "y boolean, s double")
    got = evaluation.roc_auc(df, F.col("y"), "s", hot_rows=hot_rows).first()
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    pairs = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert got["roc_auc"] == pytest.approx(pairs / (len(pos) * len(neg)))


@pytest.mark.parametrize("hot_rows", [10**9, 40])
def test_ks_and_wasserstein(spark, hot_rows):
    rng = np.random.default_rng(6)
    ref, cur = np.round(rng.normal(0, 1, 180), 1), np.round(rng.normal(0.4, 1.3, 90), 1)
    rows = [("reference", float(v)) for v in ref] + [("current", float(v)) for v in cur] + [("current", None)]
    df = spark.createDataFrame(rows, "dataset string, x double")
    got = drift.numeric_drift(df, ["x"], hot_rows=hot_rows).first()
    grid = np.unique(np.concatenate([ref, cur]))
    f, g = [np.searchsorted(np.sort(s), grid, side="right") / len(s) for s in (ref, cur)]
    assert got["ks"] == pytest.approx(np.abs(f - g).max())
    area = float((np.abs(f - g)[:-1] * np.diff(grid)).sum())
    assert got["wasserstein"] == pytest.approx(area / ref.std())
    assert (got["n_ref"], got["n_cur"]) == (180, 90)


def test_drift_slices_do_not_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(o, "SLICES", 8)
    df = spark.range(900).selectExpr("if(id % 3 = 0, 'current', 'reference') as dataset", "double(id) as x", "double(id % 7) as z")
    seen = []
    monkeypatch.setattr(drift, "per_column", lambda *a: seen.append(o.per_column(*a)) or seen[-1])
    got = {r["column_name"]: r for r in drift.numeric_drift(df, ["x", "z"], hot_rows=2).collect()}
    assert seen[0].slices == 2 * 8
    for name, of in (("x", lambda i: i), ("z", lambda i: i % 7)):
        ref, cur = [of(i) for i in range(900) if i % 3], [of(i) for i in range(0, 900, 3)]
        gaps = [abs(sum(v <= at for v in ref) / 600 - sum(v <= at for v in cur) / 300) for at in {*ref, *cur}]
        assert got[name]["ks"] == pytest.approx(max(gaps))


def test_drift_moves_and_places_its_counts_once(spark):
    df = spark.range(900).selectExpr("if(id % 3 = 0, 'current', 'reference') as dataset", "double(id) as x", "double(id % 7) as z")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = drift.numeric_drift(df, ["x", "z"], hot_rows=20).select("column_name", "ks")
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = found.count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    made = [line for line in plan.splitlines() if " Exchange " in line and "ReusedExchange" not in line]
    for of in ("value", "_slice"):
        assert len([line for line in made if re.search(rf"hashpartitioning\(column_name#\d+, {of}#", line)]) == 1, plan
    assert not re.search(r"lambda [^\n]* <= value#", plan) and rows == 2


@pytest.mark.parametrize("cuts", [0, 1, 7, 8, 9, 63, 64, 65, 511, 512, 520])
def test_place_among_cut_points(spark, cuts):
    edges = sorted(random.Random(cuts).choices(range(0, 600, 2), k=cuts))
    df = spark.range(-1, 602).select("id", F.array(*map(F.lit, edges)).cast("array<bigint>").alias("e"))
    df = o._placed(o._placed(df, "e", "id", cuts, "upto"), "e", "id", max(cuts, 2048), "below", equal=False)
    for r in df.collect():
        assert (r["upto"], r["below"]) == (bisect_right(edges, r["id"]), bisect_left(edges, r["id"]))
