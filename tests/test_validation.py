"""Profiles and rules on edge rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomtide.operators import profile, rules


@pytest.fixture(scope="module")
def messy(spark):
    rows = [(i, None if i % 10 == 0 else float(i), float("nan") if i == 3 else 1.0, None, "ab"[: i % 3]) for i in range(100)]
    return spark.createDataFrame(rows, "id int, x double, c double, empty double, s string")


def test_profile_of_edge_columns(messy):
    got = {r["column_name"]: r for r in profile.column_profile(messy).collect()}
    assert got["x"]["n_null"] == 10 and got["x"]["min_value"] == 1.0
    assert got["c"]["n_null"] == 1 and got["c"]["std_pop"] == 0.0
    assert got["empty"]["null_share"] == 1.0 and got["empty"]["min_value"] is None
    assert (got["s"]["min_length"], got["s"]["max_length"]) == (0, 2)


def test_derived_rules(messy):
    found = rules.derive_rules(messy, "m")
    kinds = [(r.kind, r.column) for r in found]
    assert ("between", "empty") not in kinds and ("length_between", "s") in kinds
    by = {(r.kind, r.column): r for r in found}
    assert by["not_null", "x"].mostly == pytest.approx(0.89)
    assert by["not_null", "c"].mostly == 1.0
    assert by["not_null", "empty"].mostly == 0.0
    results = {(r["kind"], r["column_name"]): r for r in rules.validate(messy, found, "same").collect()}
    # a small null share gives a strict rule, which the profiled data itself breaks
    assert not results["not_null", "c"]["success"]
    assert sum(not r["success"] for r in results.values()) == 1


def test_rules_survive_a_frame(spark, messy):
    found = rules.derive_rules(messy, "m")
    assert rules.rules_from_frame(rules.rules_frame(spark, found)) == found


def test_gate_and_quarantine(messy):
    limit = [rules.Rule("m", 1, "between", "x", 0.0, 50.0), rules.Rule("m", 2, "not_null", "x")]
    with pytest.raises(rules.ValidationFailed, match="between"):
        rules.require_valid(rules.validate(messy, limit, "r"))
    good, bad = rules.quarantine(messy, limit)
    assert good.count() + bad.count() == 100
    assert {tuple(r["broken_rules"]) for r in bad.collect()} == {(1,), (2,)}
    with pytest.raises(ValueError, match="unknown rule"):
        rules.validate(messy, [rules.Rule("m", 1, "nope")], "r")


def test_absent_column_and_empty_table(messy):
    absent = rules.validate(messy, [rules.Rule("m", 1, "not_null", "zz")], "r").first()
    assert not absent["success"]
    nothing = rules.validate(messy.where("id < 0"), [rules.Rule("m", 1, "row_count", min_value=1.0), rules.Rule("m", 2, "not_null", "x")], "r")
    assert [r["success"] for r in nothing.orderBy("rule_id").collect()] == [False, True]


def test_fixed_suite_is_exact(messy):
    suite = rules.declared_suite("s", messy.columns)
    assert all(r["success"] for r in rules.validate(messy, suite, "r").collect())
    assert not rules.validate(messy.drop("s"), suite, "r").where("kind = 'column_set'").first()["success"]
    wider = messy.withColumn("extra", F.lit(1))
    assert not rules.validate(wider, suite, "r").where("kind = 'column_set'").first()["success"]
    contained = [rules.Rule("s", 1, "column_set", column_set=tuple(messy.columns))]
    assert rules.validate(wider, contained, "r").first()["success"]


def test_schema_check(spark, small):
    emb = spark.read.parquet(f"{small}/embeddings.parquet")
    got = {r["column_name"]: r for r in rules.schema_check(emb, {"vec_id": "bigint", "embedding": "array<double>", "score": "double"}).collect()}
    assert {k: v["status"] for k, v in got.items()} == {"vec_id": "ok", "embedding": "type_mismatch", "score": "missing", "label": "extra"}
    assert not got["score"]["passed"] and got["label"]["passed"]
    assert rules.column_set_difference(emb, emb.drop("label").withColumn("z", F.lit(1))) == (["label"], ["z"])


def test_quality_report_and_duplicates(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (2, "a"), (2, "a")], "a int, b string")
    assert profile.duplicate_rows(df).first()["duplicate_rows"] == 3
    assert profile.deduplicate(df).count() == 2
    checks = rules.quality_checks(df, "b", min_rows=1)
    verdict = {r["name"]: r["passed"] for r in checks.collect()}
    assert verdict == {"row_count": True, "null_percentage_a": True, "null_percentage_b": False, "target_classes": False, "duplicates": False}
    report = rules.quality_report(df, checks).first()
    assert report["checks"] == 5 and report["failed_checks"] == 3 and not report["passed"]


def test_wide_missing_values(spark):
    df = spark.createDataFrame([(float("inf"), ""), (1.0, "a")], "x double, s string")
    assert profile.missing_values(df).first()["n_missing"] == 0
    assert profile.missing_values(df, wide=True).first()["n_missing"] == 2


def test_families(messy):
    got = {r["column_name"]: r["family"] for r in rules.column_families(messy.withColumn("t", F.current_timestamp())).collect()}
    assert got["s"] == "categorical" and got["x"] == "numeric" and got["t"] == "excluded"
