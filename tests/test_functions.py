"""Special functions against published table values, column helpers, missing values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomtide.functions import columns, stats


@pytest.mark.parametrize("x, dof, p", [(3.841459, 1, 0.05), (9.487729, 4, 0.05), (23.209251, 10, 0.01), (124.342113, 100, 0.05)])
def test_chi_square(x, dof, p):
    assert stats.chi_square_tail(x, dof) == pytest.approx(p, abs=1e-6)


@pytest.mark.parametrize("t, dof, p", [(12.7062, 1, 0.05), (2.228139, 10, 0.05), (2.750, 30, 0.01), (1.959964, 1e7, 0.05)])
def test_student(t, dof, p):
    assert stats.student_two_sided(t, dof) == pytest.approx(p, abs=1e-5)


@pytest.mark.parametrize("f, a, b, p", [(4.9646, 1, 10, 0.05), (3.4928, 2, 20, 0.05), (2.6049, 4, 60, 0.0445)])
def test_fisher(f, a, b, p):
    assert stats.fisher_tail(f, a, b) == pytest.approx(p, abs=1e-3)


def test_normal_and_columns(spark):
    assert stats.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    df = spark.createDataFrame([(9.487729, 4.0), (None, 4.0)], "x double, d double")
    got = [r[0] for r in df.select(stats.chi_square_p(F.col("x"), F.col("d"))).collect()]
    assert got[0] == pytest.approx(0.05, abs=1e-6) and got[1] is None


def test_kolmogorov(spark):
    df = spark.createDataFrame([(0.5, 1000, 1000), (0.0, 10, 10), (0.06074, 1000, 1000)], "d double, n long, m long")
    got = [r[0] for r in df.select(stats.kolmogorov_p(F.col("d"), F.col("n"), F.col("m"))).collect()]
    assert got[0] < 1e-50 and got[1] == 1.0
    # 1.3581 is the 5% point of the Kolmogorov distribution
    assert got[2] == pytest.approx(0.05, abs=1e-3)


def test_missing_means_null_or_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, None), (float("nan"), "")], "x double, s string")
    assert df.where(columns.missing(df, "x")).count() == 2
    assert df.where(columns.missing(df, "s")).count() == 1
    assert df.select(F.count(columns.present(df, "x"))).first()[0] == 1


def test_column_families(spark):
    df = spark.createDataFrame([(1, 1.0, "a", True)], "i int, d double, s string, b boolean")
    assert columns.numeric_columns(df) == ["i", "d"]
    assert columns.categorical_columns(df) == ["s", "b"]
    assert columns.feature_columns(df, "s", "d") == ["i", "b"]
    assert columns.existing(df, ["s", "zz", "i"]) == ["s", "i"]


def test_exact_ks_p_is_the_share_of_orders(spark):
    from itertools import combinations
    from math import comb

    from loomtide.functions.stats import kolmogorov_exact_p

    def brute(n, m, d):
        hits = 0
        for places in combinations(range(n + m), n):
            i = j = 0
            most = 0.0
            for k in range(n + m):
                i, j = (i + 1, j) if k in places else (i, j + 1)
                most = max(most, abs(i / n - j / m))
            hits += most >= d - 1e-12
        return hits / comb(n + m, n)

    rows = [(n, m, k / (n * m)) for n, m in ((1, 1), (4, 3), (5, 5), (2, 7)) for k in range(0, n * m + 1)]
    df = spark.createDataFrame([*rows, (0, 3, 0.5), (60, 55, 0.25)], "n long, m long, d double")
    got = {(r["n"], r["m"], r["d"]): r["p"] for r in df.withColumn("p", kolmogorov_exact_p(F.col("d"), F.col("n"), F.col("m"))).collect()}
    for n, m, d in rows:
        assert got[n, m, d] == pytest.approx(brute(n, m, d), abs=1e-12)
    # published: n = m = 5, D = 4/5 and 1
    assert got[5, 5, 0.8] == pytest.approx(0.0793650794) and got[5, 5, 1.0] == pytest.approx(0.0079365079)
    assert got[0, 3, 0.5] is None and 0 < got[60, 55, 0.25] < 0.06
