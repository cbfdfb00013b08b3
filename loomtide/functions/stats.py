"""Tail probabilities of test statistics.

Only result rows carry them (one per column or experiment), so the special functions are small Arrow-batched UDFs;
the Kolmogorov series is a plain column expression.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            c = 1.0 + numerator / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - scale * total
    tiny, b = 1e-300, x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    value = d
    for i in range(1, 1000):
        step = -i * (i - a)
        b += 2.0
        d = step * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + step / c
        c = c if abs(c) > tiny else tiny
        value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return scale * value


def chi_square_tail(x: float, dof: float) -> float:
    return upper_gamma(dof / 2.0, x / 2.0)


def student_two_sided(t: float, dof: float) -> float:
    return incomplete_beta(dof / 2.0, 0.5, dof / (dof + t * t))


def fisher_tail(f: float, dof1: float, dof2: float) -> float:
    return incomplete_beta(dof2 / 2.0, dof1 / 2.0, dof2 / (dof2 + dof1 * f))


def _batched(fn, *columns: Column) -> Column:
    @F.pandas_udf("double")
    def tail(args: pd.DataFrame) -> pd.Series:
        return pd.Series(
            [None if any(v is None or math.isnan(v) for v in row) else fn(*row)
             for row in args.itertuples(index=False, name=None)],
            dtype="float64",
        )

    return tail(F.struct(*[c.cast("double") for c in columns]))


def chi_square_p(statistic: Column, dof: Column) -> Column:
    return _batched(chi_square_tail, statistic, dof)


def student_p(t: Column, dof: Column) -> Column:
    return _batched(student_two_sided, t, dof)


def fisher_p(f: Column, dof1: Column, dof2: Column) -> Column:
    return _batched(fisher_tail, f, dof1, dof2)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def normal_p(z: Column) -> Column:
    return _batched(normal_two_sided, z)


def kolmogorov_p(distance: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value of the two-sample Kolmogorov-Smirnov distance."""
    n, m = n.cast("double"), m.cast("double")
    scaled = distance * F.sqrt(F.try_divide(n * m, n + m))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda total, k: total + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * scaled * scaled),
    )
    return F.when(scaled < 0.2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2.0 * series)))


def kolmogorov_exact_p(distance: Column, n: Column, m: Column) -> Column:
    """Exact two-sided p-value of the two-sample Kolmogorov-Smirnov distance.

    Every order of the n + m values is a lattice path from (0, 0) to (n, m); p is the share of paths that reach the
    distance. Row by row, ``inside[j]`` is the share of the paths to (i, j) that stay below it, from those to its two
    neighbours. An expression of n * m steps for each result row: meant for small samples.
    """
    n, m = n.cast("int"), m.cast("int")
    limit = F.round(distance * n * m).cast("long")
    below = lambda i, j: F.abs(i.cast("long") * m - j.cast("long") * n) < limit

    def next_row(before: Column, i: Column) -> Column:
        def cell(row: Column, j: Column) -> Column:
            left = F.when(j == 0, 0.0).otherwise(F.element_at(row, -1))
            share = (F.get(before, j) * i + left * j) / (i + j)
            return F.array_append(row, F.when(below(i, j), share).otherwise(0.0))

        return F.aggregate(F.sequence(F.lit(0), m), F.array().cast("array<double>"), cell)

    first = F.transform(F.sequence(F.lit(0), m), lambda j: F.when(below(F.lit(0), j), 1.0).otherwise(0.0))
    inside = F.aggregate(F.sequence(F.lit(1), n), first, next_row)
    return F.when((n > 0) & (m > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.element_at(inside, -1))))
