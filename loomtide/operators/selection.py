"""Feature scores and selection. Scores are aggregations; only one row per feature reaches the driver."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtide.functions.columns import present, ratio
from loomtide.functions.stats import fisher_p
from loomtide.operators.ordered import column_quantiles


def f_classif(df: DataFrame, features: Sequence[str], target: str, with_p: bool = False) -> DataFrame:
    """One-way ANOVA F per feature: class-wise count, mean and spread of all features in one pass."""
    rows = df.where(F.col(target).isNotNull())
    moments = []
    for name in features:
        x = present(df, name).cast("double")
        moments.append(
            F.struct(
                F.lit(name).alias("feature"), F.count(x).alias("n"), F.avg(x).alias("mean"),
                (F.var_pop(x) * F.count(x)).alias("within"),
            )
        )
    per_class = rows.groupBy(target).agg(F.array(*moments).alias("_m")).select(F.inline("_m")).where("n > 0")
    grand = per_class.groupBy("feature").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_grand"))
    joined = per_class.join(grand, "feature")
    n, k = F.sum("n"), F.count(F.lit(1))
    between = F.sum(F.col("n") * (F.col("mean") - F.col("_grand")) ** 2)
    out = joined.groupBy("feature").agg(
        ratio(ratio(between, k - 1), ratio(F.sum("within"), n - k)).alias("score"),
        (k - 1).alias("dof1"),
        (n - k).alias("dof2"),
    )
    return out.withColumn("p_value", fisher_p(F.col("score"), F.col("dof1"), F.col("dof2"))) if with_p else out


def f_regression(df: DataFrame, features: Sequence[str], target: str, with_p: bool = False) -> DataFrame:
    """F of a one-feature linear fit, from the correlation with the target."""
    scores = []
    for name in features:
        x, y = present(df, name).cast("double"), present(df, target).cast("double")
        both = x.isNotNull() & y.isNotNull()
        x, y = F.when(both, x), F.when(both, y)
        # null for a constant column, where the built-in correlation fails
        r2 = ratio(F.covar_pop(x, y) ** 2, F.var_pop(x) * F.var_pop(y))
        dof = F.count(x) - 2
        scores.append(
            F.struct(F.lit(name).alias("feature"), ratio(r2 * dof, 1 - r2).alias("score"), F.lit(1).alias("dof1"), dof.alias("dof2"))
        )
    out = df.agg(F.array(*scores).alias("_s")).select(F.inline("_s"))
    return out.withColumn("p_value", fisher_p(F.col("score"), F.col("dof1"), F.col("dof2"))) if with_p else out


def _bin_edges(df: DataFrame, columns: Sequence[str], bins: int) -> dict[str, list[float]]:
    values = df.select(*[present(df, c).cast("double").alias(c) for c in columns])
    wanted = {f"q{i}": i / bins for i in range(1, bins)}
    rows = column_quantiles(values, columns, wanted).collect()
    return {row["column_name"]: [row[q] for q in wanted] for row in rows}


def mutual_info(
    df: DataFrame, features: Sequence[str], target: str, bins: int = 10, discrete_target: bool = True
) -> DataFrame:
    """Mutual information (nats) with the target over equal-frequency bins cut at exact quantiles.

    A continuous target is binned in the same way. Bin numbers are a projection, so only counts are shuffled.
    """
    binned_columns = list(features) if discrete_target else [*features, target]
    edges = _bin_edges(df, binned_columns, bins)

    def binned(name: str):
        value = present(df, name).cast("double")
        bin_no = sum(((value > F.lit(e)).cast("int") for e in edges[name]), F.lit(0))
        return bin_no.cast("string")

    y = F.col(target).cast("string") if discrete_target else binned(target)
    joint = (
        df.select(y.alias("_y"), *[binned(c).alias(c) for c in features])
        .unpivot(["_y"], list(features), "feature", "_x")
        .where("_x is not null and _y is not null")
        .groupBy("feature", "_x", "_y")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    # from here on there are features x bins x classes rows
    total = lambda *by: F.sum("_n").over(W.partitionBy("feature", *by)).cast("double")
    n, nx, ny, whole = (F.col(c).cast("double") for c in ("_n", "_nx", "_ny", "_all"))
    return (
        joint.withColumn("_nx", total("_x")).withColumn("_ny", total("_y")).withColumn("_all", total())
        .groupBy("feature")
        .agg(F.sum(n / whole * F.log(n * whole / (nx * ny))).alias("score"))
    )


def _score_rows(scores: DataFrame, features: Sequence[str]) -> list[tuple[str, float]]:
    found = {row["feature"]: row["score"] for row in scores.select("feature", "score").collect()}
    return [(name, found[name] if found.get(name) is not None else float("-inf")) for name in features]


def k_best(scores: DataFrame, features: Sequence[str], k: int) -> list[str]:
    """The k features with the highest scores, ties in column order; returned in column order."""
    ranked = sorted(_score_rows(scores, features), key=lambda pair: -pair[1])[:k]
    keep = {name for name, _ in ranked}
    return [name for name in features if name in keep]


def best_percentile(scores: DataFrame, features: Sequence[str], percentile: float) -> list[str]:
    """Features scoring above the matching percentile of all scores; ties at the line fill up in column order."""
    rows = _score_rows(scores, features)
    values = np.array([s for _, s in rows])
    line = float(np.percentile(values, 100 - percentile))
    room = int(len(rows) * percentile / 100) - int((values > line).sum())
    keep = set()
    for name, score in rows:
        if score > line:
            keep.add(name)
        elif score == line and room > 0:
            keep.add(name)
            room -= 1
    return [name for name in features if name in keep]


def select_features(
    df: DataFrame, features: Sequence[str], target: str, method: str, task: str = "classification",
    k: int = 10, percentile: float = 50, **options: object,
) -> list[str]:
    """Names of the selected features by one of the methods in ``SELECTORS``."""
    if method not in SELECTORS:
        raise ValueError(f"unknown selection method {method}; known are {sorted(SELECTORS)}")
    return SELECTORS[method](df, list(features), target, task, k, percentile, **options)


def _anova(df: DataFrame, features: Sequence[str], target: str, task: str) -> DataFrame:
    return (f_classif if task == "classification" else f_regression)(df, features, target)


def _rfe(df, features, target, task, k, percentile, **options):
    from loomtide.operators.models import eliminate_features

    return eliminate_features(df, features, target, task, keep=k, **options)


def _rfecv(df, features, target, task, k, percentile, **options):
    from loomtide.operators.models import eliminate_features_cv

    return eliminate_features_cv(df, features, target, task, **options)


SELECTORS = {
    "k_best": lambda df, f, t, task, k, p: k_best(_anova(df, f, t, task), f, k),
    "percentile": lambda df, f, t, task, k, p: best_percentile(_anova(df, f, t, task), f, p),
    "mutual_info": lambda df, f, t, task, k, p: k_best(
        mutual_info(df, f, t, discrete_target=task == "classification"), f, k
    ),
    "rfe": _rfe,
    "rfecv": _rfecv,
}
