"""Distribution drift between a reference and a current dataset, for all columns and models in one plan.

Raw rows are never joined: both datasets are reduced to counts per (model, column, value) by one grouping, and all
statistics are sums over those counts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtide.functions.columns import (
    categorical_columns, existing, feature_columns, join_on, numeric_columns, present, quoted, ratio,
)
from loomtide.functions.stats import chi_square_p, kolmogorov_exact_p, kolmogorov_p, normal_p
from loomtide.operators.ordered import HOT_ROWS, Hot, hot_keys, per_column, running_totals
from loomtide.operators.profile import melted_moments

REFERENCE, CURRENT = "reference", "current"


def _pair_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str], dataset: str, numeric: bool) -> DataFrame:
    kind = "double" if numeric else "string"
    # not unpivot: Spark would not see that several readers of these counts can share one shuffle
    melted = df.select(*by, dataset, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), (present(df, c) if numeric else quoted(c)).cast(kind).alias("value"))
        for c in columns
    ])))
    of = lambda side: F.count_if(F.col(dataset) == side)
    return melted.where("value is not null").groupBy(*by, "column_name", "value").agg(
        of(REFERENCE).alias("n_ref"), of(CURRENT).alias("n_cur")
    )


def _category_statistics() -> dict[str, Column]:
    """Chi-square, Jensen-Shannon and two-proportion z over rows (n_ref, n_cur, total_n_ref, total_n_cur)."""
    p = ratio(F.col("n_ref"), F.col("total_n_ref"))
    q = ratio(F.col("n_cur"), F.col("total_n_cur"))
    expected = p * F.col("total_n_cur")
    middle = (p + q) / 2
    gain = lambda x: F.when(x > 0, x * F.log(x / middle)).otherwise(0.0)
    both = F.col("total_n_ref") + F.col("total_n_cur")
    pooled = (F.col("n_ref") + F.col("n_cur")) / both
    spread = F.sqrt(ratio(pooled * (1 - pooled) * both, F.col("total_n_ref").cast("double") * F.col("total_n_cur")))
    return {
        "chi_square": F.sum(F.try_divide((F.col("n_cur") - expected) ** 2, expected)),
        "unseen_categories": F.count_if((F.col("n_ref") == 0) & (F.col("n_cur") > 0)),
        "jensen_shannon": F.when(
            (F.max("total_n_ref") > 0) & (F.max("total_n_cur") > 0), F.sqrt(F.greatest(F.lit(0.0), F.sum(gain(p) + gain(q)) / 2))
        ),
        "z": F.when(F.count(F.lit(1)) == 2, F.max(F.abs(F.try_divide(p - q, spread)))),
    }


def numeric_statistics(counts: DataFrame, keys: Sequence[str], spread: DataFrame, heavy: Hot) -> DataFrame:
    """Exact two-sample statistics from counts (keys, value, n_ref, n_cur).

    ``spread`` has the reference's standard deviation (``ref_std``) per key; ``heavy`` names the keys with many rows.
    """
    keys = list(keys)
    ordered = running_totals(counts, keys, "value", ["n_ref", "n_cur"], heavy)
    gap = F.abs(
        ratio(F.col("cum_n_ref"), F.col("total_n_ref")) - ratio(F.col("cum_n_cur"), F.col("total_n_cur"))
    )
    stats = ordered.groupBy(*keys).agg(
        F.lit("numeric").alias("kind"),
        F.max("total_n_ref").alias("n_ref"),
        F.max("total_n_cur").alias("n_cur"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.max(gap).alias("ks"),
        F.sum(gap * (F.col("next_value") - F.col("value"))).alias("_distance"),
        *[c.alias(n) for n, c in _category_statistics().items()],
    )
    return join_on(stats, spread, keys, "left").withColumn(
        # null without rows on one side; a single common value has no distance
        "wasserstein",
        F.when(
            (F.col("n_ref") > 0) & (F.col("n_cur") > 0),
            F.coalesce("_distance", F.lit(0.0)) / F.greatest(F.col("ref_std"), F.lit(0.001)),
        ),
    ).drop("_distance", "ref_std")


def numeric_drift(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), dataset: str = "dataset", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Exact two-sample statistics of numeric columns; missing values are left out."""
    heavy = per_column(hot_keys(df, by, hot_rows), columns)
    counts = _pair_counts(df, columns, by, dataset, True)
    reference = df.where(F.col(dataset) == REFERENCE).select(
        *by, *[present(df, c).cast("double").alias(c) for c in columns]
    )
    spread = melted_moments(reference, columns, by, {"ref_std": F.stddev_pop})
    return numeric_statistics(counts, [*by, "column_name"], spread, heavy)


def categorical_statistics(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two-sample statistics from counts (keys, value, n_ref, n_cur) over the union of the categories."""
    keys = list(keys)
    totals = counts.groupBy(*keys).agg(F.sum("n_ref").alias("total_n_ref"), F.sum("n_cur").alias("total_n_cur"))
    return join_on(counts, totals, keys).groupBy(*keys).agg(
        F.lit("categorical").alias("kind"),
        F.max("total_n_ref").alias("n_ref"),
        F.max("total_n_cur").alias("n_cur"),
        F.count(F.lit(1)).alias("n_distinct"),
        *[c.alias(n) for n, c in _category_statistics().items()],
    )


def categorical_drift(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), dataset: str = "dataset") -> DataFrame:
    """Two-sample statistics of categorical columns over the union of their categories."""
    return categorical_statistics(_pair_counts(df, columns, by, dataset, False), [*by, "column_name"])


def compared_columns(
    df: DataFrame, columns: Sequence[str] | None = None, target: str | None = None, prediction: str | None = None,
    exclude: Sequence[str] = (),
) -> tuple[list[str], list[str]]:
    """Numeric and categorical columns to compare: those asked for that the table has, else all but target and prediction.

    ``exclude`` names columns that are no features, such as keys and the dataset mark. Columns of other types are left out.
    """
    wanted = feature_columns(df, target, prediction) if columns is None else existing(df, columns)
    numbers, texts = set(numeric_columns(df)), set(categorical_columns(df))
    wanted = [c for c in wanted if c not in exclude]
    return [c for c in wanted if c in numbers], [c for c in wanted if c in texts]


def drift_statistics(
    df: DataFrame,
    numeric: Sequence[str] = (),
    categorical: Sequence[str] = (),
    by: Sequence[str] = (),
    dataset: str = "dataset",
) -> DataFrame:
    """All statistics of all columns, long form; statistics that do not apply are null."""
    parts = []
    if numeric:
        parts.append(numeric_drift(df, numeric, by, dataset))
    if categorical:
        parts.append(categorical_drift(df, categorical, by, dataset))
    if not parts:
        raise ValueError("no columns to compare")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


# method -> (score column, True when the score is a p-value)
DRIFT_METHODS: dict[str, tuple[Callable[[], Column], bool]] = {
    "ks": (lambda: kolmogorov_p(F.col("ks"), F.col("n_ref"), F.col("n_cur")), True),
    "chi_square": (
        lambda: F.when(F.col("unseen_categories") > 0, F.lit(0.0)).otherwise(
            chi_square_p(F.col("chi_square"), F.greatest(F.col("n_distinct") - 1, F.lit(1)))
        ),
        True,
    ),
    "z": (lambda: F.when((F.col("n_ref") > 0) & (F.col("n_cur") > 0), normal_p(F.coalesce("z", F.lit(0.0)))), True),
    "wasserstein": (lambda: F.col("wasserstein"), False),
    "jensen_shannon": (lambda: F.col("jensen_shannon"), False),
}

DEFAULT_METHODS = ("wasserstein", "jensen_shannon")


def method_by_kind(
    numeric: str = DEFAULT_METHODS[0], categorical: str = DEFAULT_METHODS[1], categories: Sequence[str] = ()
) -> Column:
    """One method for numbers and one for categories, whatever the number of rows or values.

    ``categories`` names numeric columns that count as categories. A test of significance may be named instead of a
    distance; which one suits the size of the data is the caller's choice, so a verdict never turns with a row more.
    """
    number = (F.col("kind") == "numeric") & ~F.col("column_name").isin(*categories) if categories else F.col("kind") == "numeric"
    return F.when(number, numeric).otherwise(categorical)


def drift_scores(
    statistics: DataFrame,
    method: Column | None = None,
    p_threshold: float = 0.05,
    distance_threshold: float = 0.1,
    by: Sequence[str] = (),
    methods: Sequence[str] | None = None,
    exact_rows: int = 0,
) -> DataFrame:
    """Score and verdict per column: drift when p is below, or a distance at or above, its threshold.

    A column without values on one side has no score and no verdict (null): it is untested. ``method`` gives the
    method of each row, by kind of column if left out; ``methods`` names those it can be. With ``exact_rows``, the p-value
    of ``ks`` is exact where neither side has more values than that, and the asymptotic series elsewhere.
    """
    methods = methods or (DEFAULT_METHODS if method is None else tuple(DRIFT_METHODS))
    for name in ("ks", "wasserstein"):
        if name not in statistics.columns:
            statistics = statistics.withColumn(name, F.lit(None).cast("double"))
    chosen = statistics.withColumn("method", method if method is not None else method_by_kind())
    score, is_p = F.lit(None).cast("double"), F.lit(False)
    for name in methods:
        value, p = DRIFT_METHODS[name]
        found = value()
        if name == "ks" and exact_rows:
            few = (F.col("n_ref") <= exact_rows) & (F.col("n_cur") <= exact_rows)
            found = F.when(few, kolmogorov_exact_p(F.col("ks"), F.col("n_ref"), F.col("n_cur"))).otherwise(found)
        score = F.when(F.col("method") == name, found).otherwise(score)
        if p:
            is_p = is_p | (F.col("method") == name)
    scored = chosen.select(
        *by, "column_name", "method", score.alias("drift_score"), is_p.alias("_p"), "n_ref", "n_cur"
    )
    return scored.select(
        *by,
        "column_name",
        "method",
        "drift_score",
        F.when(F.col("_p"), F.lit(p_threshold)).otherwise(F.lit(distance_threshold)).alias("threshold"),
        F.when(F.col("_p"), F.col("drift_score") < p_threshold)
        .otherwise(F.col("drift_score") >= distance_threshold)
        .alias("drift_detected"),
    )


def drift_summary(scores: DataFrame, by: Sequence[str] = (), dataset_share: float = 0.5) -> DataFrame:
    """Columns tested and drifted, their share, the dataset verdict and the drifted columns in order.

    Untested columns count for nothing; without a tested column share and verdict are null.
    """
    n, drifted = F.count("drift_detected"), F.count_if("drift_detected")
    share = ratio(drifted, n)
    return scores.groupBy(*by).agg(
        n.alias("number_of_columns"),
        drifted.alias("number_of_drifted_columns"),
        share.alias("drift_share"),
        (share >= dataset_share).alias("dataset_drift"),
        # one entry per column of the table, so the list is as short as the schema
        F.array_sort(F.collect_list(F.when(F.col("drift_detected"), F.col("column_name")))).alias("drifted_columns"),
    )


def drift_gate(summary: DataFrame, threshold: float = 0.1) -> DataFrame:
    """The retraining workflow's gate on the share of drifted columns."""
    return summary.withColumn("drift_gate", F.col("drift_share") > threshold)
