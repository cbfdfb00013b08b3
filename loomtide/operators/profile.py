"""Dataset and column profiles: all statistics of all columns in one aggregation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtide.functions.columns import (
    categorical_columns,
    is_floating,
    join_on,
    missing,
    numeric_columns,
    present,
    quoted,
    ratio,
)
from loomtide.operators.ordered import HOT_ROWS, bracketed_quantiles

COLUMNS_PER_PASS = 100


def _statistics(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    number = isinstance(dtype, T.NumericType)
    text = isinstance(dtype, T.StringType)
    value = present(df, name).cast("double") if number else F.lit(None).cast("double")
    length = F.length(quoted(name)).cast("long") if text else F.lit(None).cast("long")
    n = F.count(F.lit(1))
    n_null = F.count_if(missing(df, name))
    return F.struct(
        F.lit(name).alias("column_name"),
        F.lit(dtype.simpleString()).alias("dtype"),
        n.alias("n"),
        n_null.alias("n_null"),
        ratio(n_null, n, 0.0).alias("null_share"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std_pop"),
        F.min(length).alias("min_length"),
        F.max(length).alias("max_length"),
    )


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One row per column (and group): counts, null share, numeric range and moments, string lengths."""
    names = [c for c in (columns or df.columns) if c not in by]
    out: DataFrame | None = None
    for start in range(0, len(names), COLUMNS_PER_PASS):
        part = names[start : start + COLUMNS_PER_PASS]
        rows = (
            df.groupBy(*by)
            .agg(F.array(*[_statistics(df, c) for c in part]).alias("_columns"))
            .select(*by, F.inline("_columns"))
        )
        out = rows if out is None else out.unionByName(rows)
    assert out is not None, "no columns to profile"
    return out


def dataset_summary(df: DataFrame) -> DataFrame:
    """Row, column and type-family counts and the total number of missing values, as one row."""
    nulls = F.lit(0).cast("long")
    for name in df.columns:
        nulls = nulls + F.count_if(missing(df, name))
    rows = F.count(F.lit(1))
    cells = rows * F.lit(len(df.columns))
    return df.agg(
        rows.alias("total_rows"),
        F.lit(len(df.columns)).cast("long").alias("total_columns"),
        F.lit(len(numeric_columns(df))).cast("long").alias("numeric_columns"),
        F.lit(len(categorical_columns(df))).cast("long").alias("categorical_columns"),
        nulls.alias("total_nulls"),
        ratio(nulls, cells, 0.0).alias("share_missing"),
    )


def missing_values(
    df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = (), wide: bool = False
) -> DataFrame:
    """Missing cells and their share of all cells per group; ``wide`` also counts infinities and empty strings."""
    names = list(columns or [c for c in df.columns if c not in by])
    total = F.lit(0).cast("long")
    for name in names:
        gap = missing(df, name)
        dtype = df.schema[name].dataType
        if wide and is_floating(dtype):
            gap = gap | (F.abs(quoted(name)) == F.lit(float("inf")))
        if wide and isinstance(dtype, T.StringType):
            gap = gap | (quoted(name) == "")
        total = total + F.count_if(gap)
    rows = F.count(F.lit(1))
    return df.groupBy(*by).agg(
        rows.alias("n_rows"), total.alias("n_missing"), ratio(total, rows * F.lit(len(names)), 0.0).alias("share_missing")
    )


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows beyond the first of each group of equal rows; nulls count as equal."""
    per_row = df.groupBy(*(columns or df.columns)).agg(F.count(F.lit(1)).alias("_n"))
    total, extra = F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))
    return per_row.agg(
        total.alias("total_rows"), extra.alias("duplicate_rows"), ratio(extra * 100, total, 0.0).alias("duplicate_percent")
    )


def deduplicate(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropDuplicates(list(columns)) if columns else df.dropDuplicates()


def class_counts(df: DataFrame, target: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows and share per target value."""
    counts = df.groupBy(*by, target).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_all"))
    return join_on(counts, totals, by).select(*by, target, "n", ratio(F.col("n"), F.col("_all")).alias("share"))


def quality_summary(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Per group and column: count, missing, distinct, most common value, mean, deviation, range, exact quartiles.

    Built on one table of value counts; ties for the most common value go to the smaller text.
    """
    by = list(by)
    numbers = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]
    texts = df.select(
        *by, *[present(df, c).cast("string").alias(c) for c in columns]
    ).unpivot(by, list(columns), "column_name", "value")
    counts = texts.groupBy(*by, "column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("value").isNotNull()
    keys = [*by, "column_name"]
    out = counts.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("n_missing"),
        F.count("value").alias("n_distinct"),
        F.min_by("value", F.when(known, F.struct(-F.col("n"), "value"))).alias("top_value"),
        F.max(F.when(known, F.col("n"))).alias("top_count"),
    )
    if not numbers:
        return out
    doubles = df.select(*by, *[present(df, c).cast("double").alias(c) for c in numbers])
    quartiles = bracketed_quantiles(doubles, by, numbers, {"q25": 0.25, "median": 0.5, "q75": 0.75}, hot_rows)
    moments = melted_moments(
        doubles, numbers, by, {"mean": F.avg, "std": F.stddev_samp, "min_value": F.min, "max_value": F.max}
    )
    return join_on(join_on(out, moments, keys, "left"), quartiles, keys, "left")


def melted_moments(
    df: DataFrame, columns: Sequence[str], by: Sequence[str], functions: dict[str, Callable[[Column], Column]]
) -> DataFrame:
    """Aggregates of several columns, one row per group and column; the data itself is not melted."""
    structs = [
        F.struct(F.lit(c).alias("column_name"), *[fn(quoted(c)).alias(n) for n, fn in functions.items()]) for c in columns
    ]
    return df.groupBy(*by).agg(F.array(*structs).alias("_m")).select(*by, F.inline("_m"))
