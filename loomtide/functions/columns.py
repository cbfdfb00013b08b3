"""Column helpers shared by all operators: types, missing values, safe division."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def feature_columns(df: DataFrame, target: str | None = None, prediction: str | None = None) -> list[str]:
    """Every column except the target and the prediction, in schema order."""
    return [c for c in df.columns if c not in (target, prediction)]


def existing(df: DataFrame, wanted: Iterable[str]) -> list[str]:
    """The wanted columns that the table really has, in the wanted order."""
    have = set(df.columns)
    return [c for c in wanted if c in have]


def missing(df: DataFrame, name: str) -> Column:
    """True where the value is null or NaN."""
    col = quoted(name)
    return (col.isNull() | F.isnan(col)) if is_floating(df.schema[name].dataType) else col.isNull()


def present(df: DataFrame, name: str) -> Column:
    """The value, with NaN turned into null so that aggregates skip it."""
    col = quoted(name)
    return F.when(~F.isnan(col), col) if is_floating(df.schema[name].dataType) else col


def join_on(left: DataFrame, right: DataFrame, keys: Iterable[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where null equals null; the result has the columns of the left side, then the others.

    Without keys every row meets every row, for sides of one row.
    """
    keys = list(keys)
    names = {k: f"_right_{i}" for i, k in enumerate(keys)}
    renamed = right.select(*[quoted(c).alias(names.get(c, c)) for c in right.columns])
    same = F.lit(True)
    for key, name in names.items():
        same = same & quoted(key).eqNullSafe(F.col(name))
    return left.join(renamed, same, how).drop(*names.values())


def row_draw(df: DataFrame) -> Column:
    """A hash of the row, the same on every attempt of a task; maps cannot be hashed and are left out."""
    names = [n for n, t in df.dtypes if "map<" not in t]
    return F.xxhash64(*[quoted(n) for n in names]) if names else F.lit(0).cast("long")


def ratio(numerator: Column, denominator: Column, default: float | None = None) -> Column:
    """numerator / denominator; ``default`` (null if not given) where the denominator is zero."""
    value = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a zoned or zone-less timestamp (session time zone UTC), with the fraction."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000.0)


def flatten_struct(df: DataFrame, separator: str = "_") -> DataFrame:
    """Replace nested struct columns by one flat column per leaf, named by its path."""

    def leaves(schema: T.StructType, path: tuple[str, ...]) -> list[Column]:
        out: list[Column] = []
        for field in schema.fields:
            here = (*path, field.name)
            if isinstance(field.dataType, T.StructType):
                out += leaves(field.dataType, here)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in here)).alias(separator.join(here)))
        return out

    return df.select(*leaves(df.schema, ()))


def split_object_url(url: Column) -> tuple[Column, Column]:
    """Bucket and key prefix of an object-store address."""
    pattern = r"^[a-z0-9]+://([^/]+)/?(.*)$"
    return F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2)


def run_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")
