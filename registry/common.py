"""Shared pieces of the registered queries: table access, roles, rounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Collects queries with the SQL each is checked against (None: no SQL equivalent)."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = fn
            if sql is not None:
                self.oracles[name] = sql
            return fn

        return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, columns: list[str] | None = None) -> DataFrame:
    """Round every double column (or the named ones), so that summation order does not show."""
    names = columns or [n for n, t in df.dtypes if t in ("double", "float")]
    return df.select(*[r(F.col(c), digits).alias(c) if c in names else F.col(c) for c in df.columns])


def r(col: Column, digits: int = 6) -> Column:
    # adding zero turns a negative zero into a plain one
    return F.round(col, digits) + F.lit(0.0)


def as_doubles(df: DataFrame, columns: list[str]) -> DataFrame:
    """Whole-number columns that may be null, as doubles: both engines then hand over the same type."""
    return df.select(*[F.col(c).cast("double").alias(c) if c in columns else F.col(c) for c in df.columns])
