"""Windowed roll-ups of metric streams. Windows close by watermark; rows later than that are dropped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(stream: DataFrame, ts: str, length: str, keys: Sequence[str], aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates per key and fixed window."""
    return (
        stream.groupBy(F.window(ts, length), *keys)
        .agg(*[c.alias(n) for n, c in aggregates.items()])
        .select("window", *keys, *aggregates)
    )


def sliding_rate(stream: DataFrame, ts: str, length: str, every: str, seconds: float, keys: Sequence[str], amount: Column) -> DataFrame:
    """Sum and per-second rate over overlapping windows."""
    return (
        stream.groupBy(F.window(ts, length, every), *keys)
        .agg(F.sum(amount).alias("increase"))
        .select("window", *keys, "increase", (F.col("increase") / F.lit(seconds)).alias("rate"))
    )


def sessions(stream: DataFrame, ts: str, gap: str, keys: Sequence[str], aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates per key and stretch of activity without a pause longer than the gap."""
    return (
        stream.groupBy(F.session_window(ts, gap).alias("window"), *keys)
        .agg(*[c.alias(n) for n, c in aggregates.items()])
        .select("window", *keys, *aggregates)
    )


def flat_window(df: DataFrame) -> DataFrame:
    """The window as plain start and end times without zone."""
    rest = [c for c in df.columns if c != "window"]
    return df.select(
        F.col("window.start").cast("timestamp_ntz").alias("window_start"),
        F.col("window.end").cast("timestamp_ntz").alias("window_end"),
        *rest,
    )


def first_of_each(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows without repeats of the same key within the watermark."""
    return stream.dropDuplicatesWithinWatermark(list(keys))
