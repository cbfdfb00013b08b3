"""Feature views: point-in-time training sets, latest-value snapshots, lookups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtide.functions.columns import row_draw
from loomtide.operators.ordered import HOT_ROWS, carry_forward


@dataclass(frozen=True)
class FeatureView:
    """Time-stamped feature rows of one entity.

    ``tie_break`` orders rows that share key and timestamp (all feature values when empty).
    ``unique`` says that (keys, timestamp) never repeats, which saves a shuffle.
    """

    name: str
    keys: tuple[str, ...]
    ttl: timedelta | None
    features: tuple[str, ...]
    source: DataFrame = field(repr=False)
    timestamp: str = "event_timestamp"
    tie_break: tuple[str, ...] = ()
    unique: bool = False
    tags: tuple[tuple[str, str], ...] = ()

    def rows(self) -> DataFrame:
        """The view's rows, one per (keys, timestamp)."""
        columns = [*self.keys, self.timestamp, *self.features]
        keyed = self.source.dropna(subset=[*self.keys, self.timestamp])
        if self.unique:
            return keyed.select(*columns)
        best = F.max_by(F.struct(*self.features), F.struct(*(self.tie_break or self.features)))
        return (
            keyed.groupBy(*self.keys, self.timestamp).agg(best.alias("_best"))
            .select(*self.keys, self.timestamp, "_best.*")
        )


def point_in_time_join(
    entities: DataFrame,
    views: Sequence[FeatureView],
    entity_timestamp: str = "event_timestamp",
    prefix: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """For every entity row, the newest feature row of each view at or before its time and within the view's ttl.

    Entity rows are kept as they are, unmatched features are null. All views with the same keys are matched in one
    shuffle and one sort; ``prefix`` names columns ``view__feature``.
    """
    out = entities
    by_keys: dict[tuple[str, ...], list[FeatureView]] = {}
    for view in views:
        by_keys.setdefault(view.keys, []).append(view)
    for keys, group in by_keys.items():
        out = _match(out, keys, group, entity_timestamp, prefix, hot_rows)
    return out


def _match(
    entities: DataFrame,
    keys: tuple[str, ...],
    views: Sequence[FeatureView],
    entity_timestamp: str,
    prefix: bool,
    hot_rows: int,
) -> DataFrame:
    carried = [c for c in entities.columns if c not in keys]
    at = F.col(entity_timestamp)
    # rows with a null key match nothing; a key of their own keeps them from meeting in one task
    no_key = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    lone = F.when(no_key, row_draw(entities)).otherwise(F.lit(0).cast("long"))
    stacked = entities.select(
        *keys, lone.alias("_lone"), at.alias("_at"), F.lit(1).alias("_side"), F.struct(*carried).alias("_row")
    )
    slots = [f"_view{i}" for i in range(len(views))]
    for slot, view in zip(slots, views):
        features = view.rows().select(
            *keys,
            F.lit(0).cast("long").alias("_lone"),
            F.col(view.timestamp).alias("_at"),
            F.lit(0).alias("_side"),
            F.struct(F.col(view.timestamp).alias("_since"), *view.features).alias(slot),
        )
        stacked = stacked.unionByName(features, allowMissingColumns=True)
    seen = carry_forward(
        stacked,
        [*keys, "_lone"],
        "_at",
        {f"_last{slot}": F.col(slot) for slot in slots},
        tie_breaks=["_side"],
        spread=F.col("_side") == 1,
        hot_rows=hot_rows,
    ).where(F.col("_side") == 1)
    columns: list[Column] = [
        F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in entities.columns
    ]
    for slot, view in zip(slots, views):
        last = F.col(f"_last{slot}")
        fresh = F.lit(True)
        if view.ttl is not None:
            seconds = int(view.ttl.total_seconds())
            fresh = last["_since"] + F.expr(f"INTERVAL '{seconds}' SECOND") >= F.col("_at")
        for name in view.features:
            columns.append(F.when(fresh, last[name]).alias(f"{view.name}__{name}" if prefix else name))
    return seen.select(*columns)


def latest_per_key(
    rows: DataFrame, keys: Sequence[str], timestamp: str, features: Sequence[str], tie_break: Sequence[str] = ()
) -> DataFrame:
    """The newest row per key, combined before the shuffle so that a hot key costs one row per task."""
    order = F.struct(timestamp, *(tie_break or features))
    return (
        rows.dropna(subset=[*keys, timestamp])
        .groupBy(*keys)
        .agg(F.max_by(F.struct(timestamp, *features), order).alias("_best"))
        .select(*keys, "_best.*")
    )


def materialize(view: FeatureView, start: Column, end: Column) -> DataFrame:
    """Snapshot for online lookup: the latest row per entity with start <= timestamp < end."""
    ts = F.col(view.timestamp)
    return latest_per_key(
        view.source.where((ts >= start) & (ts < end)), view.keys, view.timestamp, view.features, view.tie_break
    )


def materialize_incremental(view: FeatureView, snapshot: DataFrame, since: Column, end: Column) -> DataFrame:
    """Merge the rows of [since, end) into an older snapshot; a newer timestamp always wins.

    At equal times the row of the new interval does: within it the view's tie break has already decided.
    """
    delta = materialize(view, since, end)
    both = snapshot.select(*delta.columns, F.lit(0).alias("_round")).unionByName(delta.withColumn("_round", F.lit(1)))
    return latest_per_key(both, view.keys, view.timestamp, view.features, ("_round",))


def online_lookup(entity_rows: DataFrame, snapshot: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Latest features for the asked entities; entities without features get nulls."""
    return entity_rows.join(snapshot.select(*keys, *features), list(keys), "left")


def check_push(rows: DataFrame, view: FeatureView) -> DataFrame:
    """Rows to append to a view, in the view's column order; raises when a column is absent or has another type."""
    schema: T.StructType = view.source.schema
    wanted = [*view.keys, view.timestamp, *view.features]
    have = dict(rows.dtypes)
    wrong = [c for c in wanted if have.get(c) != schema[c].dataType.simpleString()]
    if wrong:
        raise ValueError(f"columns missing or of another type for view {view.name}: {wrong}")
    return rows.select(*wanted)


def append_to_view(rows: DataFrame, view: FeatureView, path: str, push_id: str | None = None) -> None:
    """Add pushed rows to the view's offline table, partitioned by event date.

    With ``push_id`` the rows go to partitions of that push, which a repeated push overwrites instead of doubling.
    """
    dated = check_push(rows, view).withColumn("event_date", F.to_date(F.col(view.timestamp)))
    if push_id is None:
        dated.write.mode("append").partitionBy("event_date").parquet(path)
        return
    (
        dated.withColumn("push_id", F.lit(push_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("push_id", "event_date").parquet(path)
    )


def transaction_stats(purchases: DataFrame, key: str, ts: str, amount: str) -> DataFrame:
    """Per entity and day: mean, sample deviation and number of amounts, and days since the day before with any.

    The feature timestamp is the end of the day, when the day's values are known.
    """
    day = F.date_trunc("day", F.col(ts))
    daily = purchases.groupBy(F.col(key), day.alias("_day")).agg(
        F.avg(amount).alias("amount_mean"),
        F.stddev_samp(amount).alias("amount_std"),
        F.count(F.lit(1)).alias("transaction_count"),
    )
    gaps = carry_forward(daily, [key], "_day", {"_before": F.col("_day")}, include_current=False)
    return gaps.select(
        key,
        (F.col("_day") + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz").alias("event_timestamp"),
        "amount_mean",
        "amount_std",
        "transaction_count",
        F.datediff(F.col("_day"), F.col("_before")).cast("double").alias("days_since_last"),
    )


def user_profile(customers: DataFrame, orders: DataFrame, as_of: Column) -> DataFrame:
    """Profile features per customer as known at ``as_of``; our definition of the declared columns.

    age_group: account balance band; account_tenure_days: days since the first order; has_premium: total spend above
    one million; engagement_score: orders per 30 days of tenure.
    """
    activity = (
        orders.where(F.col("o_orderdate") < as_of)
        .groupBy("o_custkey")
        .agg(
            F.min("o_orderdate").alias("_first"),
            F.count(F.lit(1)).alias("_orders"),
            F.sum("o_totalprice").alias("_spend"),
        )
    )
    tenure = F.datediff(as_of, F.col("_first"))
    balance = F.col("c_acctbal")
    return customers.join(activity, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").alias("user_id"),
        as_of.alias("event_timestamp"),
        F.when(balance < 0, "negative").when(balance < 3000, "low").when(balance < 7000, "middle").otherwise("high")
        .alias("age_group"),
        F.coalesce(tenure, F.lit(0)).cast("long").alias("account_tenure_days"),
        F.when(F.col("_spend") > 1_000_000, 1).otherwise(0).cast("long").alias("has_premium"),
        F.coalesce(F.try_divide(F.col("_orders") * F.lit(30.0), tenure.cast("double")), F.lit(0.0))
        .alias("engagement_score"),
    )


def hourly_features(events: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Per entity and hour: count, mean, min, max and sample deviation of a value as feature_1 to feature_5."""
    return (
        events.groupBy(F.col(key), F.date_trunc("hour", F.col(ts)).alias("_hour"))
        .agg(
            F.count(F.lit(1)).cast("double").alias("feature_1"),
            F.avg(value).alias("feature_2"),
            F.min(value).alias("feature_3"),
            F.max(value).alias("feature_4"),
            F.stddev_samp(value).alias("feature_5"),
        )
        .select(
            key,
            (F.col("_hour") + F.expr("INTERVAL 1 HOUR")).cast("timestamp_ntz").alias("event_timestamp"),
            *[f"feature_{i}" for i in range(1, 6)],
        )
    )
