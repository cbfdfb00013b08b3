"""Metric time series: counter increases, quantiles of histograms, instant and range evaluation on a time grid.

Evaluation times are multiples of a step. Samples are reduced to one row per (series, step), so a busy series costs no
more than a quiet one after the first aggregation. A step's samples enter the window at one evaluation and leave it at
another: running sums over these two changes give stretches of evaluations with one value, whatever the range is in
steps, and only the result has a row per evaluation. Windows are left-open and right-closed: an evaluation at t sees
(t - range, t].
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtide.functions.columns import ratio
from loomtide.operators.feature_store import latest_per_key
from loomtide.operators.ordered import carry_forward

MICROS = 1_000_000


def series_key(labels: Column) -> Column:
    """A map of labels as text in name order; maps themselves cannot be grouped."""
    return F.array_join(
        F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","
    )


def matches(labels: Column, matcher: dict[str, str]) -> Column:
    """Label selector: plain values must be equal, values starting with ``~`` are anchored patterns."""
    ok = F.lit(True)
    for name, wanted in matcher.items():
        value = F.coalesce(labels[name], F.lit(""))
        ok = ok & (value.rlike(f"^(?:{wanted[1:]})$") if wanted.startswith("~") else value == wanted)
    return ok


def threshold(value: Column, op: str, limit: float) -> Column:
    compare = {"==": value == limit, ">": value > limit, "<": value < limit}
    if op not in compare:
        raise ValueError(f"unknown comparison {op}")
    return compare[op]


def grid_index(ts: Column, step: int) -> Column:
    """Index of the first evaluation time at or after a timestamp."""
    return F.ceil(F.unix_micros(ts.cast("timestamp")) / F.lit(step * MICROS)).cast("long")


def grid_time(index: Column, step: int) -> Column:
    return F.timestamp_seconds(index * step).cast("timestamp_ntz")


def _spans(range_seconds: int, step: int) -> int:
    if range_seconds % step:
        raise ValueError("the range must be a multiple of the step")
    return range_seconds // step


def window_sums(per_step: DataFrame, keys: Sequence[str], at: str, spans: int, sums: Sequence[str]) -> DataFrame:
    """Sums over a sliding window of ``spans`` steps as stretches of evaluations: keys, ``_from``, ``_to``, the sums, ``_n``.

    A sum is a difference of running sums: what has entered less what has left. Where all that is left in the window is
    zero it is exactly zero. ``_n`` counts rows in the window; stretches without any are left out. The rows of one key
    are at most twice its steps.
    """
    signed = lambda sign: F.struct(
        (F.col(at) + (0 if sign > 0 else spans)).alias("_from"), F.lit(sign).cast("long").alias("_n"),
        *[(F.col(c).cast("double") * sign).alias(c) for c in sums],
        *[F.when(F.col(c) != 0, sign).otherwise(0).cast("long").alias(f"_some_{c}") for c in sums],
    )
    names = ["_n", *sums, *[f"_some_{c}" for c in sums]]
    changes = per_step.select(*keys, F.inline(F.array(signed(1), signed(-1)))).groupBy(*keys, "_from").agg(
        *[F.sum(c).alias(c) for c in names]
    )
    order = W.partitionBy(*keys).orderBy("_from")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    running = changes.select(
        *keys, "_from", (F.lead("_from").over(order) - 1).alias("_to"), *[F.sum(c).over(upto).alias(c) for c in names]
    )
    return running.where("_n > 0").select(
        *keys, "_from", "_to", *[F.when(F.col(f"_some_{c}") > 0, F.col(c)).otherwise(0.0).alias(c) for c in sums], "_n"
    )


def at_evaluations(stretches: DataFrame, keys: Sequence[str], step: int, values: dict[str, Column]) -> DataFrame:
    """One row per evaluation of each stretch: keys, ``eval_ts`` and the values, computed once per stretch."""
    return stretches.select(
        *keys, *[v.alias(n) for n, v in values.items()], F.explode(F.sequence("_from", "_to")).alias("_eval")
    ).select(*keys, grid_time(F.col("_eval"), step).alias("eval_ts"), *values)


def counter_deltas(samples: DataFrame, keys: Sequence[str], ts: str, value: str, tie_breaks: Sequence[str] = ()) -> DataFrame:
    """Add ``delta``: growth since the sample before; after a reset the new value; 0 for a first sample."""
    out = carry_forward(samples, keys, ts, {"_before": F.col(value)}, tie_breaks=tie_breaks, include_current=False)
    now, before = F.col(value), F.col("_before")
    delta = F.when(before.isNull(), F.lit(0.0)).when(now >= before, now - before).otherwise(now)
    return out.withColumn("delta", delta.cast("double")).drop("_before")


def increase(
    deltas: DataFrame, keys: Sequence[str], ts: str, range_seconds: int, step: int, amount: str = "delta"
) -> DataFrame:
    """Increase and per-second rate over a sliding range, at every evaluation time whose window has a sample.

    A delta belongs to its later sample; there is no extrapolation to the window edges.
    """
    spans = _spans(range_seconds, step)
    per_step = deltas.groupBy(*keys, grid_index(F.col(ts), step).alias("_at")).agg(F.sum(amount).alias("_delta"))
    total = F.col("_delta")
    return at_evaluations(
        window_sums(per_step, keys, "_at", spans, ["_delta"]), keys, step,
        {"increase": total, "rate": total / F.lit(float(range_seconds))},
    )


def rate_ratio(deltas: DataFrame, by: Sequence[str], ts: str, part: Column, range_seconds: int, step: int) -> DataFrame:
    """Rate of the selected part over the rate of all, in one pass; null where nothing increased."""
    marked = deltas.withColumn("_part", F.when(part, F.col("delta")).otherwise(F.lit(0.0)))
    spans = _spans(range_seconds, step)
    per_step = marked.groupBy(*by, grid_index(F.col(ts), step).alias("_at")).agg(
        F.sum("_part").alias("_part"), F.sum("delta").alias("_all")
    )
    return at_evaluations(
        window_sums(per_step, by, "_at", spans, ["_part", "_all"]), by, step, {"ratio": ratio(F.col("_part"), F.col("_all"))}
    )


def resample(samples: DataFrame, keys: Sequence[str], ts: str, value: str, step: int, lookback: int = 300) -> DataFrame:
    """Instant value at every evaluation time: the last sample within the look-back."""
    spans = _spans(lookback, step)
    # both aggregates keep plain numbers, so they are combined in a hash map and not by sorting
    per_step = samples.groupBy(*keys, grid_index(F.col(ts), step).alias("_from")).agg(
        F.max(ts).alias("_t"), F.max_by(value, ts).alias("_v")
    )
    after = F.lead("_from").over(W.partitionBy(*keys).orderBy("_from"))
    until = F.least(after - 1, F.col("_from") + (spans - 1))
    return at_evaluations(per_step.select(*keys, "_from", until.alias("_to"), "_v"), keys, step, {"value": F.col("_v")})


def over_time(
    grid: DataFrame, keys: Sequence[str], value: str, range_seconds: int, step: int, how: str = "avg"
) -> DataFrame:
    """Aggregate instant values over a sliding range of the grid (subquery range functions); null values count for nothing.

    Sums and means are differences of running sums. The least and the largest value are looked up in the window at the
    evaluations where something enters or leaves it.
    """
    if how not in ("avg", "sum", "min", "max"):
        raise ValueError(f"unknown aggregate {how}")
    spans = _spans(range_seconds, step)
    indexed = grid.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).alias("_value"), grid_index(F.col("eval_ts"), step).alias("_at")
    )
    if how in ("avg", "sum"):
        total = F.col("_value")
        return at_evaluations(
            window_sums(indexed, keys, "_at", spans, ["_value"]), keys, step,
            {"value": total / F.col("_n") if how == "avg" else total},
        )
    fn = {"min": F.min, "max": F.max}[how]
    changes = indexed.select(*keys, F.inline(F.array(
        F.struct(F.col("_at").alias("_from"), F.col("_value").alias("_value")),
        F.struct((F.col("_at") + spans).alias("_from"), F.lit(None).cast("double").alias("_value")),
    ))).groupBy(*keys, "_from").agg(fn("_value").alias("_value"))
    order = W.partitionBy(*keys).orderBy("_from")
    found = changes.select(
        *keys, "_from", (F.lead("_from").over(order) - 1).alias("_to"),
        fn("_value").over(order.rangeBetween(-(spans - 1), 0)).alias("_best"),
    )
    return at_evaluations(found.where("_best is not null and _to is not null"), keys, step, {"value": F.col("_best")})


def instant_vector(
    samples: DataFrame, keys: Sequence[str], ts: str, value: str, at: Column, lookback: int = 300
) -> DataFrame:
    """Last sample per series at one time, not older than the look-back; the time filter reaches the scan."""
    window = (F.col(ts) <= at) & (F.col(ts) > at - F.expr(f"INTERVAL {lookback} SECOND"))
    return latest_per_key(samples.where(window), keys, ts, [value])


def absent_series(known: DataFrame, seen: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Known series that did not grow: increase zero or no sample at all."""
    return known.join(seen.where(F.col(value) > 0), list(keys), "left_anti")


def histogram_buckets(samples: DataFrame, keys: Sequence[str], value: str, edges: Sequence[float]) -> DataFrame:
    """Cumulative bucket counts, one row per edge and a last one for everything (infinite edge)."""
    ends = [*edges, float("inf")]
    counts = [
        F.struct(F.lit(float(e)).alias("le"), F.count_if(F.col(value) <= F.lit(float(e))).alias("n")) for e in ends
    ]
    return samples.groupBy(*keys).agg(F.array(*counts).alias("_b")).select(*keys, F.inline("_b"))


def histogram_quantile(buckets: DataFrame, keys: Sequence[str], quantiles: dict[str, float]) -> DataFrame:
    """Quantiles from cumulative buckets by linear interpolation inside the bucket.

    In the infinite bucket the last finite edge is returned; empty histograms give null. Windows run over the few
    edges of one histogram.
    """
    w = W.partitionBy(*keys).orderBy("le")
    whole = W.partitionBy(*keys)
    lined = buckets.select(
        *keys, "le", "n",
        F.coalesce(F.lag("n").over(w), F.lit(0)).alias("_n0"),
        F.lag("le").over(w).alias("_lag"),
        F.max("n").over(whole).alias("_total"),
    )
    low = F.coalesce(F.col("_lag"), F.when(F.col("le") > 0, F.lit(0.0)).otherwise(F.col("le")))
    infinite = F.col("le") == F.lit(float("inf"))
    out = []
    for name, q in quantiles.items():
        rank = F.lit(q) * F.col("_total")
        inside = low + (F.col("le") - low) * ratio(rank - F.col("_n0"), F.col("n") - F.col("_n0"), 0.0)
        value = F.when(infinite, F.col("_lag")).otherwise(inside)
        out.append(F.min_by(value, F.when((F.col("n") >= rank) & (F.col("_total") > 0), F.col("le"))).alias(name))
    return lined.groupBy(*keys).agg(*out)


def bucket_deltas(samples: DataFrame, keys: Sequence[str], ts: str, counts: str, tie_breaks: Sequence[str] = ()) -> DataFrame:
    """Add ``delta`` to samples of histogram counters: growth of the whole array of cumulative counts (one per edge, the
    last for everything) since the sample before; zeros for a first sample.

    All edges are reset together: if any count fell, the new array is the growth, so that no bucket of a restarted
    process is mixed with one of its predecessor.
    """
    out = carry_forward(samples, keys, ts, {"_before": F.col(counts)}, tie_breaks=tie_breaks, include_current=False)
    now, before = F.col(counts), F.col("_before")
    growth = F.zip_with(now, before, lambda a, b: (a - b).cast("double"))
    plain = F.transform(now, lambda a: a.cast("double"))
    fell = F.exists(growth, lambda g: g < 0)
    delta = F.when(before.isNull(), F.transform(now, lambda a: F.lit(0.0))).when(fell, plain).otherwise(growth)
    return out.withColumn("delta", delta).drop("_before")


def bucket_increase(
    deltas: DataFrame, keys: Sequence[str], ts: str, edges: Sequence[float], range_seconds: int, step: int
) -> DataFrame:
    """Increase of every bucket over a sliding range: keys, ``eval_ts``, ``le`` and ``n``; the last edge is infinite."""
    names = [f"_b{i}" for i in range(len(edges) + 1)]
    per_step = deltas.groupBy(*keys, grid_index(F.col(ts), step).alias("_at")).agg(
        *[F.sum(F.get("delta", F.lit(i))).alias(n) for i, n in enumerate(names)]
    )
    ends = [*edges, float("inf")]
    buckets = F.array(*[F.struct(F.lit(float(e)).alias("le"), F.col(n).alias("n")) for e, n in zip(ends, names)])
    stretches = window_sums(per_step, keys, "_at", _spans(range_seconds, step), names)
    rows = at_evaluations(stretches, keys, step, {"_buckets": buckets})
    return rows.select(*keys, "eval_ts", F.inline("_buckets"))


# fixed values: unit prices of a core and of a GiB for an hour
CPU_PRICE, MEMORY_PRICE = 0.0416, 0.00405


def unit_cost(cpu_cores: Column, memory_bytes: Column) -> Column:
    """Hourly cost of requested cores and memory (fixed unit prices per core and per GiB)."""
    return cpu_cores * CPU_PRICE + memory_bytes / F.lit(float(2**30)) * MEMORY_PRICE


def top_k(df: DataFrame, value: str, k: int, ties: Sequence[str]) -> DataFrame:
    """The k rows with the largest value, ties in label order; merged from per-task tops."""
    return df.orderBy(F.col(value).desc(), *ties).limit(k)
