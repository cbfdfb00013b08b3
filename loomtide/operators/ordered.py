"""Order-dependent work that never puts a whole group into one task.

Building blocks:

* ``running_totals`` - prefix sums over (group, value) count tables. Groups with more than ``hot_rows`` rows are cut
  at approximate quantiles into slices; slices are summed independently and shifted by the totals of the slices
  before them. Rank tests and curves are small aggregations on top of it.
  A group gets more than ``SLICES`` slices only where they would hold more than ``HOT_ROWS`` rows otherwise: every row is
  looked up among its group's cut points, so their number must not grow with the rows.
* ``bracketed_quantiles`` - exact quantiles that move only the values near the wanted ranks.
* ``carry_forward`` - "last seen value" per key in time order. Keys with more than ``hot_rows`` rows are cut into
  time slices, and the last value of the slices before is carried in from a table that has one row per slice.

The cut points only decide where work runs; results are exact whatever they are. Hot groups are counted first, which
costs one pre-combined pass over the key columns. There are at most rows/hot_rows of them, with at most
about rows/hot_rows cut points in all; these tables are broadcast when the measured number says that they are small.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtide.functions.columns import join_on, present, row_draw
from loomtide.session import shared_folder

#: Parts of each pass of a search among cut points.
RADIX = 8
HOT_ROWS = 2_000_000
#: Slices of a group, however few rows make it hot, unless they would pass HOT_ROWS rows.
SLICES = 256
#: Cut points of a hot group at least, before they are thinned; a larger group gets as many as it needs.
FINE_CUTS = 2048
BROADCAST_CUTS = 2_000_000
#: Rank error of a quantile sketch is one in ACCURACY; brackets are ten times as far from the wanted rank.
ACCURACY = 10_000
MARGIN = 10 / ACCURACY


def _placed(df: DataFrame, edges: str, value: str, most: int, name: str, equal: bool = True) -> DataFrame:
    """Add the number of sorted cut points that are not above the value (``equal=False``: that are below it).

    ``most`` is the largest number of cut points. Each pass narrows the search to one in ``RADIX`` parts. These are plain
    comparisons that Spark compiles; a lambda over the array would be interpreted for each cut point it looks at.
    """
    found, step = df.withColumn(name, F.lit(0)), 1
    while step * RADIX <= most:
        step *= RADIX
    while step:
        passed = [
            f"if(get(`{edges}`, `{name}` + {i * step - 1}) {'<=' if equal else '<'} `{value}`, {step}, 0)" for i in range(1, RADIX)
        ]
        found = found.withColumn(name, F.expr(f"`{name}` + {' + '.join(passed)}"))
        step //= RADIX
    return found


def _quantile_cuts(column: str, parts: int, where: str | None = None) -> Column:
    """Approximate quantiles that divide a column into ``parts``.

    The fractions are written as one folded string: a thousand separate literals slow down every planning step.
    """
    fractions = ",".join(repr(i / parts) for i in range(1, parts))
    accuracy = max(10_000, 4 * parts)
    kept = f" FILTER (WHERE {where})" if where else ""
    return F.expr(f"percentile_approx(`{column}`, cast(split('{fractions}', ',') as array<double>), {accuracy}){kept}")


def running_totals(
    counts: DataFrame, groups: Sequence[str], value: str, sums: Sequence[str], heavy: Hot
) -> DataFrame:
    """Add ``cum_<s>`` (inclusive prefix sum), ``total_<s>`` (whole group) and ``next_value`` to a count table.

    ``counts`` holds one row per (groups, value). ``heavy`` is the result of ``hot_keys`` on the rows that were
    counted: those groups are cut into slices, the others fit into a task each.
    """
    groups = list(groups)
    if not heavy.slices:
        w = W.partitionBy(*(groups or [F.lit(0)])).orderBy(value)
        upto, whole = w.rowsBetween(W.unboundedPreceding, W.currentRow), w.rowsBetween(
            W.unboundedPreceding, W.unboundedFollowing
        )
        return counts.select(
            *counts.columns,
            *[F.sum(s).over(whole).alias(f"total_{s}") for s in sums],
            *[F.sum(s).over(upto).alias(f"cum_{s}") for s in sums],
            F.lead(value).over(w).alias("next_value"),
        )

    small = heavy.small
    base, keys = (counts, groups) if groups else (counts.withColumn("_all", F.lit(0)), ["_all"])
    # the filter is always true; it keeps the counted columns in this branch, whose shuffle is then reused
    kept = " + ".join(f"`{s}`" for s in sums) + " >= 0"
    cuts = (
        join_on(base, small(heavy.groups), keys)
        .groupBy(*keys)
        .agg(_quantile_cuts(value, heavy.cuts, kept).alias("_cuts"), F.first("_n").alias("_n"))
        .select(*keys, _thinned("_cuts", heavy).alias("_edges"))
    )
    # -1: the group is not hot. Both readers below start from this one shuffle, so that no row is looked up twice
    sliced = _placed(join_on(base, small(cuts), keys, "left"), "_edges", value, heavy.cuts, "_cuts_upto").select(
        *base.columns, F.when(F.col("_edges").isNull(), F.lit(-1)).otherwise(F.col("_cuts_upto")).alias("_slice")
    ).repartition(*keys, "_slice")
    across = W.partitionBy(*keys).orderBy("_slice")
    before = across.rowsBetween(W.unboundedPreceding, -1)
    every = across.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # one row per slice of a hot group; a test of the slice itself, or a branch without values, would be a shuffle of its own
    offsets = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.min(value).alias("_first"), F.max("_slice").alias("_hot"), *[F.sum(s).alias(f"_sum_{s}") for s in sums])
        .where("_hot >= 0 or _first is null")
        .select(
            *keys,
            "_slice",
            F.lead("_first").over(across).alias("_next_first"),
            *[F.sum(f"_sum_{s}").over(before).alias(f"_before_{s}") for s in sums],
            *[F.sum(f"_sum_{s}").over(every).alias(f"_whole_{s}") for s in sums],
        )
    )
    inside = W.partitionBy(*keys, "_slice").orderBy(value)
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    own = inside.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # the slices' totals are joined after the sort, which then moves narrow rows
    summed = sliced.select(
        "*",
        *[F.sum(s).over(own).alias(f"_own_{s}") for s in sums],
        *[F.sum(s).over(upto).alias(f"_upto_{s}") for s in sums],
        F.lead(value).over(inside).alias("_next_inside"),
    )
    return join_on(summed, small(offsets), [*keys, "_slice"], "left").select(
        *counts.columns,
        *[F.coalesce(f"_whole_{s}", f"_own_{s}").alias(f"total_{s}") for s in sums],
        *[(F.col(f"_upto_{s}") + F.coalesce(F.col(f"_before_{s}"), F.lit(0))).alias(f"cum_{s}") for s in sums],
        F.coalesce("_next_inside", "_next_first").alias("next_value"),
    )


def _thinned(cuts: str, heavy: Hot) -> Column:
    """Every n-th cut point only, so that slices hold about ``_slice_rows`` rows (needs the row count as ``_n``)."""
    every = F.greatest(F.lit(1), F.floor(F.lit(heavy.cuts) * _slice_rows(heavy.hot_rows) / F.col("_n"))).cast("int")
    return F.filter(cuts, lambda e, i: (i + 1) % every == 0)


def value_counts(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Rows per (groups, value), missing values left out; combined before the shuffle."""
    col = F.col(value)
    kept = df.where(col.isNotNull())
    if dict(df.dtypes)[value] in ("double", "float"):
        kept = kept.where(~F.isnan(col))
    return kept.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))


def bracketed_quantiles(
    df: DataFrame, groups: Sequence[str], columns: Sequence[str], probabilities: dict[str, float], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Exact linear-interpolated quantiles of several number columns: one row per group and column.

    A sketch of each column gives, for each probability, two values that enclose the quantile: about one row in 500
    lies between them. Exact counts of the rows below each bracket, and of the values inside it, then give the value at
    the wanted rank. Nothing but the values inside brackets is shuffled or sorted. Missing values are left out; a group
    of up to ``2 / MARGIN`` values is a bracket of its own. The first two passes are run at once, for their results are
    tables with one row per group.
    """
    groups, wanted = list(groups), list(probabilities.values())
    spark = df.sparkSession
    values = df.select(*groups, *[present(df, c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    cuts = [f for p in wanted for f in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))]
    # long lists of expressions are written as SQL, which costs one call where each piece of a column costs several
    fractions = ",".join(map(repr, cuts))
    facts_of, slots_of = [], []
    for i, c in enumerate(columns):
        facts_of += [
            F.expr(f"percentile_approx(_x{i}, cast(split('{fractions}', ',') as array<double>), {ACCURACY}) as _q{i}"),
            F.expr(f"count(_x{i}) as _n{i}"), F.expr(f"min(_x{i}) as _min{i}"), F.expr(f"max(_x{i}) as _max{i}"),
        ]
        few = f"_n{i} <= {2 / MARGIN}"
        for k, p in enumerate(wanted):
            low = f"_min{i}" if p <= MARGIN else f"if({few}, _min{i}, _q{i}[{2 * k}])"
            high = f"_max{i}" if p >= 1 - MARGIN else f"if({few}, _max{i}, _q{i}[{2 * k + 1}])"
            slots_of.append(f"named_struct('column', {i}, 'n', _n{i}, 'low', {low}, 'high', {high})")
    slots = range(len(slots_of))
    of = [f"_x{j // len(wanted)}" for j in slots]
    sketched = values.groupBy(*groups).agg(*facts_of).select(*groups, F.expr(f"array({', '.join(slots_of)}) as _slots"))
    path = shared_folder(spark, "quantiles")

    def table(df: DataFrame, name: str) -> DataFrame:
        """Written and read back; without groups it is one row, which the driver may hold."""
        if not groups:
            return spark.createDataFrame(df.collect(), df.schema)
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    brackets = table(sketched, "brackets")
    if groups:
        edges = [F.expr(f"_slots[{j}].{side} as _{side}{j}") for j in slots for side in ("low", "high")]
        values = join_on(values, brackets.select(*groups, *edges), groups)
        low, high = ([f"_{side}{j}" for j in slots] for side in ("low", "high"))
    else:
        row = brackets.first()["_slots"]
        number = lambda v: "cast(null as double)" if v is None else f"cast('{v!r}' as double)"
        low, high = ([number(slot[side]) for slot in row] for side in ("low", "high"))
    inside = [f"{x} >= {low[j]} and {x} <= {high[j]}" for j, x in enumerate(of)]
    below = table(values.groupBy(*groups).agg(
        F.expr("array(" + ", ".join(f"count_if({x} < {low[j]})" for j, x in enumerate(of)) + ") as _below"),
        F.expr("array_max(array(" + ", ".join(f"count_if({c})" for c in inside) + ")) as _most"),
    ), "below")
    entries = F.expr("array_compact(array(" + ", ".join(
        f"case when {c} then named_struct('_slot', {j}, 'value', {x}) end" for j, (c, x) in enumerate(zip(inside, of))
    ) + "))")
    keys = [*groups, "_slot"]
    held = values.select(*groups, F.inline(entries))
    counts = held.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    many = (below.agg(F.max("_most")).first()[0] or 0) > hot_rows
    heavy = hot_keys(held, keys, hot_rows) if many else Hot(counts, 0, hot_rows)
    ordered = running_totals(counts, keys, "value", ["n"], heavy)
    name_of = F.get(F.array(*[F.lit(c) for c in columns]), F.col("_facts.column"))
    facts = join_on(brackets, below if groups else F.broadcast(below), groups).select(
        *groups, F.posexplode("_slots").alias("_slot", "_facts"), "_below"
    ).select(*keys, name_of.alias("column_name"), F.col("_facts.n").alias("_all"), F.get("_below", F.col("_slot")).alias("_under"))
    placed = join_on(facts, ordered, keys, "left")
    share = F.element_at(F.array(*[F.lit(p) for p in wanted]), F.col("_slot") % len(wanted) + 1)
    position = (F.col("_all") - 1) * share
    start, end = F.col("cum_n") - F.col("n") + F.col("_under"), F.col("cum_n") + F.col("_under")
    at = lambda rank: F.max(F.when((start <= rank) & (rank < end), F.col("value")))
    lo, hi = at(F.floor(position)), at(F.ceil(position))
    found = placed.groupBy(*groups, "column_name", "_slot").agg((lo + F.max(position - F.floor(position)) * (hi - lo)).alias("_q"))
    return found.groupBy(*groups, "column_name").agg(
        *[F.max(F.when(F.col("_slot") % len(wanted) == k, F.col("_q"))).alias(name) for k, name in enumerate(probabilities)]
    )


def exact_quantiles(
    df: DataFrame, groups: Sequence[str], value: str, probabilities: dict[str, float], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Exact quantiles of ``value`` per group that has one (see ``bracketed_quantiles``); one row without groups."""
    found = bracketed_quantiles(df, groups, [value], probabilities, hot_rows).drop("column_name")
    return found.where(F.col(next(iter(probabilities))).isNotNull()) if groups else found


@dataclass(frozen=True)
class Hot:
    """Groups with more than ``hot_rows`` rows, with their row count as ``_n``, how many slices they give, and how many
    cut points the largest needs."""

    groups: DataFrame
    slices: int
    hot_rows: int
    cuts: int = FINE_CUTS

    def small(self, side: DataFrame) -> DataFrame:
        """Broadcast a table that has a row or a cut point per slice, if the measured number of slices allows it."""
        return F.broadcast(side) if self.slices <= BROADCAST_CUTS else side


def _slice_rows(hot_rows: int) -> Column:
    """Rows in a slice of a hot group of ``_n`` rows."""
    return F.greatest(F.lit(hot_rows), F.least(F.lit(HOT_ROWS), F.col("_n") / F.lit(SLICES)))


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> Hot:
    """Find the hot groups, in one pass over the key columns that is combined before its shuffle.

    Without keys the whole table is one group, named by a constant ``_all``.
    """
    if not keys:
        total = df.count()
        one = df.sparkSession.createDataFrame([(0, total)], "_all int, _n long")
        parts = math.ceil(total / max(hot_rows, min(HOT_ROWS, total / SLICES)))
        return Hot(one, parts if total > hot_rows else 0, hot_rows, max(FINE_CUTS, parts))
    heavy = (
        df.select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    )
    parts = F.ceil(F.col("_n") / _slice_rows(hot_rows))
    slices, most = heavy.agg(F.coalesce(F.sum(parts), F.lit(0)), F.coalesce(F.max(parts), F.lit(0))).first()
    return Hot(heavy, int(slices), hot_rows, max(FINE_CUTS, int(most)))


def per_column(heavy: Hot, columns: Sequence[str]) -> Hot:
    """Hot groups of a table melted into (column_name, value): every hot group of the table, once per column."""
    names = F.explode(F.array(*[F.lit(c) for c in columns])).alias("column_name")
    return Hot(heavy.groups.drop("_all").select("*", names), heavy.slices * len(columns), heavy.hot_rows, heavy.cuts)


def column_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: dict[str, float], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Exact quantiles of several number columns, one row per column."""
    return bracketed_quantiles(df, [], columns, probabilities, hot_rows)


def hot_key_cuts(df: DataFrame, heavy: Hot, keys: Sequence[str], order: str) -> DataFrame:
    """Time cut points of the hot keys, about ``_slice_rows`` rows apart.

    There are at most rows/hot_rows hot keys and about as many cut points in all. Cut points repeat where one
    instant holds many rows.
    """
    cuts = (
        join_on(df.select(*keys, order), heavy.small(heavy.groups), keys)
        .groupBy(*keys)
        .agg(_quantile_cuts(order, heavy.cuts).alias("_cuts"), F.first("_n").alias("_n"))
    )
    return cuts.select(*keys, _thinned("_cuts", heavy).alias("_edges"))


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: dict[str, Column],
    *,
    tie_breaks: Sequence[str] = (),
    include_current: bool = True,
    spread: Column | None = None,
    hot_rows: int | None = HOT_ROWS,
    heavy: Hot | None = None,
) -> DataFrame:
    """Add, for each named expression, its last non-null value at or before the row (per key, in time order).

    ``include_current=False`` looks strictly at earlier rows. Rows for which ``spread`` is true only read values;
    those of one instant may therefore be divided over several slices. A null key is a key. ``hot_rows=None`` skips the search for hot keys where the caller knows that there are none;
    ``heavy`` hands over the result of an earlier ``hot_keys``.
    """
    keys = list(keys)
    columns = df.columns
    by_time = [F.col(order), *[F.col(t) for t in tie_breaks]]
    last_row = W.currentRow if include_current else -1
    if heavy is None and hot_rows:
        heavy = hot_keys(df, keys, hot_rows)
    if heavy is None or not heavy.slices:
        frame = W.partitionBy(*keys).orderBy(*by_time).rowsBetween(W.unboundedPreceding, last_row)
        return df.select(*columns, *[F.last(v, ignorenulls=True).over(frame).alias(n) for n, v in values.items()])

    small = heavy.small
    cuts = hot_key_cuts(df, heavy, keys, order)
    placed = _placed(join_on(df, small(cuts), keys, "left"), "_edges", order, heavy.cuts, "_cuts_upto")
    hot_slice = F.col("_cuts_upto")
    if spread is not None:
        placed = _placed(placed, "_edges", order, heavy.cuts, "_cuts_below", equal=False)
        same = F.col("_cuts_upto") - F.col("_cuts_below")
        draw = F.pmod(row_draw(df), F.greatest(same, F.lit(1))).cast("int")
        hot_slice = F.col("_cuts_upto") - F.when(spread, draw).otherwise(F.greatest(same - 1, F.lit(0)))
    sliced = placed.select(
        *columns,
        F.col("_edges").isNotNull().alias("_hot"),
        F.when(F.col("_edges").isNull(), F.lit(0)).otherwise(hot_slice).alias("_slice"),
        *[v.alias(f"_v_{n}") for n, v in values.items()],
    )
    stamp = F.struct(*by_time)
    across = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        sliced.where("_hot")
        .groupBy(*keys, "_slice")
        .agg(*[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), stamp)).alias(f"_l_{n}") for n in values])
        .select(*keys, "_slice", *[F.last(f"_l_{n}", ignorenulls=True).over(across).alias(f"_c_{n}") for n in values])
    )
    frame = W.partitionBy(*keys, "_slice").orderBy(*by_time).rowsBetween(W.unboundedPreceding, last_row)
    return join_on(sliced, small(carried), [*keys, "_slice"], "left").select(
        *columns,
        *[F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(frame), F.col(f"_c_{n}")).alias(n) for n in values],
    )
