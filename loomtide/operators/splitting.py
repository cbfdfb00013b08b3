"""Exact, repeatable splits: rows are ranked by a hash of seed and key, and only the cut points are searched for.

Counting rows per hash prefix finds the prefix in which a cut falls; ranking the rows of that prefix alone finds the
exact hash at the cut. The search runs when a split is asked for, not each time its rows are read. The split itself is then
a comparison per row, with no shuffle of the data. Keys must be unique, or rows of one key move together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtide.functions.columns import join_on
from loomtide.session import shared_folder

PREFIX_DIGITS = 4


def row_hash(key: str | Sequence[str], seed: int) -> Column:
    """Order of the rows: md5 over seed and key, the same on any partitioning and in plain SQL."""
    names = [key] if isinstance(key, str) else list(key)
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(n).cast("string") for n in names]))


def _cut_hashes(hashed: DataFrame, groups: Sequence[str], ranks: Callable[[Column], list[Column]]) -> DataFrame:
    """Per group the hash at each wanted rank, in order; a rank of 0 gives the empty text, which is below every hash."""
    keys = list(groups)
    prefix = F.substring("_hash", 1, PREFIX_DIGITS)
    counts = hashed.groupBy(*keys, prefix.alias("_prefix")).agg(F.count(F.lit(1)).alias("_n"))
    # at most 16^4 rows per group
    across = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_prefix")
    upto = across.rowsBetween(W.unboundedPreceding, W.currentRow)
    every = across.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    placed = counts.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_total", F.sum("_n").over(every))
    wanted = F.array(*[F.struct(F.lit(i).alias("cut"), r.cast("long").alias("rank")) for i, r in enumerate(ranks(F.col("_total")))])
    # a rank of 0 is looked up in the first prefix: one table of prefixes, so that the rows are counted once
    slices = (
        placed.select(*keys, "_prefix", (F.col("_upto") - F.col("_n")).alias("_before"), "_upto", F.inline(wanted))
        .where((F.greatest("rank", F.lit(1)) > F.col("_before")) & (F.greatest("rank", F.lit(1)) <= F.col("_upto")))
        .select(*keys, "_prefix", "cut", (F.col("rank") - F.col("_before")).alias("_need"))
    )
    # without groups there is a row per cut; Spark would shuffle all hashes before it knew that
    ranked = join_on(hashed.select(*keys, "_hash", prefix.alias("_prefix")), slices if keys else F.broadcast(slices), [*keys, "_prefix"]).withColumn(
        "_rank", F.row_number().over(W.partitionBy(*keys, "_prefix", "cut").orderBy("_hash"))
    )
    found = ranked.where("_rank = greatest(_need, 1)").select(*keys, F.when(F.col("_need") > 0, F.col("_hash")).otherwise("").alias("_hash"))
    # as many entries as there are cuts
    return found.groupBy(*keys).agg(F.array_sort(F.collect_list("_hash")).alias("_cuts"))


def assign_parts(
    df: DataFrame, key: str | Sequence[str], seed: int, ranks: Callable[[Column], list[Column]],
    groups: Sequence[str] = (), name: str = "part",
) -> DataFrame:
    """Add the number of the part each row falls into; part i ends at the i-th rank of its group's hash order."""
    groups = list(groups)
    h = row_hash(key, seed)
    cuts = _cut_hashes(df.select(*groups, h.alias("_hash")), groups, ranks)
    if groups:
        path = shared_folder(df.sparkSession, "cuts")
        cuts.write.parquet(path)
        joined = join_on(df, df.sparkSession.read.schema(cuts.schema).parquet(path), groups, "left").withColumn("_at", h)
        return joined.select(*df.columns, F.size(F.filter("_cuts", lambda e: F.col("_at") > e)).cast("int").alias(name))
    # one row, with an entry per cut
    found = cuts.first()
    part = sum([(F.col("_at") > cut).cast("int") for cut in (found["_cuts"] if found else [])], F.lit(0))
    return df.withColumn("_at", h).select(*df.columns, part.alias(name))


def random_split(df: DataFrame, key: str | Sequence[str], test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``split``: exactly ceil(n * test_size) rows are test, the others train."""
    out = assign_parts(df, key, seed, lambda n: [F.ceil(n * F.lit(test_size))], name="_part")
    return out.withColumn("split", F.when(F.col("_part") == 0, "test").otherwise("train")).drop("_part")


def written_parts(marked: DataFrame, labels: Sequence[str], name: str = "split") -> list[DataFrame]:
    """The rows of each part, from a table written once: a fit reads its rows many times, and each reading of a split
    hashes every row again."""
    path = shared_folder(marked.sparkSession, "parts")
    marked.write.parquet(path)
    rows = marked.sparkSession.read.schema(marked.schema).parquet(path)
    return [rows.where(F.col(name) == label).drop(name) for label in labels]


def stratified_split(
    df: DataFrame, key: str | Sequence[str], target: str, test_size: float = 0.2, validation_size: float = 0.1, seed: int = 42
) -> DataFrame:
    """Add ``split`` with the class shares kept: per class ceil(n * test) test rows, then the validation rows.

    The validation share is taken of all rows, that is validation / (1 - test) of what the test set leaves.
    """

    def ranks(n: Column) -> list[Column]:
        test = F.ceil(n * F.lit(test_size))
        return [test, test + F.ceil((n - test) * F.lit(validation_size / (1.0 - test_size)))]

    out = assign_parts(df, key, seed, ranks, [target], "_part")
    label = F.when(F.col("_part") == 0, "test").when(F.col("_part") == 1, "validation").otherwise("train")
    return out.withColumn("split", label).drop("_part")


def cv_folds(df: DataFrame, key: str | Sequence[str], folds: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` 0..folds-1: consecutive blocks of the hash order, sizes differing by at most one."""
    return assign_parts(
        df, key, seed, lambda n: [F.ceil(n * F.lit(i) / F.lit(folds)) for i in range(1, folds)], name="fold"
    )


def repeatable_sample(df: DataFrame, key: str | Sequence[str], rows: int, seed: int = 42) -> DataFrame:
    """The rows first in hash order: a sample that does not depend on partitioning (top-k per task, then merged)."""
    return df.orderBy(row_hash(key, seed)).limit(rows)


def head(df: DataFrame, key: str | Sequence[str], rows: int) -> DataFrame:
    """The first rows by key; files have no row order of their own."""
    return df.orderBy(*([key] if isinstance(key, str) else key)).limit(rows)
