"""Mixing sources to target weights: exact quotas, dealt out by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtide.llm.ranks import column, group_key, ranked, shuffle_key, stored

#: Blocks (documents) of an output shard; what one task draws and shuffles at a time.
SHARD_BLOCKS = 4096
MAX_EPOCHS = 3
#: From this many blocks on a split is drawn by ``large_draw``, as numpy's draws end at 10**9.
EXACT_DRAWS = 10**8


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def repeating_weights(sources: list[str | None]) -> dict[str | None, int]:
    """Weights 1, 2, 3, 1, ... for sources by code point, null last."""
    ordered = sorted((s for s in sources if s is not None)) + [None] * (None in sources)
    return {s: i % 3 + 1 for i, s in enumerate(ordered)}


def targets(sizes: dict, weights: dict, total: int | None = None, most: int = MAX_EPOCHS) -> dict[str | None, Fraction]:
    """Each source's share of the total by weight, at most ``most`` times its size; the excess goes to the others."""
    left = Fraction(sum(sizes.values()) if total is None else total)
    open_, out = {s for s in sizes if weights[s] > 0}, {s: Fraction(0) for s in sizes}
    while open_:
        parts = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] > most * sizes[s] * parts}
        if not full:
            out |= {s: left * weights[s] / parts for s in open_}
            break
        out |= {s: Fraction(most * sizes[s]) for s in full}
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def large_draw(c: int, rest: int, left: int, low: int, high: int, rng: np.random.Generator) -> int:
    """A hypergeometric draw of any size, by inversion around the mode; beyond 12 deviations and 60 nothing is left in floats."""
    every = c + rest
    mode = min(high, max(low, (left + 1) * (c + 1) // (every + 2)))
    width = 60 + int(12 * (left * (c / every) * (rest / every) * ((every - left) / max(1, every - 1))) ** 0.5)
    first, last = max(low, mode - width), min(high, mode + width)
    k = np.arange(first, last, dtype=np.int64)
    # p(k + 1) / p(k)
    steps = np.log((c - k).astype(float)) + np.log((left - k).astype(float)) - np.log((k + 1).astype(float)) - np.log((rest - left + k + 1).astype(float))
    terms = np.concatenate([[0.0], np.cumsum(steps)])
    upto = np.cumsum(np.exp(terms - terms.max()))
    return first + min(int(np.searchsorted(upto, rng.random() * upto[-1], side="right")), len(upto) - 1)


def split(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each colour are among n balls drawn from the counts without putting back."""
    out, left, rest = np.zeros(len(counts), dtype=np.int64), n, int(counts.sum())
    for i, c in enumerate(counts.tolist()):
        rest -= c
        low, high = max(0, left - rest), min(c, left)
        if low == high:
            k = low
        elif c + rest < EXACT_DRAWS:
            k = int(rng.hypergeometric(c, rest, left))
        else:
            k = large_draw(c, rest, left, low, high, rng)
        out[i], left = k, left - k
    return out


class Tree:
    """The splitting tree over shards. Every node draws with a generator of its own, so any leaf can be made alone."""

    def __init__(self, quotas: list[int], shards: int, seed: int) -> None:
        self.quotas, self.shards, self.seed = np.array(quotas, dtype=np.int64), shards, seed
        self.blocks, self.made = sum(quotas), {}

    def start(self, shard: int) -> int:
        return shard * self.blocks // self.shards

    def left(self, a: int, m: int, b: int, counts: np.ndarray) -> np.ndarray:
        if (a, b) not in self.made:
            rng = np.random.default_rng([self.seed, a, b])
            self.made[a, b] = split(counts, self.start(m) - self.start(a), rng)
        return self.made[a, b]

    def leaf(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each source, the first block of the shard and the number of blocks."""
        a, b, counts, first = 0, self.shards, self.quotas, np.zeros(len(self.quotas), dtype=np.int64)
        while b - a > 1:
            m = (a + b) // 2
            left = self.left(a, m, b, counts)
            if shard < m:
                b, counts = m, left
            else:
                a, counts, first = m, counts - left, first + left
        if len(self.made) > 4096:
            self.made.clear()
        return first, counts


@dataclass
class Source:
    """What the mix takes of a source: ``epochs`` times everything, then ``extra`` blocks of the permuted order."""

    name: str | None
    key: str
    blocks: int
    size: int
    target: Fraction
    epochs: int
    budget: int
    extra: int = 0


@dataclass
class Mix:
    """``sources``: the plan. ``blocks``: the permuted documents. ``draws``: shard, slot, _g, _rank, epoch, _budget."""

    sources: list[Source]
    blocks: DataFrame
    empty: DataFrame
    draws: DataFrame

    def rows(self) -> DataFrame:
        """One row per draw: shard, slot, epoch, n_words taken, and the document's columns in struct ``doc``."""
        words = F.when(F.col("_budget").isNull(), F.col("_size")).otherwise(
            F.least(F.col("_size"), F.col("_budget") - F.col("_before"))
        )
        # draws come out of few rows of a range, so Spark would take them for small
        return self.draws.hint("merge").join(self.blocks, ["_g", "_rank"]).select(
            "shard", "slot", "epoch", words.cast("long").alias("n_words"), "doc"
        )

    def taken(self) -> DataFrame:
        """Every document once: struct ``doc``, size, key of its source ``_g`` and the words the mix takes of it."""
        words = F.when(F.col("_budget").isNull(), F.col("_size")).otherwise(
            F.least(F.col("_size"), F.col("_budget") - F.col("_before"))
        )
        per_block = self.draws.groupBy("_g", "_rank").agg(F.count("*").alias("_draws"), F.max("_budget").alias("_budget"))
        joined = self.blocks.join(per_block.hint("merge"), ["_g", "_rank"], "left")
        full = F.coalesce(F.col("_draws"), F.lit(0)) - F.when(F.col("_budget").isNull(), 0).otherwise(1)
        last = F.when(F.col("_budget").isNull(), 0).otherwise(words)
        return joined.select(
            "doc", F.col("_size").alias("size"), "_g", (full * F.col("_size") + last).cast("long").alias("taken")
        ).unionByName(self.empty.select("doc", F.col("_size").alias("size"), "_g", F.lit(0).cast("long").alias("taken")))


def draw_rows(sources: list[Source], shards: int, seed: int, cut_last: bool) -> Callable:
    """The blocks that each shard of a batch draws, in its local order."""
    quotas = [s.epochs * s.blocks + s.extra for s in sources]

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = Tree(quotas, shards, seed)
        for batch in batches:
            for shard in batch["id"]:
                first, counts = tree.leaf(int(shard))
                which = np.repeat(np.arange(len(sources)), counts)
                index = np.concatenate([np.arange(a, a + c) for a, c in zip(first, counts)])
                blocks = np.array([max(1, s.blocks) for s in sources])[which]
                epoch, rank = index // blocks, index % blocks
                whole = np.array([s.epochs for s in sources])[which]
                extra = np.array([s.extra for s in sources])[which]
                budget = pd.Series(np.array([s.budget for s in sources])[which], dtype="Int64")
                budget[~((epoch == whole) & (rank == extra - 1)) | (not cut_last)] = pd.NA
                slots = np.random.default_rng([seed, int(shard), 7]).permutation(len(which))
                yield pd.DataFrame({
                    "shard": shard, "slot": slots, "_g": np.array([s.key for s in sources], dtype=object)[which],
                    "_rank": rank, "epoch": epoch, "_budget": budget,
                })

    return made


def mix(
    docs: DataFrame, weights: Callable[[list], dict] = repeating_weights, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", total: int | None = None, cut_last: bool = True, seed: int = 20,
    shard_blocks: int = SHARD_BLOCKS, columns: list[str] | None = None,
) -> Mix:
    """Draw documents so that each source has its target share of the words.

    A block is a document. Targets follow the weights, at most three times a source's words. Each source's blocks are
    permuted by a seeded hash; the mix takes all of them as often as they fit into the target, then blocks in permuted
    order up to it. The last of these is cut to the missing words (``cut_last``), or taken whole if that comes nearer
    to the target. These exact block quotas are split among the output shards by a tree: each node draws from the
    multivariate hypergeometric distribution how many blocks of each source go left. A leaf takes disjoint runs of the
    permuted blocks and shuffles them. Reruns agree.

    Only one row per source comes to the driver. A hot source is ranked in small cells of the hash, never as a group.
    A null source is one of its own. Rows without words are never drawn. Rows without an id are permuted by their
    text; repeated rows are drawn like others. An empty table gives no draws. Column names don't matter, ``columns``
    (all by default) travel in the struct ``doc``.
    """
    spark = docs.sparkSession
    id_, text, source = (column(c) for c in (id_col, text_col, source_col))
    rows = docs.select(
        F.struct(*[column(c) for c in columns or docs.columns]).alias("doc"), group_key(source).alias("_g"), source.alias("_source"),
        word_count(text).alias("_size"), id_.alias("_id"),
        shuffle_key(f"mix{seed}", id_, F.md5(text.cast("binary"))).alias("_key"),
    )
    found = rows.groupBy("_g", "_source").agg(
        F.sum("_size").alias("size"), F.sum((F.col("_size") > 0).cast("long")).alias("blocks")
    ).collect()
    sizes = {r["_source"]: r["size"] for r in found}
    aims = targets(sizes, weights(list(sizes)), total)
    sources = []
    for r in sorted(found, key=lambda r: (r["_source"] is None, r["_source"] or "")):
        words = int(aims[r["_source"]])
        epochs, budget = divmod(words, r["size"]) if r["size"] else (0, 0)
        sources.append(Source(r["_source"], r["_g"], r["blocks"], r["size"], aims[r["_source"]], epochs, budget))

    blocks = ranked(rows.filter("_size > 0").drop("_source"), "_key", ["_id", "_size"], "_g", "_size")
    blocks = stored(blocks.drop("_key", "_id", "_of", "_weight_of"), "mix-blocks")
    if sources:
        plan = spark.createDataFrame([(s.key, s.budget) for s in sources], "_g string, _budget long")
        inside = F.col("_before") < F.col("_budget")
        if not cut_last:
            inside &= 2 * (F.col("_budget") - F.col("_before")) >= F.col("_size")
        extra = blocks.join(F.broadcast(plan), "_g").filter(inside).groupBy("_g").count().collect()
        for s in sources:
            s.extra = next((r["count"] for r in extra if r["_g"] == s.key), 0)
    drawn = sum(s.epochs * s.blocks + s.extra for s in sources)
    shards = -(-drawn // shard_blocks)
    tasks = max(1, min(shards, 2 * spark.sparkContext.defaultParallelism))
    draws = spark.range(0, shards, 1, tasks).mapInPandas(
        draw_rows(sources, shards, seed, cut_last), "shard long, slot long, _g string, _rank long, epoch long, _budget long"
    )
    return Mix(sources, blocks, rows.filter("_size = 0"), draws)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, whole, each as often as it is drawn, with the columns of ``docs``."""
    rows = mix(docs, cut_last=False, **options).rows()
    return rows.select(*[F.col("doc")[c].alias(c) for c in docs.columns])
