"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtide.llm.ranks import column, group_key, ranked, shuffle_key

#: Steps in which fractional ranks are told apart; rows of one step are ordered by source and rank.
FRACTION_BITS = 40


def interleave(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    seed: str = "shards",
) -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 within the shard).

    Rows are shuffled within each source (by a seeded hash of the id) and ranked; the rank as a fraction of the
    source's rows, (rank + 1/2) / rows, orders all rows, and the order is cut into equal runs. So shards differ by one
    row at most (law ``rows``), and each holds its share of every source to within a row or two. A large source is no
    hot key: rows meet in small cells of the hash only.

    A null source is a source of its own, behind the others. Rows without an id are shuffled by their text. Repeated
    rows are rows like others; equal ones may swap places. An empty table gives an empty one. The columns of ``docs``
    are kept, those named ``shard`` and ``slot`` replaced. Two moves of the rows; drop long columns that the result
    doesn't need before.
    """
    keep = [c for c in docs.columns if c not in ("shard", "slot")]
    id_, text = column(id_col), column(text_col) if text_col in docs.columns else F.lit(None)
    rows = docs.select(
        F.struct(*[column(c) for c in keep]).alias("_row"), group_key(column(source_col)).alias("_source"),
        shuffle_key(seed, id_, F.md5(text.cast("binary"))).alias("_key"), id_.alias("_id"),
    )
    within = ranked(rows, "_key", ["_id"], "_source")
    within = within.select(
        "_row", F.col("_rank").alias("_r"), (F.col("_source") == "").alias("_last"), "_source",
        F.floor((F.col("_rank") + 0.5) / F.col("_of") * float(1 << FRACTION_BITS)).cast("long").alias("_fraction"),
    )
    order = ranked(within, "_fraction", ["_last", "_source", "_r"], key_bits=FRACTION_BITS)
    shard = F.expr(f"_rank * {shards} div _of")
    slot = F.expr(f"_rank - (shard * _of + {shards - 1}) div {shards}")
    return order.withColumn("shard", shard).withColumn("slot", slot).select(
        *[F.col("_row")[c].alias(c) for c in keep], F.col("shard").cast("int").alias("shard"), "slot"
    )
