"""Exact positions in large groups, and tables written to the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from loomtide.session import shared_folder

#: Rows that share a cell on average at most; a cell is what one window sorts.
CELL_ROWS = 512
#: Cells whose offsets one window adds up.
CELLS_TOGETHER = 1024
KEY_BITS = 60


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df``, written to the shared folder and read back: lineage ends there and later plans know its size."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def column(name: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def shuffle_key(seed: str, *parts: Column) -> Column:
    """A number of 60 bits that looks random but depends on the seed and the first part that isn't null only (MD5, as SQL has it)."""
    text = F.concat_ws("|", F.lit(seed), F.coalesce(*[p.cast("string") for p in parts], F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def group_key(col: Column) -> Column:
    """A text that is never null and differs for null and every value."""
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit(""))


def ranked(
    df: DataFrame, key: str, ties: list[str], group: str | None = None, weight: str | None = None,
    key_bits: int = KEY_BITS,
) -> DataFrame:
    """``df`` with ``_rank`` (0, 1, ... by key, then ties, within the group) and ``_of`` (rows of the group).

    With ``weight``: also ``_before``, the weight of the rows in front, and ``_weight_of``, that of the group. Keys are
    spread evenly over ``key_bits`` bits. The rows are counted by group and leading bits of the key, so that one cell
    holds few rows however large its group is; rows are moved once, to be sorted within their cell, and the cells'
    offsets are added to that. Rows equal in key and ties are ordered either way.
    """
    rows = df.withColumn("_g", F.col(group) if group else F.lit(""))
    n = rows.count()
    bits = max(0, min(key_bits, (max(1, n // CELL_ROWS) - 1).bit_length()))
    rows = rows.withColumn("_cell", F.shiftright(F.col(key), key_bits - bits))
    amount = F.col(weight) if weight else F.lit(0)
    cells = rows.groupBy("_g", "_cell").agg(F.count("*").alias("_n"), F.sum(amount).cast("long").alias("_w"))
    cells = cells.withColumn("_far", F.col("_cell").cast("long").bitwiseAND(-CELLS_TOGETHER))
    far = Window.partitionBy("_g").orderBy("_far").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_g")
    blocks = cells.groupBy("_g", "_far").agg(F.sum("_n").alias("_n"), F.sum("_w").alias("_w")).select(
        F.col("_g").alias("_bg"), F.col("_far").alias("_bf"),
        F.coalesce(F.sum("_n").over(far), F.lit(0)).alias("_far_n"), F.coalesce(F.sum("_w").over(far), F.lit(0)).alias("_far_w"),
        F.sum("_n").over(whole).alias("_of"), F.sum("_w").over(whole).alias("_weight_of"),
    )
    near = Window.partitionBy("_g", "_far").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.join(blocks, (F.col("_g") == F.col("_bg")) & (F.col("_far") == F.col("_bf"))).select(
        F.col("_g").alias("_og"), F.col("_cell").alias("_oc"), "_of", "_weight_of",
        (F.col("_far_n") + F.coalesce(F.sum("_n").over(near), F.lit(0))).alias("_cell_n"),
        (F.col("_far_w") + F.coalesce(F.sum("_w").over(near), F.lit(0))).alias("_cell_w"),
    )
    cell = Window.partitionBy("_g", "_cell").orderBy(key, *ties)
    front = cell.rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(offsets, (F.col("_g") == F.col("_og")) & (F.col("_cell") == F.col("_oc")))
    out = out.withColumn("_rank", F.col("_cell_n") + F.row_number().over(cell) - 1)
    extra = ["_rank", "_of"]
    if weight:
        out = out.withColumn("_before", F.col("_cell_w") + F.coalesce(F.sum(weight).over(front), F.lit(0)))
        extra += ["_before", "_weight_of"]
    return out.select(*[column(c) for c in df.columns], *extra)
