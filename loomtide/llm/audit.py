"""Filter interaction audit: what every order of some filters removes, step by step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from loomtide.llm.lines import BLANKS
from loomtide.llm.ranks import column, stored

#: One letter per filter; the first one is bit 0 of a mask.
LETTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_UPPER_PERCENT = 10
SYMBOLS = "[#$%&*|]"
#: Bit of the filter that looks at the other documents.
REPEATED = LETTERS.index("E")


def text_bits(text: Column) -> Column:
    """Bits of the filters A to D, which look at one text only. A null text counts as an empty one."""
    text = F.coalesce(text, F.lit(""))
    stripped = F.trim(text, F.lit(BLANKS))
    words = F.split(stripped, "[ \t-\r]+", -1)
    n = F.when(stripped == "", 0).otherwise(F.size(words))
    distinct = F.when(stripped == "", 0).otherwise(F.size(F.array_distinct(words)))
    upper = F.regexp_count(text, F.lit("[A-Z]"))
    fails = [
        n < MIN_WORDS,
        distinct.cast("long") * 100 < n.cast("long") * MIN_DISTINCT_PERCENT,
        upper.cast("long") * 100 > F.length(text).cast("long") * MAX_UPPER_PERCENT,
        text.rlike(SYMBOLS),
    ]
    bits = [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)]
    return sum(bits[1:], bits[0])


def mask_cells(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
) -> DataFrame:
    """Documents counted by part and mask: ``part``, ``mask``, ``n``, ``good``, ``toxic``.

    The mask has a bit for every filter that a document fails. A text fails E if a row with a smaller id has the same
    text, in any part; a row without id comes before and after nothing and never fails it, and rows that repeat an id
    don't fail it through each other. A null text is an empty one, a null part the part ``''``. A document is good or
    toxic if any row of ``labels`` with its id says 1. Other columns are ignored; empty tables give no cells.

    Texts are read once and not moved: equal rows are counted before anything is joined, so copies without id are one
    row, and a text held by very many ids is counted per part and label before its smallest id is looked up.
    """
    text = F.coalesce(column(text_col), F.lit(""))
    read = docs.select(
        column(id_col).alias("id"), F.coalesce(column(part_col).cast("string"), F.lit("")).alias("part"),
        text_bits(column(text_col)).alias("bits"), F.sha2(text.cast("binary"), 256).alias("digest"),
    ).groupBy("id", "part", "bits", "digest").agg(F.count("*").alias("rows"))
    said = labels.groupBy(column("doc_id").alias("labelled")).agg(
        F.max((column("quality") == 1).cast("int")).alias("good"), F.max((column("toxic") == 1).cast("int")).alias("toxic"),
    )
    marked = read.join(said, F.col("id") == F.col("labelled"), "left").select(
        "id", "part", "bits", "digest", "rows", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("good", "toxic")]
    )
    held = marked.groupBy("digest", "part", "bits", "good", "toxic").agg(
        F.sum("rows").alias("rows"), F.min("id").alias("first"),
        F.min_by("rows", "id").alias("rows_first"), F.sum(F.when(F.col("id").isNull(), F.col("rows"))).alias("rows_null"),
    )
    lowest = F.min("first").over(Window.partitionBy("digest"))
    spared = F.coalesce(F.col("rows_null"), F.lit(0)) + F.when(F.col("first") == F.col("lowest"), F.col("rows_first")).otherwise(0)
    both = held.withColumn("lowest", lowest).withColumn("spared", spared).select(
        "part", "good", "toxic", F.explode(F.array(
            F.struct(F.col("bits").alias("mask"), F.col("spared").alias("n")),
            F.struct((F.col("bits") + (1 << REPEATED)).alias("mask"), (F.col("rows") - F.col("spared")).alias("n")),
        )).alias("cell"),
    )
    n = F.col("cell.n")
    return both.filter(n > 0).groupBy("part", F.col("cell.mask").alias("mask")).agg(
        F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic")
    )


def prefixes(spark: SparkSession, letters: str = LETTERS) -> DataFrame:
    """Every way to begin an order of the filters, for every mask: what the last filter of it does to such documents.

    A recursive query. A level takes the prefixes of the level before, adds each unused letter, and carries the bits of
    the filters applied so far; each level emits its step: ``removed`` (fails the last filter and none before),
    ``redundant`` (fails it, removed before), ``kept`` (fails none so far), as 0 or 1. Its size depends on the number
    of filters only: 10,400 rows for five.
    """
    every = ", ".join(f"'{x}'" for x in letters)
    return spark.sql(f"""
        with recursive grown (prefix, step, letter, applied, bit, mask) as (
            select '', 0, '', 0, 0, cast(id as int) from range(0, {1 << len(letters)}, 1, 1)
            union all
            select concat(prefix, added), step + 1, added, applied | bit, shiftleft(1, instr('{letters}', added) - 1), mask
            from (
                select *, explode(filter(array({every}), x -> instr(prefix, x) = 0)) as added from grown
                where step < {len(letters)}
            )
        )
        select prefix, step, letter, bit, mask,
               cast(mask & (applied | bit) = 0 as int) as kept,
               cast(mask & bit <> 0 and mask & applied = 0 as int) as removed,
               cast(mask & bit <> 0 and mask & applied <> 0 as int) as redundant
        from grown where step > 0
    """)


def audit(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """What each filter does at each step of each order: one row per part, order and step, zeros included.

    ``cells`` are counts by part and mask (``mask_cells``). ``kept``, ``removed``, ``redundant``, ``unique_fails``,
    ``good_lost`` and ``toxic_lost`` are documents; ``shapley`` is what the step's filter removes, summed over all
    orders, at whatever step. A part has a row for every order and step as soon as it has a document. Orders that begin
    alike share their first steps, so only prefixes are joined with the cells.
    """
    n, removed = F.col("n"), F.col("removed")
    grown = stored(prefixes(cells.sparkSession, letters), "orders")
    steps = cells.join(F.broadcast(grown), "mask").groupBy("part", "prefix", "step", "letter").agg(
        F.sum(n * F.col("kept")).alias("kept"), F.sum(n * removed).alias("removed"),
        F.sum(n * F.col("redundant")).alias("redundant"),
        F.sum(F.when(F.col("mask") == F.col("bit"), n).otherwise(0)).alias("unique_fails"),
        F.sum(F.col("good") * removed).alias("good_lost"), F.sum(F.col("toxic") * removed).alias("toxic_lost"),
    )
    whole = grown.filter((F.col("step") == len(letters)) & (F.col("mask") == 0))
    begun = F.explode(F.transform(F.sequence(F.lit(1), F.lit(len(letters))), lambda k: F.substring(F.col("prefix"), F.lit(1), k)))
    orders = whole.select(F.col("prefix").alias("filter_order"), begun.alias("prefix"))
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter"))
    return steps.join(F.broadcast(orders), "prefix").select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails",
        "good_lost", "toxic_lost", shapley.alias("shapley"),
    )
