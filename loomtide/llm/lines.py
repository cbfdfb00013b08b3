"""Line deduplication: lines that many documents share are kept in one of them only."""

from __future__ import annotations

import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtide.llm.ranks import column, stored, unused

MIN_CHARS = 40
MIN_DOCS = 5
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def hashed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row per line with a long enough key: id, hash of the whole text, position, 128-bit hash of the key."""
    text = column(text_col)
    lines = docs.select(
        column(id_col).alias("_id"), F.xxhash64(text).alias("_text"), F.posexplode(F.split(text, "\n", -1)).alias("_pos", "_line")
    ).select("_id", "_text", "_pos", line_key(F.col("_line")).alias("_key"))
    return lines.filter(F.length("_key") >= min_chars).select(
        "_id", "_text", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit("second"), "_key").alias("_h2")
    )


def common_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """Hashes of lines that at least so many documents hold, with the largest id (``_last``) that does.

    Documents are made distinct before they are counted; both steps combine rows before they move them.
    """
    held = lines.groupBy("_h1", "_h2", "_id").agg(F.lit(1).alias("_one"))
    return held.groupBy("_h1", "_h2").agg(F.count("_id").alias("_docs"), F.max("_id").alias("_last")).filter(
        F.col("_docs") >= min_docs
    )


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
) -> DataFrame:
    """``docs`` with the text's remaining lines, and ``n_lines`` (before) and ``n_dropped``.

    Lines are cut at line feeds. A line's key is the line stripped of ASCII white space, A-Z lower-cased. A key of at
    least ``min_chars`` code points in at least ``min_docs`` documents goes from all of them but the one with the
    largest id, which keeps every line with that key. The other lines stay in order.

    Documents are told apart by id: rows that repeat an id count once, and each of them keeps the lines of the largest
    id. Rows without an id count as no document and lose common lines. A null text stays null and counts, as an empty
    one, as one line. An empty table gives an empty one. Other columns are kept; ``n_lines`` and ``n_dropped`` are
    replaced. The text is moved once. A line of very many documents is joined from a written table, so Spark can split
    its rows.
    """
    did, dtext, at, own = unused(docs, "_did", "_dtext", "_gone", "_own")
    lines = hashed_lines(docs, id_col, text_col, min_chars)
    common = stored(common_lines(lines, min_docs).select("_h1", "_h2", "_last"), "common-lines")
    drops = (
        lines.join(common, ["_h1", "_h2"]).filter(~F.col("_id").eqNullSafe(F.col("_last")))
        .groupBy(F.col("_id").alias(did), F.col("_text").alias(dtext)).agg(F.collect_set("_pos").alias(at))
    )

    @F.pandas_udf("string")
    def without(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, gone in batches:
            out = []
            for text, at in zip(texts, gone):
                if at is not None:
                    at = set(at)
                    text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in at)
                out.append(text)
            yield pd.Series(out, dtype=object)

    text, gone = column(text_col), F.col(at)
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    joined = docs.select(*[column(c) for c in keep], F.xxhash64(text).alias(own)).join(
        drops, column(id_col).eqNullSafe(F.col(did)) & (F.col(own) == F.col(dtext)), "left"
    )
    n_lines = F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(1))
    n_lines = F.when(text.isNull(), 1).otherwise(n_lines).cast("long")
    return joined.select(
        *[without(text, gone).alias(c) if c == text_col else column(c) for c in keep],
        n_lines.alias("n_lines"), F.coalesce(F.when(gone.isNotNull(), F.size(gone)), F.lit(0)).cast("long").alias("n_dropped"),
    )
