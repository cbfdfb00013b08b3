"""A corpus pipeline over ``documents``: quality, near duplicates, decontamination, mixing, shards.

Each stage takes (spark, docs, folder of the tables) and works on all rows that its predecessor left; the runner
writes what a stage returns as Parquet and reads it again for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomtide.llm.decontam import decontaminated
from loomtide.llm.mixing import mixed_documents
from loomtide.llm.neardup import without_near_duplicates
from loomtide.llm.quality import quality_kept
from loomtide.llm.ranks import stored
from loomtide.llm.sharding import interleave
from registry.common import Registry, table

SHARDS = 16
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return quality_kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that share no ten-word window with the benchmark."""
    return decontaminated(docs, table(spark, folder, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Whole documents, each as often as the mixture of the sources draws it (not at all, or up to three times)."""
    return mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every row with its shard and slot."""
    return interleave(docs, SHARDS)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("mixture", mixture), ("shards", shards),
]

#: No SQL: hashes decide which documents the mixture draws. The stages are tested against brute-force versions.
ORACLE_SQL = None

REG = Registry()


@REG.add("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
