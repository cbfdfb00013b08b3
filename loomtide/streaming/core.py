"""Stream plumbing: sources, event time, running a stream until its input is used up."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtide.session import shared_folder


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet", files_per_trigger: int = 1000
) -> DataFrame:
    """Files arriving at a path as a stream; the schema defaults to that of the files there now.

    The last letter is written as a pattern, because the file source takes a plain path for a folder only.
    """
    known = schema or spark.read.format(fmt).load(path).schema
    pattern = path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(known).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(pattern)


def with_event_time(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """Zone-less times as UTC instants, with a watermark; the session time zone must be UTC."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def run_to_table(stream: DataFrame, purpose: str, mode: str = "append", partition_by: Sequence[str] = ()) -> DataFrame:
    """Process all input there is into a Parquet table in the shared folder and return the table.

    Progress and state are kept in the same place, so that a lost executor or driver costs no rows.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark, purpose)
    writer = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], purpose: str, mode: str = "append") -> str:
    """Process all input there is with a function per micro-batch; returns the folder of the progress log."""
    folder = shared_folder(stream.sparkSession, purpose)
    (
        stream.writeStream.foreachBatch(each).outputMode(mode)
        .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    )
    return folder
