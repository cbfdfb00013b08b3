"""Reading and writing tables, listing files, choosing the current data."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("csv", "json", "parquet")


def format_of(path: str, fmt: str | None = None) -> str:
    """The given format, else the one the name ends with; others raise."""
    name = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if name not in FORMATS:
        raise ValueError(f"unsupported format for {path}: {name}; supported are {FORMATS}")
    return name


def read_table(
    spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | str | None = None, **options: str
) -> DataFrame:
    """Read a file or folder; the path's scheme picks the file system.

    CSV without a schema is read twice, once to infer types. JSON is one record per line unless multiLine is set.
    """
    kind = format_of(path, fmt)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "csv":
        options = {"header": "true", **({"inferSchema": "true"} if schema is None else {}), **options}
    return reader.options(**options).format(kind).load(path)


def write_table(
    df: DataFrame, path: str, fmt: str | None = None, mode: str = "overwrite", partition_by: Sequence[str] = ()
) -> None:
    """Write a folder of files; partitions are written in parallel and never merged into one file."""
    kind = format_of(path, fmt)
    writer = df.write.mode(mode)
    if kind == "csv":
        writer = writer.option("header", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(kind).save(path)


def list_files(spark: SparkSession, prefix: str, pattern: str | None = None) -> DataFrame:
    """Every file below a prefix with its size and time; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(prefix).select("path", "length", "modificationTime")


def data_exists(spark: SparkSession, prefix: str, pattern: str | None = None) -> int:
    """Number of files below a prefix; raises when there is none."""
    n = list_files(spark, prefix, pattern).count()
    if n == 0:
        raise FileNotFoundError(f"no files below {prefix}")
    return n


def read_all(spark: SparkSession, prefix: str) -> DataFrame:
    """All Parquet files below a prefix, or all CSV files where there is no Parquet; differing columns are merged."""
    for kind, pattern in (("parquet", "*.parquet"), ("csv", "*.csv")):
        if not list_files(spark, prefix, pattern).isEmpty():
            reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
            if kind == "parquet":
                return reader.option("mergeSchema", "true").parquet(prefix)
            return reader.option("header", "true").option("inferSchema", "true").csv(prefix)
    raise FileNotFoundError(f"no data below {prefix}")


def concat(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames; columns a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def trailing_window(df: DataFrame, ts: str, now: Column, span: timedelta = timedelta(hours=1), where: Column | None = None) -> DataFrame:
    """Rows with now - span < ts, newest data first to be pruned by the scan; ``now`` is given to be repeatable."""
    recent = df.where((F.col(ts) > now - F.expr(f"INTERVAL {int(span.total_seconds())} SECOND")) & (F.col(ts) <= now))
    return recent.where(where) if where is not None else recent


def current_data(
    spark: SparkSession, path: str | None = None, query: str | None = None, schema: T.StructType | None = None
) -> DataFrame | None:
    """A model's current data from a path or else a SQL query; None when neither is configured."""
    if path:
        return read_table(spark, path, schema=schema)
    return spark.sql(query) if query else None


def inline_records(spark: SparkSession, records: Sequence[dict], schema: T.StructType | str) -> DataFrame:
    """A dataset that came with a request."""
    return spark.createDataFrame(list(records), schema)


def jdbc_options(url: str, table: str, column: str, low: int, high: int, partitions: int, **more: str) -> dict[str, str]:
    """Options for a JDBC scan in parallel ranges of a numeric column."""
    if partitions < 1 or high < low:
        raise ValueError("need at least one partition and low <= high")
    return {
        "url": url, "dbtable": table, "partitionColumn": column, "lowerBound": str(low), "upperBound": str(high),
        "numPartitions": str(partitions), **more,
    }


def read_jdbc(spark: SparkSession, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(**options).load()
