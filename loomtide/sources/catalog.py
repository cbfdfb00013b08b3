"""Catalog tables: registration, schema discovery, and what changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def register_database(spark: SparkSession, name: str, comment: str = "") -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}` COMMENT '{comment}'")


def register_table(
    spark: SparkSession, database: str, table: str, schema: T.StructType, fmt: str, location: str,
    partitioned_by: Sequence[str] = (), clustered_by: Sequence[str] = (), sorted_by: Sequence[str] = (), buckets: int = 0,
) -> None:
    """Declare an external table with its columns, partition and bucket layout."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    sql = f"CREATE TABLE IF NOT EXISTS `{database}`.`{table}` ({columns}) USING {fmt}"
    if fmt == "csv":
        sql += " OPTIONS (header 'true')"
    if partitioned_by:
        sql += f" PARTITIONED BY ({', '.join(f'`{c}`' for c in partitioned_by)})"
    if clustered_by:
        sql += f" CLUSTERED BY ({', '.join(f'`{c}`' for c in clustered_by)})"
        if sorted_by:
            sql += f" SORTED BY ({', '.join(f'`{c}`' for c in sorted_by)})"
        sql += f" INTO {buckets} BUCKETS"
    spark.sql(f"{sql} LOCATION '{location}'")
    if partitioned_by:
        spark.catalog.recoverPartitions(f"`{database}`.`{table}`")


def schema_changes(spark: SparkSession, known: T.StructType, found: T.StructType) -> DataFrame:
    """Columns added, removed or of another type in the discovered schema."""
    old = {f.name: f.dataType.simpleString() for f in known.fields}
    new = {f.name: f.dataType.simpleString() for f in found.fields}
    rows = []
    for name in sorted({*old, *new}):
        if name not in old:
            rows.append((name, "added", None, new[name]))
        elif name not in new:
            rows.append((name, "removed", old[name], None))
        elif old[name] != new[name]:
            rows.append((name, "type_changed", old[name], new[name]))
    return spark.createDataFrame(rows, "column_name string, change string, old_type string, new_type string")


#: Types in the order in which they hold each other's values without loss.
WIDENING = (("tinyint", "smallint", "int", "bigint"), ("float", "double"))


def wider(old: T.DataType, new: T.DataType) -> T.DataType | None:
    """The type of the two that holds both without loss, or None if neither does."""
    a, b = old.simpleString(), new.simpleString()
    if a == b:
        return old
    for order in WIDENING:
        if a in order and b in order:
            return old if order.index(a) > order.index(b) else new
    return None


def merged_schema(known: T.StructType, found: T.StructType) -> T.StructType:
    """``known`` with the new columns of ``found`` behind it and types widened where both allow it.

    Columns that ``found`` lacks stay; a type that neither holds the other raises ``ValueError``.
    """
    fields, of = [], {f.name: f for f in found.fields}
    for field in known.fields:
        other = of.pop(field.name, None)
        kind = field.dataType if other is None else wider(field.dataType, other.dataType)
        if kind is None:
            raise ValueError(f"column {field.name} changed from {field.dataType.simpleString()} to {other.dataType.simpleString()}")
        fields.append(T.StructField(field.name, kind, True))
    return T.StructType(fields + [T.StructField(f.name, f.dataType, True) for f in of.values()])


def read_versions(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """Folders written with different schemas as one table: columns that a folder lacks are null, types are widened.

    Each folder is read with its own schema and cast; those of one schema are one scan, so the plan grows with the number
    of schemas and not of folders.
    """
    by_schema: dict[str, list[str]] = {}
    schemas: dict[str, T.StructType] = {}
    merged: T.StructType | None = None
    for path in paths:
        own = discover(spark, path, fmt)
        schemas[own.simpleString()] = own
        by_schema.setdefault(own.simpleString(), []).append(path)
        merged = own if merged is None else merged_schema(merged, own)
    if merged is None:
        raise ValueError("no folders to read")
    out: DataFrame | None = None
    for key, folders in by_schema.items():
        have = set(schemas[key].names)
        part = spark.read.schema(schemas[key]).format(fmt).option("header", "true").load(folders).select(*[
            (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in merged.fields
        ])
        out = part if out is None else out.unionByName(part)
    return out


def discover(spark: SparkSession, path: str, fmt: str) -> T.StructType:
    """Schema of the files below a path, merged over files."""
    reader = spark.read.option("recursiveFileLookup", "false")
    if fmt == "parquet":
        return reader.option("mergeSchema", "true").parquet(path).schema
    options = {"header": "true", "inferSchema": "true"} if fmt == "csv" else {}
    return reader.options(**options).format(fmt).load(path).schema


def crawl(spark: SparkSession, table: str, path: str, fmt: str) -> DataFrame:
    """Compare a registered table with its files: add new columns to the table, only report removed ones."""
    changes = schema_changes(spark, spark.table(table).schema, discover(spark, path, fmt))
    rows = changes.collect()
    added = [row for row in rows if row["change"] == "added"]
    if added:
        columns = ", ".join(f"`{row['column_name']}` {row['new_type']}" for row in added)
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({columns})")
    # a fixed table, as the comparison would find nothing once the columns are added
    return spark.createDataFrame(rows, changes.schema)
