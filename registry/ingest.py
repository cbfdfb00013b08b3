"""Reading, writing and choosing data."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtide.functions.columns import run_stamp, split_object_url
from loomtide.session import shared_folder
from loomtide.sources import catalog, files
from registry.common import Registry, as_doubles, table

REG = Registry()


@REG.add("parquet_scan", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY ALL")
def parquet_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Pruned columns and a pushed filter."""
    data = files.read_table(spark, f"{folder}/lineitem.parquet")
    return data.where(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).groupBy(
        "l_returnflag", "l_linestatus"
    ).agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("l_quantity"), 2) + 0.0).alias("quantity"))


@REG.add("csv_roundtrip", "SELECT * FROM orders")
def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    path = shared_folder(spark, "orders") + ".csv"
    files.write_table(orders, path)
    return files.read_table(spark, path, schema=orders.schema)


@REG.add("json_roundtrip", "SELECT * FROM documents")
def json_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    path = shared_folder(spark, "documents") + ".json"
    files.write_table(docs, path)
    return files.read_table(spark, path, schema=docs.schema)


@REG.add(
    "union_frames",
    """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance FROM customer
 UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier""",
)
def union_frames(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"),
    )
    supplier = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
    )
    return files.concat([customer, supplier])


@REG.add(
    "multi_file_read",
    """SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus = 'F'
 UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, NULL FROM orders WHERE o_orderstatus <> 'F'""",
)
def multi_file_read(spark: SparkSession, folder: str) -> DataFrame:
    """All files below a prefix, written with two different column sets."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    path = shared_folder(spark, "parts")
    orders.where("o_orderstatus = 'F'").drop("o_orderstatus").write.parquet(f"{path}/a/first")
    orders.where("o_orderstatus != 'F'").drop("o_orderstatus", "o_orderpriority").write.parquet(f"{path}/b")
    return files.read_all(spark, path).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


@REG.add(
    "trailing_window_source",
    "SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-20 06:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00' AND event_type = 'click'",
)
def trailing_window_source(spark: SparkSession, folder: str) -> DataFrame:
    now = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    return files.trailing_window(
        table(spark, folder, "events"), "ts", now, timedelta(hours=6), F.col("event_type") == "click"
    )


@REG.add(
    "object_urls",
    """SELECT page_id, regexp_extract(url, '^[a-z0-9]+://([^/]+)/?(.*)$', 1) AS bucket, regexp_extract(url, '^[a-z0-9]+://([^/]+)/?(.*)$', 2) AS prefix FROM pages""",
)
def object_urls(spark: SparkSession, folder: str) -> DataFrame:
    bucket, prefix = split_object_url(F.col("url"))
    return table(spark, folder, "pages").select("page_id", bucket.alias("bucket"), prefix.alias("prefix"))


@REG.add("run_names", "SELECT event_id, 'validation_run_' || strftime(ts, '%Y%m%d_%H%M%S') AS run_name FROM events")
def run_names(spark: SparkSession, folder: str) -> DataFrame:
    name = F.concat(F.lit("validation_run_"), run_stamp(F.col("ts")))
    return table(spark, folder, "events").select("event_id", name.alias("run_name"))


@REG.add(
    "json_rows",
    """SELECT event_id, user_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""",
)
def json_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows serialised to JSON and parsed back."""
    schema = "event_id long, user_id long, event_type string, props struct<k:int>"
    rows = table(spark, folder, "events").select(
        F.to_json(F.struct("event_id", "user_id", "event_type", F.from_json("props", "k int").alias("props"))).alias("value")
    )
    return rows.select(F.from_json("value", schema).alias("r")).select("r.event_id", "r.user_id", "r.event_type", F.col("r.props.k").alias("k"))


@REG.add(
    "schema_changes_applied",
    """SELECT 'part' AS source, p_partkey AS id, CAST(p_size AS DOUBLE) AS whole, CAST(p_retailprice AS DOUBLE) AS fraction,
  CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS added FROM part
UNION ALL SELECT 'embeddings', vec_id, NULL, CAST(embedding[1] AS DOUBLE), NULL FROM embeddings""",
)
def schema_changes_applied(spark: SparkSession, folder: str) -> DataFrame:
    """Tables written with two schemas each: wider types and a new column in the second folder."""
    root = shared_folder(spark, "versions")
    part = table(spark, folder, "part")
    price = F.col("p_retailprice").cast("double")
    part.where("p_partkey % 2 = 1").select(
        F.col("p_partkey").alias("id"), F.col("p_size").cast("int").alias("whole"), price.alias("fraction")
    ).write.parquet(f"{root}/part/1")
    part.where("p_partkey % 2 = 0").select(
        F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("whole"), price.alias("fraction"), F.col("p_brand").alias("added")
    ).write.parquet(f"{root}/part/2")
    first = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.get("embedding", F.lit(0)).cast("float").alias("fraction"))
    first.where("id % 2 = 1").write.parquet(f"{root}/embeddings/1")
    first.where("id % 2 = 0").select("id", F.col("fraction").cast("double").alias("fraction")).write.parquet(f"{root}/embeddings/2")
    frames = [
        catalog.read_versions(spark, [f"{root}/{name}/{i}" for i in (1, 2)]).withColumn("source", F.lit(name)) for name in ("part", "embeddings")
    ]
    out = files.concat(frames)
    assert dict(out.dtypes)["whole"] == "bigint" and dict(out.dtypes)["fraction"] == "double"
    return as_doubles(out.select("source", "id", "whole", "fraction", "added"), ["whole"])


@REG.add("file_listing", "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, true AS has_bytes, CAST(1 AS BIGINT) AS n_files FROM nation GROUP BY 1")
def file_listing(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a partitioned table; without any, the gate raises."""
    path = shared_folder(spark, "nations")
    files.write_table(table(spark, folder, "nation").coalesce(1), path, "parquet", partition_by=["n_regionkey"])
    files.data_exists(spark, path, "*.parquet")
    key = F.regexp_extract("path", "n_regionkey=([0-9]+)", 1).cast("long").alias("n_regionkey")
    return files.list_files(spark, path, "*.parquet").groupBy(key).agg(
        (F.min("length") > 0).alias("has_bytes"), F.count(F.lit(1)).alias("n_files")
    )


@REG.add(
    "catalog_table",
    "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1",
)
def catalog_table(spark: SparkSession, folder: str) -> DataFrame:
    """A registered table with partitions, asked by SQL."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    path = shared_folder(spark, "registered")
    files.write_table(orders, path, "parquet", partition_by=["o_orderstatus"])
    name = "orders_" + path[-12:]
    catalog.register_database(spark, "loomtide_catalog")
    catalog.register_table(spark, "loomtide_catalog", name, orders.schema, "parquet", path, partitioned_by=["o_orderstatus"])
    return spark.sql(
        f"SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM loomtide_catalog.{name} "
        "WHERE o_orderstatus <> 'P' GROUP BY o_orderstatus"
    )


@REG.add("current_by_query", "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1")
def current_by_query(spark: SparkSession, folder: str) -> DataFrame:
    """A model's current data given by a query."""
    return files.current_data(
        spark, query=f"SELECT event_type, count(*) AS n FROM parquet.`{folder}/events.parquet` WHERE ts >= TIMESTAMP_NTZ '2024-01-20' GROUP BY 1"
    )


@REG.add("inline_rows", "SELECT n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def inline_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Records that come with a request: the nations, as a client would send them."""
    asked = [row.asDict() for row in table(spark, folder, "nation").select("n_name", "n_regionkey").collect()]
    return files.inline_records(spark, asked, "n_name string, n_regionkey long")
