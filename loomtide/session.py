"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def build_session(app_name: str = "loomtide", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tested with.

    Cluster submissions normally bring their own session; nothing in the library depends on this one.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def parallelism(spark: SparkSession) -> int:
    """Number of reduce tasks a shuffle gets; also how finely ordered work is sliced."""
    return max(2, min(4096, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for written intermediate tables, on storage every executor sees.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a folder below the warehouse is used, which
    every executor has to reach as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
