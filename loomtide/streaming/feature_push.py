"""Pushed feature rows: append to the offline table and keep the latest row per entity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from loomtide.operators.snapshots import SnapshotStore


@dataclass
class FeaturePush:
    """A ``foreachBatch`` function: each batch writes its own folder in the offline table and merges into the snapshot.

    Repeating a batch after a failure rewrites the same folders. An older event never replaces a newer one.
    """

    store: SnapshotStore

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        folder = f"{self.store.path}/offline/batch={batch_id}"
        rows = batch.select(*self.store.schema.names)
        rows.write.mode("overwrite").parquet(folder)
        # read back what was written, so that the stream's input is computed once
        self.store.merge(batch.sparkSession.read.schema(rows.schema).parquet(folder), batch_id)

    def offline(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.store.path}/offline").drop("batch")

    def snapshot(self, spark: SparkSession) -> DataFrame:
        return self.store.read(spark)
