"""Latest-value snapshots kept in hash buckets: a change rewrites the buckets it touches and nothing else."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtide.operators.feature_store import FeatureView, latest_per_key

BUCKETS = 64
COMMIT = "bucket int, version long, mark timestamp_ntz"
#: The commit of a store without rows; batches are numbered from 0.
EMPTY = -1


@dataclass
class SnapshotStore:
    """The newest row per key, in ``buckets`` hash buckets of the key below ``path``.

    A batch writes new versions of the buckets that have rows in it, and then a commit: for every bucket the batch that
    wrote its current version, and the high-water mark up to which the source has been read. Readers follow the last
    commit, so they never see half a batch; a repeated batch starts from the commit before it and replaces what it wrote.
    Versions that no commit in use names can be deleted. The number of buckets is fixed when the store is made: choose
    it so that a bucket is a file of ordinary size.
    """

    path: str
    keys: Sequence[str]
    timestamp: str
    features: Sequence[str]
    schema: T.StructType
    tie_break: Sequence[str] = ()
    buckets: int = BUCKETS

    def __post_init__(self) -> None:
        self.schema = T.StructType([self.schema[c] for c in (*self.keys, self.timestamp, *self.features)])

    def _latest(self, rows: DataFrame, tie_break: Sequence[str] | None = None) -> DataFrame:
        return latest_per_key(rows, self.keys, self.timestamp, self.features, tie_break or self.tie_break)

    def _commit(self, spark: SparkSession, before: int | None = None) -> tuple[int, dict[int, int], object]:
        """The last commit (before a batch): its batch, the version of each bucket, the mark."""
        spark.createDataFrame([], COMMIT).coalesce(1).write.mode("ignore").parquet(f"{self.path}/commits/batch={EMPTY}")
        commits = spark.read.schema(f"{COMMIT}, batch long").parquet(f"{self.path}/commits")
        if before is not None:
            commits = commits.where(F.col("batch") < before)
        last = commits.agg(F.max("batch")).first()[0]
        if last is None:
            return EMPTY, {}, None
        # one row per bucket, and one without bucket for the mark
        rows = commits.where(F.col("batch") == last).collect()
        mark = max((r["mark"] for r in rows if r["mark"] is not None), default=None)
        return last, {r["bucket"]: r["version"] for r in rows if r["bucket"] is not None}, mark

    def _read(self, spark: SparkSession, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/rows/version={v}/bucket={b}" for b, v in sorted(versions.items())]
        if not paths:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*paths)

    def merge(self, rows: DataFrame, batch: int, mark: Column | None = None) -> None:
        """Bring in the rows of a batch. An older row never replaces a newer one; at equal times the tie break decides,
        without one the row that came last. ``mark`` is stored as the new high-water mark."""
        spark = rows.sparkSession
        _, versions, old_mark = self._commit(spark, batch)
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        fresh = f"{self.path}/incoming/batch={batch}"
        newest = self._latest(rows.select(*self.schema.names)).withColumn("bucket", bucket)
        newest.write.mode("overwrite").partitionBy("bucket").parquet(fresh)
        incoming = spark.read.schema(T.StructType([*self.schema, T.StructField("bucket", T.IntegerType())])).parquet(fresh)
        touched = [r["bucket"] for r in incoming.select("bucket").distinct().collect()]
        newest = incoming.drop("bucket")
        before = self._read(spark, {b: versions[b] for b in touched if b in versions})
        both = before.withColumn("_round", F.lit(0)).unionByName(newest.withColumn("_round", F.lit(1)))
        merged = self._latest(both, [*self.tie_break, "_round"]).withColumn("bucket", bucket)
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/version={batch}")
        commit = [(b, v, old_mark) for b, v in {**versions, **dict.fromkeys(touched, batch)}.items()] + [(None, None, old_mark)]
        done = spark.createDataFrame(commit, COMMIT)
        if mark is not None:
            done = done.withColumn("mark", mark.cast("timestamp_ntz"))
        done.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch}")

    def read(self, spark: SparkSession) -> DataFrame:
        """The newest row per key, as of the last commit."""
        return self._read(spark, self._commit(spark)[1])

    def mark(self, spark: SparkSession):
        """Up to where the source has been read (exclusive), or None."""
        return self._commit(spark)[2]

    def last_batch(self, spark: SparkSession) -> int:
        return self._commit(spark)[0]


def store_of(view: FeatureView, path: str, buckets: int = BUCKETS) -> SnapshotStore:
    return SnapshotStore(path, view.keys, view.timestamp, view.features, view.source.schema, view.tie_break, buckets)


def materialize_since_mark(view: FeatureView, store: SnapshotStore, end: Column, start: Column | None = None) -> DataFrame:
    """Bring a view's snapshot up to ``end`` (exclusive), from where the last run stopped; returns the snapshot.

    Only rows from the stored high-water mark on are read (on the first run from ``start``, or all). Rows that come with
    an older time after their interval was read are not looked for. A run that is repeated reads an empty interval.
    """
    spark = view.source.sparkSession
    batch, _, mark = store._commit(spark)
    ts = F.col(view.timestamp)
    rows = view.source.where(ts < end)
    if mark is not None:
        rows = rows.where(ts >= F.lit(mark).cast("timestamp_ntz"))
    elif start is not None:
        rows = rows.where(ts >= start)
    reached = end if mark is None else F.greatest(end.cast("timestamp_ntz"), F.lit(mark).cast("timestamp_ntz"))
    store.merge(rows, batch + 1, reached)
    return store.read(spark)
