"""Drift of each closed time window of a stream against a fixed reference table.

The stream is reduced to value counts per window by a watermarked aggregation, so the only state is the counts of the
open windows. A window leaves it once, complete, and is compared with stored counts of the reference. No rows are
staged, and no batch reads what an earlier one wrote.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtide.functions.columns import present, quoted
from loomtide.operators import drift
from loomtide.operators.ordered import HOT_ROWS, hot_keys
from loomtide.session import shared_folder
from loomtide.streaming import core

SCORES = "slot long, column_name string, method string, drift_score double, threshold double, drift_detected boolean"


def _values(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> Column:
    """One entry per column: its name and its value, as a number or as a text."""
    cell = lambda name, number, text: F.struct(
        F.lit(name).alias("column_name"), number.cast("double").alias("number"), text.cast("string").alias("text")
    )
    none = F.lit(None)
    entries = [cell(c, present(df, c), none) for c in numeric] + [cell(c, none, quoted(c)) for c in categorical]
    return F.explode(F.filter(F.array(*entries), lambda e: e["number"].isNotNull() | e["text"].isNotNull()))


def value_counts(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], by: Sequence[Column] = ()) -> DataFrame:
    """Rows per column and value (``column_name``, ``number``, ``text``, ``n``); works on tables and on streams."""
    names = [f"_by{i}" for i in range(len(by))]
    cells = df.select(*[c.alias(n) for c, n in zip(by, names)], _values(df, numeric, categorical).alias("_cell"))
    return cells.groupBy(*names, "_cell.column_name", "_cell.number", "_cell.text").agg(F.count(F.lit(1)).alias("n"))


def closed_counts(
    stream: DataFrame, ts: str, length: str, numeric: Sequence[str], categorical: Sequence[str]
) -> DataFrame:
    """Value counts of the windows that a stream with a watermark on ``ts`` has closed: ``window`` and the counts."""
    timed = stream.withColumn("_window", F.window(ts, length))
    return value_counts(timed, numeric, categorical, [F.col("_window")]).withColumnRenamed("_by0", "window")


@dataclass
class DriftWindows:
    """A ``foreachBatch`` function over ``closed_counts`` in append mode: scores the windows that the batch closes.

    The reference is counted once, when the object is made. Each batch writes its own folder of scores; a repeated one
    replaces it. A window counts once it has a value in any column; a column without values there is untested.
    """

    path: str
    reference: DataFrame
    numeric: Sequence[str] = ()
    categorical: Sequence[str] = ()
    hot_rows: int = HOT_ROWS

    def __post_init__(self) -> None:
        spark = self.reference.sparkSession
        self._counts = shared_folder(spark, "drift-reference")
        value_counts(self.reference, self.numeric, self.categorical).write.parquet(self._counts)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            self.scored(batch).write.mode("overwrite").parquet(f"{self.path}/scores/batch={batch_id}")
        elif batch_id == 0:
            # the folder exists once a stream has run, also if no window was closed
            batch.sparkSession.createDataFrame([], SCORES).write.mode("overwrite").parquet(f"{self.path}/scores/batch=0")

    def scored(self, closed: DataFrame) -> DataFrame:
        """Scores per window and column; ``slot`` is the window's start in seconds since 1970."""
        spark = closed.sparkSession
        reference = spark.read.parquet(self._counts)
        current = closed.withColumn("slot", F.unix_seconds("window.start"))
        columns = F.array(*[F.lit(c) for c in [*self.numeric, *self.categorical]])
        slots = current.select("slot").distinct().select("slot", F.explode(columns).alias("column_name"))
        zero = F.lit(0).cast("long")
        sides = slots.join(reference, "column_name").select("slot", "column_name", "number", "text", F.col("n").alias("n_ref"), zero.alias("n_cur"))
        sides = sides.unionByName(current.select("slot", "column_name", "number", "text", zero.alias("n_ref"), F.col("n").alias("n_cur")))
        pairs = lambda kind, names: sides.where(F.col("column_name").isin(list(names))).groupBy(
            "slot", "column_name", F.col(kind).alias("value")
        ).agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))
        keys, parts = ["slot", "column_name"], []
        if self.numeric:
            counts = pairs("number", self.numeric)
            # moments of the reference from its counts
            mean = reference.where("number is not null").groupBy("column_name").agg(
                (F.sum(F.col("number") * F.col("n")) / F.sum("n")).alias("_mean")
            )
            off = (F.col("number") - F.col("_mean")) ** 2
            std = reference.join(mean, "column_name").groupBy("column_name").agg(F.sqrt(F.sum(off * F.col("n")) / F.sum("n")).alias("ref_std"))
            parts.append(drift.numeric_statistics(counts, keys, slots.join(std, "column_name"), hot_keys(counts, keys, self.hot_rows)))
        if self.categorical:
            parts.append(drift.categorical_statistics(pairs("text", self.categorical), keys))
        if not parts:
            raise ValueError("no columns to compare")
        stats = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
        return drift.drift_scores(stats, by=["slot"])

    def run(self, stream: DataFrame, ts: str, length: str) -> DataFrame:
        """Score every window that the stream's input closes."""
        core.run_batches(closed_counts(stream, ts, length, self.numeric, self.categorical), self, "drift-progress")
        return self.scores(stream.sparkSession)

    def scores(self, spark: SparkSession) -> DataFrame:
        found = spark.read.schema(SCORES).parquet(f"{self.path}/scores")
        return found.select(
            F.timestamp_seconds("slot").cast("timestamp_ntz").alias("window_start"),
            "column_name", "method", "drift_score", "threshold", "drift_detected",
        )
