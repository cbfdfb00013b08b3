"""The monitoring job: one plan for all models, results appended to the history and exported."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtide.operators import health
from loomtide.sources.files import write_table


def run_checks(
    models: DataFrame, data: DataFrame, run_ts: Column, numeric: Sequence[str], categorical: Sequence[str],
    label: str | None = None, prediction: str | None = None, model_type: str = "classification", history: str | None = None,
) -> DataFrame:
    """Check every model of the ``models`` table against its reference and return one record per model.

    ``data`` holds the reference and current rows of all models; models without current rows get status skipped.
    With ``history`` the records are written there, a folder per date and run: a repeated run replaces its own, and only
    that folder is read back.
    """
    runs = health.monitoring_run(data, run_ts, numeric, categorical, label, prediction, model_type)
    if history is None:
        return health.check_list(models, runs)
    spark = data.sparkSession
    day, key = spark.range(1).select(F.date_format(run_ts, "yyyy-MM-dd"), F.unix_micros(run_ts.cast("timestamp"))).first()
    write_table(runs, f"{history}/run_date={day}/run={key}", "parquet", mode="overwrite")
    written = spark.read.schema(runs.schema).parquet(f"{history}/run_date={day}/run={key}")
    return health.check_list(models, written)
