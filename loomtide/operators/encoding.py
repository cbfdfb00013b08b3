"""Scaling and encoding: fitting is an aggregation, transforming is a projection."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtide.functions.columns import categorical_columns, numeric_columns, present, quoted
from loomtide.operators.ordered import column_quantiles
from loomtide.session import parallelism, shared_folder

MAX_WIDE = 1000


def _one_pass(df: DataFrame, columns: Sequence[str], stats: Callable[[Column], tuple[Column, Column]]) -> dict[str, tuple[float, float]]:
    aggs = []
    for i, name in enumerate(columns):
        center, scale = stats(present(df, name).cast("double"))
        aggs += [center.alias(f"c{i}"), scale.alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return {name: (row[f"c{i}"], row[f"s{i}"]) for i, name in enumerate(columns)}


def _standard(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    return _one_pass(df, columns, lambda x: (F.avg(x), F.stddev_pop(x)))


def _minmax(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    return _one_pass(df, columns, lambda x: (F.min(x), F.max(x) - F.min(x)))


def _robust(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    values = df.select(*[present(df, c).cast("double").alias(c) for c in columns])
    found = column_quantiles(values, columns, {"q1": 0.25, "q2": 0.5, "q3": 0.75}).collect()
    return {row["column_name"]: (row["q2"], row["q3"] - row["q1"]) for row in found}


SCALERS: dict[str, Callable[[DataFrame, Sequence[str]], dict[str, tuple[float, float]]]] = {
    "standard": _standard,
    "minmax": _minmax,
    "robust": _robust,
}
ENCODERS = ("onehot", "ordinal", "label")


def category_dictionary(df: DataFrame, column: str) -> DataFrame:
    """Every category with its position in sorted order, for any number of categories.

    The sorted values are written once, so that the range partition they fell into is a fixed property of the row;
    positions are ranks within a partition, shifted by the sizes of the partitions before it.
    """
    spark = df.sparkSession
    path = shared_folder(spark, "categories")
    (
        df.select(quoted(column).cast("string").alias("value")).where("value is not null").distinct()
        .repartitionByRange(parallelism(spark), "value")
        .withColumn("_part", F.spark_partition_id())
        .write.parquet(path)
    )
    values = spark.read.parquet(path)
    sizes = values.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range partition
    across = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(W.partitionBy("_part").orderBy("value"))
    return values.join(F.broadcast(offsets), "_part").select("value", (F.col("_offset") + rank - 1).alias("code"))


def onehot_pairs(df: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """One-hot encoding for any number of categories: (key, position, 1.0) for each row's one column that isn't zero.

    Positions are those of the categories in sorted order without the first, which is all zeros like a missing value.
    """
    codes = category_dictionary(df, column).where("code > 0").select(
        F.col("value").alias("_value"), (F.col("code") - 1).alias("position")
    )
    rows = df.select(*key, quoted(column).cast("string").alias("_of")).where("_of is not null")
    return rows.join(codes, F.col("_of") == F.col("_value")).select(*key, "position", F.lit(1.0).alias("value"))


@dataclass
class Preprocessor:
    """Scales numeric columns, encodes categorical ones and passes the rest through, in this order."""

    numeric: list[str] | None = None
    categorical: list[str] | None = None
    numeric_strategy: str = "standard"
    categorical_strategy: str = "onehot"
    max_wide: int = MAX_WIDE
    scaling: dict[str, list[float]] = field(default_factory=dict)
    categories: dict[str, list[str]] = field(default_factory=dict)
    dictionaries: dict[str, str] = field(default_factory=dict)
    remainder: list[str] = field(default_factory=list)
    fitted: bool = False

    def __post_init__(self) -> None:
        if self.numeric_strategy not in SCALERS:
            raise ValueError(f"unknown numeric strategy {self.numeric_strategy}; known are {sorted(SCALERS)}")
        if self.categorical_strategy not in ENCODERS:
            raise ValueError(f"unknown categorical strategy {self.categorical_strategy}; known are {ENCODERS}")

    def fit(self, df: DataFrame, exclude: Sequence[str] = ()) -> Preprocessor:
        if self.numeric is None:
            self.numeric = [c for c in numeric_columns(df) if c not in exclude]
        if self.categorical is None:
            self.categorical = [c for c in categorical_columns(df) if c not in exclude]
        taken = {*self.numeric, *self.categorical, *exclude}
        self.remainder = [c for c in df.columns if c not in taken]
        if self.numeric:
            found = SCALERS[self.numeric_strategy](df, self.numeric)
            for name in self.numeric:
                center, scale = found.get(name, (None, None))
                # a constant column has no spread: it is only centred
                self.scaling[name] = [center or 0.0, scale or 1.0]
        if self.categorical and self.categorical_strategy != "onehot":
            # one plan for any number of categories: a written dictionary that is joined
            for name in self.categorical:
                self.dictionaries[name] = shared_folder(df.sparkSession, "dictionary")
                category_dictionary(df, name).write.parquet(self.dictionaries[name])
        elif self.categorical:
            pairs = (
                df.select(*[quoted(c).cast("string").alias(c) for c in self.categorical])
                .unpivot([], self.categorical, "column_name", "value").where("value is not null").distinct()
            )
            sizes = {row["column_name"]: row["count"] for row in pairs.groupBy("column_name").count().collect()}
            narrow = [c for c in self.categorical if sizes.get(c, 0) <= self.max_wide]
            self.categories = {c: [] for c in narrow}
            for row in pairs.where(F.col("column_name").isin(narrow)).collect():
                self.categories[row["column_name"]].append(row["value"])
            for found in self.categories.values():
                found.sort()
            for name in self.categorical:
                if name not in self.categories:
                    raise ValueError(f"{name} has {sizes[name]} categories, more columns than max_wide; use onehot_pairs or ordinal")
        self.fitted = True
        return self

    def _check(self) -> None:
        if not self.fitted:
            raise ValueError("the preprocessor is not fitted")

    def output_names(self) -> list[str]:
        self._check()
        names = list(self.numeric)
        for name in self.categorical:
            if self.categorical_strategy == "onehot":
                names += [f"{name}_{v}" for v in self.categories[name][1:]]
            else:
                names.append(name)
        return names + self.remainder

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """The prepared columns, preceded by the ``keep`` columns as they are.

        Unknown categories become all zeros (one-hot) or -1 (ordinal).
        """
        self._check()
        for name, path in self.dictionaries.items():
            codes = df.sparkSession.read.parquet(path).select(
                F.col("value").alias(f"_value_{name}"), F.col("code").alias(f"_code_{name}")
            )
            df = df.join(codes, quoted(name).cast("string") == F.col(f"_value_{name}"), "left")
        out: list[Column] = [quoted(c) for c in keep]
        for name in self.numeric:
            center, scale = self.scaling[name]
            out.append(((present(df, name).cast("double") - F.lit(center)) / F.lit(scale)).alias(name))
        for name in self.categorical:
            value = quoted(name).cast("string")
            if name in self.dictionaries:
                out.append(F.coalesce(F.col(f"_code_{name}"), F.lit(-1)).cast("double").alias(name))
            else:
                out += [
                    F.when(value == v, 1.0).otherwise(0.0).alias(f"{name}_{v}") for v in self.categories[name][1:]
                ]
        return df.select(*out, *[quoted(c) for c in self.remainder if c not in keep])

    def fit_transform(self, df: DataFrame, exclude: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
        return self.fit(df, exclude).transform(df, keep)

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the fitted values as one readable JSON row; dictionaries are copied next to it."""
        self._check()
        state = asdict(self)
        for name, source in self.dictionaries.items():
            state["dictionaries"][name] = f"{path}/dictionary={name}"
            spark.read.parquet(source).write.mode("overwrite").parquet(state["dictionaries"][name])
        row = spark.createDataFrame([(json.dumps(state),)], "value string")
        row.coalesce(1).write.mode("overwrite").text(f"{path}/state")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Preprocessor:
        return Preprocessor(**json.loads(spark.read.text(f"{path}/state").first()["value"]))
