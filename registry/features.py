"""Scaling, encoding, selection and split queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtide.functions.columns import flatten_struct
from loomtide.operators import encoding, selection, splitting
from registry.common import Registry, rounded, table

REG = Registry()

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEY = ["l_orderkey", "l_linenumber", "l_partkey"]
_KEYS = ", ".join(KEY)


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem")


def _scaled(spark: SparkSession, folder: str, strategy: str) -> DataFrame:
    data = lines(spark, folder).select(*KEY, *NUM)
    prep = encoding.Preprocessor(numeric=NUM, categorical=[], numeric_strategy=strategy)
    return rounded(prep.fit_transform(data, exclude=KEY, keep=KEY), 5)


def _scale_sql(center: str, scale: str) -> str:
    out = ", ".join(
        f"round(({c} - (SELECT {center.format(c=c)} FROM lineitem)) / (SELECT {scale.format(c=c)} FROM lineitem), 5) + 0.0 AS {c}" for c in NUM
    )
    return f"SELECT {_KEYS}, {out} FROM lineitem"


@REG.add("standard_scale", _scale_sql("avg({c})", "stddev_pop({c})"))
def standard_scale(spark: SparkSession, folder: str) -> DataFrame:
    return _scaled(spark, folder, "standard")


@REG.add("minmax_scale", _scale_sql("min({c})", "max({c}) - min({c})"))
def minmax_scale(spark: SparkSession, folder: str) -> DataFrame:
    return _scaled(spark, folder, "minmax")


@REG.add("robust_scale", _scale_sql("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"))
def robust_scale(spark: SparkSession, folder: str) -> DataFrame:
    return _scaled(spark, folder, "robust")


CAT = ["l_returnflag", "l_linestatus"]


@REG.add(
    "onehot",
    f"""SELECT {_KEYS}, CASE WHEN l_returnflag = 'N' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "l_returnflag_N",
 CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "l_returnflag_R",
 CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "l_linestatus_O" FROM lineitem""",
)
def onehot(spark: SparkSession, folder: str) -> DataFrame:
    prep = encoding.Preprocessor(numeric=[], categorical=CAT)
    return prep.fit_transform(lines(spark, folder).select(*KEY, *CAT), exclude=KEY, keep=KEY)


@REG.add(
    "ordinal",
    """SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS DOUBLE) AS p_brand,
 CAST(CASE WHEN p_type <> 'PROMO' THEN (SELECT count(DISTINCT b.p_type) FROM part b WHERE b.p_type < a.p_type AND b.p_type <> 'PROMO') ELSE -1 END AS DOUBLE) AS p_type
 FROM part a""",
)
def ordinal(spark: SparkSession, folder: str) -> DataFrame:
    """Fitted without one type, which is then unknown."""
    parts = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type")
    prep = encoding.Preprocessor(numeric=[], categorical=["p_brand", "p_type"], categorical_strategy="ordinal")
    prep.fit(parts.where("p_type != 'PROMO'"), exclude=["p_partkey"])
    return prep.transform(parts, keep=["p_partkey"])


@REG.add(
    "ordinal_large",
    "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS DOUBLE) AS c_name FROM customer",
)
def ordinal_large(spark: SparkSession, folder: str) -> DataFrame:
    """More categories than fit into a literal: the dictionary is a table and encoding is a join."""
    data = table(spark, folder, "customer").select("c_custkey", "c_name")
    prep = encoding.Preprocessor(numeric=[], categorical=["c_name"], categorical_strategy="ordinal", max_wide=100)
    return prep.fit_transform(data, exclude=["c_custkey"], keep=["c_custkey"])


@REG.add(
    "preprocessed_table",
    f"""SELECT {_KEYS}, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem), 5) + 0.0 AS l_quantity,
 CASE WHEN l_returnflag = 'N' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "l_returnflag_N",
 CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "l_returnflag_R", l_shipdate FROM lineitem""",
)
def preprocessed_table(spark: SparkSession, folder: str) -> DataFrame:
    """Numeric, categorical and passed-through columns together."""
    data = lines(spark, folder).select(*KEY, "l_shipdate", "l_returnflag", "l_quantity")
    prep = encoding.Preprocessor(numeric=["l_quantity"], categorical=["l_returnflag"])
    return rounded(prep.fit_transform(data, exclude=KEY, keep=KEY), 5)


FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]

_F_CLASS_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, round((sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))), 5) AS score,
 CAST(count(*) - 1 AS BIGINT) AS dof1, CAST(sum(n) - count(*) AS BIGINT) AS dof2 FROM
 (SELECT count({c}) AS n, avg({c}) AS m, var_pop({c}) * count({c}) AS w, (SELECT avg({c}) FROM lineitem) AS g FROM lineitem GROUP BY l_returnflag)"""
    for c in FEATS
)


@REG.add("f_classif", _F_CLASS_SQL)
def f_classif(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(selection.f_classif(lines(spark, folder), FEATS, "l_returnflag"), 5)


REG_FEATS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@REG.add(
    "f_regression",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(pow(corr({c}, l_extendedprice), 2) / (1 - pow(corr({c}, l_extendedprice), 2)) * (count(*) - 2), 4) AS score FROM lineitem"
        for c in REG_FEATS
    ),
)
def f_regression(spark: SparkSession, folder: str) -> DataFrame:
    scores = selection.f_regression(lines(spark, folder), REG_FEATS, "l_extendedprice")
    return rounded(scores.select("feature", "score"), 4)


def _mi_sql(features: list[str], y: str) -> str:
    parts = []
    for c in features:
        edges = " + ".join(f"CAST({c} > (SELECT quantile_cont({c}, {i / 10}) FROM lineitem) AS INT)" for i in range(1, 10))
        parts.append(
            f"""SELECT '{c}' AS feature, round(sum(n / t * ln(n * t / (nx * ny))), 6) AS score FROM (SELECT *,
 sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS t FROM
 (SELECT {edges} AS x, {y} AS y, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY ALL))"""
        )
    return " UNION ALL ".join(parts)


@REG.add("mutual_info", _mi_sql(FEATS, "l_returnflag"))
def mutual_info(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(selection.mutual_info(lines(spark, folder), FEATS, "l_returnflag"))


@REG.add(
    "mutual_info_regression",
    _mi_sql(["l_quantity", "l_tax"], " + ".join(f"CAST(l_extendedprice > (SELECT quantile_cont(l_extendedprice, {i / 10}) FROM lineitem) AS INT)" for i in range(1, 10))),
)
def mutual_info_regression(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        selection.mutual_info(lines(spark, folder), ["l_quantity", "l_tax"], "l_extendedprice", discrete_target=False)
    )


@REG.add(
    "k_best",
    f"""WITH s AS ({_F_CLASS_SQL}), b AS (SELECT feature FROM s ORDER BY score DESC LIMIT 3)
SELECT {_KEYS}, """ + ", ".join(f"CASE WHEN '{c}' IN (SELECT feature FROM b) THEN CAST({c} AS DOUBLE) ELSE 0 END AS {c}" for c in FEATS if c != "l_linenumber") + " FROM lineitem",
)
def k_best(spark: SparkSession, folder: str) -> DataFrame:
    """The selected columns; unselected ones are shown as 0 so that the result has fixed columns."""
    data = lines(spark, folder)
    kept = selection.select_features(data, FEATS, "l_returnflag", "k_best", k=3)
    shown = [c for c in FEATS if c != "l_linenumber"]
    return data.select(*KEY, *[(F.col(c) if c in kept else F.lit(0.0)).cast("double").alias(c) for c in shown])


@REG.add(
    "best_percentile",
    f"""WITH s AS ({_F_CLASS_SQL}) SELECT feature, score > (SELECT quantile_cont(score, 0.4) FROM s) AS selected FROM s""",
)
def best_percentile(spark: SparkSession, folder: str) -> DataFrame:
    scores = selection.f_classif(lines(spark, folder), FEATS, "l_returnflag")
    kept = selection.best_percentile(scores, FEATS, 60)
    return scores.select("feature", F.col("feature").isin(kept).alias("selected"))


_RANK = "row_number() OVER ({p} ORDER BY md5('42:' || o_orderkey))"


@REG.add(
    "onehot_sparse",
    """WITH r AS (SELECT c_custkey, dense_rank() OVER (ORDER BY c_name) - 2 AS position FROM customer)
SELECT c_custkey, position, CAST(1 AS DOUBLE) AS value FROM r WHERE position >= 0""",
)
def onehot_sparse(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.onehot_pairs(table(spark, folder, "customer"), ["c_custkey"], "c_name")


@REG.add(
    "random_split",
    f"""SELECT o_orderkey, CASE WHEN {_RANK.format(p="")} <= ceil((SELECT count(*) FROM orders) * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM orders""",
)
def random_split(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.random_split(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey")


@REG.add(
    "stratified_split",
    f"""WITH r AS (SELECT o_orderkey, o_orderstatus, {_RANK.format(p="PARTITION BY o_orderstatus")} AS k,
  ceil(count(*) OVER (PARTITION BY o_orderstatus) * 0.2::DOUBLE) AS t, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderkey, o_orderstatus, CASE WHEN k <= t THEN 'test' WHEN k <= t + ceil((n - t) * (0.1::DOUBLE / (1 - 0.2::DOUBLE))) THEN 'validation' ELSE 'train' END AS split FROM r""",
)
def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return splitting.stratified_split(orders, "o_orderkey", "o_orderstatus")


@REG.add(
    "stratified_split_null_class",
    f"""WITH o AS (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS o_orderstatus FROM orders),
r AS (SELECT o_orderkey, o_orderstatus, {_RANK.format(p="PARTITION BY o_orderstatus")} AS k,
  ceil(count(*) OVER (PARTITION BY o_orderstatus) * 0.2::DOUBLE) AS t, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM o)
SELECT o_orderkey, o_orderstatus, CASE WHEN k <= t THEN 'test' WHEN k <= t + ceil((n - t) * (0.1::DOUBLE / (1 - 0.2::DOUBLE))) THEN 'validation' ELSE 'train' END AS split FROM r""",
)
def stratified_split_null_class(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("o_orderstatus"))
    return splitting.stratified_split(orders, "o_orderkey", "o_orderstatus")


@REG.add(
    "cv_folds",
    f"""WITH r AS (SELECT o_orderkey, {_RANK.format(p="")} AS k, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CAST(""" + " + ".join(f"CASE WHEN k > ceil(n * {i}::DOUBLE / 5) THEN 1 ELSE 0 END" for i in range(1, 5)) + " AS INTEGER) AS fold FROM r",
)
def cv_folds(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.cv_folds(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey")


@REG.add("profile_sample", "SELECT * FROM customer ORDER BY md5('42:' || c_custkey) LIMIT 1000")
def profile_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The sampling operator: up to a thousand rows to profile."""
    return splitting.repeatable_sample(table(spark, folder, "customer"), "c_custkey", 1000)


@REG.add("head_rows", "SELECT * FROM part ORDER BY p_partkey LIMIT 50")
def head_rows(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.head(table(spark, folder, "part"), "p_partkey", 50)


@REG.add(
    "flattened_struct",
    "SELECT event_id, user_id AS who_id, event_type AS what_type, CAST(json_extract(props, '$.k') AS BIGINT) AS what_props_k FROM events",
)
def flattened_struct(spark: SparkSession, folder: str) -> DataFrame:
    nested = table(spark, folder, "events").select(
        "event_id",
        F.struct(F.col("user_id").alias("id")).alias("who"),
        F.struct(F.col("event_type").alias("type"), F.from_json("props", "k long").alias("props")).alias("what"),
    )
    return flatten_struct(nested)


@REG.add("features_without_target", "SELECT l_quantity, l_discount, l_tax FROM lineitem")
def features_without_target(spark: SparkSession, folder: str) -> DataFrame:
    data = lines(spark, folder).select("l_quantity", "l_discount", "l_tax", "l_returnflag")
    return data.drop("l_returnflag")
