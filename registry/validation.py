"""Profile and validation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtide.operators import profile, rules
from registry.common import Registry, as_doubles, rounded, table

REG = Registry()

ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
LINES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
         "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _sql_profile(name: str, kind: str, source: str, by: str = "") -> str:
    number = kind in ("bigint", "int", "double")
    value = f"CAST({name} AS DOUBLE)" if number else "CAST(NULL AS DOUBLE)"
    length = f"CAST(length({name}) AS DOUBLE)" if kind == "string" else "CAST(NULL AS DOUBLE)"
    group = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    return f"""SELECT {group}'{name}' AS column_name, '{kind}' AS dtype, count(*) AS n,
  count(*) - count({name}) AS n_null, round((count(*) - count({name})) / count(*), 6) AS null_share,
  round(min({value}), 6) AS min_value, round(max({value}), 6) AS max_value, round(avg({value}), 6) AS mean,
  round(stddev_pop({value}), 6) AS std_pop, min({length}) AS min_length, max({length}) AS max_length
FROM {source}{tail}"""


PART_TYPES = {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int",
              "p_retailprice": "double"}
DOC_TYPES = {"doc_id": "bigint", "text": "string", "n_chars": "bigint"}


@REG.add("column_profile", " UNION ALL ".join(_sql_profile(c, t, "part") for c, t in PART_TYPES.items()))
def column_profile(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(as_doubles(profile.column_profile(table(spark, folder, "part")), ["min_length", "max_length"]))


@REG.add("document_profile_by_lang", " UNION ALL ".join(_sql_profile(c, t, "documents", "lang") for c, t in DOC_TYPES.items()))
def document_profile_by_lang(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("lang", *DOC_TYPES)
    return rounded(as_doubles(profile.column_profile(docs, by=["lang"]), ["min_length", "max_length"]))


@REG.add(
    "dataset_summary",
    """SELECT count(*) AS total_rows, CAST(11 AS BIGINT) AS total_columns, CAST(8 AS BIGINT) AS numeric_columns,
       CAST(2 AS BIGINT) AS categorical_columns, CAST(0 AS BIGINT) AS total_nulls, CAST(0 AS DOUBLE) AS share_missing
       FROM lineitem WHERE l_shipdate IS NOT NULL AND l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL""",
)
def dataset_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.dataset_summary(table(spark, folder, "lineitem")))


def sparse_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with gaps that follow from the data: no value on errors, no type where k is below 10."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, folder, "events").select(
        "user_id",
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
        F.when(k >= 10, F.col("event_type")).alias("event_type"),
        k.alias("k"),
    )


SPARSE_SQL = """(SELECT user_id, CASE WHEN event_type <> 'error' THEN value END AS value,
  CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) >= 10 THEN event_type END AS event_type,
  CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)"""


@REG.add(
    "null_checks",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null,
        round(100.0 * (count(*) - count({c})) / count(*), 6) AS null_percent,
        100.0 * (count(*) - count({c})) / count(*) <= 5.0 AS passed FROM {SPARSE_SQL} t"""
        for c in ("user_id", "value", "event_type", "k")
    ),
)
def null_checks(spark: SparkSession, folder: str) -> DataFrame:
    percent = F.col("null_share") * 100
    return rounded(
        profile.column_profile(sparse_events(spark, folder)).select(
            "column_name", "n_null", percent.alias("null_percent"), (percent <= 5.0).alias("passed")
        )
    )


@REG.add(
    "missing_values",
    f"""SELECT event_type, count(*) AS n_rows, CAST(2 * count(*) - count(value) - count(k) AS BIGINT) AS n_missing,
    round((2 * count(*) - count(value) - count(k)) / (2 * count(*)), 6) AS share_missing
    FROM {SPARSE_SQL} t GROUP BY event_type""",
)
def missing_values(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.missing_values(sparse_events(spark, folder), ["value", "k"], by=["event_type"]))


@REG.add(
    "duplicate_rows",
    """SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
       round(100.0 * sum(n - 1) / sum(n), 6) AS duplicate_percent
       FROM (SELECT text, lang, count(*) AS n FROM documents GROUP BY text, lang)""",
)
def duplicate_rows(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.duplicate_rows(table(spark, folder, "documents"), ["text", "lang"]))


@REG.add("deduplicated_rows", "SELECT DISTINCT l_partkey, l_quantity, l_returnflag FROM lineitem")
def deduplicated_rows(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_partkey", "l_quantity", "l_returnflag")
    return profile.deduplicate(lines)


@REG.add(
    "class_balance",
    """SELECT quality, toxic, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY quality), 6) AS share
       FROM labels GROUP BY quality, toxic""",
)
def class_balance(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.class_counts(table(spark, folder, "labels"), "toxic", by=["quality"]))


@REG.add(
    "class_balance_null_group",
    """WITH l AS (SELECT nullif(l_returnflag, 'R') AS l_returnflag, nullif(l_linestatus, 'O') AS l_linestatus FROM lineitem)
       SELECT l_returnflag, l_linestatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 6) AS share
       FROM l GROUP BY l_returnflag, l_linestatus""",
)
def class_balance_null_group(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        F.nullif("l_returnflag", F.lit("R")).alias("l_returnflag"), F.nullif("l_linestatus", F.lit("O")).alias("l_linestatus")
    )
    return rounded(profile.class_counts(lines, "l_linestatus", by=["l_returnflag"]))


_DERIVED = {"o_orderkey": "n", "o_custkey": "n", "o_orderstatus": "s", "o_totalprice": "n", "o_orderpriority": "s"}


def _derived_sql() -> str:
    parts = [
        "SELECT 'row_count' AS kind, CAST(NULL AS VARCHAR) AS column_name, CAST(1 AS DOUBLE) AS min_value, CAST(NULL AS DOUBLE) AS max_value, CAST(1 AS DOUBLE) AS mostly",
        "SELECT 'column_set', NULL, NULL, NULL, CAST(1 AS DOUBLE)",
    ]
    for c in ORDERS:
        parts.append(f"SELECT 'not_null', '{c}', NULL, NULL, CAST(1 AS DOUBLE) FROM base HAVING count(*) = count({c})")
        if _DERIVED.get(c) == "n":
            parts.append(
                f"SELECT 'between', '{c}', round(min({c}) - (max({c}) - min({c})) * 0.1, 6), "
                f"round(max({c}) + (max({c}) - min({c})) * 0.1, 6), CAST(1 AS DOUBLE) FROM base"
            )
        elif _DERIVED.get(c) == "s":
            parts.append(
                f"SELECT 'length_between', '{c}', CAST(min(length({c})) AS DOUBLE), CAST(max(length({c})) AS DOUBLE), "
                f"CAST(1 AS DOUBLE) FROM base"
            )
    return "WITH base AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01') " + " UNION ALL ".join(parts)


def base_orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").where("o_orderdate < timestamp_ntz'1998-01-01'")


@REG.add("derived_rules", _derived_sql())
def derived_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = rules.derive_rules(base_orders(spark, folder), "orders")
    return rounded(
        rules.rules_frame(spark, found).select(
            "kind", F.col("column").alias("column_name"), "min_value", "max_value", "mostly"
        )
    )


def _results_sql() -> str:
    """Orders from 1998 on, judged by the ranges of those before."""
    parts = ["SELECT 'row_count' AS kind, CAST(NULL AS VARCHAR) AS column_name, count(*) >= 1 AS success, "
             "CAST(0 AS BIGINT) AS unexpected_count, CAST(0 AS DOUBLE) AS unexpected_share FROM later",
             "SELECT 'column_set', NULL, true, CAST(0 AS BIGINT), CAST(0 AS DOUBLE)"]
    for c in ORDERS:
        parts.append(f"SELECT 'not_null', '{c}', count(*) = count({c}), count(*) - count({c}), "
                     f"round((count(*) - count({c})) / count(*), 6) FROM later")
        kind = _DERIVED.get(c)
        if kind:
            v = c if kind == "n" else f"length({c})"
            pad = "(max(v) - min(v)) * 0.1" if kind == "n" else "0"
            parts.append(
                f"SELECT '{'between' if kind == 'n' else 'length_between'}', '{c}', count(*) FILTER (bad) = 0, "
                f"count(*) FILTER (bad), round(count(*) FILTER (bad) / count(*), 6) FROM (SELECT {v} < lo OR {v} > hi AS bad "
                f"FROM later, (SELECT min(v) - {pad} AS lo, max(v) + {pad} AS hi FROM (SELECT {v} AS v FROM base)))"
            )
    return ("WITH base AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), "
            "later AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01') " + " UNION ALL ".join(parts))


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    found = rules.derive_rules(base_orders(spark, folder), "orders")
    later = table(spark, folder, "orders").where("o_orderdate >= timestamp_ntz'1998-01-01'")
    return rules.validate(later, found, "from_1998")


@REG.add("rule_results", _results_sql())
def rule_results(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_judged(spark, folder).select("kind", "column_name", "success", "unexpected_count", "unexpected_share"))


@REG.add(
    "validation_summary",
    f"""SELECT 'orders' AS suite, 'from_1998' AS run_name, count(*) AS evaluated, count(*) FILTER (success) AS successful,
    count(*) FILTER (NOT success) AS unsuccessful, round(100.0 * count(*) FILTER (success) / count(*), 6) AS success_percent,
    bool_and(success) AS success FROM ({_results_sql()})""",
)
def validation_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rules.validation_summary(_judged(spark, folder)))


@REG.add(
    "test_suite_summary",
    f"""SELECT count(*) AS total_tests, count(*) FILTER (success) AS success_tests,
    count(*) FILTER (NOT success) AS failed_tests, bool_and(success) AS all_passed,
    '{{"SUCCESS":' || count(*) FILTER (success) || CASE WHEN bool_and(success) THEN '' ELSE ',"FAIL":' ||
    count(*) FILTER (NOT success) END || '}}' AS by_status FROM ({_results_sql()})""",
)
def test_suite_summary(spark: SparkSession, folder: str) -> DataFrame:
    out = rules.test_suite_summary(_judged(spark, folder), F.when(F.col("success"), "SUCCESS").otherwise("FAIL"))
    return out.withColumn("by_status", F.to_json("by_status"))


@REG.add(
    "quality_checks",
    f"""WITH t AS {SPARSE_SQL} SELECT 'row_count' AS name, count(*) >= 100 AS passed, '>= 100' AS expected,
    CAST(count(*) AS VARCHAR) AS actual FROM t UNION ALL """
    + " UNION ALL ".join(
        f"SELECT 'null_percentage_{c}', 100.0 * (count(*) - count({c})) / count(*) <= 5.0, '<= 5.0%', "
        f"printf('%.2f%%', 100.0 * (count(*) - count({c})) / count(*)) FROM t"
        for c in ("user_id", "value", "event_type", "k")
    )
    + """ UNION ALL SELECT 'target_classes', count(DISTINCT event_type) >= 2, '>= 2', CAST(count(DISTINCT event_type) AS VARCHAR) FROM t
    UNION ALL SELECT 'duplicates', 100.0 * sum(n - 1) / sum(n) < 10, '< 10%', printf('%.2f%%', 100.0 * sum(n - 1) / sum(n))
    FROM (SELECT count(*) AS n FROM t GROUP BY user_id, value, event_type, k)""",
)
def quality_checks(spark: SparkSession, folder: str) -> DataFrame:
    return rules.quality_checks(sparse_events(spark, folder), "event_type")


@REG.add(
    "dq_ruleset",
    "SELECT 'column_count' AS kind, CAST(NULL AS VARCHAR) AS column_name, true AS success, CAST(0 AS BIGINT) AS unexpected_count UNION ALL "
    + " UNION ALL ".join(
        f"SELECT 'is_complete', '{c}', count({c}) = count(*), count(*) - count({c}) FROM {SPARSE_SQL} t" for c in ("user_id", "value", "event_type")
    )
    + " UNION ALL SELECT 'column_type', 'value', true, 0 UNION ALL SELECT 'column_type', 'event_type', false, 1",
)
def dq_ruleset(spark: SparkSession, folder: str) -> DataFrame:
    declared = rules.declared_quality_rules("events", ["user_id", "value", "event_type"], ["value", "event_type"])
    return rules.validate(sparse_events(spark, folder), declared, "declared").select(
        "kind", "column_name", "success", "unexpected_count"
    )


@REG.add(
    "quarantined_rows",
    """SELECT event_id, event_type, value, CASE WHEN event_type = 'error' AND value > 100 THEN '[1,2]'
       WHEN event_type = 'error' THEN '[1]' ELSE '[2]' END AS broken_rules
       FROM events WHERE event_type = 'error' OR value > 100""",
)
def quarantined_rows(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select(
        "event_id", "event_type", "value", F.when(F.col("event_type") != "error", F.lit(1)).alias("checked")
    )
    limits = [rules.Rule("events", 1, "not_null", "checked"), rules.Rule("events", 2, "between", "value", 0.0, 100.0)]
    bad = rules.quarantine(events, limits)[1]
    return bad.select("event_id", "event_type", "value", F.to_json("broken_rules").alias("broken_rules"))


def _summary_sql() -> str:
    half = "CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'reference' ELSE 'current' END AS dataset"
    src = f"(SELECT *, {half} FROM events)"
    parts = []
    for c, number in (("event_type", False), ("value", True)):
        text = f"CAST({c} AS VARCHAR)"
        stat = (lambda f: f) if number else (lambda f: "CAST(NULL AS DOUBLE)")
        parts.append(f"""SELECT a.dataset, '{c}' AS column_name, a.n, a.n_missing, a.n_distinct, t.top_value, t.top_count,
          a.mean, a.min_value, a.max_value, a.std, a.q25, a.median, a.q75 FROM
        (SELECT dataset, count(*) AS n, count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS n_distinct,
          {stat(f'round(avg({c}), 8)')} AS mean, {stat(f'min({c})')} AS min_value, {stat(f'max({c})')} AS max_value,
          {stat(f'round(stddev_samp({c}), 8)')} AS std, {stat(f'round(quantile_cont({c}, 0.25), 8)')} AS q25,
          {stat(f'round(quantile_cont({c}, 0.5), 8)')} AS median, {stat(f'round(quantile_cont({c}, 0.75), 8)')} AS q75
         FROM {src} GROUP BY dataset) a JOIN
        (SELECT dataset, {text} AS top_value, count(*) AS top_count FROM {src} GROUP BY 1, 2
         QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY count(*) DESC, {text}) = 1) t ON a.dataset = t.dataset""")
    return " UNION ALL ".join(parts)


@REG.add("quality_summary", _summary_sql())
def quality_summary(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").withColumn(
        "dataset", F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "reference").otherwise("current")
    )
    return rounded(profile.quality_summary(events, ["event_type", "value"], by=["dataset"]), 8)
