"""Validation rules as data: derive them from a profile, judge a table, gate a job, split off bad rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtide.functions.columns import categorical_columns, missing, numeric_columns, present, quoted, ratio
from loomtide.operators.profile import column_profile, dataset_summary, duplicate_rows

RULES_SCHEMA = (
    "suite string, rule_id int, kind string, column string, min_value double, max_value double, mostly double, "
    "column_set array<string>, exact boolean, type_name string"
)


@dataclass(frozen=True)
class Rule:
    suite: str
    rule_id: int
    kind: str
    column: str | None = None
    min_value: float | None = None
    max_value: float | None = None
    mostly: float = 1.0
    column_set: tuple[str, ...] | None = None
    exact: bool = False
    type_name: str | None = None


class ValidationFailed(ValueError):
    """Raised by ``require_valid`` with the failed rules in the message."""


def rules_frame(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    rows = [{**asdict(rule), "column_set": list(rule.column_set) if rule.column_set else None} for rule in rules]
    return spark.createDataFrame(rows, RULES_SCHEMA)


def rules_from_frame(frame: DataFrame) -> list[Rule]:
    """Rule rows as objects; their number is bounded by the number of columns, not of data rows."""
    return [
        Rule(**{**row.asDict(), "column_set": tuple(row["column_set"]) if row["column_set"] else None})
        for row in frame.orderBy("suite", "rule_id").collect()
    ]


def derive_rules(
    df: DataFrame, suite: str, strict_below: float = 0.05, slack: float = 0.01, buffer: float = 0.1
) -> list[Rule]:
    """Rules a table's own profile suggests.

    At least one row; the column set is contained; not-null per column (strict while the null share is below
    ``strict_below``, otherwise with that much tolerance plus ``slack``); numeric range widened by ``buffer`` of
    its span on both sides; string length range. Columns without any value get no range rule.
    """
    profile = {row["column_name"]: row for row in column_profile(df).collect()}
    rules = [Rule(suite, 1, "row_count", min_value=1.0), Rule(suite, 2, "column_set", column_set=tuple(df.columns))]

    def add(kind: str, **fields: object) -> None:
        rules.append(Rule(suite, len(rules) + 1, kind, **fields))

    for name in df.columns:
        seen = profile[name]
        share = seen["null_share"]
        add("not_null", column=name, mostly=1.0 if share < strict_below else max(0.0, 1.0 - share - slack))
        if seen["min_value"] is not None:
            margin = (seen["max_value"] - seen["min_value"]) * buffer
            add("between", column=name, min_value=seen["min_value"] - margin, max_value=seen["max_value"] + margin)
        elif seen["min_length"] is not None:
            add("length_between", column=name, min_value=float(seen["min_length"]), max_value=float(seen["max_length"]))
    return rules


def declared_suite(suite: str, columns: Sequence[str]) -> list[Rule]:
    """The fixed suite: at least one row and exactly these columns."""
    return [Rule(suite, 1, "row_count", min_value=1.0), Rule(suite, 2, "column_set", column_set=tuple(columns), exact=True)]


def declared_quality_rules(suite: str, complete: Sequence[str], numeric: Sequence[str]) -> list[Rule]:
    """Declared table rules: some columns, complete columns, numeric columns."""
    rules = [Rule(suite, 1, "column_count", min_value=1.0)]
    rules += [Rule(suite, 2 + i, "is_complete", column=c) for i, c in enumerate(complete)]
    rules += [Rule(suite, 2 + len(complete) + i, "column_type", column=c, type_name="NUMERIC") for i, c in enumerate(numeric)]
    return rules


def row_is_bad(df: DataFrame, rule: Rule) -> Column:
    """True for rows that break a row-level rule; missing values only break ``not_null``."""
    if rule.kind in ("not_null", "is_complete"):
        return missing(df, rule.column)
    value = F.length(quoted(rule.column)) if rule.kind == "length_between" else present(df, rule.column)
    bad = F.lit(False)
    if rule.min_value is not None:
        bad = bad | (value < F.lit(rule.min_value))
    if rule.max_value is not None:
        bad = bad | (value > F.lit(rule.max_value))
    return F.coalesce(bad, F.lit(False))


def _outcome(success: Column, observed: Column, bad: Column | None = None, of: Column | None = None) -> list[Column]:
    return [
        success.alias("success"),
        observed.cast("double").alias("observed"),
        (bad if bad is not None else F.lit(0)).cast("long").alias("unexpected_count"),
        (ratio(bad, of, 0.0) if bad is not None else F.lit(0.0)).alias("unexpected_share"),
    ]


def _within(value: Column, rule: Rule) -> Column:
    ok = F.lit(True)
    if rule.min_value is not None:
        ok = ok & (value >= F.lit(rule.min_value))
    if rule.max_value is not None:
        ok = ok & (value <= F.lit(rule.max_value))
    return ok


def _row_count(df: DataFrame, rule: Rule) -> list[Column]:
    n = F.count(F.lit(1))
    return _outcome(_within(n, rule), n)


def _column_set(df: DataFrame, rule: Rule) -> list[Column]:
    absent = set(rule.column_set) - set(df.columns)
    extra = set(df.columns) - set(rule.column_set)
    # count keeps the expression an aggregate, so that it runs with the others
    wrong = F.lit(len(absent) + (len(extra) if rule.exact else 0)) + F.count(F.lit(None))
    return _outcome(wrong == 0, F.lit(len(df.columns)), wrong, F.lit(max(1, len(rule.column_set))))


def _row_rule(df: DataFrame, rule: Rule) -> list[Column]:
    bad = F.count_if(row_is_bad(df, rule))
    considered = F.count(F.lit(1)) if rule.kind in ("not_null", "is_complete") else F.count_if(~missing(df, rule.column))
    share = ratio(bad, considered, 0.0)
    return _outcome(share <= F.lit(1.0 - rule.mostly), share, bad, considered)


def _column_count(df: DataFrame, rule: Rule) -> list[Column]:
    n = F.lit(len(df.columns)) + F.count(F.lit(None))
    return _outcome(_within(n, rule), n)


def _column_type(df: DataFrame, rule: Rule) -> list[Column]:
    family = "ABSENT"
    if rule.column in df.columns:
        dtype = df.schema[rule.column].dataType
        family = "NUMERIC" if isinstance(dtype, T.NumericType) else dtype.simpleString().upper()
    wrong = F.lit(int(family != rule.type_name)) + F.count(F.lit(None))
    return _outcome(wrong == 0, F.lit(1) - wrong, wrong, F.lit(1))


RULE_KINDS: dict[str, Callable[[DataFrame, Rule], list[Column]]] = {
    "row_count": _row_count,
    "column_set": _column_set,
    "not_null": _row_rule,
    "between": _row_rule,
    "length_between": _row_rule,
    "column_count": _column_count,
    "is_complete": _row_rule,
    "column_type": _column_type,
}
ROW_KINDS = ("not_null", "is_complete", "between", "length_between")


def validate(df: DataFrame, rules: Sequence[Rule], run_name: str) -> DataFrame:
    """Judge a table by all rules in one pass; one result row per rule.

    A rule on a column the table lacks fails.
    """
    unknown = {rule.kind for rule in rules} - set(RULE_KINDS)
    if unknown:
        raise ValueError(f"unknown rule kinds {sorted(unknown)}; known are {sorted(RULE_KINDS)}")
    results = []
    for rule in rules:
        absent = rule.kind in ROW_KINDS and rule.column not in df.columns
        n = F.count(F.lit(1))
        outcome = _outcome(n < 0, F.lit(None), n, n) if absent else RULE_KINDS[rule.kind](df, rule)
        results.append(
            F.struct(
                F.lit(rule.suite).alias("suite"),
                F.lit(run_name).alias("run_name"),
                F.lit(rule.rule_id).alias("rule_id"),
                F.lit(rule.kind).alias("kind"),
                F.lit(rule.column).cast("string").alias("column_name"),
                *outcome,
            )
        )
    return df.agg(F.array(*results).alias("_results")).select(F.inline("_results"))


def validation_summary(results: DataFrame) -> DataFrame:
    """Evaluated, successful and failed rules per suite and run; success means that all passed."""
    n, good = F.count(F.lit(1)), F.count_if("success")
    return results.groupBy("suite", "run_name").agg(
        n.alias("evaluated"),
        good.alias("successful"),
        (n - good).alias("unsuccessful"),
        (ratio(good, n, 0.0) * 100).alias("success_percent"),
        F.bool_and("success").alias("success"),
    )


def test_suite_summary(results: DataFrame, status: Column) -> DataFrame:
    """Total, passed and failed tests, counts by status and whether all passed."""
    marked = results.select("*", status.alias("_status"))
    by_status = marked.groupBy("_status").agg(F.count(F.lit(1)).alias("n"))
    good = F.coalesce(F.sum(F.when(F.col("_status") == "SUCCESS", F.col("n"))), F.lit(0))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return by_status.agg(
        total.alias("total_tests"),
        good.alias("success_tests"),
        (total - good).alias("failed_tests"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("_status", "n")))).alias("by_status"),
        (total == good).alias("all_passed"),
    )


test_suite_summary.__test__ = False


def require_valid(results: DataFrame) -> DataFrame:
    """Return the results, or raise when any rule failed, with their number; the first 20 are named."""
    failed = results.where(~F.col("success"))
    first = failed.orderBy("rule_id").limit(20).collect()
    if first:
        named = ", ".join(f"{row['kind']}({row['column_name'] or ''})" for row in first)
        raise ValidationFailed(f"validation failed, {failed.count()} rules: {named}")
    return results


def quarantine(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all row-level rules, and the others with the ids of the rules they break."""
    checks = [rule for rule in rules if rule.kind in ROW_KINDS]
    broken = F.array_compact(F.array(*[F.when(row_is_bad(df, rule), F.lit(rule.rule_id)) for rule in checks]))
    marked = df.withColumn("broken_rules", broken)
    return marked.where(F.size("broken_rules") == 0).drop("broken_rules"), marked.where(F.size("broken_rules") > 0)


def schema_check(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Compare the schema: ``missing`` columns fail, ``extra`` columns and other types only warn."""
    actual = dict(df.dtypes)
    rows = []
    for name in sorted({*expected, *actual}):
        if name not in actual:
            status = "missing"
        elif name not in expected:
            status = "extra"
        else:
            status = "ok" if actual[name] == expected[name] else "type_mismatch"
        rows.append((name, status, expected.get(name), actual.get(name), status != "missing"))
    return df.sparkSession.createDataFrame(
        rows, "column_name string, status string, expected string, actual string, passed boolean"
    )


def column_set_difference(left: DataFrame, right: DataFrame) -> tuple[list[str], list[str]]:
    """Columns only in the left table and columns only in the right one."""
    return sorted(set(left.columns) - set(right.columns)), sorted(set(right.columns) - set(left.columns))


def quality_checks(
    df: DataFrame, target: str, min_rows: int = 100, max_null_percent: float = 5.0, max_duplicate_percent: float = 10.0
) -> DataFrame:
    """Named checks with expected and actual values: rows, null share per column, target classes, duplicates."""
    text = lambda c: c.cast("string")
    n = F.count(F.lit(1))
    row = lambda name, ok, want, got: F.struct(
        F.lit(name).alias("name"), ok.alias("passed"), F.lit(want).alias("expected"), got.alias("actual")
    )
    checks = [row("row_count", n >= min_rows, f">= {min_rows}", text(n))]
    for name in df.columns:
        percent = ratio(F.count_if(missing(df, name)) * 100, n, 0.0)
        checks.append(
            row(f"null_percentage_{name}", percent <= max_null_percent, f"<= {max_null_percent}%",
                F.format_string("%.2f%%", percent))
        )
    one_pass = df.agg(F.array(*checks).alias("_c")).select(F.inline("_c"))
    classes = df.agg(F.count_distinct(present(df, target)).alias("k")).select(
        F.lit("target_classes").alias("name"), (F.col("k") >= 2).alias("passed"), F.lit(">= 2").alias("expected"),
        text(F.col("k")).alias("actual"),
    )
    share = F.col("duplicate_percent")
    repeats = duplicate_rows(df).select(
        F.lit("duplicates").alias("name"), (share < max_duplicate_percent).alias("passed"),
        F.lit(f"< {max_duplicate_percent:g}%").alias("expected"), F.format_string("%.2f%%", share).alias("actual"),
    )
    return one_pass.unionByName(classes).unionByName(repeats)


def quality_report(df: DataFrame, checks: DataFrame) -> DataFrame:
    """Header row of a report: dataset summary, number of checks, overall verdict."""
    verdict = checks.agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(~F.col("passed")).alias("failed_checks"),
        F.bool_and("passed").alias("passed"),
    ).first()
    return dataset_summary(df).select("*", *[F.lit(verdict[c]).alias(c) for c in ("checks", "failed_checks", "passed")])


def column_families(df: DataFrame) -> DataFrame:
    """Each column with the family that decides how it is treated."""
    numbers, texts = set(numeric_columns(df)), set(categorical_columns(df))
    rows = [
        (c, "numeric" if c in numbers else "categorical" if c in texts else "excluded") for c in df.columns
    ]
    return df.sparkSession.createDataFrame(rows, "column_name string, family string")
