"""Name-driven rules on single columns.

Each rule is a keyword list and a violation predicate. All rules that match any
column are evaluated together: one aggregate for the counts, one narrow
projection for the offending cells.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colprep.functions.exprs import c, count_if, is_numeric, is_text, literal_rows, num, percent
from colprep.functions.names import matches

# Patterns and word lists of the format rules.
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE_PATTERN = r"^[\+]?[1-9][\d\s\-\(\)]{6,}$"
POSTAL_PATTERN = r"^[A-Z0-9\s\-]{3,10}$"
NON_ASCII_PATTERN = r"[^\x00-\x7F]"
GENDER_VALUES = ("male", "m", "female", "f", "other", "non-binary", "prefer not to say", "unknown")
YES_NO_VALUES = ("yes", "y", "no", "n", "true", "false", "1", "0")
AGE_RANGE = (0, 120)
FIRST_BIRTH_YEAR = 1900
PERCENT_RANGE = (0, 100)


@dataclass(frozen=True)
class Rule:
    """``violated`` maps a non-null value column to a boolean."""

    name: str
    family: str
    keywords: tuple[str, ...]
    numeric: bool
    violated: Callable[[Column], Column]


def _outside(low, high) -> Callable[[Column], Column]:
    return lambda x: (x < low) | (x > high)


def single_rules(as_of_year: int) -> list[Rule]:
    """Rules in dispatch order; within a family the first match wins."""
    return [
        Rule("age", "range", ("age",), True, _outside(*AGE_RANGE)),
        Rule("birth_year", "range", ("birth_year",), True, _outside(FIRST_BIRTH_YEAR, as_of_year)),
        Rule("percentage", "range", ("percent", "percentage", "rate", "ratio"), True, _outside(*PERCENT_RANGE)),
        Rule("score", "range", ("score", "rating", "grade"), True, lambda x: x < 0),
        Rule("income", "range", ("income", "salary", "wage", "earnings"), True, lambda x: x < 0),
        Rule("email", "format", ("email", "e_mail", "mail"), False, lambda x: ~x.rlike(EMAIL_PATTERN)),
        Rule("phone", "format", ("phone", "telephone", "mobile"), False, lambda x: ~x.rlike(PHONE_PATTERN)),
        Rule("postal", "format", ("zip", "postal", "postcode"), False, lambda x: ~F.upper(x).rlike(POSTAL_PATTERN)),
        Rule("gender", "category", ("gender", "sex"), False, lambda x: ~F.lower(x).isin(*GENDER_VALUES)),
        Rule("yes_no", "category", ("yes_no", "yn", "boolean", "flag"), False, lambda x: ~F.lower(x).isin(*YES_NO_VALUES)),
        Rule("non_ascii", "encoding", (), False, lambda x: x.rlike(NON_ASCII_PATTERN)),
    ]


@dataclass(frozen=True)
class Check:
    """A rule bound to a column of a concrete schema."""

    column: str
    rule: str
    condition: Column
    value: Column


def bind_rules(schema: T.StructType, as_of_year: int, match: str = "token", columns: Sequence[str] | None = None) -> list[Check]:
    """Match rules to columns by name and type; no data is read."""
    checks = []
    for f in schema.fields:
        if columns is not None and f.name not in columns:
            continue
        numeric, text = is_numeric(f.dataType), is_text(f.dataType)
        taken = set()
        for rule in single_rules(as_of_year):
            if rule.family in taken or not (numeric if rule.numeric else text):
                continue
            if rule.keywords and not matches(f.name, rule.keywords, match):
                continue
            taken.add(rule.family)
            value = c(f.name).cast("double") if rule.numeric and not isinstance(f.dataType, T.BooleanType) else c(f.name)
            if isinstance(f.dataType, T.BooleanType):
                value = value.cast("int").cast("double")
            checks.append(Check(f.name, rule.name, F.coalesce(rule.violated(value), F.lit(False)), c(f.name)))
    return checks


_COUNT_SCHEMA = "column string, rule string, violations long, rows long"


def rule_counts(df: DataFrame, as_of_year: int, match: str = "token", columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, rule, violations, rows)`` for all matching rules in one aggregate."""
    checks = bind_rules(df.schema, as_of_year, match, columns)
    if not checks:
        return literal_rows(df.sparkSession, [], _COUNT_SCHEMA)
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[count_if(k.condition).alias(f"v{i}") for i, k in enumerate(checks)])
    entries = F.array(
        *[F.struct(F.lit(k.column).alias("column"), F.lit(k.rule).alias("rule"), F.col(f"v{i}").alias("violations"))
          for i, k in enumerate(checks)]
    )
    return counts.select("rows", F.inline(entries)).select("column", "rule", "violations", "rows")


def severity(total: Column, rows: Column) -> Column:
    return F.when(total > rows * 0.1, "high").when(total > rows * 0.05, "moderate").otherwise("low")


def rule_severity(df: DataFrame, as_of_year: int, match: str = "token") -> DataFrame:
    """Total of all rules per column against the number of rows."""
    return (
        rule_counts(df, as_of_year, match)
        .groupBy("column")
        .agg(F.sum("violations").alias("violations"), F.max("rows").alias("rows"),
             F.array_sort(F.array_compact(F.collect_list(F.when(F.col("violations") > 0, F.col("rule"))))).alias("rules"))
        .select("column", "violations", percent(F.col("violations"), F.col("rows")).alias("violation_pct"),
                severity(F.col("violations"), F.col("rows")).alias("severity"), "rules")
    )


def rule_violations(df: DataFrame, key: Sequence[str], as_of_year: int, match: str = "token") -> DataFrame:
    """Row-level view: one row per offending cell. Narrow, works on streams."""
    checks = bind_rules(df.schema, as_of_year, match)
    keys = [c(k) for k in key]
    if not checks:
        return df.select(*keys, F.lit("").alias("column"), F.lit("").alias("rule"), F.lit("").alias("value")).where(F.lit(False))
    entry = lambda k: F.when(
        k.condition, F.struct(F.lit(k.column).alias("column"), F.lit(k.rule).alias("rule"), k.value.cast("string").alias("value"))
    )
    return df.select(*keys, F.inline(F.array_compact(F.array(*[entry(k) for k in checks]))))


def rule_samples(df: DataFrame, key: Sequence[str], as_of_year: int, match: str = "token", k: int = 10, k_encoding: int = 5) -> DataFrame:
    """The first offending values per column and rule in key order."""
    w = Window.partitionBy("column", "rule").orderBy(*[c(x) for x in key])
    limit = F.when(F.col("rule") == "non_ascii", k_encoding).otherwise(k)
    return (
        rule_violations(df, key, as_of_year, match)
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= max(k, k_encoding))  # lets each task drop all but the first k
        .where(F.col("rank") <= limit)
    )
