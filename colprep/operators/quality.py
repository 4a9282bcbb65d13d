"""Quality scores, validation, recommendations and digests.

All of it is arithmetic on per-column metric tables; the data itself is read by
the profile, outlier, pattern and rule operators.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colprep.functions.exprs import bounded, c, count_if, literal_rows, num, percent, text_columns
from colprep.functions.text import DATE_FORMATS, NUMBER_PATTERN
from colprep.operators.missing import missing_pattern
from colprep.operators.outliers import METHODS, fit_outliers, outlier_summary
from colprep.operators.profile import TableProfile, _as_profile, shape_label
from colprep.operators.rules_single import rule_counts, rule_severity

# Score penalties and grade bands.
MISSING_PENALTIES = ((50, 40), (20, 20), (5, 10))
MIXED_PENALTY = 15
LOW_UNIQUE_PENALTY = 10
GRADES = ((90, "A"), (80, "B"), (70, "C"), (60, "D"))
IDENTIFIER_UNIQUE_PCT = 95
IDENTIFIER_MIN_ROWS = 100


# --- content classes --------------------------------------------------------

def content_class(col: Column) -> Column:
    """int, float, bool, date or text."""
    return (
        F.when(col.rlike(r"^\s*[+-]?\d+\s*$"), "int")
        .when(col.rlike(NUMBER_PATTERN), "float")
        .when(F.lower(F.trim(col)).isin("true", "false", "yes", "no"), "bool")
        .when(col.rlike(r"^\s*\d{4}[-/]\d{2}[-/]\d{2}"), "date")
        .otherwise("text")
    )


CONTENT_CLASSES = ("int", "float", "bool", "date", "text")


def mixed_content(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows per content class of each text column; mixed when there is more than one.

    All rows count, in one aggregate.
    """
    names = list(columns if columns is not None else text_columns(df))
    schema = "column string, " + ", ".join(f"{k}_values long" for k in CONTENT_CLASSES) + ", classes long, is_mixed boolean"
    if not names:
        return literal_rows(df.sparkSession, [], schema)
    aggs, entries = [], []
    for i, name in enumerate(names):
        kind = content_class(c(name))
        aggs += [count_if(c(name).isNotNull() & (kind == k)).alias(f"{k}_{i}") for k in CONTENT_CLASSES]
        entries.append(F.struct(F.lit(name).alias("column"), *[F.col(f"{k}_{i}").alias(f"{k}_values") for k in CONTENT_CLASSES]))
    used = reduce(lambda a, b: a + b, [(F.col(f"{k}_values") > 0).cast("long") for k in CONTENT_CLASSES])
    return df.agg(*aggs).select(F.inline(F.array(*entries))).withColumn("classes", used).withColumn("is_mixed", used > 1)


# --- score ------------------------------------------------------------------

def grade_label(score: Column) -> Column:
    label = F.when(score >= GRADES[0][0], GRADES[0][1])
    for low, grade in GRADES[1:]:
        label = label.when(score >= low, grade)
    return label.otherwise("F")


def quality_score(source, columns=None) -> DataFrame:
    """Score out of 100, grade and issue list per column."""
    p = _as_profile(source, columns)
    mixed = mixed_content(p.df, p.text).select("column", "is_mixed")
    base = (
        p.table().join(F.broadcast(mixed), "column", "left")
        .withColumn("is_mixed", F.coalesce("is_mixed", F.lit(False)))
        .withColumn("unique_pct", F.coalesce("unique_pct", F.lit(0.0)))
    )
    pct = F.col("missing_pct")
    (high, p_high), (mid, p_mid), (low, p_low) = MISSING_PENALTIES
    identifier = (F.col("unique_pct") > IDENTIFIER_UNIQUE_PCT) & (F.col("rows") > IDENTIFIER_MIN_ROWS)
    constant = (F.col("unique_pct") < 1) & ~identifier
    penalty = (
        F.when(pct > high, p_high).when(pct > mid, p_mid).when(pct > low, p_low).otherwise(0)
        + F.when(F.col("is_mixed"), MIXED_PENALTY).otherwise(0)
        + F.when(constant, LOW_UNIQUE_PENALTY).otherwise(0)
    )
    issues = F.array_compact(
        F.array(
            F.when(pct > high, "high_missing").when(pct > mid, "moderate_missing").when(pct > low, "low_missing"),
            F.when(F.col("is_mixed"), "mixed_types"),
            F.when(identifier, "possible_identifier"),
            F.when(constant, "low_uniqueness"),
        )
    )
    score = F.greatest(F.lit(0), F.lit(100) - penalty).cast("long")
    return base.select("column", "missing_pct", "unique_pct", score.alias("score"), grade_label(score).alias("grade"),
                       issues.alias("issues"))


def identifier_columns(source, columns=None) -> DataFrame:
    p = _as_profile(source, columns)
    return p.table().select(
        "column", "unique_pct",
        (F.coalesce("unique_pct", F.lit(0.0)) > IDENTIFIER_UNIQUE_PCT).__and__(F.col("rows") > IDENTIFIER_MIN_ROWS).alias("possible_identifier"),
    )


def quality_grades(source, columns=None) -> DataFrame:
    """Number of columns and mean score per grade."""
    scores = quality_score(source, columns)
    return scores.groupBy("grade").agg(F.count(F.lit(1)).alias("columns"), F.avg("score").alias("avg_score"))


# --- validation -------------------------------------------------------------

def validate_columns(source, columns=None) -> DataFrame:
    """Issues and warnings per column before export."""
    p = _as_profile(source, columns)
    fences, entries = [], []
    for i, x in enumerate(p.numeric):
        q1, _, q3 = p.quartiles[x]
        v = num(p.df, x)
        reach = None if q1 is None else 1.5 * (q3 - q1)
        outside = F.lit(False) if q1 is None else (v < F.lit(q1 - reach)) | (v > F.lit(q3 + reach))
        fences.append(count_if(outside).alias(f"o{i}"))
        entries.append(F.struct(F.lit(x).alias("column"), F.col(f"o{i}").alias("outliers")))
    table = p.table()
    if entries:
        table = table.join(F.broadcast(p.df.agg(*fences).select(F.inline(F.array(*entries)))), "column", "left")
    else:
        table = table.withColumn("outliers", F.lit(None).cast("long"))
    miss, rows = F.col("missing_pct"), F.col("rows")
    outlier_pct = F.coalesce(percent(F.col("outliers"), F.col("non_null")), F.lit(0.0))
    text = F.col("is_text") & (F.col("non_null") > 0)
    issues = F.array_compact(F.array(
        F.when(miss > 10, "high_missing"),
        F.when(F.coalesce("infinite", F.lit(0)) > 0, "infinite_values"),
    ))
    warnings = F.array_compact(F.array(
        F.when((miss > 5) & (miss <= 10), "moderate_missing"),
        F.when(outlier_pct > 5, "many_outliers"),
        F.when(text & (F.col("unique_count") == rows), "all_unique"),
        F.when(text & (F.col("rare_values") > F.col("unique_count") * 0.5), "many_rare_values"),
        F.when(F.col("duplicate_rows") > rows * 0.1, "high_duplicates"),
    ))
    return table.select(
        "column", "rows", "missing", "missing_pct", "unique_count", F.col("duplicate_rows").alias("duplicate_count"),
        outlier_pct.alias("outlier_pct"), issues.alias("issues"), warnings.alias("warnings"), (F.size(issues) == 0).alias("passed"),
    )


def validate_dataset(source, columns=None) -> DataFrame:
    """Totals over all columns: one row."""
    v = validate_columns(source, columns)
    cells = F.sum("rows")
    critical = F.array_sort(F.flatten(F.collect_list(F.transform("issues", lambda x: F.concat_ws(": ", F.col("column"), x)))))
    agg = v.agg(
        F.sum(F.size("issues")).cast("long").alias("total_issues"),
        F.sum(F.size("warnings")).cast("long").alias("total_warnings"),
        F.every("passed").alias("passed"),
        percent(F.sum("missing"), cells).alias("missing_pct"),
        critical.alias("critical_issues"),
    )
    advice = F.array_compact(F.array(
        F.when(F.col("total_issues") > 0, "review_critical_issues"),
        F.when(F.col("total_warnings") > 0, "address_warnings"),
        F.when(F.col("missing_pct") > 10, "additional_cleaning"),
    ))
    return agg.withColumn("recommendations", advice)


# --- recommendations --------------------------------------------------------

@dataclass(frozen=True)
class Advice:
    """A cleaning suggestion with the condition under which it is made."""

    method_type: str
    method: str
    priority: str
    applicability: int
    description: str
    pros: str
    cons: str
    when: Column


def _advice() -> list[Advice]:
    pct, pattern, severity = F.col("missing_pct"), F.col("pattern"), F.col("outlier_severity")
    some, low, mid = pct > 0, pct < 5, (pct >= 5) & (pct < 20)
    blocks = pattern == "systematic_blocks"
    measured = F.col("outliers_measured")
    return [
        Advice("missing_values", "median_imputation", "high", 85, "few gaps in a numeric column",
               "simple; robust to extremes", "shrinks the variance", some & low & F.col("is_numeric")),
        Advice("missing_values", "knn_imputation", "medium", 75, "few gaps and related numeric columns",
               "keeps relations between columns", "costly; depends on scales", some & low & F.col("is_numeric")),
        Advice("missing_values", "mode_imputation", "high", 80, "few gaps in a category column",
               "keeps the leading category", "favours common values", some & low & ~F.col("is_numeric")),
        Advice("missing_values", "interpolation", "high", 70, "gaps come in long runs",
               "follows trends of ordered data", "meaningless without an order", mid & blocks),
        Advice("missing_values", "regression_imputation", "medium", 75, "scattered gaps",
               "uses related columns", "needs predictors", mid & ~blocks),
        Advice("missing_values", "missing_category", "high", 90, "a large part of the values is missing",
               "keeps every row; missingness stays visible", "adds a category", pct >= 20),
        Advice("outliers", "winsorization", "high", 85, "many extreme values",
               "keeps the sample size", "reshapes the distribution", measured & (severity == "high")),
        Advice("outliers", "iqr_removal", "medium", 60, "many extreme values, removal acceptable",
               "clean range", "loses values", measured & (severity == "high")),
        Advice("outliers", "log_transformation", "medium", 75, "a moderate number of extreme values",
               "tames long tails", "changes the scale", measured & (severity == "moderate")),
        Advice("data_quality", "type_standardization", "high", 95, "values of several kinds in one column",
               "consistent values", "values that do not convert are lost",
               (F.col("score") < 70) & F.array_contains("issues", "mixed_types")),
    ]


# Sort weight of priorities.
PRIORITY_ORDER = {"high": 3, "medium": 2, "low": 1}
# Methods that change the type of a numeric column.
TYPE_CHANGING = ("missing_category",)


def recommend_from(metrics: DataFrame, k: int = 10) -> DataFrame:
    """Rank suggestions per row of a metrics table (one row per column)."""
    entries = []
    for position, a in enumerate(_advice()):
        changes = F.lit(a.method in TYPE_CHANGING) & F.col("is_numeric")
        entries.append(F.when(a.when, F.struct(
            F.lit(position).alias("position"), F.lit(a.method_type).alias("method_type"), F.lit(a.method).alias("method"),
            F.lit(a.priority).alias("priority"), F.lit(PRIORITY_ORDER[a.priority]).alias("weight"),
            F.lit(a.applicability).cast("long").alias("applicability"), F.lit(a.description).alias("description"),
            F.lit(a.pros).alias("pros"), F.lit(a.cons).alias("cons"), changes.alias("changes_type"),
        )))
    w = Window.partitionBy("column").orderBy(F.col("weight").desc(), F.col("applicability").desc(), "position")
    return (
        metrics.select("column", F.inline(F.array_compact(F.array(*entries))))
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .drop("weight", "position")
    )


def column_metrics(source, order_by: Sequence[str], as_of_year: int, match: str = "token", buckets: int | None = None) -> DataFrame:
    """Everything known about each column in one row per column.

    Shares the profile passes among all parts. Each part is a table with one
    row per column, so the joins here are tiny.
    """
    p = _as_profile(source)
    fits = fit_outliers(p)
    outliers = outlier_summary(p, fits=fits).select(
        "column", *[f"{m}_count" for m in METHODS], "lower_bound", "upper_bound", "consensus_rows", "flagged_rows",
        F.col("max_pct").alias("outlier_max_pct"), F.col("severity").alias("outlier_severity"), "methods_agree",
        (F.col("non_null") >= 5).alias("outliers_measured"),
    )
    patterns = missing_pattern(p.df, order_by, p.columns, buckets).select("column", "max_run", "pattern")
    scores = quality_score(p).select("column", "score", "grade", "issues")
    rules = rule_severity(p.df, as_of_year, match).select(
        "column", "violations", F.col("severity").alias("violation_severity"), "rules"
    )
    out = p.table()
    for part in (patterns, outliers, scores, rules):
        out = out.join(F.broadcast(part), "column", "left")  # one row per column each
    zero = {f"{m}_count": 0 for m in METHODS} | {"consensus_rows": 0, "flagged_rows": 0, "violations": 0, "outlier_max_pct": 0.0}
    return bounded(
        out.fillna(zero)
        .withColumn("outlier_severity", F.coalesce("outlier_severity", F.lit("low")))
        .withColumn("violation_severity", F.coalesce("violation_severity", F.lit("low")))
        .withColumn("outliers_measured", F.coalesce("outliers_measured", F.lit(False)))
        .withColumn("shape", F.when(F.col("is_numeric"), shape_label(F.col("skewness"), F.col("non_null"))).otherwise("categorical"))
    )


def recommend(source, order_by: Sequence[str], as_of_year: int, buckets: int | None = None) -> DataFrame:
    return recommend_from(column_metrics(source, order_by, as_of_year, buckets=buckets))


# --- digests ----------------------------------------------------------------

def issue_rows(metrics: DataFrame) -> DataFrame:
    """One row per issue of a column."""
    skew, kurt = F.col("skewness"), F.col("kurtosis")
    numeric = F.col("is_numeric") & (F.col("non_null") >= 10)
    proxy = F.abs(F.col("mean") - F.col("median")) / (F.col("std") + 0.001)
    items = [
        ("missing", F.col("missing") > 0, F.format_string("%,d missing (%.2f%%), pattern %s, longest run %d", "missing", "missing_pct", "pattern", "max_run")),
        ("use_median", F.col("is_numeric") & (F.col("missing") > 0) & (proxy > 0.5), F.lit("mean and median differ: prefer the median")),
        ("outliers", F.col("flagged_rows") > 0, F.format_string(
            "%,d flagged, severity %s (iqr %d, zscore %d, modified_zscore %d)", "flagged_rows", "outlier_severity",
            *[f"{m}_count" for m in METHODS])),
        ("quality", F.col("score") < 80, F.format_string("score %d/100, grade %s: %s", "score", "grade", F.concat_ws(", ", "issues"))),
        ("skewed", numeric & (F.abs(skew) > 1), F.format_string("skewness %.2f", skew)),
        ("heavy_tails", numeric & (F.abs(kurt) > 3), F.format_string("kurtosis %.2f", kurt)),
        ("violations", F.col("violations") > 0, F.format_string("%,d rule violations: %s", "violations", F.concat_ws(", ", "rules"))),
    ]
    entries = [F.when(cond, F.struct(F.lit(name).alias("issue"), text.alias("detail"))) for name, cond, text in items]
    return metrics.select("column", F.inline(F.array_compact(F.array(*entries))))


def issue_digest(metrics: DataFrame) -> DataFrame:
    """All issues of a column as one text."""
    rows = issue_rows(metrics).groupBy("column").agg(
        F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws(": ", "issue", "detail")))).alias("digest")  # at most seven lines
    )
    return metrics.select("column").join(rows, "column", "left").select(
        "column", F.coalesce("digest", F.lit("no significant issues")).alias("digest")
    )


def priority_table(metrics: DataFrame) -> DataFrame:
    """Columns in the order in which they deserve attention."""
    return metrics.select("column", "missing_pct", "score", "outlier_severity").orderBy("score", F.col("missing_pct").desc(), "column")


def anomaly_summary(metrics: DataFrame) -> DataFrame:
    """Outliers per method, missing values and violations per column."""
    total = reduce(lambda a, b: a + b, [F.col(f"{m}_count") for m in METHODS])
    return metrics.select(
        "column", *[f"{m}_count" for m in METHODS], total.cast("long").alias("total_outliers"), "outlier_severity",
        "missing", "pattern", "violations", "violation_severity",
        (total + F.col("missing") + F.col("violations")).cast("long").alias("total_anomalies"),
    )


def next_steps(columns: Sequence[str], metrics: DataFrame, log: DataFrame) -> DataFrame:
    """What is left to do: columns not analysed, not cleaned, of low quality."""
    spark = metrics.sparkSession
    names = literal_rows(spark, [(x,) for x in columns], "column string")
    cleaned = log.select("column").distinct()

    def step(kind: str, priority: str, hits: DataFrame) -> DataFrame:
        return hits.agg(F.count(F.lit(1)).alias("columns_affected"), F.array_sort(F.collect_list("column")).alias("names")).select(
            F.lit(kind).alias("step"), F.lit(priority).alias("priority"), "columns_affected", F.concat_ws(",", "names").alias("columns")
        )

    parts = [
        step("analysis", "high", names.join(metrics.select("column"), "column", "left_anti")),
        step("cleaning", "medium", names.join(cleaned, "column", "left_anti")),
        step("quality", "high", metrics.where("score < 70").select("column")),
        step("validation", "medium", cleaned),
    ]
    return reduce(DataFrame.unionByName, parts).where("columns_affected > 0")
