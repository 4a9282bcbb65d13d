"""Report tables and their text form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprep.functions.exprs import literal_rows
from colprep.operators.profile import profile_dataset
from colprep.operators.quality import issue_rows
from colprep.operators.rules_cross import cross_summary
from colprep.operators.weights import weights_report

# Status bands.
QUALITY_BANDS = ((80, "acceptable"), (60, "conditional"))
MISSING_BANDS = ((5, "low"), (15, "moderate"))


def executive(df: DataFrame, metrics: DataFrame, log: DataFrame) -> DataFrame:
    """One row: size, missing share, mean score, operations, status."""
    size = profile_dataset(df).first()
    scores = metrics.agg(F.round(F.avg("score"), 2).alias("avg_quality_score"))
    ops = log.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("column").alias("c")).first()
    score, missing = F.col("avg_quality_score"), F.round(F.lit(float(size["missing_pct"] or 0.0)), 2)
    return scores.select(
        F.lit(size["rows"]).alias("total_rows"), F.lit(size["columns"]).alias("total_columns"),
        F.lit(size["missing_cells"]).alias("total_missing"), missing.alias("missing_pct"),
        F.when(missing < MISSING_BANDS[0][0], MISSING_BANDS[0][1]).when(missing < MISSING_BANDS[1][0], MISSING_BANDS[1][1]).otherwise("high").alias("missing_level"),
        score, F.when(score >= QUALITY_BANDS[0][0], QUALITY_BANDS[0][1]).when(score >= QUALITY_BANDS[1][0], QUALITY_BANDS[1][1]).otherwise("caution").alias("quality_status"),
        F.lit(ops["n"]).alias("total_operations"), F.lit(ops["c"]).alias("columns_cleaned"),
    )


def detailed(metrics: DataFrame, log: DataFrame) -> DataFrame:
    """Per column: findings and the operations applied."""
    applied = log.groupBy("column").agg(
        F.count(F.lit(1)).alias("cleaning_operations"),
        F.concat_ws(" > ", F.transform(F.array_sort(F.collect_list(F.struct("seq", "method"))), lambda e: e["method"])).alias("methods"),
    )
    return metrics.join(applied, "column", "left").select(
        "column", "dtype", "rows", "missing", "missing_pct", "unique_count", "pattern", "shape", "outlier_severity", "flagged_rows",
        "score", "grade", "violations", F.coalesce("cleaning_operations", F.lit(0)).alias("cleaning_operations"), "methods",
    )


# What each method is for, by method name.
METHOD_NOTES = (
    ("mean_imputation", "fill gaps with the mean", "keeps the centre of the distribution", "symmetric numeric columns with few gaps"),
    ("median_imputation", "fill gaps with the median", "insensitive to extreme values", "skewed numeric columns"),
    ("mode_imputation", "fill gaps with the commonest value", "keeps the leading category", "category columns with a clear mode"),
    ("forward_fill", "repeat the previous value", "state persists until it changes", "ordered records"),
    ("backward_fill", "take the next value", "state is reported late", "ordered records"),
    ("knn_imputation", "average the nearest rows", "uses relations between columns", "numeric columns with related columns"),
    ("interpolation", "draw a line across the gap", "follows the trend", "ordered numeric series"),
    ("missing_category", "make missing a category", "missingness is information", "category columns with many gaps"),
    ("regression_imputation", "predict from other columns", "uses relations between columns", "numeric columns with good predictors"),
    ("iqr_removal", "drop values outside the quartile fences", "distribution-free limits", "roughly symmetric numeric columns"),
    ("zscore_removal", "drop values far from the mean", "limits in standard deviations", "roughly normal numeric columns"),
    ("winsorization", "cap values at percentiles", "keeps the sample size", "numeric columns with extreme values"),
    ("log_transformation", "compress the scale", "reduces skewness", "right-skewed numeric columns"),
    ("cap_outliers", "cap values at the fences", "keeps the sample size", "numeric columns with extreme values"),
    ("isolation_forest", "drop isolated values", "no distribution assumed", "numeric columns with irregular extremes"),
    ("type_standardization", "give the column one type", "consistent processing", "columns with mixed content"),
    ("remove_duplicates", "keep the first of equal values", "values must be unique", "identifier columns"),
    ("trim_whitespace", "strip surrounding space", "same value, same text", "text columns"),
    ("standardize_case", "one letter case", "same value, same text", "text columns"),
)


def methodology(log: DataFrame) -> DataFrame:
    """Purpose, rationale and applicability of the methods that were used."""
    notes = literal_rows(log.sparkSession, METHOD_NOTES, "method string, purpose string, rationale string, applicability string")
    used = log.groupBy("method").agg(F.count(F.lit(1)).alias("operations"), F.sum("rows_changed").alias("rows_changed"))
    return used.join(F.broadcast(notes), "method", "left")


def comprehensive(df: DataFrame, metrics: DataFrame, log: DataFrame, as_of_year: int, weights: str | None = None) -> DataFrame:
    """All summaries as ``(section, name, metric, value)``."""
    def melt(t: DataFrame, section: str, name: str | None) -> DataFrame:
        fields = [x for x in t.columns if x != name]
        entries = F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).cast("string").alias("value")) for x in fields])
        label = F.col(name) if name else F.lit("dataset")
        return t.select(F.lit(section).alias("section"), label.alias("name"), F.inline(entries))

    parts = [
        melt(profile_dataset(df), "basic", None),
        melt(log.agg(F.countDistinct("column").alias("columns_cleaned"), F.count(F.lit(1)).alias("total_operations"),
                     F.concat_ws(",", F.array_sort(F.collect_set("method"))).alias("methods_used")), "cleaning", None),
        melt(cross_summary(df, as_of_year), "violations", None),
        melt(detailed(metrics, log).select("column", "dtype", "missing", "missing_pct", "flagged_rows", "violations", "cleaning_operations"), "columns", "column"),
    ]
    if weights:
        parts.append(melt(weights_report(df, weights), "weighted", "column"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def issues(metrics: DataFrame) -> DataFrame:
    return issue_rows(metrics)


def to_markdown(title: str, sections: Sequence[tuple[str, DataFrame]]) -> str:
    """Text of report tables that have at most one row per column or operation."""
    lines = [f"# {title}", ""]
    for heading, table in sections:
        lines += [f"## {heading}", "", "| " + " | ".join(table.columns) + " |", "|" + " --- |" * len(table.columns)]
        for row in table.collect():
            lines.append("| " + " | ".join("" if v is None else str(v) for v in row) + " |")
        lines.append("")
    return "\n".join(lines)
