"""Complete analysis of a table: every column, every check, one row per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprep.operators.profile import TableProfile
from colprep.operators.quality import column_metrics, recommend_from
from colprep.operators.relations import top_correlations


def analyze_all(df: DataFrame, order_by: Sequence[str], as_of_year: int, match: str = "token", buckets: int | None = None) -> DataFrame:
    """Profile, missing pattern, outliers, distribution, quality, relations, rules and advice."""
    profile = TableProfile(df)
    metrics = column_metrics(profile, order_by, as_of_year, match, buckets)
    advice = recommend_from(metrics).groupBy("column").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "method"))), lambda e: e["method"]).alias("recommended")
    )
    related = top_correlations(profile).groupBy("column").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "other"))), lambda e: e["other"]).alias("correlated_with")
    )
    return (
        metrics.join(advice, "column", "left").join(related, "column", "left")
        .select(
            "column", "dtype", F.col("rows").alias("count"), "missing", "missing_pct", "unique_count", "unique_pct",
            "mean", "std", "min", "q25", "median", "q75", "max", "skewness", "kurtosis", "shape", "entropy", "mode_value",
            "pattern", "max_run", "iqr_count", "zscore_count", "modified_zscore_count", "outlier_severity",
            "score", "grade", "violations", "violation_severity", "correlated_with", "recommended",
        )
        .orderBy("column")
    )
