"""Outlier detection: quartile fences, z-score and modified z-score.

Limits are fitted first (a few numbers per column) and inlined as literals, so
the flags themselves are narrow expressions over the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colprep.functions.exprs import c, count_if, is_numeric, literal_rows, num, percent
from colprep.functions.quantiles import exact_quantiles
from colprep.operators.profile import TableProfile, _as_profile

# Detection thresholds.
IQR_MULTIPLIER = 1.5
Z_THRESHOLD = 3.0
MODIFIED_Z_FACTOR = 0.6745
MODIFIED_Z_THRESHOLD = 3.5
MIN_VALUES = 5
MIN_VALUES_Z = 10

METHODS = ("iqr", "zscore", "modified_zscore")


@dataclass(frozen=True)
class OutlierFit:
    """Fitted limits of one numeric column."""

    column: str
    n: int
    lower: float | None = None
    upper: float | None = None
    mean: float | None = None
    std_pop: float | None = None
    median: float | None = None
    mad: float | None = None

    def flags(self, x: Column) -> dict[str, Column]:
        """One boolean per method; false for NULL and for methods not run."""
        off = F.lit(False)
        iqr = z = mz = off
        if self.n >= MIN_VALUES:
            iqr = (x < F.lit(self.lower)) | (x > F.lit(self.upper))
        if self.n >= MIN_VALUES_Z:
            if self.std_pop:
                z = F.abs((x - F.lit(self.mean)) / F.lit(self.std_pop)) > Z_THRESHOLD
            if self.mad:
                mz = F.abs(F.lit(MODIFIED_Z_FACTOR) * (x - F.lit(self.median)) / F.lit(self.mad)) > MODIFIED_Z_THRESHOLD
        return {k: F.coalesce(v, off) for k, v in zip(METHODS, (iqr, z, mz))}


def fit_outliers(source: DataFrame | TableProfile, columns: Sequence[str] | None = None) -> list[OutlierFit]:
    p = _as_profile(source, columns)
    medians = {x: p.quartiles[x][1] for x in p.numeric}
    spread = {
        x: F.abs(num(p.df, x) - F.lit(medians[x]))
        for x in p.numeric
        if p.pass_a[x]["non_null"] >= MIN_VALUES_Z
    }
    mads = exact_quantiles(p.df, spread, [0.5])
    fits = []
    for x in p.numeric:
        s = p.pass_a[x]
        q25, median, q75 = p.quartiles[x]
        if s["non_null"] < MIN_VALUES:
            fits.append(OutlierFit(x, s["non_null"]))
            continue
        reach = IQR_MULTIPLIER * (q75 - q25)
        fits.append(
            OutlierFit(x, s["non_null"], q25 - reach, q75 + reach, s["mean"], s["stdp"], median, mads.get(x, [None])[0])
        )
    return fits


def _counts(p: TableProfile, fits: list[OutlierFit]) -> DataFrame:
    """Per column and method counts, votes and overlap in a single aggregate.

    The three flags of a value are packed into one small number first, so the
    aggregate only tests bits.
    """
    codes, aggs, entries = [], [], []
    for i, fit in enumerate(fits):
        f = fit.flags(num(p.df, fit.column))
        codes.append(sum((F.when(x, 1 << bit).otherwise(0) for bit, x in enumerate(f.values())), F.lit(0)).alias(f"o{i}"))
        tests = {f"{k}_count": f"o{i} & {1 << bit} != 0" for bit, k in enumerate(METHODS)} | {
            "consensus_rows": f"bit_count(o{i}) >= 2", "flagged_rows": f"o{i} != 0", "iqr_and_zscore": f"o{i} & 3 = 3",
        }
        aggs += [F.expr(f"count_if({t})").alias(f"{k}_{i}") for k, t in tests.items()]
        limits = ", ".join(f"{'double(null)' if v is None else repr(float(v)) + 'D'} AS {k}" for k, v in (("lower_bound", fit.lower), ("upper_bound", fit.upper)))
        counts = ", ".join(f"{k}_{i} AS {k}" for k in tests)
        name = fit.column.replace("\\", "\\\\").replace("'", "\\'")
        entries.append(f"struct('{name}' AS column, {fit.n}L AS non_null, {limits}, {counts})")
    return p.df.select(*codes).agg(*aggs).select(F.expr(f"inline(array({', '.join(entries)}))"))


def severity_label(max_pct: Column) -> Column:
    return F.when(max_pct > 10, "high").when(max_pct > 5, "moderate").otherwise("low")


def outlier_summary(source, columns=None, fits: list[OutlierFit] | None = None) -> DataFrame:
    """Counts per method, consensus, agreement and severity per numeric column."""
    p = _as_profile(source, columns)
    fits = fit_outliers(p) if fits is None else fits
    if not fits:
        return literal_rows(p.spark, [], _SUMMARY_SCHEMA)
    worst = F.greatest(*[F.col(f"{k}_count") for k in METHODS])
    max_pct = F.coalesce(percent(worst, F.col("non_null")), F.lit(0.0))
    return (
        _counts(p, fits)
        .withColumn("max_pct", max_pct)
        .withColumn("severity", severity_label(F.col("max_pct")))
        .withColumn("methods_agree", F.col("iqr_and_zscore") > 0)
        .drop("iqr_and_zscore")
    )


_SUMMARY_SCHEMA = (
    "column string, non_null long, lower_bound double, upper_bound double, iqr_count long, zscore_count long, "
    "modified_zscore_count long, consensus_rows long, flagged_rows long, max_pct double, severity string, methods_agree boolean"
)


def outlier_method(source, method: str, columns=None) -> DataFrame:
    """Count and share of one method."""
    if method not in METHODS:
        raise ValueError(f"unknown outlier method: {method}")
    out = outlier_summary(source, columns)
    keep = ["lower_bound", "upper_bound"] if method == "iqr" else []
    count = F.col(f"{method}_count")
    need = MIN_VALUES if method == "iqr" else MIN_VALUES_Z
    return out.where(F.col("non_null") >= need).select(
        "column", count.alias("outlier_count"), percent(count, F.col("non_null")).alias("outlier_pct"), *keep
    )


def outlier_status(df: DataFrame) -> DataFrame:
    """Whether detection applies to each column."""
    counts = df.agg(*[F.count(c(f.name)).alias(f"n{i}") for i, f in enumerate(df.schema.fields)])
    entries = F.array(
        *[F.struct(F.lit(f.name).alias("column"), F.col(f"n{i}").alias("non_null"), F.lit(is_numeric(f.dataType)).alias("is_numeric"))
          for i, f in enumerate(df.schema.fields)]
    )
    n = F.col("non_null")
    status = (
        F.when(~F.col("is_numeric"), "not_applicable")
        .when(n < MIN_VALUES, "insufficient_data")
        .when(n < MIN_VALUES_Z, "iqr_only")
        .otherwise("all_methods")
    )
    return counts.select(F.inline(entries)).select("column", "non_null", status.alias("status"))


def outlier_rows(df: DataFrame, column: str, key: Sequence[str]) -> DataFrame:
    """Every flagged row with the methods that flagged it; a filter, no shuffle."""
    (fit,) = fit_outliers(df, [column])
    flags = fit.flags(num(df, column))
    methods = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in flags.items()]))
    return (
        df.select(*key, num(df, column).alias("value"), methods.alias("methods"))
        .where(F.size("methods") > 0)
        .withColumn("votes", F.size("methods").cast("long"))
    )
