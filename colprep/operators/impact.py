"""Before / after comparison of a cleaned column.

Before and after live in the same row, so nothing is joined.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colprep.functions.exprs import c, count_if, is_numeric, num, percent, ratio, literal_rows
from colprep.functions.quantiles import exact_quantiles


def _changed(before: str, after: str) -> Column:
    return ~c(before).eqNullSafe(c(after))


def impact_stats(df: DataFrame, before: str, after: str) -> DataFrame:
    """Changed rows, missing counts, mean, sd and median before and after.

    ``rows_changed`` is null-safe. ``rows_affected_compat`` also counts rows
    that are missing on both sides.
    """
    changed = count_if(_changed(before, after))
    compat = count_if(_changed(before, after) | (c(before).isNull() & c(after).isNull()))
    aggs = [
        F.count(F.lit(1)).alias("rows"), changed.alias("rows_changed"), compat.alias("rows_affected_compat"),
        count_if(c(before).isNull()).alias("missing_before"), count_if(c(after).isNull()).alias("missing_after"),
    ]
    numeric = is_numeric(df.schema[before].dataType) and is_numeric(df.schema[after].dataType)
    medians = {}
    if numeric:
        b, a = num(df, before), num(df, after)
        aggs += [F.avg(b).alias("mean_before"), F.avg(a).alias("mean_after"),
                 F.stddev_samp(b).alias("std_before"), F.stddev_samp(a).alias("std_after")]
        medians = exact_quantiles(df, {"before": b, "after": a}, [0.5])
    out = df.agg(*aggs)
    extra = []
    if numeric:
        extra = ["mean_before", "mean_after", "std_before", "std_after",
                 F.lit(medians["before"][0]).cast("double").alias("median_before"),
                 F.lit(medians["after"][0]).cast("double").alias("median_after")]
    return out.select(
        F.lit(before).alias("column"), "rows_changed", percent(F.col("rows_changed"), F.col("rows")).alias("changed_pct"),
        "rows_affected_compat", "missing_before", "missing_after",
        (F.col("missing_after") - F.col("missing_before")).alias("missing_change"), *extra,
    )


def impact_weighted(df: DataFrame, before: str, after: str, weights: str) -> DataFrame:
    b, a, w = num(df, before), num(df, after), num(df, weights)
    totals = df.agg(
        F.sum(F.when(b.isNotNull(), b * w)).alias("sb"), F.sum(F.when(b.isNotNull() & w.isNotNull(), w)).alias("wb"),
        F.sum(F.when(a.isNotNull(), a * w)).alias("sa"), F.sum(F.when(a.isNotNull() & w.isNotNull(), w)).alias("wa"),
    )
    mean_b, mean_a = ratio(F.col("sb"), F.col("wb")), ratio(F.col("sa"), F.col("wa"))
    return totals.select(
        F.lit(before).alias("column"), mean_b.alias("weighted_mean_before"), mean_a.alias("weighted_mean_after"),
        (mean_a - mean_b).alias("weighted_mean_change"), F.col("wb").alias("total_weight_before"), F.col("wa").alias("total_weight_after"),
    )


def changed_rows(df: DataFrame, before: str, after: str, key: list[str], limit: int = 20) -> DataFrame:
    """The first ``limit`` changed rows in key order and how many there are in all."""
    changed = df.where(_changed(before, after)).select(*key, c(before).alias("before"), c(after).alias("after"))
    total = changed.count()
    return changed.orderBy(*key).limit(limit).withColumn("remaining", F.lit(max(0, total - limit)).cast("long"))


def missing_delta(original: DataFrame, current: DataFrame, cleaned: Collection[str] = ()) -> DataFrame:
    """Missing cells per column in two versions of a table, with the overall reduction."""
    shared = [x for x in current.columns if x in set(original.columns)]

    def counts(df: DataFrame, name: str) -> DataFrame:
        one = df.agg(*[count_if(c(x).isNull()).alias(f"m{i}") for i, x in enumerate(shared)])
        return one.select(F.inline(F.array(*[F.struct(F.lit(x).alias("column"), F.col(f"m{i}").alias(name)) for i, x in enumerate(shared)])))

    both = counts(original, "original_missing").join(counts(current, "current_missing"), "column")
    w = Window.partitionBy(F.lit(1))  # one row per column of the table
    total_before, total_after = F.sum("original_missing").over(w), F.sum("current_missing").over(w)
    return both.select(
        "column", "original_missing", "current_missing", (F.col("current_missing") - F.col("original_missing")).alias("change"),
        F.col("column").isin(list(cleaned)).alias("cleaned"),
        (total_before - total_after).alias("total_reduction"),
        F.coalesce(percent(total_before - total_after, total_before), F.lit(0.0)).alias("reduction_pct"),
    )


def impact_histogram(df: DataFrame, before: str, after: str, bins: int = 30) -> DataFrame:
    """Counts of both versions over the same equal-width bins."""
    from colprep.operators.charts import bin_number

    b, a = num(df, before), num(df, after)
    lim = df.agg(F.least(F.min(b), F.min(a)).alias("lo"), F.greatest(F.max(b), F.max(a)).alias("hi")).first()
    if lim["lo"] is None:
        return literal_rows(df.sparkSession, [], "bin long, bin_start double, before_count long, after_count long")
    lo, width = lim["lo"], (lim["hi"] - lim["lo"]) / bins
    sides = F.array(
        F.struct(bin_number(b, lo, width, bins).alias("bin"), F.lit(1).alias("b"), F.lit(0).alias("a")),
        F.struct(bin_number(a, lo, width, bins).alias("bin"), F.lit(0).alias("b"), F.lit(1).alias("a")),
    )
    return (
        df.select(F.inline(sides)).where(F.col("bin").isNotNull()).groupBy("bin")
        .agg(F.sum("b").alias("before_count"), F.sum("a").alias("after_count"))
        .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_start"), "before_count", "after_count")
    )


def impact_categories(df: DataFrame, before: str, after: str, k: int = 10) -> DataFrame:
    """Top categories of either version with their counts in each top list."""
    def top(name: str, alias: str) -> DataFrame:
        counts = df.where(c(name).isNotNull()).groupBy(c(name).cast("string").alias("category")).agg(F.count(F.lit(1)).alias(alias))
        return counts.orderBy(F.col(alias).desc(), "category").limit(k)

    return top(before, "before_count").join(top(after, "after_count"), "category", "full").fillna(0, ["before_count", "after_count"])
