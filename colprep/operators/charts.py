"""Aggregates behind the plots. Drawing is left to the caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colprep.functions.exprs import c, is_numeric, num, percent, literal_rows
from colprep.functions.ordered import with_position
from colprep.functions.quantiles import exact_quantiles
from colprep.operators.missing import systematic_sample


def _top_counts(df: DataFrame, column: str, k: int) -> DataFrame:
    """A distributed count, then a take-ordered of ``k`` rows."""
    return (
        df.where(c(column).isNotNull()).groupBy(c(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), "value").limit(k)
    )


def bar_top(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """Most frequent values; numeric ones in value order."""
    top = _top_counts(df, column, k)
    return top.orderBy("value") if is_numeric(df.schema[column].dataType) else top.orderBy(F.col("count").desc(), "value")


def bar_xy(df: DataFrame, x: str, y: str) -> DataFrame:
    """Height of the bar per x: the sum of y."""
    return df.groupBy(c(x).alias("x")).agg(F.sum(num(df, y)).alias("y"))


def line(df: DataFrame, column: str, order_by: Sequence[str], step: int = 1, buckets: int | None = None) -> DataFrame:
    """Values by position; means of stretches of ``step`` values."""
    positioned = with_position(
        df.select(*dict.fromkeys([column, *order_by])).where(c(column).isNotNull()), order_by, "position", buckets
    )
    return (
        positioned.groupBy(F.floor(F.col("position") / step).cast("long").alias("point"))
        .agg(F.min("position").alias("position"), F.avg(num(df, column)).alias("value"), F.count(F.lit(1)).alias("rows"))
    )


def scatter(df: DataFrame, x: str, y: str, order_by: Sequence[str], color: str | None = None, size: str | None = None, every: int = 1, buckets: int | None = None) -> DataFrame:
    """Point columns of all rows, or of every ``every``-th."""
    extra = {"color": color, "size": size}
    cols = [c(x).alias("x"), c(y).alias("y"), *[c(v).alias(k) for k, v in extra.items() if v]]
    needed = dict.fromkeys([x, y, *[v for v in extra.values() if v], *order_by])
    return systematic_sample(df.select(*needed), order_by, every, buckets).select("position", *cols)


def box(df: DataFrame, column: str) -> DataFrame:
    """Quartiles, whisker ends (extremes inside the fences), fences, mean, sd, outlier count."""
    x = num(df, column)
    q1, q2, q3 = exact_quantiles(df, {column: x}, [0.25, 0.5, 0.75])[column]
    if q1 is None:
        return literal_rows(df.sparkSession, [], "column string, q1 double, median double, q3 double, lower_fence double, upper_fence double, whisker_low double, whisker_high double, mean double, std double, outliers long")
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = F.when((x >= F.lit(lo)) & (x <= F.lit(hi)), x)
    fixed = {"q1": q1, "median": q2, "q3": q3, "lower_fence": lo, "upper_fence": hi}
    return df.agg(
        F.min(inside).alias("whisker_low"), F.max(inside).alias("whisker_high"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        (F.count(x) - F.count(inside)).alias("outliers"),
    ).select(F.lit(column).alias("column"), *[F.lit(float(v)).alias(k) for k, v in fixed.items()], "whisker_low", "whisker_high", "mean", "std", "outliers")


def bin_number(x: Column, low: float, width: float, bins: int) -> Column:
    """Equal-width bin, the last one closed."""
    if width <= 0:
        return F.when(x.isNotNull(), F.lit(0).cast("long"))
    number = F.floor((x - F.lit(low)) / F.lit(width)).cast("long")
    return F.when(x.isNotNull(), F.least(number, F.lit(bins - 1).cast("long")))  # least() skips NULL


def histogram(df: DataFrame, column: str, max_bins: int = 50) -> DataFrame:
    """Counts of min(50, n / 10) bins, with mean and quartiles as reference lines."""
    x = num(df, column)
    s = df.agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("mean")).first()
    schema = "bin long, bin_start double, bin_end double, count long, mean double, median double, q25 double, q75 double"
    if not s["n"]:
        return literal_rows(df.sparkSession, [], schema)
    bins = max(1, min(max_bins, s["n"] // 10))
    width = (s["hi"] - s["lo"]) / bins
    q25, median, q75 = exact_quantiles(df, {column: x}, [0.25, 0.5, 0.75])[column]
    start = F.lit(s["lo"]) + F.col("bin") * F.lit(width)
    marks = {"mean": s["mean"], "median": median, "q25": q25, "q75": q75}
    return (
        df.select(bin_number(x, s["lo"], width, bins).alias("bin")).where(F.col("bin").isNotNull())
        .groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
        .select("bin", start.alias("bin_start"), (start + F.lit(width)).alias("bin_end"), "count",
                *[F.lit(v).cast("double").alias(k) for k, v in marks.items()])
    )


def density(df: DataFrame, column: str, max_bins: int = 50) -> DataFrame:
    """Histogram scaled to area one, for violin shapes."""
    h = histogram(df, column, max_bins)
    total = F.sum("count").over(Window.partitionBy(F.lit(1)))  # one row per bin
    width = F.col("bin_end") - F.col("bin_start")
    return h.select("bin", "bin_start", "count", F.try_divide(F.col("count").cast("double"), total * width).alias("density"), "median", "q25", "q75")


def pie(df: DataFrame, column: str, k: int = 15) -> DataFrame:
    """Shares among the top values."""
    top = _top_counts(df, column, k)
    total = F.sum("count").over(Window.partitionBy(F.lit(1)))  # at most k rows
    return top.select(F.col("value").cast("string").alias("value"), "count", percent(F.col("count"), total).alias("share_pct"))
