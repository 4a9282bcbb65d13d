"""Fitted recipes, rules, missing rates and repeats on streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprep.functions.exprs import c, percent
from colprep.operators.rules_single import rule_violations
from colprep.plans.recipe import FittedRecipe
from colprep.sources.normalize import nan_to_null


def clean_stream(stream: DataFrame, recipe: FittedRecipe) -> DataFrame:
    """Apply row-wise steps to a stream.

    Fitted numbers are literals, so the query is stateless. Steps that need the
    order or the neighbours of a row have no meaning on an open stream.
    """
    if not recipe.row_wise:
        bad = [s.operation.method for s in recipe.steps if s.fitted is not None and not s.fitted.row_wise]
        raise ValueError(f"not applicable to a stream: {', '.join(bad)}")
    return recipe.transform(nan_to_null(stream))


def violation_counts(stream: DataFrame, time: str, key: Sequence[str], as_of_year: int, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Rule violations per tumbling window, late rows within ``late`` included."""
    cells = rule_violations(stream.withWatermark(time, late), [time, *key], as_of_year)
    return cells.groupBy(F.window(c(time), window), "column", "rule").agg(F.count(F.lit(1)).alias("violations"))


def missing_rates(stream: DataFrame, time: str, columns: Sequence[str] | None = None, window: str = "30 minutes", slide: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Share of missing values of each column in sliding windows of event time.

    One row for each closed window and column: ``start``, ``end``, ``column``, ``rows``,
    ``missing``, ``missing_pct``. In append mode a window is emitted once, when the
    watermark passes its end; rows that come up to ``late`` behind are counted, later
    ones are not. The state is one row of counts for each open window.
    """
    columns = [x for x in (columns or stream.columns) if x != time]
    marked = stream.withWatermark(time, late)
    counts = marked.groupBy(F.window(c(time), window, slide).alias("w")).agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(c(x).isNull()).alias(f"m{i}") for i, x in enumerate(columns)]
    )
    cells = F.array(*[F.struct(F.lit(x).alias("column"), F.col(f"m{i}").alias("missing")) for i, x in enumerate(columns)])
    rows = counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows", F.inline(cells))
    return rows.select("start", "end", "column", "rows", "missing", percent(F.col("missing"), F.col("rows")).alias("missing_pct"))


def drop_repeats(stream: DataFrame, time: str, key: Sequence[str], within: str = "10 minutes") -> DataFrame:
    """The first row of each key; a repeat is dropped if it comes within the watermark's delay of the first one.

    The state store holds a key until the watermark has passed its first row by
    ``within``, so it stays bounded on an endless stream. A null key equals a null key.
    """
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(list(key))
