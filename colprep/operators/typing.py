"""Semantic types of columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colprep.functions.exprs import DATETIME_TYPES, INTEGER_TYPES, c, flat_columns, is_numeric, is_text, literal_rows, num, ratio
from colprep.operators.profile import value_frequencies, vf_value

# The types a user may choose from.
SEMANTIC_TYPES = ("continuous", "integer", "ordinal", "categorical", "binary", "text", "datetime", "empty", "unknown")

# Every rule asks about fewer than 20 distinct values. A column whose sketch
# shows ten times as many is certainly past them and needs no exact count.
_EXACT_BELOW = 200


def _family(dtype: T.DataType) -> str:
    if is_text(dtype):
        return "text"
    if isinstance(dtype, INTEGER_TYPES):
        return "integer"
    if is_numeric(dtype):
        return "float"
    if isinstance(dtype, DATETIME_TYPES):
        return "datetime"
    return "other"


def _type_rule(family: Column, non_null: Column, distinct: Column, minimum: Column) -> Column:
    return (
        F.when(non_null == 0, "empty")
        .when(distinct == 2, "binary")
        .when((family == "text") & (ratio(distinct, non_null) < 0.1) & (distinct < 20), "categorical")
        .when(family == "text", "text")
        .when((family == "integer") & (distinct < 10) & (minimum >= 0), "ordinal")
        .when(family == "integer", "integer")
        .when(family == "float", "continuous")
        .when(family == "datetime", "datetime")
        .otherwise("unknown")
    )


def detect_types(df: DataFrame) -> DataFrame:
    """``(column, dtype, semantic_type)`` for every column.

    One aggregate with sketches for all columns, then exact distinct counts for
    the low-cardinality ones only, so no high-cardinality column is shuffled.
    """
    flat = set(flat_columns(df))
    aggs = []
    for i, f in enumerate(df.schema.fields):
        aggs.append(F.count(c(f.name)).alias(f"n{i}"))
        if f.name in flat:
            aggs.append(F.approx_count_distinct(c(f.name)).alias(f"d{i}"))
        if is_numeric(f.dataType):
            aggs.append(F.min(num(df, f.name)).alias(f"m{i}"))
    fit = df.agg(*aggs).first().asDict()
    low = [f.name for i, f in enumerate(df.schema.fields) if f.name in flat and fit[f"d{i}"] < _EXACT_BELOW]
    base = literal_rows(
        df.sparkSession,
        [
            (i, f.name, f.dataType.simpleString(), _family(f.dataType), fit[f"n{i}"], fit.get(f"d{i}", -1), fit.get(f"m{i}"))
            for i, f in enumerate(df.schema.fields)
        ],
        "position int, column string, dtype string, family string, non_null long, sketch long, minimum double",
    )
    if low:
        exact = (
            value_frequencies(df, low).where(vf_value().isNotNull())
            .groupBy("column").agg(F.count(F.lit(1)).alias("exact"))
        )
        base = base.join(exact, "column", "left")
    else:
        base = base.withColumn("exact", F.lit(None).cast("long"))
    distinct = F.coalesce("exact", "sketch")
    return base.select(
        "column", "dtype",
        _type_rule(F.col("family"), F.col("non_null"), distinct, F.col("minimum")).alias("semantic_type"),
    )


def override_types(types: DataFrame, overrides: Mapping[str, str]) -> DataFrame:
    """Replace detected types by user choices."""
    unknown = set(overrides.values()) - set(SEMANTIC_TYPES)
    if unknown:
        raise ValueError(f"unknown semantic type: {sorted(unknown)}")
    chosen = literal_rows(types.sparkSession, overrides.items(), "column string, chosen string")
    return types.join(F.broadcast(chosen), "column", "left").select(
        "column", "dtype",
        F.coalesce("chosen", "semantic_type").alias("semantic_type"),
        F.col("chosen").isNotNull().alias("overridden"),
    )
