"""Ingest rules that make NULL the only missing value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprep.functions.exprs import FLOAT_TYPES, c, is_text
from colprep.functions.text import INFINITY_PATTERN, NUMBER_PATTERN, to_number

# Texts read as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating-point column."""
    floats = {f.name: F.when(~F.isnan(c(f.name)), c(f.name)) for f in df.schema.fields if isinstance(f.dataType, FLOAT_TYPES)}
    return df.withColumns(floats) if floats else df


def na_tokens_to_null(df: DataFrame, tokens=NA_TOKENS) -> DataFrame:
    """The usual missing-value markers become NULL in every text column."""
    texts = {f.name: F.when(~c(f.name).isin(*tokens), c(f.name)) for f in df.schema.fields if is_text(f.dataType)}
    return df.withColumns(texts) if texts else df


def infer_text_types(df: DataFrame) -> DataFrame:
    """Cast text columns to bigint, double or boolean when every value fits.

    One aggregate over the data decides all columns.
    """
    names = [f.name for f in df.schema.fields if is_text(f.dataType)]
    if not names:
        return df
    aggs = []
    for i, name in enumerate(names):
        col = c(name)
        number = col.rlike(NUMBER_PATTERN) | col.rlike(INFINITY_PATTERN)
        aggs += [
            F.count(col).alias(f"n{i}"),
            F.coalesce(F.every(col.rlike(r"^\s*[+-]?\d{1,18}\s*$")), F.lit(False)).alias(f"i{i}"),
            F.coalesce(F.every(number), F.lit(False)).alias(f"d{i}"),
            F.coalesce(F.every(col.isin("True", "False", "TRUE", "FALSE", "true", "false")), F.lit(False)).alias(f"b{i}"),
        ]
    fit = df.agg(*aggs).first()
    casts = {}
    for i, name in enumerate(names):
        if fit[f"n{i}"] == 0:
            casts[name] = c(name).cast("double")
        elif fit[f"i{i}"]:
            casts[name] = F.trim(c(name)).cast("bigint")
        elif fit[f"d{i}"]:
            casts[name] = to_number(c(name))
        elif fit[f"b{i}"]:
            casts[name] = F.lower(c(name)).cast("boolean")
    return df.withColumns(casts) if casts else df
