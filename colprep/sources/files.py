"""File sources and sinks."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colprep.functions.exprs import c
from colprep.sources.normalize import infer_text_types, na_tokens_to_null, nan_to_null


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """CSV with a header row, missing-value markers as NULL and inferred types.

    With an explicit schema the extra inference pass over the file is skipped.
    """
    reader = spark.read.option("header", True).option("escape", '"').options(**options)
    raw = na_tokens_to_null(reader.csv(path))
    if schema is None:
        return infer_text_types(raw)
    fields = T._parse_datatype_string(schema).fields if isinstance(schema, str) else schema.fields
    return nan_to_null(raw.select(*[c(f.name).cast(f.dataType).alias(f.name) for f in fields]))


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return nan_to_null(spark.read.format(fmt).load(path))


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """One file per partition with a header; quotes are doubled."""
    (
        df.write.mode(mode).option("header", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    df.write.mode(mode).format(fmt).save(path)


def report_json(tables: Mapping[str, DataFrame], metadata: Mapping[str, str]) -> DataFrame:
    """Report tables as JSON rows ``(section, metadata, record)``.

    Rows keep their distribution, so a long report table is written in parallel.
    """
    meta = F.lit(json.dumps(dict(metadata), sort_keys=True))
    parts = [
        t.select(F.lit(name).alias("section"), meta.alias("metadata"), F.to_json(F.struct(*[c(x) for x in t.columns])).alias("record"))
        for name, t in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_report_json(tables: Mapping[str, DataFrame], metadata: Mapping[str, str], path: str, mode: str = "error") -> None:
    report_json(tables, metadata).write.mode(mode).json(path)
