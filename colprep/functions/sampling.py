"""Deterministic bounded samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colprep.functions.exprs import c

_SPAN = 2.0**64


def hash_sample(df: DataFrame, value: Column, key: Sequence[str], size: int, total: int | None = None) -> list[float]:
    """The ``size`` non-null values whose key hash is smallest, on the driver.

    Same rows on every run and under any partitioning. A hash cut-off drops all
    but about ``size`` rows before the sort, so no task sees more than that.
    """
    rows = df.select(
        F.xxhash64(*[c(k) for k in key]).alias("h"), value.cast("double").alias("x")
    ).where(F.col("x").isNotNull())
    n = rows.count() if total is None else total
    if n > size:
        slack = 6.0 * size**0.5 + 16
        share = min(1.0, (size + slack) / n)
        rows = rows.where(F.col("h").cast("double") <= F.lit(-(2.0**63) + share * _SPAN))
    picked = rows.orderBy("h", "x").limit(size).collect()
    return [r["x"] for r in picked]
