"""Order-insensitive content fingerprint of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprep.functions.exprs import c

_PRIME = 2_147_483_647


def fingerprint(df: DataFrame) -> DataFrame:
    """One row; equal for equal bags of rows under any partitioning."""
    h = F.xxhash64(*[c(x) for x in df.columns])
    return df.select(h.alias("h")).agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor("h").alias("xor_hash"), F.sum(F.pmod("h", F.lit(_PRIME))).alias("sum_hash")
    )


def same_content(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows in the same columns."""
    return a.columns == b.columns and fingerprint(a).first() == fingerprint(b).first()
