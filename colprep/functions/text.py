"""Text expressions with the semantics of Python string methods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Literals accepted as numbers and as dates.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITY_PATTERN = r"^\s*[+-]?(?i:inf|infinity)\s*$"
DATE_FORMATS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
)


def to_number(col: Column) -> Column:
    """Number or NULL. The guard rejects suffixed literals such as ``1d``."""
    number = F.when(col.rlike(NUMBER_PATTERN), F.trim(strip(col)).try_cast("double"))
    sign = F.when(strip(col).startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(col.rlike(INFINITY_PATTERN), sign).otherwise(number)


def to_timestamp(col: Column, formats=DATE_FORMATS) -> Column:
    """Timestamp without zone or NULL, first matching format wins."""
    clean = strip(col)
    return F.coalesce(*[F.try_to_timestamp(clean, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def strip(col: Column) -> Column:
    """Remove leading and trailing white space of any kind, not only blanks."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def title_case(col: Column) -> Column:
    """Upper-case every letter that does not follow a letter."""
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("after_letter"))
    folded = F.aggregate(
        F.split(F.lower(col), ""),
        start,
        lambda acc, ch: F.struct(
            F.concat(acc["text"], F.when(acc["after_letter"], ch).otherwise(F.upper(ch))).alias("text"),
            ch.rlike(r"\p{L}").alias("after_letter"),
        ),
        lambda acc: acc["text"],
    )
    return F.when(col.isNull(), F.lit(None).cast("string")).otherwise(folded)


def fixed(x: Column, digits: int) -> Column:
    """Fixed-point text, rounded from the exact binary value.

    ``%.2f`` on the JVM rounds the shortest decimal form, so 1.795 (stored as
    1.79499...) would become 1.80. The product with the scale is split into its
    rounded value and its exact error, which decides apparent ties.
    """
    scale = float(10**digits)
    v = F.abs(x)
    big = v * F.lit(134217729.0)  # 2**27 + 1 splits the mantissa in two halves
    high = big - (big - v)
    product = v * F.lit(scale)
    error = (high * F.lit(scale) - product) + (v - high) * F.lit(scale)
    whole = F.floor(F.least(product, F.lit(1e15))).cast("double")
    rest = product - whole
    odd = F.pmod(whole, F.lit(2.0)) == 1
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & odd)))
    rounded = (whole + F.when(up, 1.0).otherwise(0.0)) / F.lit(scale)
    safe = F.when(product < 1e15, rounded).otherwise(v)
    return F.concat(F.when(x < 0, "-").otherwise(""), F.format_string(f"%.{digits}f", safe))
