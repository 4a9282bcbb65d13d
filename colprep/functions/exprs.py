"""Small Column-expression helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def is_numeric(dtype: T.DataType) -> bool:
    """Numbers and booleans; booleans count as 0/1."""
    return isinstance(dtype, (*INTEGER_TYPES, *FLOAT_TYPES, T.DecimalType, T.BooleanType))


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text(f.dataType)]


def flat_columns(df: DataFrame) -> list[str]:
    """Columns with a scalar type; nested values only get count statistics."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, NESTED_TYPES)]


def c(name: str) -> Column:
    """Column by exact name, also when the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def num(df: DataFrame, name: str) -> Column:
    """The column as double; booleans become 0.0 / 1.0."""
    dtype = df.schema[name].dataType
    col = c(name)
    return (col.cast("int") if isinstance(dtype, T.BooleanType) else col).cast("double")


def ratio(part: Column, whole: Column) -> Column:
    """Division that yields NULL instead of an error for a zero divisor."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double") * F.lit(100.0), whole.cast("double"))


def count_if(cond: Column) -> Column:
    """Number of rows where ``cond`` is true (0, not NULL, on no rows)."""
    return F.count(F.when(cond, F.lit(1)))


def pearson(a: Column, b: Column) -> Column:
    """Pairwise-complete Pearson correlation, NULL for a constant side."""
    both = a.isNotNull() & b.isNotNull()
    return F.try_divide(
        F.covar_samp(a, b),
        F.stddev_samp(F.when(both, a)) * F.stddev_samp(F.when(both, b)),
    )


def literal_rows(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    """A driver-side table whose size is bounded by the number of columns, rules or buckets.

    It becomes a local relation of known size, so joins with it are broadcast
    and filters on it are folded while planning.
    """
    fields = T._parse_datatype_string(schema)
    data = [dict(zip(fields.names, r)) for r in rows]
    return spark.createDataFrame(pa.Table.from_pylist(data, schema=to_arrow_schema(fields)), schema=fields)


def bounded(df: DataFrame) -> DataFrame:
    """Evaluate a table of at most one row per column, rule or bucket and keep it local.

    Several reports read these tables; without this each would scan the data again.
    """
    return df.sparkSession.createDataFrame(df.toArrow(), schema=df.schema)
