"""Column profiling in two passes over the data.

Pass A is one aggregate without a row shuffle: counts, moments, extremes.
Pass B is the value-frequency table: one shuffle after map-side combine, from
which distinct counts, modes, top lists, entropy, duplicates and rare values
are read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colprep.functions.exprs import (
    FLOAT_TYPES, INTEGER_TYPES, bounded, c, count_if, flat_columns, is_numeric, is_text, literal_rows, num, numeric_columns,
    percent, ratio,
)
from colprep.functions.quantiles import exact_quantiles
from colprep.functions.text import fixed

QUARTILES = (0.25, 0.5, 0.75)


def value_frequencies(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, int_value, dbl_value, str_value, cnt)``, NULL as one group.

    Columns of one type family are unpivoted together, so there are at most
    four shuffles whatever the number of columns, each on a native key. Partial
    aggregation before the shuffle keeps a value that holds a third of the rows
    cheap.
    """
    columns = list(columns or flat_columns(df))
    families: dict[str, list[str]] = {"int_value": [], "dbl_value": [], "dec_value": [], "str_value": []}
    for name in columns:
        dtype = df.schema[name].dataType
        if isinstance(dtype, (*INTEGER_TYPES, T.BooleanType)):
            families["int_value"].append(name)
        elif isinstance(dtype, FLOAT_TYPES):
            families["dbl_value"].append(name)
        elif isinstance(dtype, T.DecimalType):
            families["dec_value"].append(name)
        else:
            families["str_value"].append(name)
    cast = {
        "int_value": lambda x: x.cast("long"),
        "dbl_value": lambda x: x.cast("double") + F.lit(0.0),  # folds -0.0 into 0.0
        # a decimal's own digits tell its values apart, whatever their size; the double only orders them
        "dec_value": lambda x: x.cast("string"),
        "str_value": lambda x: x.cast("string"),
    }
    holds = {"dec_value": ("dbl_value", "str_value")}
    types = {"int_value": "long", "dbl_value": "double", "str_value": "string"}
    parts = []
    for field, names in families.items():
        if not names:
            continue
        cells = F.array(*[F.struct(F.lit(i).alias("id"), cast[field](c(x)).alias("v")) for i, x in enumerate(names)])
        counts = df.select(F.inline(cells)).groupBy("id", "v").agg(F.count(F.lit(1)).alias("cnt"))
        label = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("id") + 1)
        parts.append(counts.select(
            label.alias("column"), *[(F.col("v") if f in holds.get(field, (field,)) else F.lit(None)).cast(t).alias(f) for f, t in types.items()], "cnt"
        ))
    return reduce(DataFrame.unionByName, parts)


def vf_value() -> Column:
    """The value of a frequency row as text, NULL for the missing group."""
    return F.coalesce(F.col("str_value"), F.col("int_value").cast("string"), F.col("dbl_value").cast("string"))


def vf_top(vf: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent non-null values per column; ties by value.

    ``row_number() <= k`` is pushed into the sort as a group limit, so each
    task forwards at most ``k`` rows per column.
    """
    w = Window.partitionBy("column").orderBy(F.col("cnt").desc(), "int_value", "dbl_value", "str_value")
    return (
        vf.where(vf_value().isNotNull())
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .withColumn("value", vf_value())
    )


def vf_summary(vf: DataFrame, rows: int) -> DataFrame:
    """Per column: distinct values, duplicates, entropy, mode, rare values."""
    n = F.col("cnt")
    present = vf_value().isNotNull()
    value_count = F.when(present, n)
    non_null = F.sum(value_count)
    mode = F.min(F.when(present, F.struct((-n).alias("neg"), *[F.col(x) for x in ("int_value", "dbl_value", "str_value")])))
    return (
        vf.groupBy("column")
        .agg(
            count_if(present).alias("unique_count"),
            F.sum(F.when(n > 1, n).otherwise(0)).cast("long").alias("duplicate_rows"),
            (F.ln(non_null) - ratio(F.sum(value_count * F.ln(value_count)), non_null)).alias("entropy"),
            count_if(present & (n < F.lit(rows * 0.01))).alias("rare_values"),
            mode.alias("m"),
        )
        .select(
            "column", "unique_count", "duplicate_rows", "rare_values",
            # no values at all: zero, not an undefined logarithm
            F.coalesce("entropy", F.lit(0.0)).alias("entropy"),
            F.coalesce(F.col("m.str_value"), F.col("m.int_value").cast("string"), F.col("m.dbl_value").cast("string")).alias("mode_value"),
            (-F.col("m.neg")).alias("mode_count"),
        )
    )


class TableProfile:
    """Shared, lazily computed statistics of one table.

    Driver-side state is a dozen numbers per column. Everything else stays a
    DataFrame.
    """

    def __init__(self, df: DataFrame, columns: Sequence[str] | None = None):
        self.df = df
        self.columns = list(columns or df.columns)
        self.flat = [x for x in self.columns if x in set(flat_columns(df))]
        self.numeric = [x for x in self.columns if x in set(numeric_columns(df))]
        self.text = [x for x in self.columns if is_text(df.schema[x].dataType)]

    @property
    def spark(self):
        return self.df.sparkSession

    @cached_property
    def pass_a(self) -> dict[str, dict]:
        """Counts and extremes, then moments centred on the means.

        Two aggregates of plain sums over all columns. They compile to small
        generated code, and centring keeps the higher moments accurate.
        """
        aggs = [F.count(F.lit(1)).alias("rows")]
        for i, name in enumerate(self.columns):
            aggs.append(F.count(c(name)).alias(f"nn_{i}"))
            if name in self.numeric:
                x = num(self.df, name)
                aggs += [F.sum(x).alias(f"sum_{i}"), F.min(x).alias(f"min_{i}"), F.max(x).alias(f"max_{i}"),
                         count_if(F.abs(x) == F.lit(float("inf"))).alias(f"inf_{i}")]
        row = self.df.agg(*aggs).first().asDict()
        out = {}
        for i, name in enumerate(self.columns):
            stats = {k: row.get(f"{k}_{i}") for k in ("sum", "min", "max", "inf")}
            n = row[f"nn_{i}"]
            out[name] = {"rows": row["rows"], "non_null": n, "missing": row["rows"] - n, **stats,
                         "mean": stats["sum"] / n if n and stats["sum"] is not None else None,
                         "std": None, "stdp": None, "skew": None, "kurt": None}
        self._add_moments(out)
        return out

    def _add_moments(self, out: dict[str, dict]) -> None:
        names = [x for x in self.numeric if out[x]["mean"] is not None and math.isfinite(out[x]["mean"])]
        aggs = []
        for i, name in enumerate(names):
            d = num(self.df, name) - F.lit(out[name]["mean"])
            aggs += [F.sum(d * d).alias(f"d2_{i}"), F.sum(d * d * d).alias(f"d3_{i}"), F.sum(d * d * d * d).alias(f"d4_{i}")]
        if not aggs:
            return
        row = self.df.agg(*aggs).first()
        for i, name in enumerate(names):
            s, n = out[name], out[name]["non_null"]
            constant = s["min"] == s["max"]
            d2 = 0.0 if constant else row[f"d2_{i}"]
            s["stdp"] = math.sqrt(d2 / n)
            s["std"] = math.sqrt(d2 / (n - 1)) if n > 1 else None
            if d2 > 0:
                s["skew"] = (row[f"d3_{i}"] / n) / (d2 / n) ** 1.5
                s["kurt"] = (row[f"d4_{i}"] / n) / (d2 / n) ** 2 - 3.0

    @property
    def rows(self) -> int:
        return next(iter(self.pass_a.values()))["rows"]

    @cached_property
    def quartiles(self) -> dict[str, list[float | None]]:
        ends = {x: tuple(self.pass_a[x][k] for k in ("non_null", "min", "max")) for x in self.numeric}
        return exact_quantiles(self.df, {x: num(self.df, x) for x in self.numeric}, QUARTILES, ends)

    @cached_property
    def vf(self) -> DataFrame:
        return value_frequencies(self.df, self.flat)

    @cached_property
    def frequencies(self) -> DataFrame:
        return bounded(vf_summary(self.vf, self.rows))

    def stats_table(self) -> DataFrame:
        """Pass A and quartiles as one row per column."""
        rows = []
        for position, name in enumerate(self.columns):
            s = self.pass_a[name]
            q25, median, q75 = self.quartiles.get(name, [None] * 3)
            rows.append(
                (
                    position, name, self.df.schema[name].dataType.simpleString(), name in self.numeric, name in self.text,
                    s["rows"], s["non_null"], s["missing"],
                    *[s[k] if s[k] is None else float(s[k]) for k in ("mean", "std", "stdp", "min", "max", "skew", "kurt")],
                    median, q25, q75, s["inf"],
                )
            )
        schema = (
            "position int, column string, dtype string, is_numeric boolean, is_text boolean, rows long, non_null long, "
            "missing long, mean double, std double, std_pop double, min double, max double, skewness double, "
            "kurtosis double, median double, q25 double, q75 double, infinite long"
        )
        table = literal_rows(self.spark, rows, schema)
        return table.withColumn("missing_pct", percent(F.col("missing"), F.col("rows")))

    def table(self) -> DataFrame:
        """Statistics and frequency summary joined; one row per column."""
        return (
            self.stats_table()
            .join(self.frequencies, "column", "left")
            .withColumn("unique_pct", percent(F.col("unique_count"), F.col("rows")))
        )


def _as_profile(source: DataFrame | TableProfile, columns=None) -> TableProfile:
    return source if isinstance(source, TableProfile) else TableProfile(source, columns)


def profile_basic(source, columns=None) -> DataFrame:
    """Counts, missing, distinct, mean, median, sd, extremes and quartiles."""
    return _as_profile(source, columns).table().select(
        "column", F.col("rows").alias("count"), "missing", "missing_pct", "unique_count", "unique_pct",
        "mean", "median", "std", "min", "max", "q25", "q75",
    )


def profile_moments(source, columns=None) -> DataFrame:
    """Population skewness and excess kurtosis of numeric columns."""
    p = _as_profile(source, columns)
    return p.stats_table().where("is_numeric").select("column", "non_null", "mean", "std", "skewness", "kurtosis")


def profile_summary_text(source, columns=None) -> DataFrame:
    """One descriptive sentence per column."""
    parts = [
        F.format_string("Column '%s' has %,d total values", F.col("column"), F.col("rows")),
        F.when(F.col("missing") > 0, F.format_string(", %,d missing (%s%%)", F.col("missing"), fixed(F.col("missing_pct"), 1))).otherwise(""),
        F.format_string(", %,d unique values", F.coalesce("unique_count", F.lit(0))),
        F.when(
            F.col("is_numeric") & F.col("min").isNotNull(),
            F.format_string(". Range: %s to %s", fixed(F.col("min"), 2), fixed(F.col("max"), 2)),
        ).otherwise(""),
    ]
    return _as_profile(source, columns).table().select("column", F.concat(*parts).alias("summary"))


def profile_dataset(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and missing share; a single aggregate."""
    nulls = [count_if(c(x).isNull()) for x in df.columns]
    total = nulls[0]
    for n in nulls[1:]:
        total = total + n
    return df.agg(F.count(F.lit(1)).alias("rows"), total.alias("missing_cells")).select(
        "rows",
        F.lit(len(df.columns)).cast("long").alias("columns"),
        "missing_cells",
        percent(F.col("missing_cells"), F.col("rows") * F.lit(len(df.columns))).alias("missing_pct"),
    )


def dataset_flags(df: DataFrame, missing_share: float = 0.2, large_rows: int = 50_000) -> DataFrame:
    """Warnings about the table as a whole."""
    return profile_dataset(df).select(
        "rows", "missing_pct",
        (F.col("missing_cells") > F.col("rows") * F.lit(len(df.columns) * missing_share)).alias("high_missing"),
        (F.col("rows") > large_rows).alias("large_dataset"),
    )


def profile_describe(source, columns=None) -> DataFrame:
    """Numeric summary in long form: ``(column, statistic, value)``."""
    p = _as_profile(source, columns)
    fields = {"count": F.col("non_null").cast("double"), "mean": F.col("mean"), "std": F.col("std"), "min": F.col("min"),
              "25%": F.col("q25"), "50%": F.col("median"), "75%": F.col("q75"), "max": F.col("max")}
    entries = F.array(*[F.struct(F.lit(k).alias("statistic"), v.alias("value")) for k, v in fields.items()])
    return p.stats_table().where("is_numeric").select("column", F.inline(entries))


def profile_overview(source, columns=None) -> DataFrame:
    return _as_profile(source, columns).table().select("column", "dtype", "missing_pct", "unique_pct")


def column_info(source, columns=None) -> DataFrame:
    """Type, non-null, missing and distinct counts per column."""
    return _as_profile(source, columns).table().select(
        "column", "dtype", "non_null", "missing", "missing_pct", "unique_count"
    )


def missing_summary(df: DataFrame) -> DataFrame:
    """Columns that have missing values, share to two decimals."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[count_if(c(x).isNull()).alias(f"m{i}") for i, x in enumerate(df.columns)])
    entries = F.array(*[F.struct(F.lit(x).alias("column"), F.col(f"m{i}").alias("missing")) for i, x in enumerate(df.columns)])
    return (
        counts.select("n", F.inline(entries))
        .where("missing > 0")
        .select("column", "missing", F.round(percent(F.col("missing"), F.col("n")), 2).alias("missing_pct"))
        .orderBy(F.col("missing").desc(), "column")
    )


def sample_values(df: DataFrame, order_by: Sequence[str], k: int = 3, width: int = 20, head: int = 1_000) -> DataFrame:
    """The first ``k`` non-null values per column in row order, cut at ``width``.

    The first rows usually hold them all. Columns that start with a long gap are
    looked up one by one. Both are bounded take-ordered plans, not a sort.
    """
    names = flat_columns(df)
    keys = [c(x) for x in order_by]
    texts = [c(x).cast("string").alias(f"t{i}") for i, x in enumerate(names)]
    first = df.orderBy(*keys).limit(head).select(*texts).collect()
    rows = []
    for i, x in enumerate(names):
        found = [r[i] for r in first if r[i] is not None][:k]
        if len(found) < k and len(first) == head:
            found = [r[0] for r in df.where(c(x).isNotNull()).orderBy(*keys).limit(k).select(texts[i]).collect()]
        rows.append((x, ", ".join(t[:width] + "..." if len(t) > width else t for t in found)))
    return literal_rows(df.sparkSession, rows, "column string, samples string")


# --- distribution -----------------------------------------------------------

def shape_label(skew: Column, non_null: Column) -> Column:
    return (
        F.when(non_null < 10, "insufficient_data")
        .when(F.abs(skew) < 0.5, "approximately_normal")
        .when(F.abs(skew) < 1, "moderately_skewed")
        .otherwise("highly_skewed")
    )


def dist_shape(source, columns=None) -> DataFrame:
    p = _as_profile(source, columns)
    return p.stats_table().where("is_numeric").select(
        "column", "skewness", "kurtosis", shape_label(F.col("skewness"), F.col("non_null")).alias("shape")
    )


def dist_labels(source, columns=None) -> DataFrame:
    """Direction of the skew and weight of the tails."""
    p = _as_profile(source, columns)
    skew, kurt = F.col("skewness"), F.col("kurtosis")
    return p.stats_table().where("is_numeric").select(
        "column",
        F.when(skew > 0.1, "right").when(skew < -0.1, "left").otherwise("symmetric").alias("direction"),
        F.when(kurt < -0.5, "platykurtic").when(kurt > 0.5, "leptokurtic").otherwise("mesokurtic").alias("tails"),
    )


def dist_jarque_bera(source, columns=None) -> DataFrame:
    """Normality test on all rows, from the moments alone."""
    p = _as_profile(source, columns)
    jb = F.col("non_null") / 6.0 * (F.pow("skewness", F.lit(2.0)) + F.pow("kurtosis", F.lit(2.0)) / 4.0)
    return (
        p.stats_table().where("is_numeric AND non_null >= 10")
        .select("column", jb.alias("jarque_bera"), F.exp(-jb / 2.0).alias("p_value"))
        .withColumn("is_normal", F.col("p_value") > 0.05)
    )


def dist_top(source, columns=None, k: int = 10) -> DataFrame:
    p = _as_profile(source, columns)
    return vf_top(p.vf, k).select("column", "value", F.col("cnt").alias("count"), "rank")


def dist_entropy(source, columns=None) -> DataFrame:
    p = _as_profile(source, columns)
    return p.frequencies.select("column", "unique_count", "mode_value", "mode_count", "entropy")


def balance_label(entropy_ratio: Column) -> Column:
    return F.when(entropy_ratio > 0.9, "even").when(entropy_ratio > 0.7, "moderate").otherwise("imbalanced")


def dist_balance(source, columns=None, k: int = 10) -> DataFrame:
    """Top categories with their share of the list, extremes, entropy ratio."""
    p = _as_profile(source, columns)
    listed = vf_top(p.vf, k)
    w = Window.partitionBy("column")  # at most k rows per column
    entropy_ratio = F.coalesce(ratio(F.col("entropy"), F.ln("unique_count")), F.lit(0.0))
    return (
        listed.withColumn("share_pct", percent(F.col("cnt"), F.sum("cnt").over(w)))
        .withColumn("most_common", F.max(F.when(F.col("rank") == 1, F.col("value"))).over(w))
        .withColumn("last", F.max("rank").over(w))
        .withColumn("least_common", F.max(F.when(F.col("rank") == F.col("last"), F.col("value"))).over(w))
        .join(p.frequencies.select("column", "unique_count", "entropy"), "column")
        .select("column", "rank", "value", F.col("cnt").alias("count"), "share_pct", "most_common", "least_common",
                entropy_ratio.alias("entropy_ratio"), balance_label(entropy_ratio).alias("balance"))
    )


def format_number(value: Column, integral: bool = False) -> Column:
    """N/A, millions as M, thousands as K, otherwise three decimals."""
    x = value.cast("double")
    return (
        F.when(value.isNull() | F.isnan(x), "N/A")
        .when(F.abs(x) >= 1_000_000, F.concat(fixed(x / 1_000_000, 2), F.lit("M")))
        .when(F.abs(x) >= 1_000, F.concat(fixed(x / 1_000, 2), F.lit("K")))
        .otherwise(value.cast("string") if integral else fixed(x, 3))
    )
