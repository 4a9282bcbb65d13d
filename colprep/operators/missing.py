"""Patterns of missing values along the row order and across columns."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colprep.functions.exprs import c, count_if, percent, ratio, literal_rows
from colprep.functions.gram import pair_sums
from colprep.functions.names import matches
from colprep.functions.ordered import BUCKET, OrderedFrame, with_position


def _null_positions(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], buckets: int | None) -> DataFrame:
    """``(column, position, island)`` of every null cell.

    Position minus running null count is constant along a run of nulls, also
    across bucket borders, because both are global: local values plus the
    offsets of the buckets ahead.
    """
    o = OrderedFrame(df.select(*dict.fromkeys([*columns, *order_by])), order_by, buckets)
    nulls = [c(x).isNull() for x in columns]
    summary = o.summary(n=F.count(F.lit(1)), **{f"m{i}": count_if(x) for i, x in enumerate(nulls)})
    offsets = o.carried(summary, sums={"__n": "n", **{f"__m{i}": f"m{i}" for i in range(len(columns))}})
    local = o.df.select(
        BUCKET,
        F.row_number().over(o.window()).alias("__r"),
        *[F.when(x, count_if(x).over(o.running())).alias(f"__c{i}") for i, x in enumerate(nulls)],
    )
    position = F.col("__n") + F.col("__r") - 1
    cells = F.array(
        *[
            F.struct(F.lit(x).alias("column"), (position - F.col(f"__m{i}") - F.col(f"__c{i}")).alias("island"))
            for i, x in enumerate(columns)
        ]
    )
    return (
        o.attach(local, offsets)
        .select(position.alias("position"), F.inline(cells))
        .where(F.col("island").isNotNull())
    )


def missing_runs(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Every run of consecutive missing values: start position and length."""
    return (
        _null_positions(df, columns, order_by, buckets)
        .groupBy("column", "island")
        .agg(F.min("position").alias("start"), F.count(F.lit(1)).alias("length"))
        .select("column", "start", "length")
    )


def missing_max_run(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], buckets: int | None = None) -> DataFrame:
    return missing_runs(df, columns, order_by, buckets).groupBy("column").agg(
        F.count(F.lit(1)).alias("runs"), F.max("length").alias("max_run")
    )


def pattern_label(missing: Column, missing_pct: Column, max_run: Column, rows: Column, front: Column, tail: Column) -> Column:
    return (
        F.when(missing == 0, "none")
        .when(missing_pct < 5, "sporadic")
        .when(max_run > rows * 0.1, "systematic_blocks")
        .when(front > tail * 2, "front_loaded")
        .when(tail > front * 2, "tail_loaded")
        .otherwise("random")
    )


def missing_pattern(df: DataFrame, order_by: Sequence[str], columns: Sequence[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Pattern label per column.

    Only columns that have nulls take part in the ordered pass.
    """
    columns = list(columns or df.columns)
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[count_if(c(x).isNull()).alias(f"m{i}") for i, x in enumerate(columns)]).first()
    n = counts["n"]
    missing = {x: counts[f"m{i}"] for i, x in enumerate(columns)}
    base = literal_rows(df.sparkSession, [(x, n, m) for x, m in missing.items()], "column string, rows long, missing long")
    holes = [x for x in columns if missing[x]]
    if holes:
        head, tail = int(n * 0.1), int(n * 0.9)
        runs = (
            _null_positions(df, holes, order_by, buckets)
            .groupBy("column", "island")
            .agg(
                F.count(F.lit(1)).alias("length"),
                count_if(F.col("position") < head).alias("front"),
                count_if(F.col("position") >= tail).alias("tail"),
            )
            .groupBy("column")
            .agg(F.max("length").alias("max_run"), F.sum("front").alias("front"), F.sum("tail").alias("tail"))
        )
        base = base.join(runs, "column", "left")
    else:
        base = base.withColumns({k: F.lit(None).cast("long") for k in ("max_run", "front", "tail")})
    base = base.fillna(0, ["max_run", "front", "tail"]).withColumn("missing_pct", percent(F.col("missing"), F.col("rows")))
    label = pattern_label(*[F.col(x) for x in ("missing", "missing_pct", "max_run", "rows", "front", "tail")])
    return base.select("column", "missing", "missing_pct", "max_run", F.col("front").alias("front_missing"),
                       F.col("tail").alias("tail_missing"), label.alias("pattern"))


def systematic_sample(df: DataFrame, order_by: Sequence[str], every: int, buckets: int | None = None) -> DataFrame:
    """Every ``every``-th row, from the first one on."""
    positioned = with_position(df, order_by, "position", buckets)
    return positioned.where(F.col("position") % every == 0) if every > 1 else positioned


def missing_matrix(df: DataFrame, order_by: Sequence[str], columns: Sequence[str] | None = None, every: int = 1, buckets: int | None = None) -> DataFrame:
    """0/1 missing indicators of all columns and rows, or of those asked for."""
    shown = list(columns or df.columns)
    sampled = systematic_sample(df.select(*dict.fromkeys([*shown, *order_by])), order_by, every, buckets)
    return sampled.select("position", *[c(x).isNull().cast("tinyint").alias(x) for x in shown])


def comissing_pairs(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.8) -> DataFrame:
    """Column pairs whose missing flags correlate above ``threshold``.

    Pair counts are a Gram matrix of the null flags; only columns with nulls are
    paired.
    """
    columns = list(columns or df.columns)
    first = df.agg(F.count(F.lit(1)).alias("n"), *[count_if(c(x).isNull()).alias(f"m{i}") for i, x in enumerate(columns)]).first()
    n = first["n"]
    missing = {x: first[f"m{i}"] for i, x in enumerate(columns)}
    holes = [x for x in columns if missing[x]]
    if len(holes) < 2:
        return literal_rows(df.sparkSession, [], "column1 string, column2 string, phi double, violations long")
    flags = df.select(*[c(x).isNull().cast("double").alias(f"m{k}") for k, x in enumerate(holes)])
    label, count = F.array(*[F.lit(x) for x in holes]), F.array(*[F.lit(float(missing[x])) for x in holes])
    ma, mb, size = F.element_at(count, F.col("i") + 1), F.element_at(count, F.col("j") + 1), F.lit(float(n))
    phi = ratio(F.col("xy") * size - ma * mb, F.sqrt(ma * (size - ma) * mb * (size - mb)))
    return (
        pair_sums(flags, flags.columns, gaps=False)
        .select(F.element_at(label, F.col("i") + 1).alias("column1"), F.element_at(label, F.col("j") + 1).alias("column2"), phi.alias("phi"), F.least(ma, mb).cast("long").alias("violations"))
        .where(F.col("phi") > threshold)
    )


# When the first is present, the second is expected too.
REQUIRED_PAIRS = (
    ("email", "phone"),
    ("first_name", "last_name"),
    ("street", "city"),
    ("start_date", "end_date"),
    ("income", "employment"),
)


def required_pairs(columns: Sequence[str], match: str = "token") -> list[tuple[str, str]]:
    return [
        (a, b)
        for first, second in REQUIRED_PAIRS
        for a, b in permutations(columns, 2)
        if matches(a, first, match) and matches(b, second, match)
    ]


def required_missing(df: DataFrame, match: str = "token") -> DataFrame:
    """Rows whose primary column is present while the required one is missing."""
    pairs = required_pairs(df.columns, match)
    schema = "primary_column string, required_column string, violations long"
    if not pairs:
        return literal_rows(df.sparkSession, [], schema)
    counts = df.agg(*[count_if(c(a).isNotNull() & c(b).isNull()).alias(f"v{i}") for i, (a, b) in enumerate(pairs)])
    entries = F.array(
        *[F.struct(F.lit(a).alias("primary_column"), F.lit(b).alias("required_column"), F.col(f"v{i}").alias("violations"))
          for i, (a, b) in enumerate(pairs)]
    )
    return counts.select(F.inline(entries)).where("violations > 0")
