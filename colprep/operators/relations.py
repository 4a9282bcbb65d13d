"""Pairwise correlations of numeric columns."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colprep.functions.exprs import literal_rows, num
from colprep.functions.gram import pair_sums
from colprep.operators.profile import TableProfile, _as_profile


def _columns(source: DataFrame | TableProfile, columns: Sequence[str] | None) -> tuple[TableProfile, list[str]]:
    p = _as_profile(source)
    return p, list(columns or p.numeric)


def correlation_pairs(source: DataFrame | TableProfile, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column1, column2, r)`` for every unordered pair, pairwise complete; NULL where a side is constant.

    Sums of products of centred values come from Gram matrices, so hundreds of
    columns take as few scans as two.
    """
    p, names = _columns(source, columns)
    stats = p.pass_a
    usable = [x for x in names if stats[x]["mean"] is not None and math.isfinite(stats[x]["mean"])]
    pairs = literal_rows(p.spark, [(a, b) for a, b in combinations(names, 2)], "column1 string, column2 string")
    if len(usable) < 2:
        return pairs.withColumn("r", F.lit(None).cast("double"))
    centred = p.df.select(*[(num(p.df, x) - F.lit(stats[x]["mean"])).alias(f"d{k}") for k, x in enumerate(usable)])
    sums = pair_sums(centred, centred.columns)
    vx, vy = (F.expr(f"if({v} > 1e-12 * {s}, {v}, 0D)") for v, s in (("sxx - sx * sx / n", "sxx"), ("syy - sy * sy / n", "syy")))  # what is left of a constant is rounding noise
    r = F.when(F.col("n") > 1, F.try_divide(F.expr("xy - sx * sy / n"), F.sqrt(vx * vy)))
    label = F.array(*[F.lit(x) for x in usable])
    found = sums.where("n > 0").select(F.element_at(label, F.col("i") + 1).alias("column1"), F.element_at(label, F.col("j") + 1).alias("column2"), F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"))
    # pairs without a row in common, and columns without a finite mean, have no sums
    return pairs.join(found, ["column1", "column2"], "left")


def correlation_matrix(source: DataFrame | TableProfile, columns: Sequence[str] | None = None) -> DataFrame:
    """Full matrix in long form, diagonal included; NULL on constant columns."""
    p, names = _columns(source, columns)
    pairs = correlation_pairs(p, names)
    diagonal = literal_rows(p.spark, [(x, x, 1.0 if p.pass_a[x]["std"] else None) for x in names], "column1 string, column2 string, r double")
    both_ways = pairs.select(F.inline(F.array(F.struct("column1", "column2", "r"), F.struct(F.col("column2").alias("column1"), F.col("column1").alias("column2"), "r"))))
    return both_ways.unionByName(diagonal)


def high_pairs(source: DataFrame | TableProfile, columns: Sequence[str] | None = None, threshold: float = 0.7) -> DataFrame:
    return (
        correlation_pairs(source, columns)
        .where(F.abs("r") > threshold)
        .select("column1", "column2", F.round("r", 3).alias("correlation"))
    )


def top_correlations(source: DataFrame | TableProfile, columns: Sequence[str] | None = None, k: int = 5, minimum: float = 0.1) -> DataFrame:
    """Per column its ``k`` strongest partners among all other numeric columns."""
    p, names = _columns(source, columns)
    pairs = correlation_pairs(p, names).where(F.abs("r") > minimum)
    both_ways = pairs.select(
        F.inline(F.array(
            F.struct(F.col("column1").alias("column"), F.col("column2").alias("other"), "r"),
            F.struct(F.col("column2").alias("column"), F.col("column1").alias("other"), "r"),
        ))
    )
    w = Window.partitionBy("column").orderBy(F.abs("r").desc(), "other")
    return (
        both_ways.select("column", "other", "r", F.row_number().over(w).alias("rank"))
        .where(F.col("rank") <= k)
    )
