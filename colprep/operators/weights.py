"""Survey weights: validation, weighted estimates, margins of error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colprep.functions.exprs import c, count_if, is_numeric, literal_rows, num, numeric_columns, percent, ratio
from colprep.functions.quantiles import exact_quantiles, weighted_descent
from colprep.functions.statfn import normal_quantile, t_quantile

# Limits of the warnings and recommendations.
VARIABILITY_RATIO = 100
HIGH_CV = 2
HIGH_DESIGN_EFFECT = 2


def _check(df: DataFrame, weights: str) -> Column:
    if weights not in df.columns:
        raise ValueError(f"weights column not found: {weights}")
    if not is_numeric(df.schema[weights].dataType):
        raise ValueError("weights column must be numeric")
    return num(df, weights)


def weights_validate(df: DataFrame, weights: str) -> DataFrame:
    """Counts behind the warnings and the warnings raised; never an error for odd values."""
    w = _check(df, weights)
    q01, q99 = exact_quantiles(df, {"w": w}, [0.01, 0.99])["w"]
    spread = ratio(F.lit(q99).cast("double"), F.lit(q01).cast("double"))
    one = df.agg(
        count_if(w.isNull()).alias("missing"), count_if(w < 0).alias("negative"), count_if(w == 0).alias("zero"),
        F.min(w).alias("lo"), F.max(w).alias("hi"),
    )
    warnings = F.array_compact(F.array(
        F.when(F.col("missing") > 0, "missing_weights"),
        F.when(F.col("negative") > 0, "negative_weights"),
        F.when(F.col("zero") > 0, "zero_weights"),
        F.when((F.col("quantile_ratio") > VARIABILITY_RATIO) | (F.col("quantile_ratio").isNull() & F.lit((q99 or 0) > 0)), "high_variability"),
        F.when(F.col("lo").isNull() | (F.col("lo") == F.col("hi")), "constant_weights"),
    ))
    return one.withColumn("quantile_ratio", spread).select(
        "missing", "negative", "zero", "quantile_ratio", warnings.alias("warnings"), F.lit(True).alias("valid")
    )


def weights_metadata(df: DataFrame, weights: str) -> DataFrame:
    w = _check(df, weights)
    return df.agg(
        F.avg(w).alias("mean"), F.min(w).alias("min"), F.max(w).alias("max"), F.stddev_samp(w).alias("std"),
        F.sum(w).alias("total_weight"), count_if(w < 0).alias("negative_weights"), count_if(w == 0).alias("zero_weights"),
    )


def _power_sums(df: DataFrame, columns: Sequence[str], weights: str) -> dict[str, dict]:
    """Count, sums of w, w*w, w*x and the centred w*(x-m)^2 per column.

    Two aggregates over all columns: the second is centred on the weighted mean
    of the first, which keeps the variance accurate for large means.
    """
    w = _check(df, weights)
    aggs = []
    for i, name in enumerate(columns):
        x = num(df, name)
        ok = x.isNotNull() & w.isNotNull()
        aggs += [
            count_if(ok).alias(f"n{i}"), F.sum(F.when(ok, w)).alias(f"w{i}"), F.sum(F.when(ok, w * w)).alias(f"ww{i}"),
            F.sum(F.when(ok, w * x)).alias(f"wx{i}"), F.min(F.when(ok, x)).alias(f"lo{i}"), F.max(F.when(ok, x)).alias(f"hi{i}"),
        ]
    one = df.agg(*aggs).first()
    means = [None if not one[f"w{i}"] else one[f"wx{i}"] / one[f"w{i}"] for i in range(len(columns))]
    centred = [
        F.sum(F.when(w.isNotNull(), w * F.pow(num(df, name) - F.lit(m), F.lit(2.0)))).alias(f"v{i}")
        for i, (name, m) in enumerate(zip(columns, means)) if m is not None
    ]
    two = df.agg(*centred).first().asDict() if centred else {}
    out = {}
    for i, name in enumerate(columns):
        total, square = one[f"w{i}"], one[f"ww{i}"]
        variance = two[f"v{i}"] / total if means[i] is not None else None
        out[name] = {
            "n": one[f"n{i}"], "total_weight": total, "n_eff": total * total / square if square else None, "mean": means[i],
            "variance": variance, "std": variance**0.5 if variance is not None and variance >= 0 else None,
            "min": one[f"lo{i}"], "max": one[f"hi{i}"],
        }
    return out


def weighted_summary(df: DataFrame, columns: Sequence[str], weights: str) -> DataFrame:
    """Weighted mean, variance, sd, extremes and effective sample size."""
    rows = [
        (name, s["n"], s["total_weight"], s["n_eff"], s["mean"], s["variance"], s["std"], s["min"], s["max"])
        for name, s in _power_sums(df, columns, weights).items()
    ]
    return literal_rows(
        df.sparkSession, rows,
        "column string, valid_observations long, total_weight double, effective_sample_size double, mean double, "
        "variance double, std double, min double, max double",
    )


def weighted_quantiles(df: DataFrame, column: str, weights: str, probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Smallest value whose cumulative weight reaches ``p`` of the total (less the rounding of float sums)."""
    found = weighted_descent(df, num(df, column), _check(df, weights), [float(p) for p in probs], 1e-12)
    rows = [(column, p, value, float(reached)) for p, (value, reached) in found.items()]
    return literal_rows(df.sparkSession, rows, "column string, p double, value double, cumulative_weight double")


def weighted_top(df: DataFrame, column: str, weights: str, k: int = 5) -> DataFrame:
    """Categories by total weight; the first is the weighted mode."""
    w = _check(df, weights)
    sums = (
        df.where(c(column).isNotNull() & w.isNotNull())
        .groupBy(c(column).cast("string").alias("value")).agg(F.sum(w).alias("weight"))
    )
    distinct = sums.count()
    ranked = sums.orderBy(F.col("weight").desc(), "value").limit(k)
    order = Window.orderBy(F.col("weight").desc(), "value")  # at most k rows
    return ranked.select(F.lit(column).alias("column"), F.row_number().over(order).alias("rank"), "value", "weight",
                         F.lit(distinct).cast("long").alias("unique_values"))


def unweighted_summary(df: DataFrame, columns: Sequence[str], weights: str) -> DataFrame:
    """The comparison figures on the same valid rows."""
    w = _check(df, weights)
    values = {x: F.when(w.isNotNull(), num(df, x)) for x in columns}
    quart = exact_quantiles(df, values, [0.25, 0.5, 0.75])
    aggs = []
    for i, v in enumerate(values.values()):
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"a{i}"), F.stddev_samp(v).alias(f"s{i}"), F.var_samp(v).alias(f"v{i}"),
                 F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    one = df.agg(*aggs).first()
    rows = [
        (x, one[f"n{i}"], one[f"a{i}"], one[f"s{i}"], one[f"v{i}"], one[f"lo{i}"], one[f"hi{i}"], *quart[x])
        for i, x in enumerate(values)
    ]
    base = literal_rows(
        df.sparkSession, rows,
        "column string, count long, mean double, std double, variance double, min double, max double, q25 double, q50 double, q75 double",
    )
    from colprep.operators.profile import value_frequencies, vf_value

    valid = df.where(w.isNotNull())
    unique = value_frequencies(valid, columns).where(vf_value().isNotNull()).groupBy("column").agg(F.count(F.lit(1)).alias("unique_values"))
    return base.join(unique, "column", "left").fillna(0, ["unique_values"])


def unweighted_top(df: DataFrame, column: str, weights: str, k: int = 5) -> DataFrame:
    w = _check(df, weights)
    counts = (
        df.where(c(column).isNotNull() & w.isNotNull()).groupBy(c(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), "value").limit(k)
    )
    return counts.select(F.lit(column).alias("column"), "value", "count")


def moe_numeric(df: DataFrame, columns: Sequence[str], weights: str, confidence: float = 0.95) -> DataFrame:
    """Margin of error of weighted means, t distribution with n_eff - 1 degrees of freedom."""
    rows = []
    for name, s in _power_sums(df, columns, weights).items():
        if not s["n"] or s["mean"] is None or not s["n_eff"]:
            continue
        se = (s["variance"] / s["n_eff"]) ** 0.5
        critical = t_quantile(1 - (1 - confidence) / 2, s["n_eff"] - 1) if s["n_eff"] > 1 else None
        margin = critical * se if critical is not None else None
        rows.append((
            name, confidence, s["n"], s["total_weight"], s["mean"], se, s["n"] / s["n_eff"], s["n_eff"], critical, margin,
            None if margin is None else s["mean"] - margin, None if margin is None else s["mean"] + margin,
        ))
    return literal_rows(
        df.sparkSession, rows,
        "column string, confidence_level double, sample_size long, total_weight double, weighted_mean double, standard_error double, "
        "design_effect double, effective_sample_size double, critical_value double, margin_of_error double, ci_low double, ci_high double",
    )


def moe_categorical(df: DataFrame, column: str, weights: str, confidence: float = 0.95, double_deff: bool = True) -> DataFrame:
    """Weighted proportions with margins, normal critical value.

    ``double_deff`` multiplies by the design effect although the effective
    sample size already holds it; switch it off for the textbook margin.
    """
    w = _check(df, weights)
    valid = df.where(c(column).isNotNull() & w.isNotNull())
    per = valid.groupBy(c(column).cast("string").alias("category")).agg(F.sum(w).alias("weight"))
    total = valid.agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), F.sum(w * w).alias("ww")).first()
    if not total["n"]:
        return literal_rows(df.sparkSession, [], "category string, proportion double, margin_of_error double, ci_low double, ci_high double")
    n_eff = total["w"] ** 2 / total["ww"]
    factor = (total["n"] / n_eff if double_deff else 1.0) / n_eff
    p = F.col("weight") / F.lit(total["w"])
    margin = F.lit(normal_quantile(1 - (1 - confidence) / 2)) * F.sqrt(p * (1 - p) * F.lit(factor))
    return per.select("category", p.alias("proportion"), margin.alias("margin_of_error"), (p - margin).alias("ci_low"), (p + margin).alias("ci_high"))


def weights_compare(df: DataFrame, columns: Sequence[str], weights: str) -> DataFrame:
    """Weighted against unweighted mean and sd per column."""
    a = weighted_summary(df, columns, weights).select("column", F.col("mean").alias("weighted_mean"), F.col("std").alias("weighted_std"))
    w = num(df, weights)
    values = {x: F.when(w.isNotNull(), num(df, x)) for x in columns}
    one = df.agg(*[F.avg(v).alias(f"a{i}") for i, v in enumerate(values.values())], *[F.stddev_samp(v).alias(f"s{i}") for i, v in enumerate(values.values())])
    b = one.select(F.inline(F.array(*[F.struct(F.lit(x).alias("column"), F.col(f"a{i}").alias("mean"), F.col(f"s{i}").alias("std")) for i, x in enumerate(values)])))
    diff = F.col("weighted_mean") - F.col("mean")
    return a.join(b, "column").select(
        "column", "weighted_mean", "mean", diff.alias("mean_difference"),
        F.coalesce(percent(diff, F.col("mean")), F.lit(0.0)).alias("mean_percent_change"),
        "weighted_std", "std", (F.col("weighted_std") - F.col("std")).alias("std_difference"),
    )


def weights_diagnostics(df: DataFrame, weights: str) -> DataFrame:
    """Distribution of the weights, effective sample size, design effect, advice."""
    w = _check(df, weights)
    q01, q25, median, q75, q99 = exact_quantiles(df, {"w": w}, [0.01, 0.25, 0.5, 0.75, 0.99])["w"]
    from colprep.operators.profile import value_frequencies, vf_value

    unique = value_frequencies(df, [weights]).where(vf_value().isNotNull()).count()
    quantile = {k: F.lit(v).cast("double") for k, v in (("q01", q01), ("q25", q25), ("median", median), ("q75", q75), ("q99", q99))}
    one = df.agg(
        F.count(F.lit(1)).alias("count"), count_if(w.isNull()).alias("missing"), F.avg(w).alias("mean"), F.stddev_samp(w).alias("std"),
        F.min(w).alias("min"), F.max(w).alias("max"), count_if(w < 0).alias("negative_weights"), count_if(w == 0).alias("zero_weights"),
        count_if((w < quantile["q01"]) | (w > quantile["q99"])).alias("extreme_weights"), F.sum(w).alias("s"), F.sum(w * w).alias("ss"),
    )
    n_eff = F.coalesce(ratio(F.col("s") * F.col("s"), F.col("ss")), F.lit(0.0))
    deff = F.coalesce(ratio(F.col("count"), ratio(F.col("s") * F.col("s"), F.col("ss"))), F.lit(1.0))
    cv = F.coalesce(ratio(F.col("std"), F.col("mean")), F.lit(0.0))
    advice = F.array_compact(F.array(
        F.when(F.col("missing") > 0, "handle_missing_weights"),
        F.when(F.col("negative_weights") > 0, "review_negative_weights"),
        F.when(cv > HIGH_CV, "consider_trimming"),
        F.when(deff > HIGH_DESIGN_EFFECT, "high_design_effect"),
    ))
    return one.select(
        "count", "missing", "mean", quantile["median"].alias("median"), "std", "min", "max", quantile["q25"].alias("q25"), quantile["q75"].alias("q75"),
        F.lit(unique).cast("long").alias("unique_values"), cv.alias("coefficient_of_variation"),
        F.when(F.col("min") > 0, F.col("max") / F.col("min")).otherwise(F.lit(float("inf"))).alias("range_ratio"),
        "negative_weights", "zero_weights", "extreme_weights", n_eff.alias("effective_sample_size"), deff.alias("design_effect"),
        advice.alias("recommendations"),
    )


def weights_report(df: DataFrame, weights: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Unweighted and weighted figures of every numeric column."""
    names = [x for x in (columns or numeric_columns(df)) if x != weights]
    sums = _power_sums(df, names, weights)
    medians = exact_quantiles(df, {x: num(df, x) for x in names}, [0.5])
    one = df.agg(*[f(num(df, x)).alias(f"{k}{i}") for i, x in enumerate(names) for k, f in (("a", F.avg), ("s", F.stddev_samp), ("t", F.sum), ("n", F.count))]).first()
    rows = []
    for i, x in enumerate(names):
        s, mean = sums[x], one[f"a{i}"]
        if not s["n"] or s["mean"] is None:
            continue
        rows.append((
            x, mean, one[f"s{i}"], medians[x][0], one[f"t{i}"], s["mean"], s["mean"] * one[f"n{i}"], s["n_eff"],
            s["mean"] - mean, (s["mean"] - mean) / mean * 100 if mean else 0.0,
        ))
    return literal_rows(
        df.sparkSession, rows,
        "column string, mean double, std double, median double, total double, weighted_mean double, weighted_total double, "
        "effective_sample_size double, mean_difference double, relative_difference double",
    )
