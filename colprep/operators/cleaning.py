"""Cleaning methods as fit / transform pairs.

``fit`` runs small aggregates and returns plain numbers or strings. ``transform``
inlines them as literals. Row-wise methods therefore give a pure Column
expression that also applies to new batches and to streams; order-sensitive and
neighbour-based methods need the whole table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colprep.functions.exprs import c, count_if, is_numeric, is_text, num
from colprep.functions.ordered import BUCKET, OrderedFrame, small
from colprep.functions.quantiles import exact_quantiles, weighted_descent
from colprep.functions.text import strip, title_case, to_number, to_timestamp
from colprep.operators import iforest
from colprep.operators.knn import choose_features, knn_impute
from colprep.operators.spline import LEAST_VALUES, second_derivatives

NUMERIC, TEXT, ANY = "numeric", "text", "any"


@dataclass(frozen=True)
class Fitted:
    """A method bound to a column with its fitted parameters."""

    column: str
    method_type: str
    method: str
    params: dict = field(default_factory=dict)

    @property
    def row_wise(self) -> bool:
        return METHODS[self.method_type][self.method].value is not None

    def transform(self, df: DataFrame, output: str | None = None) -> DataFrame:
        spec = METHODS[self.method_type][self.method]
        if spec.value is not None:
            return df.withColumn(output or self.column, spec.value(df, self.column, self.params))
        return spec.table(df, self.column, self.params, output or self.column)


@dataclass(frozen=True)
class Method:
    kind: str
    fit: Callable[..., dict]
    value: Callable[[DataFrame, str, dict], Column] | None = None
    table: Callable[[DataFrame, str, dict, str], DataFrame] | None = None


# --- shared fits ------------------------------------------------------------

def _median(df: DataFrame, column: str) -> float | None:
    return exact_quantiles(df, {column: num(df, column)}, [0.5])[column][0]


def _mode(df: DataFrame, column: str) -> tuple[object, int] | None:
    """Most frequent value and its count, smallest value on ties."""
    counts = df.where(c(column).isNotNull()).groupBy(c(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col("v")))).first()[0]
    return None if best is None else (best["v"], -best["neg"])


def _need(value, message: str):
    if value is None:
        raise ValueError(message)
    return value


def _weighted(df: DataFrame, column: str, weights: str) -> DataFrame:
    """Values and weights ``(v, w)`` of the rows that hold both; a negative weight is an error."""
    if not is_numeric(df.schema[weights].dataType):
        raise ValueError("weights column must be numeric")
    rows = df.select(c(column).alias("v"), num(df, weights).alias("w")).where("v IS NOT NULL AND w IS NOT NULL")
    low, total = rows.agg(F.min("w"), F.sum("w")).first()
    if low is not None and low < 0:
        raise ValueError("weights must not be negative")
    if not total:
        raise ValueError("no value has a weight")
    return rows


def _fit_mean(df, column, weights: str | None = None):
    """Mean of the observed values, by ``weights`` where a column of them is named."""
    if weights:
        rows = _weighted(df, column, weights)
        mean = rows.agg(F.sum(num(rows, "v") * F.col("w")) / F.sum("w")).first()[0]
    else:
        mean = df.agg(F.avg(num(df, column))).first()[0]
    return {"imputed_value": _need(mean, "all values are missing")}


def _fit_median(df, column, weights: str | None = None):
    """Median; with ``weights`` the smallest value at which the cumulative weight reaches half of the total."""
    if weights:
        rows = _weighted(df, column, weights)
        return {"imputed_value": weighted_descent(rows, num(rows, "v"), F.col("w"), [0.5], 1e-12)[0.5][0]}
    return {"imputed_value": _need(_median(df, column), "all values are missing")}


def _fit_mode(df, column, weights: str | None = None):
    """Most frequent value, or the one with the most weight; the smallest on ties."""
    if weights:
        sums = _weighted(df, column, weights).groupBy("v").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))
        best = sums.agg(F.min(F.struct((-F.col("w")).alias("neg"), F.col("v"), F.col("n")))).first()[0]
        return {"imputed_value": best["v"], "mode_frequency": best["n"], "mode_weight": -best["neg"]}
    value, count = _need(_mode(df, column), "all values are missing")
    return {"imputed_value": value, "mode_frequency": count}


def _fill(df, column, params):
    """The fitted value in place of NULL; text and other types keep their type."""
    dtype = df.schema[column].dataType
    if is_numeric(dtype) and isinstance(params["imputed_value"], float):
        return F.coalesce(num(df, column), F.lit(params["imputed_value"]))
    return F.coalesce(c(column), F.lit(params["imputed_value"]).cast(dtype))


def _fit_category(df, column, category_name: str = "Missing"):
    return {"category_name": category_name}


def _fill_category(df, column, params):
    return F.coalesce(c(column).cast("string"), F.lit(params["category_name"]))


# --- fills along an order ---------------------------------------------------

def _edge_fallback(df: DataFrame, column: str, order_by: Sequence[str]) -> dict:
    """Substitute for a leading / trailing gap, fitted only when there is one."""
    key = F.struct(*[c(k) for k in order_by])
    edge = df.agg(F.min_by(c(column).isNull(), key).alias("lead"), F.max_by(c(column).isNull(), key).alias("trail")).first()
    return {"lead": bool(edge["lead"]), "trail": bool(edge["trail"])}


def _backup(df: DataFrame, column: str):
    if is_numeric(df.schema[column].dataType):
        return _median(df, column)
    mode = _mode(df, column)
    return "Unknown" if mode is None else mode[0]


def _fit_directional(reverse: bool):
    def fit(df, column, order_by=None, buckets=None):
        order_by = _order(order_by)
        gap = _edge_fallback(df, column, order_by)["trail" if reverse else "lead"]
        return {"order_by": order_by, "buckets": buckets, "fallback": _backup(df, column) if gap else None, "reverse": reverse}

    return fit


def _order(order_by) -> list[str]:
    if not order_by:
        raise ValueError("this method needs order_by, a total order of the rows")
    return [order_by] if isinstance(order_by, str) else list(order_by)


def _directional(df, column, params, output):
    """Last (or next) value along the order, across buckets by a carried value."""
    o = OrderedFrame(df, params["order_by"], params.get("buckets"))
    dtype = df.schema[column].dataType
    fallback = params["fallback"]
    # observed values keep their type, and with it their precision, unless a fraction has to be filled in
    fraction = is_numeric(dtype) and fallback is not None and not float(fallback).is_integer()
    kind = T.DoubleType() if fraction else dtype
    x = c(column).cast(kind)
    reverse = params["reverse"]
    edges = o.edge_value(x, "v", last=not reverse, text=not is_numeric(dtype))
    carried = o.carried(edges, **{"nexts" if reverse else "lasts": {"__carry": "v"}})
    rows = o.df.withColumn("__local", F.last(x, ignorenulls=True).over(o.running(reverse)))
    filled = F.coalesce(x, F.col("__local"), F.col("__carry"), F.lit(fallback).cast(kind))
    return o.attach(rows, carried).withColumn(output, filled).drop(BUCKET, "__local", "__carry")


# Interpolation names. Quadratic splines are not offered.
LINEAR = ("linear", "index", "values")
INTERPOLATIONS = (*LINEAR, "slinear", "nearest", "zero", "time", "cubic")


def _fit_interpolation(df, column, method: str = "linear", order_by=None, buckets=None):
    if method not in INTERPOLATIONS:
        raise ValueError(f"unsupported interpolation: {method}")
    order_by = _order(order_by)
    if method == "cubic" and df.agg(F.count(c(column))).first()[0] < LEAST_VALUES:
        raise ValueError(f"cubic interpolation needs {LEAST_VALUES} values")
    edge = _edge_fallback(df, column, order_by)
    last_holds = method in (*LINEAR, "time")
    needs = edge["lead"] or (edge["trail"] and not last_holds)
    return {"method": method, "order_by": order_by, "buckets": buckets, "fallback": _median(df, column) if needs else None}


def _interpolate(df, column, params, output):
    method = params["method"]
    o = OrderedFrame(df, params["order_by"], params.get("buckets"))
    x = num(df, column)
    present = F.when(x.isNotNull(), o.key)

    if method == "time":
        axis = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01'"), c(params["order_by"][0]).cast("timestamp_ntz")).cast("double")
        point = F.when(x.isNotNull(), F.struct(axis.alias("at"), x.alias("v")))
        carried = o.carried(o.summary(last=F.max_by(point, present), first=F.min_by(point, present)), lasts={"__prev": "last"}, nexts={"__next": "first"})
        rows = o.df.withColumn("__at", axis)
    else:
        # Positions need the number of rows outside the observed stretch of each
        # bucket: two map-side aggregates, no extra sort.
        edges = o.summary(n=F.count(F.lit(1)), lo=F.min(present), hi=F.max(present), lv=F.min_by(x, present), hv=F.max_by(x, present))
        outside = o.attach(o.df.select(BUCKET, o.key.alias("__key")), edges.select(BUCKET, "lo", "hi")).groupBy(BUCKET).agg(
            count_if(F.col("__key") < F.col("lo")).alias("lead"), count_if(F.col("__key") > F.col("hi")).alias("trail")
        )
        offsets = edges.join(small(outside, o.buckets), BUCKET).join(small(o.carried(edges, sums={"__off": "n"}), o.buckets), BUCKET)
        first = F.when(F.col("lo").isNotNull(), F.struct((F.col("__off") + F.col("lead")).cast("double").alias("at"), F.col("lv").alias("v")))
        last = F.when(F.col("hi").isNotNull(), F.struct((F.col("__off") + F.col("n") - 1 - F.col("trail")).cast("double").alias("at"), F.col("hv").alias("v")))
        placed = offsets.select(BUCKET, "__off", first.alias("first"), last.alias("last"))
        carried = o.carried(placed, lasts={"__prev": "last"}, nexts={"__next": "first"}).join(small(placed.select(BUCKET, "__off"), o.buckets), BUCKET)
        rows = o.df.withColumn("__rank", F.row_number().over(o.window()))

    rows = o.attach(rows, carried)
    if method != "time":
        rows = rows.withColumn("__at", (F.col("__off") + F.col("__rank") - 1).cast("double"))
    point = F.when(x.isNotNull(), F.struct(F.col("__at").alias("at"), x.alias("v")))
    if method == "cubic":
        bends = second_derivatives(rows.where(x.isNotNull()).select(BUCKET, F.col("__at").alias("at"), x.alias("v")))
        rows = rows.drop("__prev", "__next").join(bends.select(BUCKET, F.col("at").alias("__at"), F.col("m").alias("__m")), [BUCKET, "__at"], "left")
        point = F.when(x.isNotNull(), F.struct(F.col("__at").alias("at"), x.alias("v"), F.col("__m").alias("m")))
        seen = F.when(x.isNotNull(), F.col("__at"))
        ends = rows.groupBy(BUCKET).agg(F.max_by(point, seen).alias("last"), F.min_by(point, seen).alias("first"))
        rows = o.attach(rows, o.carried(ends, lasts={"__prev": "last"}, nexts={"__next": "first"}))
    rows = rows.withColumn("__p", F.coalesce(F.last(point, ignorenulls=True).over(o.running()), F.col("__prev"))).withColumn(
        "__n", F.coalesce(F.last(point, ignorenulls=True).over(o.running(reverse=True)), F.col("__next"))
    )
    p, n, at = F.col("__p"), F.col("__n"), F.col("__at")
    inside = p.isNotNull() & n.isNotNull()
    step = F.try_divide(at - p["at"], n["at"] - p["at"])
    if method == "nearest":
        gap = F.when(inside, F.when(at - p["at"] <= n["at"] - at, p["v"]).otherwise(n["v"]))
    elif method == "cubic":
        h, a, b = F.when(n["at"] > p["at"], n["at"] - p["at"]), n["at"] - at, at - p["at"]
        bent = (p["m"] * a * a * a + n["m"] * b * b * b) / (6 * h) + (p["v"] / h - p["m"] * h / 6) * a + (n["v"] / h - n["m"] * h / 6) * b
        gap = F.when(inside, bent)
    elif method == "zero":
        gap = F.when(inside, p["v"])
    else:
        gap = F.when(inside, p["v"] + (n["v"] - p["v"]) * F.coalesce(step, F.lit(0.0)))
        if method != "slinear":
            gap = F.coalesce(gap, p["v"])
    filled = F.coalesce(x, gap, F.lit(params["fallback"]).cast("double"))
    return rows.withColumn(output, filled).select(*dict.fromkeys([*df.columns, output]))


# --- model-based imputation -------------------------------------------------

def _fit_knn(df, column, n_neighbors: int = 5, key=None, features=None):
    # checks only; the neighbours are searched when the table is transformed
    if df.agg(F.count(c(column))).first()[0] == 0:
        raise ValueError("all values are missing")
    features = list(features) if features is not None else choose_features(df, column)
    if not features:
        raise ValueError("no other numeric column holds a value")
    return {"n_neighbors": n_neighbors, "key": _order(key), "features": features}


def _knn(df, column, params, output):
    out, _ = knn_impute(df, column, params["key"], params["n_neighbors"], params["features"], output)
    return out


def _fit_regression(df, column, predictors: Sequence[str] | None = None):
    """Least squares on complete rows; coefficients become literals."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    from colprep.functions.exprs import numeric_columns

    names = [x for x in (predictors or numeric_columns(df)) if x != column]
    if not names:
        raise ValueError("no numeric predictors available")
    data = df.select(num(df, column).alias("y"), *[num(df, x).alias(f"x{i}") for i, x in enumerate(names)]).na.drop()
    if len(data.limit(10).take(10)) < 10:
        raise ValueError("insufficient complete cases for regression imputation")
    vectors = VectorAssembler(inputCols=[f"x{i}" for i in range(len(names))], outputCol="features").transform(data)
    model = LinearRegression(featuresCol="features", labelCol="y", solver="normal").fit(vectors)
    return {
        "predictors": names, "intercept": float(model.intercept), "coefficients": [float(v) for v in model.coefficients],
        "r2_score": float(model.summary.r2), "predictors_used": len(names), "fallback": _median(df, column),
    }


def _regression(df, column, params):
    predicted = F.lit(params["intercept"])
    for name, weight in zip(params["predictors"], params["coefficients"]):
        predicted = predicted + F.lit(weight) * num(df, name)
    return F.coalesce(num(df, column), predicted, F.lit(params["fallback"]).cast("double"))


# --- outliers ---------------------------------------------------------------

def _quantile_bounds(df, column, low, high):
    lo, hi = exact_quantiles(df, {column: num(df, column)}, [low, high])[column]
    return {"lower_bound": lo, "upper_bound": hi}


def _iqr_bounds(df, column, multiplier):
    q1, q3 = exact_quantiles(df, {column: num(df, column)}, [0.25, 0.75])[column]
    if q1 is None:
        return {"multiplier": multiplier, "lower_bound": None, "upper_bound": None}
    reach = multiplier * (q3 - q1)
    return {"multiplier": multiplier, "lower_bound": q1 - reach, "upper_bound": q3 + reach}


def _fit_iqr(df, column, multiplier: float = 1.5):
    return _iqr_bounds(df, column, multiplier)


def _null_outside(df, column, params):
    x = num(df, column)
    lo, hi = (F.lit(params[b]).cast("double") for b in ("lower_bound", "upper_bound"))
    return F.when((x >= lo) & (x <= hi), x)


def _fit_zscore(df, column, threshold: float = 3.0):
    x = num(df, column)
    row = df.agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("s")).first()
    return {"threshold": threshold, "mean": row["m"], "std_pop": row["s"]}


def _null_far(df, column, params):
    x = num(df, column)
    if not params["std_pop"]:
        return x
    return F.when(F.abs((x - F.lit(params["mean"])) / F.lit(params["std_pop"])) <= F.lit(float(params["threshold"])), x)


def _fit_winsor(df, column, lower_percentile: float = 5, upper_percentile: float = 95):
    return _quantile_bounds(df, column, lower_percentile / 100, upper_percentile / 100)


def _clip(df, column, params):
    x = num(df, column)
    if params["lower_bound"] is None:
        return x
    return F.when(x.isNotNull(), F.greatest(F.lit(params["lower_bound"]), F.least(x, F.lit(params["upper_bound"]))))


def _fit_log(df, column):
    low = df.agg(F.min(num(df, column))).first()[0]
    return {"shift_applied": abs(low) + 1.0 if low is not None and low <= 0 else 0.0}


def _log(df, column, params):
    return F.ln(num(df, column) + F.lit(params["shift_applied"]))


def _fit_cap(df, column, method: str = "iqr", multiplier: float = 1.5):
    if method == "iqr":
        return {"cap_method": method, **_iqr_bounds(df, column, multiplier)}
    return {"cap_method": "percentile", **_quantile_bounds(df, column, 0.05, 0.95)}


def _fit_iforest(df, column, contamination: float = 0.1, key=None):
    return {"contamination": contamination, **iforest.fit_column(df, column, _order(key), contamination)}


def _null_anomaly(df, column, params):
    x = num(df, column)
    return F.when(~iforest.is_anomaly(x, params["ranges"]), x)


# --- data quality -----------------------------------------------------------

# Share of values that must parse for an automatic numeric target.
AUTO_NUMERIC_SHARE = 0.8


def _fit_type(df, column, target_type: str | None = None):
    col = c(column)
    if target_type is None:
        numeric = is_numeric(df.schema[column].dataType)
        parsed = col.isNotNull() if numeric else to_number(col.cast("string")).isNotNull()
        row = df.agg(F.count(col).alias("n"), count_if(parsed).alias("k")).first()
        target_type = "numeric" if row["n"] and row["k"] / row["n"] > AUTO_NUMERIC_SHARE else "string"
    if target_type not in ("numeric", "string", "datetime"):
        raise ValueError(f"unknown target type: {target_type}")
    return {"target_type": target_type}


def _standard_type(df, column, params):
    dtype, target = df.schema[column].dataType, params["target_type"]
    if target == "string":
        return c(column).cast("string")
    if target == "numeric":
        return num(df, column) if is_numeric(dtype) else to_number(c(column).cast("string"))
    return to_timestamp(c(column)) if is_text(dtype) else c(column).cast("timestamp_ntz")


def _fit_dedupe(df, column, order_by=None):
    return {"order_by": _order(order_by)}


def _dedupe(df, column, params, output):
    """Keep the value in its first row only.

    The first row of each value is a map-side combined minimum. It is joined
    back on the row key and the value, so a value that fills a third of the table
    does not gather its rows in one task, and rows never multiply. Rows that agree
    in value and key are one row for this purpose and all keep the value.
    """
    keys = params["order_by"]
    groups = df.where(c(column).isNotNull()).groupBy(c(column).alias("__value"))
    if len(keys) == 1:  # a plain minimum runs in a hash aggregate
        marks = groups.agg(F.min(c(keys[0])).alias("__k0")).select("__value", "__k0", F.lit(True).alias("__first"))
    else:
        first = groups.agg(F.min(F.struct(*[c(k).alias(f"__k{i}") for i, k in enumerate(keys)])).alias("__f"))
        marks = first.select("__value", *[F.col(f"__f.__k{i}").alias(f"__k{i}") for i in range(len(keys))], F.lit(True).alias("__first"))
    same = [c(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    condition = c(column) == F.col("__value")
    for s in same:
        condition = condition & s
    joined = df.join(marks, condition, "left")
    return joined.withColumn(output, F.when(F.col("__first"), c(column))).select(*dict.fromkeys([*df.columns, output]))


def _fit_nothing(df, column):
    return {}


def _fit_case(df, column, case_type: str = "lower"):
    if case_type not in ("lower", "upper", "title"):
        raise ValueError(f"unknown case type: {case_type}")
    return {"case_type": case_type}


def _case(df, column, params):
    return {"lower": F.lower, "upper": F.upper, "title": title_case}[params["case_type"]](c(column))


# Method names by type.
METHODS: dict[str, dict[str, Method]] = {
    "missing_values": {
        "mean_imputation": Method(NUMERIC, _fit_mean, _fill),
        "median_imputation": Method(NUMERIC, _fit_median, _fill),
        "mode_imputation": Method(ANY, _fit_mode, _fill),
        "forward_fill": Method(ANY, _fit_directional(False), table=_directional),
        "backward_fill": Method(ANY, _fit_directional(True), table=_directional),
        "knn_imputation": Method(NUMERIC, _fit_knn, table=_knn),
        "interpolation": Method(NUMERIC, _fit_interpolation, table=_interpolate),
        "missing_category": Method(ANY, _fit_category, _fill_category),
        "regression_imputation": Method(NUMERIC, _fit_regression, _regression),
    },
    "outliers": {
        "iqr_removal": Method(NUMERIC, _fit_iqr, _null_outside),
        "zscore_removal": Method(NUMERIC, _fit_zscore, _null_far),
        "winsorization": Method(NUMERIC, _fit_winsor, _clip),
        "log_transformation": Method(NUMERIC, _fit_log, _log),
        "cap_outliers": Method(NUMERIC, _fit_cap, _clip),
        "isolation_forest": Method(NUMERIC, _fit_iforest, _null_anomaly),
    },
    "data_quality": {
        "type_standardization": Method(ANY, _fit_type, _standard_type),
        "remove_duplicates": Method(ANY, _fit_dedupe, table=_dedupe),
        "trim_whitespace": Method(TEXT, _fit_nothing, lambda df, col, p: strip(c(col))),
        "standardize_case": Method(TEXT, _fit_case, _case),
    },
}


def fit_method(df: DataFrame, column: str, method_type: str, method: str, parameters: Mapping | None = None) -> Fitted:
    """Fit a method; raises ``ValueError`` when it does not apply."""
    if method_type not in METHODS:
        raise ValueError(f"unknown method type: {method_type}")
    if method not in METHODS[method_type]:
        raise ValueError(f"unknown method: {method}")
    spec, dtype = METHODS[method_type][method], df.schema[column].dataType
    if spec.kind == NUMERIC and not is_numeric(dtype):
        raise ValueError(f"{method} applies to numeric columns only")
    if spec.kind == TEXT and not is_text(dtype):
        raise ValueError(f"{method} applies to text columns only")
    return Fitted(column, method_type, method, spec.fit(df, column, **dict(parameters or {})))


def clean(df: DataFrame, column: str, method_type: str, method: str, parameters: Mapping | None = None, output: str | None = None) -> tuple[DataFrame, dict]:
    """Fit and apply; a method that does not apply leaves the column as it is.

    Unknown names raise. The second result says whether it worked, with the
    fitted parameters or the error.
    """
    if method_type not in METHODS or method not in METHODS[method_type]:
        raise ValueError(f"unknown method: {method_type}/{method}")
    try:
        fitted = fit_method(df, column, method_type, method, parameters)
    except ValueError as error:
        out = df if output in (None, column) else df.withColumn(output, c(column))
        return out, {"success": False, "error": str(error), "method_type": method_type, "method": method}
    return fitted.transform(df, output), {"success": True, "method_type": method_type, "method": method, **fitted.params}


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Listwise deletion; pairwise deletion is built into the correlations."""
    return df.na.drop(subset=list(columns) if columns is not None else None)
