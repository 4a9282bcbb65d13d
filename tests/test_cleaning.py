import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colprep.operators import impact as I
from colprep.operators.cleaning import METHODS, clean, drop_incomplete, fit_method
from colprep.operators import iforest
from colprep.operators.knn import knn_impute
from colprep.plans.recipe import Recipe, operation_log

GAPS = [(1, None), (2, 1.0), (3, None), (4, None), (5, 4.0), (6, None)]


def values(df, column="x"):
    return [r[column] for r in df.orderBy("id").collect()]


def apply(df, kind, name, /, **params):
    return values(fit_method(df, "x", kind, name, params).transform(df))


def test_linear_interpolation_by_hand(frame):
    df = frame(GAPS, "id long, x double")
    got = apply(df, "missing_values", "interpolation", order_by=["id"])
    assert got == [2.5, 1.0, 2.0, 3.0, 4.0, 4.0]
    assert apply(df, "missing_values", "interpolation", method="slinear", order_by=["id"]) == [2.5, 1.0, 2.0, 3.0, 4.0, 2.5]
    assert apply(df, "missing_values", "interpolation", method="nearest", order_by=["id"]) == [2.5, 1.0, 1.0, 4.0, 4.0, 2.5]
    assert apply(df, "missing_values", "interpolation", method="zero", order_by=["id"]) == [2.5, 1.0, 1.0, 1.0, 4.0, 2.5]
    with pytest.raises(ValueError):
        fit_method(df, "x", "missing_values", "interpolation", {"method": "cubic", "order_by": ["id"]})


@pytest.mark.parametrize("buckets", [1, 4, 32])
def test_fills_match_pandas_for_any_bucket_count(spark, buckets):
    rng = random.Random(buckets)
    xs = [None if 50 <= i < 350 or rng.random() < 0.3 or i < 3 or i > 995 else rng.uniform(0, 9) for i in range(1000)]
    s = pd.Series(xs, dtype=float)
    rows = list(enumerate(xs))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, x double").repartition(5)
    args = {"order_by": ["id"], "buckets": buckets}
    assert apply(df, "missing_values", "forward_fill", **args) == pytest.approx(s.ffill().fillna(s.median()).tolist())
    assert apply(df, "missing_values", "backward_fill", **args) == pytest.approx(s.bfill().fillna(s.median()).tolist())
    assert apply(df, "missing_values", "interpolation", **args) == pytest.approx(s.interpolate().fillna(s.median()).tolist())


def test_weighted_mean_median_and_mode(frame):
    rows = [(1, 1.0, 1.0), (2, 2.0, 1.0), (3, 10.0, 5.0), (4, None, 9.0), (5, 2.0, None), (6, 4.0, 3.0)]
    df = frame(rows, "id long, x double, w double")
    mean = (1 + 2 + 50 + 12) / 10
    assert apply(df, "missing_values", "mean_imputation", weights="w") == pytest.approx([1, 2, 10, mean, 2, 4])
    assert apply(df, "missing_values", "median_imputation", weights="w") == [1, 2, 10, 4, 2, 4]
    assert apply(df, "missing_values", "mode_imputation", weights="w") == [1, 2, 10, 10, 2, 4]
    assert apply(df, "missing_values", "mode_imputation") == [1, 2, 10, 2, 2, 4]
    words = frame([(1, "b", 2.0), (2, "a", 1.0), (3, "a", 1.0), (4, None, 1.0)], "id long, x string, w double")
    assert apply(words, "missing_values", "mode_imputation", weights="w") == ["b", "a", "a", "a"]  # a tie of weights: the smallest
    for bad in ([(1, 1.0, -1.0), (2, None, 1.0)], [(1, 1.0, 0.0), (2, None, 1.0)], [(1, 1.0, None)]):
        with pytest.raises(ValueError):
            fit_method(frame(bad, "id long, x double, w double"), "x", "missing_values", "mean_imputation", {"weights": "w"})


def dense_spline(at, v, t):
    """Not-a-knot cubic spline from one dense system of all second derivatives."""
    n, h = len(at), np.diff(at)
    a, d = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        d[i] = 6 * ((v[i + 1] - v[i]) / h[i] - (v[i] - v[i - 1]) / h[i - 1])
    a[0, :3] = -1 / h[0], 1 / h[0] + 1 / h[1], -1 / h[1]
    a[-1, -3:] = -1 / h[-2], 1 / h[-2] + 1 / h[-1], -1 / h[-1]
    m = np.linalg.solve(a, d)
    k = np.clip(np.searchsorted(at, t, side="right") - 1, 0, n - 2)
    left, right = t - at[k], at[k + 1] - t
    return (m[k] * right**3 + m[k + 1] * left**3) / (6 * h[k]) + (v[k] / h[k] - m[k] * h[k] / 6) * right + (v[k + 1] / h[k] - m[k + 1] * h[k] / 6) * left


@pytest.mark.parametrize("rows, buckets", [(6, 3), (30, 8), (600, 1), (600, 25), (600, 150)])
def test_cubic_interpolation_equals_a_dense_solve(spark, rows, buckets):
    rng = random.Random(rows)
    xs = [rng.uniform(0, 9) if rows == 6 or rng.random() < 0.5 and not 100 < i < 180 else None for i in range(rows)]
    if rows == 6:
        xs[2] = xs[5] = None  # the fewest values, and an open end
    frame = list(enumerate(xs))
    rng.shuffle(frame)
    df = spark.createDataFrame(frame, "id long, x double").repartition(4)
    got = apply(df, "missing_values", "interpolation", method="cubic", order_by=["id"], buckets=buckets)
    at = np.array([i for i, x in enumerate(xs) if x is not None], dtype=float)
    v = np.array([x for x in xs if x is not None])
    want = dense_spline(at, v, np.arange(rows, dtype=float))
    middle = float(np.median(v))
    assert got == pytest.approx([middle if i < at[0] or i > at[-1] else want[i] for i in range(rows)], abs=1e-8)


def test_text_fill_falls_back_to_mode_or_unknown(frame):
    df = frame([(1, None), (2, "b"), (3, None), (4, "a"), (5, "b")], "id long, x string")
    assert apply(df, "missing_values", "forward_fill", order_by=["id"]) == ["b", "b", "b", "a", "b"]
    empty = frame([(1, None), (2, None)], "id long, x string")
    assert apply(empty, "missing_values", "forward_fill", order_by=["id"]) == ["Unknown", "Unknown"]


def test_time_interpolation_uses_the_clock(spark):
    df = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP_NTZ'2020-01-01', 0D), (2, TIMESTAMP_NTZ'2020-01-02', NULL), (3, TIMESTAMP_NTZ'2020-01-05', 8D) AS t(id, ts, x)")
    assert apply(df, "missing_values", "interpolation", method="time", order_by=["ts"]) == [0.0, 2.0, 8.0]


@pytest.mark.parametrize("rows", [[(1, None), (2, None)], [(1, 1.0), (2, 2.0)], [(1, 5.0)], []])
def test_degenerate_columns(frame, rows):
    df = frame(rows, "id long, x double")
    extra = {"forward_fill": {"order_by": ["id"]}, "backward_fill": {"order_by": ["id"]}, "interpolation": {"order_by": ["id"]},
             "knn_imputation": {"key": ["id"]}, "isolation_forest": {"key": ["id"]}, "remove_duplicates": {"order_by": ["id"]}}
    for kind, methods in METHODS.items():
        for method in methods:
            out, meta = clean(df, "x", kind, method, extra.get(method))
            assert out.count() == len(rows)
            if not meta["success"]:
                assert values(out) == [x for _, x in rows]


def test_errors_and_unknown_names(frame):
    df = frame([(1, "a")], "id long, x string")
    out, meta = clean(df, "x", "missing_values", "mean_imputation")
    assert not meta["success"] and "numeric" in meta["error"] and values(out) == ["a"]
    with pytest.raises(ValueError):
        clean(df, "x", "missing_values", "guess")
    with pytest.raises(ValueError):
        clean(df, "x", "magic", "mean_imputation")


def test_treatments_match_pandas(spark):
    rng = random.Random(2)
    xs = [None if rng.random() < 0.1 else rng.gauss(0, 1) * (20 if rng.random() < 0.03 else 1) for _ in range(800)]
    s = pd.Series(xs, dtype=float)
    df = spark.createDataFrame(list(enumerate(xs)), "id long, x double")
    q1, q3 = s.quantile([0.25, 0.75])
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    z = (s - s.mean()) / s.std(ddof=0)
    cases = {
        "iqr_removal": s.where((s >= lo) & (s <= hi)), "zscore_removal": s.where(z.abs() <= 3), "winsorization": s.clip(*s.quantile([0.05, 0.95])),
        "log_transformation": np.log(s + abs(s.min()) + 1), "cap_outliers": s.clip(lo, hi),
    }
    for method, want in cases.items():
        got = pd.Series(apply(df, "outliers", method), dtype=float)
        pd.testing.assert_series_equal(got, want, check_names=False, rtol=1e-9)
    again = fit_method(df, "x", "outliers", "winsorization")
    assert values(again.transform(again.transform(df))) == values(again.transform(df))


def test_isolation_forest_flags_extremes_first(spark):
    rng = np.random.default_rng(0)
    xs = np.concatenate([rng.normal(0, 1, 990), [50, -60, 70, 80, -90, 100, 110, 120, -130, 140]])
    df = spark.createDataFrame([(k, float(x)) for k, x in enumerate(xs)] + [(5000, None)], "id long, x double")
    fit = iforest.fit_column(df, "x", ["id"], 0.05)
    assert fit == iforest.fit_column(df.repartition(7), "x", ["id"], 0.05) and fit["rows"] == len(xs)
    flagged = [r[0] for r in df.where(iforest.is_anomaly(F.col("x"), fit["ranges"])).select("x").collect()]
    assert 0.02 * len(xs) <= len(flagged) <= 0.06 * len(xs)
    assert all(x in flagged for x in xs[-10:])


def test_forest_samples_come_from_all_rows(spark):
    """Smallest hashes of every tree, equal to a plain sort, for tables below and far above a tree's size."""
    for rows in (40, 30_000):
        values = spark.range(rows).select(F.xxhash64("id").alias("h"), F.col("id").cast("double").alias("x"))
        got = iforest.tree_samples(values, rows, trees=5)
        ranked = values.crossJoin(spark.range(5).select(F.col("id").cast("int").alias("t"))).select("t", "x", F.shiftrightunsigned(F.xxhash64("h", "t"), 1).alias("rank")).toPandas()
        for t in range(5):
            assert got[t] == ranked[ranked["t"] == t].sort_values("rank")["x"].head(256).tolist()
    hot = spark.createDataFrame([(1, 7.0)] * 900 + [(k, float(k)) for k in range(100)], "h long, x double")
    assert [len(v) for v in iforest.tree_samples(hot, 1000, trees=20)] == [256] * 20


def test_quantile_of_counts():
    rng = np.random.default_rng(2)
    values, counts = rng.permutation(50) / 7, rng.integers(1, 9, 50)
    for p in (0.0, 0.1, 0.5, 0.95, 1.0):
        assert iforest.quantile_of_counts(values, counts, p) == pytest.approx(np.quantile(np.repeat(values, counts), p))


def brute_knn(pdf, column, features, k):
    total, out = len(features) + 1, {}
    donors = pdf[pdf[column].notna()].sort_values("id")
    for _, row in pdf[pdf[column].isna()].iterrows():
        diff = donors[features] - row[features].astype(float)
        shared = diff.notna().sum(axis=1)
        d = (diff.pow(2).sum(axis=1) * total / shared.where(shared > 0)).round(6)
        near = d.dropna().sort_values(kind="stable").index[:k]
        out[row["id"]] = donors.loc[near, column].mean() if len(near) else donors[column].mean()
    return out


@pytest.mark.parametrize("cell,chunk", [(10_000, 20_000), (20, 20_000), (20, 7)])
def test_knn_equals_brute_force(spark, cell, chunk):
    rng = random.Random(11)
    rows = []
    for i in range(600):
        hot = i % 3 == 0  # a third of the rows are copies of one profile
        a, b, c = (1.0, 2.0, None) if hot else (rng.choice([None, rng.gauss(0, 50)]), round(rng.gauss(0, 9), 1), rng.choice([None, float(rng.randint(0, 5))]))
        rows.append((i, a, b if rng.random() > 0.05 or hot else None, c, None if rng.random() < 0.3 else rng.uniform(0, 100)))
    rows += [(1000, None, None, None, None), (1001, None, None, None, 5.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double")
    out, fit = knn_impute(df, "y", ["id"], 4, ["a", "b", "c"], "z", donors_per_cell=cell, chunk_rows=chunk)
    pdf = pd.DataFrame(rows, columns=["id", "a", "b", "c", "y"]).astype({"a": float, "b": float, "c": float, "y": float})
    want = brute_knn(pdf, "y", ["a", "b", "c"], fit["n_neighbors"])
    got = {r["id"]: r["z"] for r in out.where("y IS NULL").collect()}
    assert got == pytest.approx(want) and out.count() == len(rows)


def test_regression_is_exact_on_a_plane(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        x1, x2 = rng.uniform(0, 10), rng.uniform(0, 10)
        rows.append((i, x1, x2 if i != 7 else None, None if i % 5 == 2 else 2 * x1 - x2 + 1))
    df = spark.createDataFrame(rows, "id long, x1 double, x2 double, x double")
    fit = fit_method(df, "x", "missing_values", "regression_imputation", {"predictors": ["x1", "x2"]})
    got = values(fit.transform(df))
    observed = pd.Series([r[3] for r in rows], dtype=float)
    for (i, x1, x2, y), g in zip(rows, got):
        assert g == pytest.approx(observed.median() if x2 is None and y is None else y if y is not None else 2 * x1 - x2 + 1, abs=1e-6)
    assert fit.params["r2_score"] == pytest.approx(1.0)


def test_dedupe_keeps_first_row(frame):
    df = frame([(3, "a"), (1, "b"), (2, "a"), (4, None), (5, None)], "id long, x string")
    assert apply(df, "data_quality", "remove_duplicates", order_by=["id"]) == ["b", "a", None, None, None]


def test_type_standardization(frame):
    df = frame([(i, v) for i, v in enumerate(["1", "2", " 3 ", "4", "5", "x"])], "id long, x string")
    assert fit_method(df, "x", "data_quality", "type_standardization").params["target_type"] == "numeric"
    assert apply(df, "data_quality", "type_standardization") == [1.0, 2.0, 3.0, 4.0, 5.0, None]
    with pytest.raises(ValueError):
        fit_method(df, "x", "data_quality", "type_standardization", {"target_type": "money"})


def test_impact(frame):
    df = frame([(1, None, 2.0, 1.0), (2, 1.0, 1.0, 2.0), (3, None, None, 3.0), (4, 3.0, 2.5, 4.0)], "id long, b double, a double, w double")
    r = I.impact_stats(df, "b", "a").first()
    assert (r["rows_changed"], r["rows_affected_compat"], r["missing_before"], r["missing_after"]) == (2, 3, 2, 1)
    assert r["median_before"] == 2.0 and r["median_after"] == 2.0
    w = I.impact_weighted(df, "b", "a", "w").first()
    assert w["weighted_mean_before"] == pytest.approx((1 * 2 + 3 * 4) / 6) and w["weighted_mean_after"] == pytest.approx((2 + 2 + 10) / 7)
    rows = I.changed_rows(df, "b", "a", ["id"], limit=1).collect()
    assert rows[0]["id"] == 1 and rows[0]["remaining"] == 1
    assert I.changed_rows(df, "b", "b", ["id"]).count() == 0


def test_listwise(frame):
    df = frame([(1, None), (2, 1.0)], "id long, x double")
    assert drop_incomplete(df).count() == 1 and drop_incomplete(df, ["id"]).count() == 2


def test_recipe_undo_redo_and_json(frame):
    r = Recipe(column_types={"x": "continuous"}).append("x", "missing_values", "mean_imputation").append("x", "outliers", "winsorization", {"lower_percentile": 1})
    assert len(r.undo().active) == 1 and r.undo().redo() == r and len(r.undo().undo().undo().active) == 0
    branched = r.undo().append("x", "outliers", "log_transformation")
    assert [op.method for op in branched.operations] == ["mean_imputation", "log_transformation"]
    assert Recipe.from_json(r.undo().to_json()) == r.undo()
    long = Recipe()
    for _ in range(30):
        long = long.append("x", "missing_values", "mean_imputation")
    for _ in range(40):
        long = long.undo()
    assert long.cursor == 0
    with pytest.raises(ValueError):
        r.append("x", "outliers", "nonsense")


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_replay_is_deterministic(spark, parts):
    xs = [None if i % 7 == 0 else float(i % 31) for i in range(300)]
    df = spark.createDataFrame(list(enumerate(xs)), "id long, x double")
    r = (Recipe().append("x", "missing_values", "forward_fill", {"order_by": ["id"]}).append("x", "outliers", "cap_outliers")
         .append("x", "outliers", "isolation_forest", {"key": ["id"]}))
    assert values(r.replay(df.repartition(parts))) == values(r.replay(df))
    assert values(r.fit(df, materialize=True).transform(df)) == values(r.replay(df))


def test_operation_log(frame):
    df = frame([(1, None), (2, 2.0), (3, 4.0)], "id long, x double")
    log = operation_log(df, Recipe().append("x", "missing_values", "mean_imputation", timestamp="t1").append("x", "data_quality", "trim_whitespace", timestamp="t2"))
    a, b = log.orderBy("seq").collect()
    assert (a["rows_changed"], a["missing_before"], a["missing_after"], a["imputed_value"]) == (1, 1, 0, "3.0")
    assert not b["success"] and "text" in b["error"]


def test_dedupe_with_tied_keys_keeps_the_rows(frame):
    df = frame([(1, "a"), (1, "b"), (2, "a"), (2, "c")], "k long, s string")
    out, info = clean(df, "s", "data_quality", "remove_duplicates", {"order_by": ["k"]})
    assert info["success"] and sorted((r["k"], r["s"] or "") for r in out.collect()) == [(1, "a"), (1, "b"), (2, ""), (2, "c")]


def test_fills_keep_large_integers(frame):
    df = frame([(1, 9007199254740993), (2, None), (3, 9007199254740995)], "k long, x long")
    out, _ = clean(df, "x", "missing_values", "forward_fill", {"order_by": ["k"]})
    assert [r["x"] for r in out.orderBy("k").collect()] == [9007199254740993, 9007199254740993, 9007199254740995]


def test_knn_without_features_reports_failure(frame):
    out, info = clean(frame([(1, 1.0, "a"), (2, None, "b")], "k long, x double, s string").selectExpr("cast(k as string) k", "x", "s"), "x", "missing_values", "knn_imputation", {"key": ["k"]})
    assert not info["success"] and out.count() == 2
