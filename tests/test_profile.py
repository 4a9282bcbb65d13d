import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colprep.functions import gram
from colprep.operators import missing as M
from colprep.operators import profile as P
from colprep.operators import quality as Q
from colprep.operators.outliers import fit_outliers, outlier_rows, outlier_summary
from colprep.operators.relations import correlation_matrix, correlation_pairs, top_correlations
from colprep.operators.typing import detect_types, override_types
from colprep.plans.analyze import analyze_all
from colprep.sources.normalize import nan_to_null

DEGENERATE = {
    "all_null": [(i, None) for i in range(12)],
    "no_null": [(i, float(i)) for i in range(12)],
    "constant": [(i, 5.0) for i in range(12)],
    "one_row": [(0, 3.0)],
    "empty": [],
}


def by_column(df):
    return {r["column"]: r for r in df.collect()}


@pytest.mark.parametrize("name", DEGENERATE)
def test_degenerate_frames(frame, name):
    df = frame(DEGENERATE[name], "id long, x double")
    row = by_column(P.profile_basic(df))["x"]
    values = [x for _, x in DEGENERATE[name] if x is not None]
    assert row["count"] == len(DEGENERATE[name]) and row["missing"] == len(DEGENERATE[name]) - len(values)
    assert row["mean"] == (pytest.approx(sum(values) / len(values)) if values else None)
    analyze_all(df, ["id"], 2026).collect()
    Q.validate_dataset(df).collect()
    outlier_summary(df).collect()
    correlation_matrix(df).collect()


def test_moments_match_definition(frame):
    xs = [1.0, 2.0, 2.0, 3.0, 10.0, 40.0]
    row = P.profile_moments(frame([(x,) for x in xs], "x double")).first()
    m = sum(xs) / len(xs)
    m2, m3, m4 = (sum((x - m) ** k for x in xs) / len(xs) for k in (2, 3, 4))
    assert row["skewness"] == pytest.approx(m3 / m2**1.5) and row["kurtosis"] == pytest.approx(m4 / m2**2 - 3)
    assert row["std"] == pytest.approx(pd.Series(xs).std())


def test_large_mean_keeps_variance(frame):
    row = P.profile_moments(frame([(1e9 + i,) for i in range(10)], "x double")).first()
    assert row["std"] == pytest.approx(pd.Series(range(10)).std(), rel=1e-9)


def test_nan_becomes_null(frame):
    df = nan_to_null(frame([(1, float("nan")), (2, float("inf")), (3, 1.0), (4, None)], "id long, x double"))
    assert df.where("x IS NULL").count() == 2
    assert Q.validate_columns(df).where("column = 'x'").first()["issues"] == ["high_missing", "infinite_values"]


def test_top_values_break_ties_by_value(frame):
    df = frame([(s,) for s in "baab"], "s string")
    assert [(r["value"], r["count"]) for r in P.dist_top(df).orderBy("rank").collect()] == [("a", 2), ("b", 2)]
    e = P.dist_entropy(df).first()
    assert e["mode_value"] == "a" and e["entropy"] == pytest.approx(math.log(2))


def test_signed_zero_is_one_value(frame):
    assert by_column(P.profile_basic(frame([(0.0,), (-0.0,)], "x double")))["x"]["unique_count"] == 1


def test_nested_column_gets_counts_only(frame):
    df = frame([(1, [1.0]), (2, None)], "id long, v array<double>")
    row = by_column(P.profile_basic(df))["v"]
    assert row["missing"] == 1 and row["unique_count"] is None
    assert by_column(detect_types(df))["v"]["semantic_type"] == "unknown"


def test_types(frame):
    rows = [(i, i % 2, i % 5, f"t{i}", "ab"[i % 2] * (1 + i % 3), i / 7, None, bool(i % 2)) for i in range(100)]
    df = frame(rows, "i long, b long, o long, t string, c string, f double, e string, flag boolean")
    got = {k: r["semantic_type"] for k, r in by_column(detect_types(df)).items()}
    assert got == {"i": "integer", "b": "binary", "o": "ordinal", "t": "text", "c": "categorical", "f": "continuous", "e": "empty", "flag": "binary"}
    changed = by_column(override_types(detect_types(df), {"o": "continuous"}))
    assert changed["o"]["semantic_type"] == "continuous" and changed["o"]["overridden"]
    with pytest.raises(ValueError):
        override_types(detect_types(df), {"o": "nonsense"})


@pytest.mark.parametrize("buckets", [1, 4, 32])
def test_runs_cross_buckets(spark, buckets):
    # nulls 100..399 span many buckets, some of them entirely null
    df = spark.range(1000).select("id", F.when((F.col("id") >= 100) & (F.col("id") < 400) | (F.col("id") % 97 == 3), None).otherwise(F.col("id")).alias("x"))
    mask = pd.Series([(100 <= i < 400) or i % 97 == 3 for i in range(1000)])
    runs = mask.ne(mask.shift()).cumsum()[mask].value_counts()
    got = M.missing_runs(df, ["x"], ["id"], buckets).collect()
    assert sorted(r["length"] for r in got) == sorted(runs.tolist())
    assert M.missing_max_run(df, ["x"], ["id"], buckets).first()["max_run"] == 300


def test_patterns(spark):
    ids = F.col("id")
    df = spark.range(1000).select(
        "id",
        F.when(ids % 100 == 0, None).otherwise(1).alias("sporadic"),
        F.when(ids.between(300, 500), None).otherwise(1).alias("blocks"),
        F.when((ids < 100) & (ids % 2 == 0) | (ids.between(200, 800)) & (ids % 12 == 0), None).otherwise(1).alias("front"),
        F.when((ids >= 900) & (ids % 2 == 0) | (ids.between(200, 800)) & (ids % 12 == 0), None).otherwise(1).alias("tail"),
        F.when(ids % 10 == 0, None).otherwise(1).alias("random"), F.lit(1).alias("none"),
    )
    got = {k: r["pattern"] for k, r in by_column(M.missing_pattern(df, ["id"])).items() if k != "id"}
    assert got == {"sporadic": "sporadic", "blocks": "systematic_blocks", "front": "front_loaded", "tail": "tail_loaded", "random": "random", "none": "none"}


def test_correlations_pairwise_complete(spark):
    pdf = pd.DataFrame({"a": [1.0, 2, 3, None, 5, 6], "b": [2.0, None, 5, 1, 9, 8], "c": [5.0, 4, 3, 2, 1, 0], "k": [7.0] * 6, "m": [1.0, None, 1, 1, 1, None]})
    df = spark.createDataFrame([tuple(None if pd.isna(v) else float(v) for v in r) for r in pdf.itertuples(index=False)], "a double, b double, c double, k double, m double")
    want = pdf.corr()
    for r in correlation_pairs(df).collect():
        expected = want.loc[r["column1"], r["column2"]]
        assert (r["r"] is None) if pd.isna(expected) else r["r"] == pytest.approx(expected, abs=1e-12)
    assert len(correlation_matrix(df).collect()) == 25
    assert {r["other"] for r in top_correlations(df).where("column = 'a'").collect()} == {"b", "c"}


def test_outliers_by_hand(frame):
    xs = [10.0] * 6 + [11.0] * 6 + [12.0] * 6 + [500.0]
    df = frame(list(enumerate(xs)), "id long, x double")
    s = outlier_summary(df, ["x"]).first()
    assert (s["iqr_count"], s["zscore_count"], s["modified_zscore_count"], s["consensus_rows"]) == (1, 1, 1, 1)
    assert s["methods_agree"] and s["severity"] == "moderate"
    assert outlier_rows(df, "x", ["id"]).first()["methods"] == ["iqr", "zscore", "modified_zscore"]
    small = fit_outliers(frame([(1, 1.0), (2, 2.0)], "id long, x double"), ["x"])[0]
    assert small.lower is None


def test_recommendations_follow_rules(frame):
    df = frame([(i, None if i % 3 == 0 else f"v{i % 4}") for i in range(60)], "id long, s string")
    got = Q.recommend(df, ["id"], 2026).collect()
    assert [(r["column"], r["method"], r["priority"]) for r in got] == [("s", "missing_category", "high")]


@pytest.mark.parametrize("block, count", [(30, 70), (512, 300)])
def test_pairs_of_many_columns_with_gaps(spark, monkeypatch, block, count):
    """One operator a scan, the figures of pandas."""
    monkeypatch.setattr(gram, "BLOCK", block)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, count)) + rng.normal(size=(400, 1)) * rng.random(count)
    x[:, 7] = 4.0
    x[rng.random(x.shape) < 0.2] = np.nan
    x[200:, 11], x[:200, 12] = np.nan, np.nan  # no row in common
    pdf = pd.DataFrame(x, columns=[f"c {k}" for k in range(count)])
    df = spark.createDataFrame(pdf).select(*[F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")).alias(c) for c in pdf.columns]).repartition(3)
    got = {(r["column1"], r["column2"]): r["r"] for r in correlation_pairs(df).collect()}
    want = pdf.corr(min_periods=2).to_numpy()
    assert len(got) == count * (count - 1) // 2
    for i in range(count):
        for j in range(i + 1, count):
            r = got[f"c {i}", f"c {j}"]
            assert r == pytest.approx(want[i, j], abs=1e-9) if r is not None else (7 in (i, j) or (i, j) == (11, 12)), (i, j)
    phi = np.corrcoef(np.isnan(x).T)
    found = {(r["column1"], r["column2"]): r["phi"] for r in M.comissing_pairs(df, threshold=0.1).collect()}
    assert found == pytest.approx({(f"c {i}", f"c {j}"): phi[i, j] for i in range(count) for j in range(i + 1, count) if phi[i, j] > 0.1})


def test_decimals_are_counted_by_their_digits(spark):
    big = 2**53
    df = spark.sql(f"SELECT * FROM VALUES (CAST({big}.01 AS DECIMAL(38,2)), 1.50), (CAST({big}.02 AS DECIMAL(38,2)), 1.50), (CAST({big}.02 AS DECIMAL(38,2)), -2.00), (NULL, NULL) AS t(a, b)")
    rows = {r["column"]: r for r in P.profile_basic(df).collect()}
    assert (rows["a"]["unique_count"], rows["b"]["unique_count"]) == (2, 2) and rows["b"]["median"] == 1.5
    profile = P.TableProfile(df)
    found = {r["column"]: r for r in profile.frequencies.collect()}
    assert (found["a"]["mode_value"], found["a"]["mode_count"]) == (f"{big}.02", 2) and found["b"]["mode_value"] == "1.50"
    top = [(r["value"], r["cnt"]) for r in P.vf_top(profile.vf.where("column = 'b'"), 5).orderBy("rank").collect()]
    assert top == [("1.50", 2), ("-2.00", 1)]
