import json

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colprep.functions import quantiles
from colprep.operators import weights as W
from colprep.operators.charts import box, histogram, line
from colprep.operators.missing import comissing_pairs, required_missing
from colprep.operators.rules_cross import cross_counts, cross_summary, cross_violations
from colprep.operators.rules_single import bind_rules, rule_counts, rule_samples, rule_severity, rule_violations
from colprep.plans.recipe import Recipe
from colprep.plans.report import to_markdown
from colprep.sources import files
from colprep.sources.fingerprint import same_content
from colprep.streaming.apply import clean_stream, violation_counts


def test_rule_binding_by_token_and_substring(frame):
    df = frame([(1.0, 2.0, 3.0, "x")], "percentage double, wage double, age double, mailbox string")
    assert {(k.column, k.rule) for k in bind_rules(df.schema, 2026)} == {
        ("percentage", "percentage"), ("wage", "income"), ("age", "age"), ("mailbox", "non_ascii")}
    loose = {(k.column, k.rule) for k in bind_rules(df.schema, 2026, "substring")}
    assert ("percentage", "age") in loose and ("wage", "age") in loose and ("mailbox", "email") in loose


def test_single_rules_by_hand(frame):
    rows = [(1, -1, "a@b.co", "+49 301234567", "12345", "Male", "YES"), (2, 121, "a@b", "0301234567", "#", "x", "perhaps"), (3, None, None, None, None, None, None), (4, 50, "ä@b.co", "123456", "ab 1", "F", "0")]
    df = frame(rows, "id long, age long, email string, phone string, zip string, gender string, consent_flag string")
    got = {(r["column"], r["rule"]): r["violations"] for r in rule_counts(df, 2026).collect()}
    assert got[("age", "age")] == 2 and got[("email", "email")] == 2 and got[("phone", "phone")] == 2 and got[("zip", "postal")] == 1
    assert got[("gender", "gender")] == 1 and got[("consent_flag", "yes_no")] == 1 and got[("email", "non_ascii")] == 1
    total = rule_severity(df, 2026).where("column = 'email'").first()
    assert total["violations"] == 3 and total["severity"] == "high" and total["rules"] == ["email", "non_ascii"]
    assert rule_violations(df, ["id"], 2026).where("column = 'age'").count() == 2
    assert [r["value"] for r in rule_samples(df, ["id"], 2026, k=1).where("rule = 'age'").collect()] == ["-1"]


def test_no_rules_match(frame):
    df = frame([(1, 2.0)], "id long, q double")
    assert rule_counts(df, 2026).count() == 0 and rule_violations(df, ["id"], 2026).count() == 0
    assert cross_counts(df, 2026).count() == 0 and cross_violations(df, ["id"], 2026).count() == 0
    assert cross_summary(df, 2026).first()["total_violations"] == 0


def test_employment_and_education_rules(frame):
    rows = [(1, "2020-05-01", "2019-01-01", "PhD, later high school"), (2, "2020-05-01", "soon", "doctorate and elementary"), (3, "2020-05-01", "2021-01-01", "phd")]
    df = frame(rows, "id long, employment_start string, employment_end string, education string")
    got = {r["rule"]: r["violations"] for r in cross_counts(df, 2026).collect()}
    assert got["employment_dates"] == 1 and got["education"] == 2
    assert {(r["id"], r["rule"]) for r in cross_violations(df, ["id"], 2026).collect()} >= {(1, "employment_dates"), (1, "education"), (2, "education")}


def test_gender_title_uses_whole_words(frame):
    df = frame([("female", "Mrs."), ("Female", "Mr"), ("m", "Ms"), ("male", "Mr")], "gender string, title string")
    assert cross_counts(df, 2026, rules=["gender_title"]).first()["violations"] == 2


def test_total_needs_a_base_name(frame):
    df = frame([(float(i), 1.0, 2.0) for i in range(5)], "total double, a double, b double")
    assert cross_counts(df, 2026, rules=["total_parts"]).count() == 0
    with pytest.raises(ValueError):
        cross_counts(df, 2026, rules=["nope"])


def test_comissing_and_required(frame):
    df = frame([(i, None if i % 3 == 0 else 1, None if i % 3 == 0 else "x", None if i % 2 else "y") for i in range(60)], "id long, a long, email string, phone string")
    pairs = comissing_pairs(df).collect()
    assert [(r["column1"], r["column2"], r["violations"]) for r in pairs] == [("a", "email", 20)] and pairs[0]["phi"] == pytest.approx(1.0)
    assert required_missing(df).first()["violations"] == 20


def weighted(spark, xs, ws):
    return spark.createDataFrame(list(zip(xs, ws)), "x double, w double")


def test_weighted_figures_by_hand(spark):
    df = weighted(spark, [1.0, 2.0, 4.0, None, 9.0], [1.0, 2.0, 1.0, 5.0, None])
    s = W.weighted_summary(df, ["x"], "w").first()
    assert (s["valid_observations"], s["total_weight"], s["mean"]) == (3, 4.0, 2.25)
    assert s["effective_sample_size"] == pytest.approx(16 / 6) and s["variance"] == pytest.approx(np.average((np.array([1, 2, 4]) - 2.25) ** 2, weights=[1, 2, 1]))
    q = {r["p"]: r["value"] for r in W.weighted_quantiles(df, "x", "w").collect()}
    assert q == {0.25: 1.0, 0.5: 2.0, 0.75: 2.0}
    m = W.moe_numeric(df, ["x"], "w").first()
    assert m["standard_error"] == pytest.approx((s["variance"] / s["effective_sample_size"]) ** 0.5) and m["ci_high"] - m["ci_low"] == pytest.approx(2 * m["margin_of_error"])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=2, max_size=30))
def test_unit_weights_change_nothing(spark, xs):
    df = weighted(spark, xs, [1.0] * len(xs))
    r = W.weights_compare(df, ["x"], "w").first()
    assert r["weighted_mean"] == pytest.approx(r["mean"], abs=1e-6)


@pytest.mark.parametrize("ranges", [2, 8, 4096])
def test_weighted_quantiles_for_any_number_of_ranges(spark, monkeypatch, ranges):
    monkeypatch.setattr(quantiles, "MAX_RANGES", ranges)
    rng = np.random.default_rng(1)
    xs, ws = rng.integers(0, 200, 2000).astype(float), rng.integers(1, 9, 2000).astype(float)
    order = np.argsort(xs, kind="stable")
    cum = np.cumsum(ws[order])
    want = {p: xs[order][np.searchsorted(cum, p * ws.sum())] for p in (0.05, 0.25, 0.5, 0.75, 1.0)}
    got = W.weighted_quantiles(weighted(spark, xs.tolist(), ws.tolist()), "x", "w", list(want))
    assert {r["p"]: r["value"] for r in got.collect()} == want


def test_weight_checks(spark):
    df = weighted(spark, [1.0] * 4, [0.0, -1.0, None, 500.0])
    v = W.weights_validate(df, "w").first()
    assert (v["missing"], v["negative"], v["zero"]) == (1, 1, 1) and "negative_weights" in v["warnings"]
    assert "constant_weights" in W.weights_validate(weighted(spark, [1.0] * 3, [2.0] * 3), "w").first()["warnings"]
    with pytest.raises(ValueError):
        W.weights_validate(df, "absent")
    d = W.weights_diagnostics(df, "w").first()
    assert d["range_ratio"] == float("inf") and "review_negative_weights" in d["recommendations"]


def test_categorical_margin(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), (None, 9.0)], "g string, w double")
    rows = {r["category"]: r for r in W.moe_categorical(df, "g", "w").collect()}
    assert rows["a"]["proportion"] == 0.25
    plain = {r["category"]: r for r in W.moe_categorical(df, "g", "w", double_deff=False).collect()}
    assert plain["a"]["margin_of_error"] < rows["a"]["margin_of_error"]
    top = W.weighted_top(df, "g", "w").collect()
    assert [(r["rank"], r["value"], r["unique_values"]) for r in top] == [(1, "b", 2), (2, "a", 2)]


def test_charts_ignore_missing(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else float(i)) for i in range(400)], "id long, x double")
    h = histogram(df, "x").collect()
    assert sum(r["count"] for r in h) == 300 and len(h) <= 30
    assert sum(r["rows"] for r in line(df, "x", ["id"], step=6).collect()) == 300
    assert box(df, "x").first()["outliers"] == 0


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, " a,\"b ", 1.5, True), (2, None, None, False), (3, "NA", 2.0, None)], "i long, s string, x double, b boolean")
    path = str(tmp_path / "t")
    files.write_csv(df, path)
    back = files.read_csv(spark, path)
    assert [f.dataType.simpleString() for f in back.schema.fields] == ["bigint", "string", "double", "boolean"]
    assert {tuple(r) for r in back.collect()} == {(1, " a,\"b ", 1.5, True), (2, None, None, False), (3, None, 2.0, None)}


def test_fingerprint_ignores_order_and_partitions(spark):
    df = spark.range(100).withColumn("x", F.col("id") % 7)
    assert same_content(df, df.repartition(9).orderBy(F.desc("id")))
    assert not same_content(df, df.withColumn("x", F.when(F.col("id") == 5, 0).otherwise(F.col("x"))))
    assert not same_content(df, df.unionByName(df.limit(1)))


def test_report_json_and_markdown(spark, tmp_path):
    t = spark.createDataFrame([("a", 1)], "column string, n long")
    path = str(tmp_path / "r")
    files.write_report_json({"s": t}, {"k": "v"}, path)
    row = spark.read.json(path).first()
    assert json.loads(row["record"]) == {"column": "a", "n": 1} and json.loads(row["metadata"]) == {"k": "v"}
    assert "| a | 1 |" in to_markdown("T", [("S", t)])


def test_stream_of_a_fitted_recipe(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i % 60:02d}:00", None if i % 5 == 0 else float(i % 150 - 10)) for i in range(120)]
    batch = spark.createDataFrame(rows, "id long, t string, age double").withColumn("ts", F.col("t").cast("timestamp_ntz").cast("timestamp")).drop("t")
    path = str(tmp_path / "in")
    batch.repartition(3).write.parquet(path)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(path)
    recipe = Recipe().append("age", "missing_values", "median_imputation").append("age", "outliers", "winsorization").fit(batch)
    query = clean_stream(stream, recipe).writeStream.format("memory").queryName("cleaned").start()
    query.processAllAvailable()
    query.stop()
    want = {(r["id"], r["age"]) for r in recipe.transform(batch).collect()}
    assert {(r["id"], r["age"]) for r in spark.table("cleaned").collect()} == want

    counts = violation_counts(stream, "ts", ["id"], 2026).writeStream.outputMode("complete").format("memory").queryName("violations").start()
    counts.processAllAvailable()
    counts.stop()
    assert spark.table("violations").agg(F.sum("violations")).first()[0] == batch.where("age < 0 OR age > 120").count()

    ordered = Recipe().append("age", "missing_values", "forward_fill", {"order_by": ["id"]}).fit(batch)
    with pytest.raises(ValueError):
        clean_stream(stream, ordered)


def test_names_and_values_match_as_whole_words(spark):
    from colprep.functions.names import matches
    from colprep.operators.rules_cross import MARRIED_PATTERN, WORKING_PATTERN, whole

    assert not matches("rationale_code", "ratio") and not matches("scorecard", "score") and not matches("childhood_trauma", "child") and matches("employment", "employ")
    got = spark.createDataFrame([("unknown", "unmarried"), ("no", "married")], "a string, b string").selectExpr(f"a rlike r'{whole(WORKING_PATTERN)}' x", f"b rlike r'{whole(MARRIED_PATTERN)}' y").collect()
    assert [tuple(r) for r in got] == [(False, False), (True, True)]
