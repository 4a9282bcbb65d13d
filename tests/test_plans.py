"""Plans must stay distributed: no task sees all rows, no Python in the rows' way."""

import re

import pytest
from pyspark.sql import functions as F

from colprep.functions.ordered import with_position
from colprep.operators import cleaning as C
from colprep.operators import missing as M
from colprep.operators import profile as P
from colprep.operators import rules_cross as X
from colprep.operators import rules_single as S


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "t")
    spark.range(2000).select(
        "id", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") * 1.0).alias("age"), (F.col("id") % 5).cast("string").alias("gender"), F.rand(1).alias("unused")
    ).write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def single_partition_inputs(text):
    """Operators that feed an exchange into one partition."""
    lines = text.splitlines()
    return [re.sub(r"^[\s:+\-*()\d]*", "", lines[i + 1]) for i, line in enumerate(lines[:-1]) if "Exchange SinglePartition" in line]


ORDERED = {
    "position": lambda df: with_position(df, ["id"], buckets=8),
    "runs": lambda df: M.missing_runs(df, ["age"], ["id"], 8),
    "ffill": lambda df: C.fit_method(df, "age", "missing_values", "forward_fill", {"order_by": ["id"], "buckets": 8}).transform(df),
    "ffill_text": lambda df: C.fit_method(df, "gender", "missing_values", "forward_fill", {"order_by": ["id"], "buckets": 8}).transform(df),
    "interpolate": lambda df: C.fit_method(df, "age", "missing_values", "interpolation", {"order_by": ["id"], "buckets": 8}).transform(df),
    "dedupe": lambda df: C.fit_method(df, "gender", "data_quality", "remove_duplicates", {"order_by": ["id"]}).transform(df),
}


@pytest.mark.parametrize("name", ORDERED)
def test_only_bucket_summaries_meet_in_one_partition(stored, name):
    text = plan(ORDERED[name](stored))
    for fed_by in single_partition_inputs(text):
        assert re.match(r"(HashAggregate|Project|BroadcastHashJoin|LocalTableScan)", fed_by), fed_by
    # text fills sort the looked-up values, one row per bucket; nothing sorts the table
    assert name == "ffill_text" or "SortAggregate" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "ArrowEvalPython" not in text and "BatchEvalPython" not in text


def test_row_wise_methods_need_no_exchange(stored):
    for kind, method in (("missing_values", "mean_imputation"), ("outliers", "winsorization"), ("outliers", "zscore_removal")):
        out = C.fit_method(stored, "age", kind, method).transform(stored).select("id", "age")
        text = plan(out)
        assert "Exchange" not in text and "unused" not in text  # columns are pruned at the scan


def test_rules_run_as_one_scan(stored):
    assert plan(S.rule_counts(stored, 2026)).count("FileScan") == 1
    assert "Exchange" not in plan(S.rule_violations(stored, ["id"], 2026))
    assert plan(X.cross_counts(stored, 2026)).count("FileScan") <= 1


def test_top_values_are_limited_before_the_shuffle(stored):
    text = plan(P.dist_top(stored, ["gender"]))
    assert re.search(r"WindowGroupLimit .*Partial", text)
    assert re.search(r"WindowGroupLimit .*Partial", plan(S.rule_samples(stored, ["id"], 2026)))


def test_configure_leaves_static_settings_alone(spark):
    from colprep.session import configure

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    configure(spark)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
