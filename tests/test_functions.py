import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from colprep.functions import ordered, quantiles, statfn
from colprep.functions.names import matches, tokens
from colprep.functions.ordered import BUCKET, OrderedFrame, assign_buckets, with_position
from colprep.functions.quantiles import exact_quantiles
from colprep.functions.sampling import hash_sample
from colprep.functions.text import fixed, strip, title_case, to_number


def test_tokens_and_matching():
    assert tokens("birthYear") == ["birth", "year"]
    assert matches("respondent_age", "age") and not matches("percentage", "age")
    assert matches("percentage", "age", "substring")
    assert matches("employment", "employ") and not matches("duration", "ratio")
    assert matches("Birth_Year", ("birth_year",))
    with pytest.raises(ValueError):
        matches("x", "y", "regex")


@settings(max_examples=50, deadline=None)
@given(st.floats(0.51, 0.999), st.floats(1.5, 5000))
def test_t_quantile_inverts_cdf(p, df):
    assert statfn.t_cdf(statfn.t_quantile(p, df), df) == pytest.approx(p, abs=1e-9)


def test_known_quantiles():
    assert statfn.t_quantile(0.975, 10) == pytest.approx(2.2281388519649385, abs=1e-9)
    assert statfn.t_quantile(0.975, 1) == pytest.approx(12.706204736432095, rel=1e-9)
    assert statfn.normal_quantile(0.975) == pytest.approx(1.959963984540054)


@pytest.mark.parametrize("ranges", [2, 50, 4096])
def test_quantiles_match_pandas(spark, monkeypatch, ranges):
    monkeypatch.setattr(quantiles, "MAX_RANGES", ranges)
    rng = random.Random(3)
    data = [(None if rng.random() < 0.1 else rng.gauss(0, 100), float(rng.choice([1, 1, 1, 2, 9]))) for _ in range(5000)]
    df = spark.createDataFrame(data, "a double, b double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = exact_quantiles(df, {"a": F.col("a"), "b": F.col("b"), "none": F.lit(None)}, probs)
    pdf = pd.DataFrame(data, columns=["a", "b"])
    for name in ("a", "b"):
        assert got[name] == pytest.approx(pdf[name].quantile(probs).tolist(), rel=1e-12)
    assert got["none"] == [None] * len(probs)


def test_quantile_search_with_heavy_ties(spark):
    # A third of the rows share one value, right at the border of the wanted ranks.
    rows = [(7.0,)] * 4000 + [(float(i),) for i in range(-4000, 4000)]
    df = spark.createDataFrame(rows, "x double")
    probs = [0.1, 0.33, 0.5, 0.66, 0.9]
    want = pd.Series([r[0] for r in rows]).quantile(probs).tolist()
    assert exact_quantiles(df, {"x": F.col("x")}, probs)["x"] == pytest.approx(want)


ODD = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, 1.0, 2.0, 0.5, 3.0,
       4.0 - 2**-51, 4.0, -1.0, 1e-320, math.inf, -math.inf, math.nan, 9007199254740993.0]


def test_codes_are_the_bits(spark):
    rng = random.Random(8)
    values = ODD + [rng.choice((-1, 1)) * rng.random() * 10.0 ** rng.randint(-320, 308) for _ in range(3000)] + [2.0**k * m for k in range(-1070, 1023, 7) for m in (1 - 2**-53, 1, 1 + 2**-52)]
    rows = quantiles.with_code(spark.createDataFrame([(v,) for v in values], "x double"), "x").collect()
    assert [r["code"] for r in rows] == [quantiles.code_of(v) for v in values]
    ordered = sorted(v for v in values if not math.isnan(v))
    assert all(quantiles.code_of(a) <= quantiles.code_of(b) for a, b in zip(ordered, ordered[1:]))


def test_quantiles_of_odd_values(spark):
    df = spark.createDataFrame([(v,) for v in ODD if not math.isnan(v)] + [(None,)], "x double")
    n = len(ODD) - 2
    got = exact_quantiles(df, {"x": F.col("x")}, [k / n for k in range(n + 1)])["x"]
    assert got == sorted(v for v in ODD if not math.isnan(v))


def test_quantile_rounds_are_bounded(spark, monkeypatch):
    """64-bit noise with one value in a third of the rows, in many columns: few rounds, no round above the table."""
    rng = np.random.default_rng(4)
    noise = np.frombuffer(rng.bytes(8 * 40_000), "f8")
    x = np.where(rng.random(40_000) < 1 / 3, 1.5, np.where(np.isfinite(noise), noise, 0.0))
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    sizes, counted = [], quantiles._round

    def watched(values, intervals):
        starts, table = counted(values, intervals)
        sizes.append(len(table["slot"]))
        return starts, table

    monkeypatch.setattr(quantiles, "_round", watched)
    probs = [0.001, 0.25, 0.5, 0.75, 0.999]
    got = exact_quantiles(df, {f"c{k}": F.col("x") * float(2**k) for k in range(20)}, probs)
    want = np.quantile(x, probs)
    for k in range(20):
        assert got[f"c{k}"] == pytest.approx((want * 2.0**k).tolist(), rel=1e-12)
    assert len(sizes) <= 6 and max(sizes) <= quantiles.TABLE


@pytest.mark.parametrize("buckets", [1, 4, 32])
def test_positions(spark, buckets):
    ids = list(range(500))
    random.Random(1).shuffle(ids)
    df = spark.createDataFrame([(i * 3,) for i in ids], "id long")
    rows = with_position(df, ["id"], buckets=buckets).collect()
    assert all(r["position"] * 3 == r["id"] for r in rows)


@pytest.mark.parametrize("second", ["long", "string"])
def test_hot_leading_key_is_split(spark, second):
    n = 4000
    rows = [(5 if i % 2 else i, i if second == "long" else f"respondent-{i:06d}") for i in range(n)]
    df = spark.createDataFrame(rows, f"k long, j {second}")
    sizes = assign_buckets(df, ["k", "j"], 16).groupBy(BUCKET).count().collect()
    assert max(r["count"] for r in sizes) < n / 3
    got = [(r["k"], r["j"]) for r in with_position(df, ["k", "j"], buckets=16).orderBy("position").collect()]
    assert got == sorted(rows)


@pytest.mark.parametrize("slots", [0, 1 << 20])
def test_long_text_keys_split_evenly(spark, monkeypatch, slots):
    """100,000 addresses that begin alike, a third of them on one host and one long path."""
    rng = random.Random(9)
    urls = [f"https://www.example.org/{'archive/of/all/pages/' * 5 if k % 3 == 0 else rng.choice('abcdef')}{k * 7919 % 100_000:06d}{'/é' * (k % 4)}" for k in range(100_000)]
    df = spark.createDataFrame(pd.DataFrame({"url": urls})).repartition(8)
    monkeypatch.setattr(ordered, "LOOKUP_SLOTS", slots)
    sizes = [r["count"] for r in assign_buckets(df, ["url"], 50).groupBy(BUCKET).count().collect()]
    assert max(sizes) <= 2000 and sum(sizes) == len(urls) and len(sizes) <= 100
    got = with_position(df, ["url"], buckets=50).select("position", "url").toPandas().sort_values("position")
    assert got["position"].tolist() == list(range(len(urls))) and got["url"].tolist() == sorted(urls, key=str.encode)


def test_buckets_of_odd_keys(spark):
    """Nulls in every place, texts that differ in trailing zero bytes, floats with NaN, rows with equal keys."""
    texts = [None, "", "a", "a\0", "a\0\0", "ab", "zzzzzzz", "zzzzzzzz", "zzzzzzzzz\0", "é" * 40, "é" * 40 + "x"]
    numbers = [None, math.nan, -math.inf, -1.5, -0.0, 0.0, 2.0**60, math.inf]
    rows = [(t, x, k) for t in texts for x in numbers for k in (None, 1, 2**62, -(2**62), 1)] * 3
    df = spark.createDataFrame(rows, "`a.b` string, `x y` double, k long").repartition(5)
    order = ["a.b", "x y", "k"]
    key = [F.col(f"`{name}`") for name in order]
    ranked = assign_buckets(df, order, 60)
    steps = ranked.select(F.struct(*key).alias("key"), BUCKET).groupBy(BUCKET).agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n")).orderBy(BUCKET)
    apart = steps.select("n", (F.lag("hi").over(Window.orderBy(BUCKET)) < F.col("lo")).alias("apart")).collect()
    assert sum(r["n"] for r in apart) == len(rows) and all(r["apart"] for r in apart[1:])
    assert max(r["n"] for r in apart) <= math.ceil(len(rows) / 60) + 24  # rows with equal keys stay together
    assert assign_buckets(df.limit(0), order, 4).count() == 0


@pytest.mark.parametrize("group", [3, 1024])
def test_carries_over_groups_of_buckets(spark, monkeypatch, group):
    monkeypatch.setattr(ordered, "GROUP", group)
    rng = random.Random(4)
    table = [(b, rng.randint(0, 9), rng.choice([None, None, b])) for b in range(20)]
    frame = OrderedFrame(spark.range(20), ["id"], 20)
    assert frame.buckets == 20
    out = frame.carried(spark.createDataFrame(table, f"{BUCKET} long, n long, v long"), sums={"off": "n"}, lasts={"prev": "v"}).collect()
    assert {r[BUCKET]: (r["off"], r["prev"]) for r in out} == {b: (sum(n for k, n, _ in table if k < b), next((v for k, _, v in table[::-1] if k < b and v is not None), None)) for b, _, _ in table}
    out = frame.carried(spark.createDataFrame(table, f"{BUCKET} long, n long, v long"), nexts={"next": "v"}).collect()
    assert {r[BUCKET]: r["next"] for r in out} == {b: next((v for k, _, v in table if k > b and v is not None), None) for b, _, _ in table}


def test_string_and_time_order(spark):
    rows = [(f"{w}{i}",) for i in range(100) for w in ("alpha", "al", "beta-long-name-", "")]
    df = spark.createDataFrame(rows, "s string")
    got = [r["s"] for r in with_position(df, ["s"], buckets=8).orderBy("position").collect()]
    assert got == sorted(r[0] for r in rows)
    times = df.limit(50).select(F.expr("TIMESTAMP_NTZ'2020-01-01' + make_interval(0,0,0,0,0,0,length(s))").alias("t"), "s")
    assert with_position(times, ["t", "s"], buckets=4).count() == 50


def test_order_is_required(spark):
    with pytest.raises(ValueError):
        with_position(spark.range(3), [])


def test_hash_sample_is_stable(spark):
    df = spark.range(5000).withColumn("x", F.col("id").cast("double"))
    a = hash_sample(df, F.col("x"), ["id"], 300)
    assert len(a) == 300 and a == hash_sample(df.repartition(7), F.col("x"), ["id"], 300)
    assert len(hash_sample(df.limit(20), F.col("x"), ["id"], 300)) == 20


def test_text_expressions(spark):
    words = ["o'neil mc-x 3rd", "\tcafé noir ", "ABC def", "", None, "ǆ x", "a b "]
    df = spark.createDataFrame([(w,) for w in words], "s string")
    got = df.select(title_case(F.col("s")).alias("t"), strip(F.col("s")).alias("p")).collect()
    for word, row in zip(words[:5], got):
        assert row["t"] == (None if word is None else word.title())
    assert [r["p"] for r in got] == [None if w is None else w.strip() for w in words]


def test_number_guard(spark):
    values = {"1d": None, " 12 ": 12.0, "1e3": 1000.0, "-4.5": -4.5, ".5": 0.5, "x": None, "": None, "-inf": -math.inf, "Infinity": math.inf, "0x1F": None}
    df = spark.createDataFrame([(k,) for k in values], "s string")
    assert [r[0] for r in df.select(to_number(F.col("s"))).collect()] == list(values.values())


def test_fixed_rounds_like_python(spark):
    rng = random.Random(5)
    xs = [1.795, 1.005, 2.675, 0.125, 0.375, -1.795, -0.5, 0.0, 1234.5675, 1e20] + [rng.uniform(-1000, 1000) for _ in range(300)]
    xs += [round(x, 3) for x in xs[-200:]]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for digits in (1, 2, 3):
        got = [r[0] for r in df.select(fixed(F.col("x"), digits)).collect()]
        assert got == [f"{x:.{digits}f}" for x in xs]
