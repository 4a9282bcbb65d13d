"""Streams with late rows, repeats and a restart."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from colprep.streaming.apply import drop_repeats, missing_rates

SCHEMA = "ts timestamp, id string, x double, n int"


@pytest.fixture
def feed(spark, tmp_path):
    """Write one file of rows; minutes after midnight, id, x, n."""
    folder = tmp_path / "in"

    def put(rows):
        day = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
        frame = spark.createDataFrame([(day + dt.timedelta(minutes=m), i, x, n) for m, i, x, n in rows], SCHEMA)
        frame.coalesce(1).write.mode("append").parquet(str(folder))

    put([])
    put.stream = lambda: spark.readStream.schema(SCHEMA).parquet(str(folder))
    return put


def advance(stream, tmp_path, name):
    """Run all that has come in, append to a table of files, and stop: each call is a restart."""
    out = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start(str(tmp_path / name))
    out.awaitTermination(120)
    assert out.exception() is None


def minute(column):
    return (F.unix_timestamp(column) - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))).cast("int") / 60


def test_missing_rates_of_sliding_windows(spark, feed, tmp_path):
    def read():
        return {(r["a"], r["column"]): (r["rows"], r["missing"], r["missing_pct"]) for r in spark.read.parquet(str(tmp_path / "rates")).select(minute("start").alias("a"), "column", "rows", "missing", "missing_pct").collect()}

    rates = missing_rates(feed.stream(), "ts", ["x", "n"], "20 minutes", "10 minutes", "10 minutes")
    feed([(1, "a", None, 1), (12, "b", 2.0, None), (13, "c", None, None)])
    advance(rates, tmp_path, "rates")
    assert read() == {}  # nothing is closed: the watermark is at 3
    feed([(5, "late", None, 4), (31, "d", 1.0, 1)])  # late within the delay, and one that moves the watermark to 21
    advance(rates, tmp_path, "rates")
    first = {(-10, "x"): (2, 2, 100.0), (-10, "n"): (2, 0, 0.0), (0, "x"): (4, 3, 75.0), (0, "n"): (4, 2, 50.0)}
    assert read() == first
    feed([(2, "too late", None, None), (60, "e", None, 1)])
    advance(rates, tmp_path, "rates")
    assert read() == (first | {(10, "x"): (2, 1, 50.0), (10, "n"): (2, 2, 100.0), (20, "x"): (1, 0, 0.0), (20, "n"): (1, 0, 0.0), (30, "x"): (1, 0, 0.0), (30, "n"): (1, 0, 0.0)})


def test_missing_rates_equal_the_batch(spark, feed, tmp_path):
    feed([(k, str(k), None if k % 3 == 0 else 1.0, k) for k in range(0, 200)])
    feed([(10_000, "end", 1.0, 1)])
    advance(missing_rates(feed.stream(), "ts", ["x"], "30 minutes", "10 minutes", "0 minutes"), tmp_path, "rates")
    rows = spark.read.schema(SCHEMA).parquet(str(tmp_path / "in")).where("n < 200 AND id <> 'end'")
    want = rows.groupBy(F.window("ts", "30 minutes", "10 minutes").alias("w")).agg(F.count("*").alias("rows"), F.count_if(F.col("x").isNull()).alias("missing"))
    got = spark.read.parquet(str(tmp_path / "rates")).where("rows > 0")
    assert {(r["start"], r["rows"], r["missing"]) for r in got.collect()} == {(r["w"]["start"], r["rows"], r["missing"]) for r in want.collect()}


def test_repeats_inside_and_outside_the_delay(spark, feed, tmp_path):
    unique = drop_repeats(feed.stream(), "ts", ["id"], "10 minutes")

    def read():
        return sorted((str(r["id"]), int(r["m"])) for r in spark.read.parquet(str(tmp_path / "unique")).select("id", minute("ts").alias("m")).collect())

    feed([(1, "a", 1.0, 1), (2, "b", 1.0, 1), (2, "b", 9.0, 9), (3, None, 1.0, 1)])
    advance(unique, tmp_path, "unique")
    assert read() == [("None", 3), ("a", 1), ("b", 2)]
    feed([(6, "a", 2.0, 2), (7, None, 2.0, 2), (8, "c", 1.0, 1)])  # repeats, seen after a restart from the checkpoint
    advance(unique, tmp_path, "unique")
    assert read() == [("None", 3), ("a", 1), ("b", 2), ("c", 8)]
    feed([(40, "d", 1.0, 1)])  # the watermark passes the first rows by more than the delay
    advance(unique, tmp_path, "unique")
    feed([(41, "a", 3.0, 3), (41, "d", 1.0, 1), (5, "e", 1.0, 1)])  # a is new again; e is behind the watermark
    advance(unique, tmp_path, "unique")
    assert read() == [("None", 3), ("a", 1), ("a", 41), ("b", 2), ("c", 8), ("d", 40)]
