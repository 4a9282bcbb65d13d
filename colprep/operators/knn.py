"""Exact k-nearest-neighbour imputation as a pruned, partitioned join.

Distance is the Euclidean distance over the features two rows share, scaled by
features / shared features. Three steps avoid comparing every pair:

1. Rows collapse to distinct feature profiles. A profile repeated in a third of
   the table is searched once, and a repeated donor keeps the ``k`` rows that
   could ever be chosen.
2. Donors fall into cells (same missing mask, ranges of the two widest
   features). The table of cell boxes is bounded by ``MAX_CELLS``.
3. A recipient first searches its own cell. The k-th distance found there is a
   proven radius, so only cells whose box reaches inside it are searched next.

Cells are split into chunks of bounded size on both sides, so no task holds an
unbounded group, and each chunk returns at most ``k`` donors per recipient.
Equal distances (to six decimals) are ordered by key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colprep.functions.exprs import c, num, numeric_columns
from colprep.session import scratch_dir

MAX_CELLS = 16_384
DONORS_PER_CELL = 2_000
CHUNK_ROWS = 20_000
_BLOCK = 128
_DECIMALS = 6


def choose_features(df: DataFrame, column: str) -> list[str]:
    """The other numeric columns that hold any value."""
    names = [x for x in numeric_columns(df) if x != column]
    if not names:
        return []
    counts = df.agg(*[F.count(c(x)).alias(f"n{i}") for i, x in enumerate(names)]).first()
    return [x for i, x in enumerate(names) if counts[f"n{i}"]]


def _profile_key(features: Sequence[str]) -> Column:
    """Exact text form of the feature values."""
    return F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("~")) for f in features])


def _mask(features: Sequence[str]) -> Column:
    return sum((F.col(f).isNotNull().cast("int") * F.lit(1 << i) for i, f in enumerate(features)), F.lit(0))


def _range_number(name: str, cuts: list[float]) -> Column:
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(v) for v in cuts]), lambda v: v <= F.col(name)))


def _cell_columns(features: Sequence[str], widths: Sequence[float], cuts: dict[str, list[float]]) -> list[Column]:
    """Range numbers of the widest and second widest feature a row has."""
    ranked = [f for _, f in sorted(zip(widths, features), key=lambda p: -p[0])]
    where = {name: _range_number(name, cuts[name]) for name in ranked}
    first = F.coalesce(*[F.when(F.col(f).isNotNull(), where[f]) for f in ranked])
    second = F.lit(0)
    for i in range(len(ranked) - 1, -1, -1):
        rest = ranked[i + 1 :]
        if rest:
            nxt = F.coalesce(*[F.when(F.col(f).isNotNull(), F.floor(where[f] / 8).cast("int")) for f in rest], F.lit(0))
            second = F.when(F.col(ranked[i]).isNotNull(), nxt).otherwise(second)
    return [first.alias("c1"), second.alias("c2")]


def knn_impute(df: DataFrame, column: str, key: Sequence[str], n_neighbors: int = 5,
               features: Sequence[str] | None = None, output: str | None = None,
               donors_per_cell: int = DONORS_PER_CELL, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, dict]:
    """Fill NULLs with the mean of the nearest donors; returns data and fit."""
    spark = df.sparkSession
    names = list(features) if features is not None else choose_features(df, column)
    if not names:
        raise ValueError("KNN imputation requires at least two numeric columns with values")
    f = [f"f{i}" for i in range(len(names))]
    x = [num(df, n) for n in names]
    target = num(df, column)
    complete = target.isNotNull()
    for v in x:
        complete = complete & v.isNotNull()
    fit = df.agg(
        F.count(F.when(complete, 1)).alias("complete"), F.count(target).alias("donors"), F.avg(target).alias("mean"),
        *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(x)],
    ).first()
    if fit["mean"] is None:
        raise ValueError("all values are missing")
    k = max(1, min(int(n_neighbors), fit["complete"] // 2))
    total = len(names) + 1
    output = output or column
    params = {"n_neighbors": k, "features_used": total, "features": list(names)}

    base = df.select(*[(v + F.lit(0.0)).alias(a) for v, a in zip(x, f)], target.alias("t"), *[c(q).alias(f"k{i}") for i, q in enumerate(key)])
    keys = [f"k{i}" for i in range(len(key))]
    some = F.coalesce(*f).isNotNull()
    nearest_first = Window.partitionBy("p").orderBy(*keys)
    donors = (
        base.where(F.col("t").isNotNull() & some).withColumn("p", _profile_key(f))
        .withColumn("n", F.row_number().over(nearest_first)).where(F.col("n") <= k).drop("n", "p")
        .withColumn("m", _mask(f))
    )
    recipients = base.where(F.col("t").isNull() & some).select(*f).distinct().withColumn("p", _profile_key(f))

    # Cells: masks are bounded by the feature count, ranges by what is left.
    masks = donors.select("m").distinct().count()
    wanted = max(1, min(MAX_CELLS, math.ceil(fit["donors"] / donors_per_cell)))
    per_mask = max(1, min(wanted, MAX_CELLS // max(masks, 1)))
    ranges = per_mask if per_mask <= 8 else max(8, math.isqrt(per_mask * 8))
    cuts_row = base.agg(*[F.percentile_approx(a, [i / ranges for i in range(1, ranges)] or [0.5], 1000).alias(a) for a in f]).first()
    cuts = {a: sorted(set(cuts_row[a] or [])) if ranges > 1 else [] for a in f}
    # Written once: box building and both searches read it.
    celled = _stored(donors.select("*", *_cell_columns(f, [fit[f"s{i}"] or 0.0 for i in range(len(f))], cuts)), "knn-donors")
    boxes = (
        celled.groupBy("m", "c1", "c2")
        .agg(F.count(F.lit(1)).alias("n"), *[F.min(a).alias(f"lo_{a}") for a in f], *[F.max(a).alias(f"hi_{a}") for a in f])
        .toPandas()
    )  # at most about MAX_CELLS rows
    if boxes.empty:
        return df.withColumn(output, F.coalesce(target, F.lit(fit["mean"]))), params
    boxes["cell"] = range(len(boxes))
    cell_table = spark.createDataFrame(boxes[["m", "c1", "c2", "cell"]].astype("int64"), "m long, c1 long, c2 long, cell long")
    placed = celled.join(F.broadcast(cell_table), ["m", "c1", "c2"]).select("cell", "t", *keys, *f)
    geometry = spark.sparkContext.broadcast(
        (boxes["n"].to_numpy(), boxes[[f"lo_{a}" for a in f]].to_numpy(float), boxes[[f"hi_{a}" for a in f]].to_numpy(float))
    )
    cell_sizes = dict(zip(boxes["cell"].tolist(), boxes["n"].tolist()))
    key_types = [df.schema[q].dataType.simpleString() for q in key]
    found_schema = "p string, d double, " + "".join(f"k{i} {t}, " for i, t in enumerate(key_types)) + "t double"

    home = recipients.withColumn("r", F.lit(None).cast("double")).mapInPandas(
        _candidate_cells(geometry, f, k, total, first=True), "p string, cell long, " + ", ".join(f"{a} double" for a in f)
    )
    first = _stored(_search(home, placed, cell_sizes, f, keys, k, total, chunk_rows, found_schema), "knn-home")
    rank = Window.partitionBy("p").orderBy("d", *keys)
    best = first.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= k)
    radius = best.groupBy("p").agg(F.max(F.when(F.col("n") == k, F.col("d"))).alias("r"))
    wider = recipients.join(radius, "p", "left").mapInPandas(
        _candidate_cells(geometry, f, k, total, first=False), home.schema
    )
    second = _search(wider, placed, cell_sizes, f, keys, k, total, chunk_rows, found_schema)
    imputed = (
        first.unionByName(second)
        .withColumn("n", F.row_number().over(rank)).where(F.col("n") <= k)
        .groupBy("p").agg(F.avg("t").alias("__imputed"))
    )

    # Only rows with a gap take part in the join back. A hot profile is split by AQE's skew join.
    named = {n: num(df, n) + F.lit(0.0) for n in names}
    row_key = F.concat_ws("|", *[F.coalesce(v.cast("string"), F.lit("~")) for v in named.values()])
    gaps = df.where(target.isNull()).withColumn("__p", row_key)
    filled = gaps.join(imputed.withColumnRenamed("p", "__p"), "__p", "left").withColumn(
        output, F.coalesce("__imputed", F.lit(fit["mean"]))
    )
    kept = df.where(target.isNotNull()).withColumn(output, target)
    return kept.unionByName(filled.select(*kept.columns)), params


def _stored(df: DataFrame, name: str) -> DataFrame:
    """Materialise on shared storage, so a lost executor does not repeat the work."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _candidate_cells(geometry, f: Sequence[str], k: int, total: int, first: bool):
    """Cells to search per recipient: its nearest ones, or all within a radius."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, low, high = geometry.value
        has = ~np.isnan(low)
        for batch in batches:
            for start in range(0, len(batch), _BLOCK):
                part = batch.iloc[start : start + _BLOCK]
                x = part[list(f)].to_numpy(float)
                gap = np.zeros((len(part), len(counts)))
                shared = np.zeros((len(part), len(counts)))
                for j in range(len(f)):
                    both = ~np.isnan(x[:, j])[:, None] & has[None, :, j]
                    away = np.maximum(low[None, :, j] - x[:, None, j], x[:, None, j] - high[None, :, j])
                    gap += np.where(both, np.square(np.maximum(np.nan_to_num(away), 0.0)), 0.0)
                    shared += both
                with np.errstate(divide="ignore", invalid="ignore"):
                    bound = np.where(shared > 0, gap * total / shared, np.inf)
                order = np.argsort(bound, axis=1, kind="stable")
                before = np.cumsum(counts[order], axis=1) - counts[order]
                home = np.zeros(bound.shape, dtype=bool)  # nearest cells holding k donors
                np.put_along_axis(home, order, before < k, axis=1)
                wanted = home & np.isfinite(bound)
                if not first:
                    radius = part["r"].to_numpy(float)
                    limit = np.where(np.isnan(radius), np.finfo(float).max, radius * (1 + 1e-9) + 1e-5)
                    wanted = ~home & (bound <= limit[:, None])
                rows, cells = np.nonzero(wanted)
                out = part.iloc[rows][["p", *f]].reset_index(drop=True)
                out.insert(1, "cell", np.asarray(cells, dtype="int64"))
                yield out

    return run


def _search(pairs: DataFrame, donors: DataFrame, cell_sizes: dict[int, int], f, keys, k, total, chunk_rows, schema) -> DataFrame:
    """Nearest ``k`` donors per (recipient, cell chunk)."""
    spark = pairs.sparkSession
    asked = {r["cell"]: r["count"] for r in pairs.groupBy("cell").count().collect()}  # one row per cell
    grid = [
        (cell, math.ceil(cell_sizes[cell] / chunk_rows), math.ceil(n / chunk_rows))
        for cell, n in asked.items()
    ]
    layout = F.broadcast(spark.createDataFrame(grid, "cell long, nd int, nr int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = (
        pairs.join(layout, "cell")
        .withColumn("rc", F.pmod(F.xxhash64("p"), F.col("nr")).cast("int"))
        .withColumn("dc", every("nd")).drop("nd", "nr")
    )
    right = (
        donors.join(layout, "cell")
        .withColumn("dc", F.pmod(F.xxhash64(*keys), F.col("nd")).cast("int"))
        .withColumn("rc", every("nr")).drop("nd", "nr")
    )
    names, order = list(f), list(keys)

    def nearest(asking: pd.DataFrame, giving: pd.DataFrame) -> pd.DataFrame:
        if asking.empty or giving.empty:
            return pd.DataFrame({n: [] for n in ("p", "d", *order, "t")})
        giving = giving.sort_values(order, kind="stable")
        a, b = asking[names].to_numpy(float), giving[names].to_numpy(float)
        rows, chosen, dist = [], [], []
        for start in range(0, len(a), _BLOCK):
            x = a[start : start + _BLOCK]
            square, shared = np.zeros((len(x), len(b))), np.zeros((len(x), len(b)))
            for j in range(len(names)):
                delta = x[:, None, j] - b[None, :, j]
                both = ~np.isnan(delta)
                square += np.where(both, delta * delta, 0.0)
                shared += both
            with np.errstate(divide="ignore", invalid="ignore"):
                d = np.round(np.where(shared > 0, square * total / shared, np.inf), _DECIMALS)
            for i in range(len(x)):
                edge = np.partition(d[i], k - 1)[k - 1] if len(b) > k else np.inf
                near = np.flatnonzero((d[i] <= edge) & np.isfinite(d[i]))
                near = near[np.argsort(d[i][near], kind="stable")][:k]
                rows += [start + i] * len(near)
                chosen += near.tolist()
                dist += d[i][near].tolist()
        out = giving.iloc[chosen][[*order, "t"]].reset_index(drop=True)
        out.insert(0, "d", dist)
        out.insert(0, "p", asking["p"].to_numpy()[rows])
        return out

    by = ["cell", "dc", "rc"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(nearest, schema)
