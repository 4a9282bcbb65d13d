"""Isolation forest on one column.

Every tree is grown from the rows with the smallest hash of tree and row key, out
of all rows of the table: a sample without replacement that needs no random state.
With one feature the mean path length is a step function of the value. The rows
on each step are counted over the whole table, which gives the exact threshold of
the wanted share, and the forest reduces to the value ranges whose score passes it.
Scoring the table is then a plain Column expression, without Python on the executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colprep.functions.exprs import c, num

TREES = 100
TREE_ROWS = 256
MIN_VALUES = 10
_EULER = 0.5772156649015329


def average_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary tree of ``n`` values."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + _EULER) - 2.0 * (n - 1.0) / n


def _grow(values: np.ndarray, depth: int, limit: int, rng, cuts: list, leaves: list) -> None:
    """Collect cut points and leaf depths from left to right."""
    if depth >= limit or len(values) <= 1 or values[0] == values[-1]:
        leaves.append(depth + average_path(len(values)))
        return
    cut = rng.uniform(values[0], values[-1])
    split = int(np.searchsorted(values, cut, side="right"))
    _grow(values[:split], depth + 1, limit, rng, cuts, leaves)
    cuts.append(cut)
    _grow(values[split:], depth + 1, limit, rng, cuts, leaves)


def quantile_of_counts(values: np.ndarray, counts: np.ndarray, p: float) -> float:
    """Linear-interpolation quantile of values that occur ``counts`` times."""
    order = np.argsort(values, kind="stable")
    values, upto = values[order], np.cumsum(counts[order])
    place = p * (int(upto[-1]) - 1)
    a, b = (float(values[np.searchsorted(upto, k, side="right")]) for k in (math.floor(place), math.ceil(place)))
    return a + (b - a) * (place - math.floor(place))


def fit_forest(samples: Sequence[Sequence[float]], counts: Callable[[np.ndarray], np.ndarray], contamination: float, seed: int = 42) -> dict:
    """Score threshold and the value ranges scored above it.

    ``samples`` has the values of each tree; ``counts`` gives the rows of the whole
    table in (-inf, e0], (e0, e1], ... (en, inf) for ascending edges.
    """
    rng = np.random.default_rng(seed)
    size = max(map(len, samples))
    limit = max(1, math.ceil(math.log2(max(size, 2))))
    trees = []
    for values in samples:
        cuts, leaves = [], []
        _grow(np.sort(np.asarray(values, dtype=float)), 0, limit, rng, cuts, leaves)
        trees.append((np.asarray(cuts), np.asarray(leaves)))
    edges = np.unique(np.concatenate([t[0] for t in trees]))
    # Interval i is (edges[i-1], edges[i]]; its right end stands for all of it.
    points = np.append(edges, math.inf)
    depth = sum(leaves[np.searchsorted(cuts, points, side="left")] for cuts, leaves in trees) / len(trees)
    scores = 2.0 ** (-depth / max(average_path(size), 1e-12))
    held = np.asarray(counts(edges))
    threshold = quantile_of_counts(scores[held > 0], held[held > 0], 1.0 - contamination)
    ranges, low = [], None
    for i, hit in enumerate(scores > threshold):
        left = -math.inf if i == 0 else float(edges[i - 1])
        if hit and low is None:
            low = left
        if not hit and low is not None:
            ranges.append((low, left))
            low = None
    if low is not None:
        ranges.append((low, math.inf))
    return {"threshold": threshold, "ranges": ranges, "rows": int(held.sum())}


def is_anomaly(x: Column, ranges: Sequence[tuple[float, float]]) -> Column:
    """True inside any half-open range ``(low, high]``."""
    flag = F.lit(False)
    for low, high in ranges:
        flag = flag | ((x > F.lit(float(low))) & (x <= F.lit(float(high))))
    return F.coalesce(flag, F.lit(False))


def tree_samples(values: DataFrame, rows: int, trees: int = TREES, size: int = TREE_ROWS) -> list[list[float]]:
    """Per tree the values of the ``size`` rows with the smallest hash of tree and key, out of all ``rows``.

    ``values`` has the hash of the row key ``h`` and the value ``x``. Rows beyond a hash
    that some twice ``size`` rows of a tree are expected to stay below go at once; the bound
    is raised until every tree has its rows. Rows with equal key and value travel as one.
    """
    wanted, share = min(size, rows), min(1.0, 2.0 * size / rows)
    while True:
        bound = int(share * 2.0**63) if share < 1 else (1 << 63) - 1
        each = values.select("x", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "h").select("x", "tree", F.shiftrightunsigned(F.xxhash64("h", "tree"), 1).alias("rank"))
        found = each.where(F.col("rank") <= F.lit(bound)).groupBy("tree", "rank", "x").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by([("tree", "ascending"), ("rank", "ascending"), ("x", "ascending")])
        tree, x, n = (found[k].to_numpy() for k in ("tree", "x", "n"))
        start = np.searchsorted(tree, np.arange(trees + 1))
        out = [np.repeat(x[a:b], np.minimum(n[a:b], wanted))[:wanted].tolist() for a, b in zip(start[:-1], start[1:])]
        if share >= 1 or all(len(v) == wanted for v in out):
            return out
        share = min(1.0, share * 2)


def fit_column(df: DataFrame, column: str, key: Sequence[str], contamination: float = 0.1, seed: int = 42) -> dict:
    values = df.select(num(df, column).alias("x"), F.xxhash64(*[c(k) for k in key]).alias("h")).where("x IS NOT NULL AND NOT isnan(x)")
    n = values.count()
    if n < MIN_VALUES:
        raise ValueError("insufficient data for an isolation forest")

    def counts(edges: np.ndarray) -> np.ndarray:
        if not len(edges):
            return np.array([n])
        # Bucketizer takes [a, b); the steps are (a, b], so each edge moves up by one representable number
        splits = [-math.inf, *np.nextafter(edges, math.inf).tolist(), math.inf]
        placed = Bucketizer(splits=splits, inputCol="x", outputCol="step").transform(values.select("x")).groupBy("step").agg(F.count(F.lit(1)).alias("n"))
        held = np.zeros(len(edges) + 1, np.int64)
        for r in placed.collect():  # one row for each step of the score, 25,501 at most
            held[int(r["step"])] = r["n"]
        return held

    return fit_forest(tree_samples(values, n), counts, contamination, seed)
