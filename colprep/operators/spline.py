"""Cubic spline through the observed values of an ordered column.

The second derivatives at the observed places solve one tridiagonal system over
the whole table. It is solved in three steps: each bucket of the order eliminates
its own unknowns and is left with how its first and last one depend on the
neighbouring buckets; these few numbers a bucket make a small system of the same
shape, solved on the driver; then each bucket substitutes back. At both ends the
first two and the last two pieces are one polynomial (not-a-knot).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprep.functions.exprs import literal_rows
from colprep.functions.ordered import BUCKET, small
from colprep.session import scratch_dir

LEAST_VALUES = 4


def equations(at: np.ndarray, v: np.ndarray, first: int, total: int) -> tuple[np.ndarray, ...]:
    """Indexes and coefficients (left, own, right, sum) of the inner places; ``first`` is the index of ``at[0]``.

    The places reach from one before to one behind those that get an equation.
    """
    left, right = np.diff(at)[:-1], np.diff(at)[1:]
    slope = np.diff(v) / np.diff(at)
    a, b, c, d = left.copy(), 2 * (left + right), right.copy(), 6 * np.diff(slope)
    index = first + 1 + np.arange(len(a))
    start, end = index == 1, index == total - 2
    b += np.where(start, left + left**2 / right, 0) + np.where(end, right + right**2 / left, 0)
    c -= np.where(start, left**2 / right, 0)
    a -= np.where(end, right**2 / left, 0)
    a[start], c[end] = 0, 0
    return index, a, b, c, d


def eliminated(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Rows (own, by the left neighbour's last, by the right neighbour's first) of the unknowns."""
    n = len(b)
    right = np.zeros((n, 3))
    right[:, 0] = d
    right[0, 1], right[-1, 2] = -a[0], right[-1, 2] - c[-1]
    a, b, c = a.tolist(), b.tolist(), c.tolist()
    rows = right.tolist()
    ratio = [0.0] * n
    pivot = b[0]
    rows[0] = [x / pivot for x in rows[0]]
    for i in range(1, n):
        ratio[i - 1] = c[i - 1] / pivot
        pivot = b[i] - a[i] * ratio[i - 1]
        p, q = rows[i], rows[i - 1]
        rows[i] = [(p[0] - a[i] * q[0]) / pivot, (p[1] - a[i] * q[1]) / pivot, (p[2] - a[i] * q[2]) / pivot]
    for i in range(n - 2, -1, -1):
        p, q, k = rows[i], rows[i + 1], ratio[i]
        rows[i] = [p[0] - k * q[0], p[1] - k * q[1], p[2] - k * q[2]]
    return np.array(rows)


def joined_ends(edges: Sequence[Sequence[float]]) -> list[tuple[float, float]]:
    """(last of the bucket before, first of the bucket behind) for buckets in order, from their first and last rows."""
    alpha, beta, steps = 0.0, 0.0, []
    for p1, q1, r1, pm, qm, rm in edges:
        scale = 1 - q1 * beta
        first = ((p1 + q1 * alpha) / scale, r1 / scale)  # own part, and by the next bucket's first
        alpha, beta = pm + qm * alpha + qm * beta * first[0], qm * beta * first[1] + rm
        steps.append((first, alpha, beta))
    firsts, lasts, behind = [0.0] * len(steps), [0.0] * len(steps), 0.0
    for k in range(len(steps) - 1, -1, -1):
        (own, by), alpha, beta = steps[k]
        lasts[k] = alpha + beta * behind
        firsts[k] = behind = own + by * behind
    return [(lasts[k - 1] if k else 0.0, firsts[k + 1] if k + 1 < len(steps) else 0.0) for k in range(len(steps))]


def _own(pdf: pd.DataFrame):
    """Equations and eliminated unknowns of one bucket, neighbours included; None without unknowns."""
    pdf = pdf.sort_values("at")
    head = pdf.iloc[0]
    at, v, first = pdf["at"].to_numpy(), pdf["v"].to_numpy(), int(head["start"])
    if not np.isnan(head["at_before"]):
        at, v, first = np.r_[head["at_before"], at], np.r_[head["v_before"], v], first - 1
    if not np.isnan(head["at_behind"]):
        at, v = np.r_[at, head["at_behind"]], np.r_[v, head["v_behind"]]
    if len(at) < 3:
        return None
    index, a, b, c, d = equations(at, v, first, int(head["total"]))
    return index, at[1:-1], eliminated(a, b, c, d)


def second_derivatives(knots: DataFrame) -> DataFrame:
    """``BUCKET, at, m`` for the places ``BUCKET, at, v``, whose buckets are ranges of ``at``."""
    spark = knots.sparkSession
    path = scratch_dir(spark, "knots")
    knots.select(BUCKET, "at", "v").write.parquet(path)
    knots = spark.read.schema(f"{BUCKET} long, at double, v double").parquet(path)
    ends = knots.groupBy(BUCKET).agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.min_by("v", "at").alias("lv"), F.max_by("v", "at").alias("hv"),
    ).orderBy(BUCKET).collect()  # one row for each bucket
    total = sum(r["n"] for r in ends)
    if total < LEAST_VALUES:
        raise ValueError(f"cubic interpolation needs {LEAST_VALUES} values")
    rows, start = [], 0
    for k, r in enumerate(ends):
        before, behind = ends[k - 1] if k else None, ends[k + 1] if k + 1 < len(ends) else None
        rows.append((r[BUCKET], start, total, before and before["hi"], before and before["hv"], behind and behind["lo"], behind and behind["lv"]))
        start += r["n"]
    known = literal_rows(spark, rows, f"{BUCKET} long, start long, total long, at_before double, v_before double, at_behind double, v_behind double")
    placed = knots.join(small(known, len(rows)), BUCKET)

    def edges(pdf):
        found = _own(pdf)
        if found is None:
            return pd.DataFrame({BUCKET: [], **{k: [] for k in names}})
        return pd.DataFrame([[pdf[BUCKET].iloc[0], *found[2][0], *found[2][-1]]], columns=[BUCKET, *names])

    names = ("p1", "q1", "r1", "pm", "qm", "rm")
    small_system = placed.groupBy(BUCKET).applyInPandas(edges, f"{BUCKET} long, " + ", ".join(f"{k} double" for k in names)).orderBy(BUCKET).collect()
    around = joined_ends([[r[k] for k in names] for r in small_system])
    outer = literal_rows(spark, [(r[BUCKET], *x) for r, x in zip(small_system, around)], f"{BUCKET} long, last_before double, first_behind double")

    def substituted(pdf):
        found = _own(pdf)
        if found is None:
            return pd.DataFrame({BUCKET: [], "at": [], "i": [], "m": []})
        index, at, own = found
        head = pdf.iloc[0]
        return pd.DataFrame({BUCKET: int(head[BUCKET]), "at": at, "i": index, "m": own[:, 0] + own[:, 1] * head["last_before"] + own[:, 2] * head["first_behind"]})

    path = scratch_dir(spark, "spline")
    placed.join(small(outer, len(around)), BUCKET).groupBy(BUCKET).applyInPandas(substituted, f"{BUCKET} long, at double, i long, m double").write.parquet(path)
    inner = spark.read.schema(f"{BUCKET} long, at double, i long, m double").parquet(path)
    near = {r["i"]: (r["at"], r["m"]) for r in inner.where(F.col("i").isin(1, 2, total - 3, total - 2)).collect()}

    def end(x: float, nearest: int, next_: int) -> float:
        (x1, m1), (x2, m2) = near[nearest], near[next_]
        return m1 + (m2 - m1) * (x - x1) / (x2 - x1)

    first, last = ends[0], ends[-1]
    both = [(first[BUCKET], first["lo"], end(first["lo"], 1, 2)), (last[BUCKET], last["hi"], end(last["hi"], total - 2, total - 3))]
    return inner.select(BUCKET, "at", "m").unionByName(literal_rows(spark, both, f"{BUCKET} long, at double, m double"))
