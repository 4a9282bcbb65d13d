"""Exact quantiles by radix descent.

Every double has an integer code of the same order (its IEEE bits, negated for
negative numbers). A wanted order statistic starts with the interval of all
values and is narrowed digit by digit: a round cuts each open interval into
aligned ranges of codes, counts the rows (or sums their weights) per range, and
keeps the one range in which the cumulative count passes the wanted rank,
shrunk to the smallest and largest value seen in it. A range of one value is
the answer.

A round is one aggregate by range number, combined in the tasks before it is
shuffled. No task and no collected table holds more than ``TABLE`` rows,
whatever the number of rows, distinct values or columns. The same path serves
every size: few distinct values end in the first round, 64-bit noise after
some five.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colprep.functions.exprs import literal_rows

TABLE = 1 << 16  # ranges of all open intervals of a round together
MAX_RANGES = 1 << 12  # of one interval

# Fixed values of the IEEE format.
_MAX = 1.7976931348623157e308
_LEAST_EXPONENT, _MOST_EXPONENT, _MANTISSA = -1022, 1023, 52


def code_of(x: float) -> int:
    """Integer of the same order as the double; NaN is above infinity, both zeros are 0."""
    if math.isnan(x):
        return 0x7FF0_0000_0000_0001
    bits = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -bits if x < 0 else bits


def with_code(df: DataFrame, value: str, name: str = "code") -> DataFrame:
    """Add the code of a double column without nulls, in generated code only.

    Exponent and fraction come from a logarithm that is then corrected, so the
    result is the bit pattern itself. Names of one select build on each other: the
    optimizer keeps the steps apart, and no subexpression is evaluated twice.
    """
    x = "`" + value.replace("`", "``") + "`"
    fraction = "__a / (__p * (1 + __up) / (1 + __down))"
    bits = f"(__e + __up - __down - ({_LEAST_EXPONENT})) * {1 << _MANTISSA}L + cast({fraction} * {1 << _MANTISSA}D AS bigint)"
    beyond = f"cast(abs({x}) > {_MAX!r}D AS int) + cast(isnan({x}) AS int)"
    return df.selectExpr(
        "*", f"least(abs({x}), {_MAX!r}D) AS __a",
        f"greatest(least(floor(coalesce(log2(__a), {_LEAST_EXPONENT}D)), {_MOST_EXPONENT}), {_LEAST_EXPONENT}) AS __e",
        "power(2D, cast(__e AS double)) AS __p",
        "cast(__a >= 2 * __p AS int) AS __up", f"cast(__a < __p AND __e > {_LEAST_EXPONENT} AS int) AS __down",
        f"({bits} + {beyond}) * CASE WHEN {x} < 0 THEN -1 ELSE 1 END AS {name}",
    ).drop("__a", "__e", "__p", "__up", "__down")


@dataclass
class _Interval:
    """Values of a column that must hold the wanted places; ``below`` rows (or weight) lie before them."""

    column: int
    lo: float
    hi: float
    below: float
    wanted: list = field(default_factory=list)  # (target, key): the first value whose cumulative count reaches the target

    def cut(self, ranges: int) -> tuple[int, int, int]:
        """(shift, first range, number of ranges), the ranges aligned to the shift."""
        lo, hi = code_of(self.lo), code_of(self.hi)
        shift = max(0, (hi - lo).bit_length() - ranges.bit_length() + 1)
        while (hi >> shift) - (lo >> shift) >= ranges:
            shift += 1
        return shift, lo >> shift, (hi >> shift) - (lo >> shift) + 1


def _round(values: DataFrame, intervals: list[_Interval]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """First slot of each interval, and the counted ranges by ascending slot."""
    ranges = max(2, min(MAX_RANGES, TABLE // len(intervals)))
    rows, starts, slot = [], [], 0
    for s in intervals:
        shift, first, count = s.cut(ranges)
        rows.append((s.column, s.lo, s.hi, shift, first, slot))
        starts.append(slot)
        slot += count
    cuts = F.broadcast(literal_rows(values.sparkSession, rows, "__c int, __lo double, __hi double, __shift int, __first long, __slot long"))
    inside = values.join(cuts, (F.col("i") == F.col("__c")) & (F.col("x") >= F.col("__lo")) & (F.col("x") <= F.col("__hi")))
    ranged = with_code(inside, "x").withColumn("slot", F.col("__slot") + F.expr("shiftright(code, __shift)") - F.col("__first"))
    table = ranged.groupBy("slot").agg(F.sum("w").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).toArrow().sort_by("slot")
    return np.array([*starts, slot]), {name: table[name].to_numpy() for name in ("slot", "n", "lo", "hi")}


def descend(values: DataFrame, intervals: list[_Interval]) -> dict:
    """{key: (value, cumulative count or weight up to it)} for the targets of all intervals.

    ``values`` has a column number ``i``, a double ``x`` without nulls and a count
    or weight ``w``. Rounding may leave the ranges of a weight sum a little short of
    their target; the last range of the interval then holds it.
    """
    found = {}
    pending = list(intervals)
    while pending:
        batch, pending = pending[: TABLE // 16], pending[TABLE // 16 :]
        starts, table = _round(values, batch)
        for s, a, b in zip(batch, np.searchsorted(table["slot"], starts[:-1]), np.searchsorted(table["slot"], starts[1:])):
            reached = s.below + np.cumsum(table["n"][a:b])
            narrower: dict[int, _Interval] = {}
            for target, key in s.wanted:
                k = min(int(np.searchsorted(reached, target)), b - a - 1)
                lo, hi = float(table["lo"][a + k]), float(table["hi"][a + k])
                if code_of(lo) == code_of(hi):
                    found[key] = (lo, reached[k])
                else:
                    below = reached[k - 1] if k else s.below
                    narrower.setdefault(k, _Interval(s.column, lo, hi, below)).wanted.append((target, key))
            pending += narrower.values()
    return found


def exact_quantiles(
    df: DataFrame, values: Mapping[str, Column], probs: Sequence[float], ends: Mapping[str, tuple[int, float | None, float | None]] | None = None
) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles of several expressions.

    ``ends`` gives the count of non-null values, the smallest and the largest one
    where they are known already; otherwise one more aggregate finds them.

    Returns ``{name: [quantile per prob]}``, ``None`` for columns without values.
    The result is a few numbers per column, small enough to inline as literals.
    """
    names = list(values)
    if not names:
        return {}
    base = df.select(*[v.cast("double").alias(f"v{i}") for i, v in enumerate(values.values())])
    if ends is None:
        row = base.agg(*[f(f"v{i}").alias(f"{k}{i}") for i in range(len(names)) for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
        ends = {name: (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, name in enumerate(names)}
    intervals = []
    for i, name in enumerate(names):
        n, lo, hi = ends[name]
        if n:
            ranks = sorted({r for p in probs for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})
            intervals.append(_Interval(i, lo, hi, 0, [(r + 1, (i, r)) for r in ranks]))
    stacked = base.select(F.explode(F.array(*[F.struct(F.lit(s.column).alias("i"), F.col(f"v{s.column}").alias("x")) for s in intervals])).alias("v")) if intervals else None
    found = descend(stacked.select("v.i", "v.x", F.lit(1).alias("w")).where("x IS NOT NULL"), intervals) if intervals else {}

    result = {}
    for i, name in enumerate(names):
        n, row = ends[name][0], []
        for p in probs if n else ():
            place = p * (n - 1)
            low, high = math.floor(place), math.ceil(place)
            a, b = found[i, low][0], found[i, high][0]
            row.append(a if low == high or a == b else a + (b - a) * (place - low))
        result[name] = row if n else [None] * len(probs)
    return result


def weighted_descent(df: DataFrame, value: Column, weight: Column, probs: Sequence[float], slack: float = 0.0) -> dict[float, tuple[float, float]]:
    """{p: (smallest value whose cumulative weight reaches p of the total, that weight)}; weights below 0 are not meant."""
    rows = df.select(F.lit(0).alias("i"), value.cast("double").alias("x"), weight.cast("double").alias("w")).where("x IS NOT NULL AND w IS NOT NULL")
    ends = rows.agg(F.sum("w").alias("total"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if ends["total"] is None:
        return {}
    wanted = [(p * ends["total"] * (1 - slack), p) for p in dict.fromkeys(probs)]
    return descend(rows, [_Interval(0, ends["lo"], ends["hi"], 0.0, wanted)])
