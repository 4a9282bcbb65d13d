"""Sums of products over all pairs of columns, by blockwise Gram matrices.

Each task multiplies its Arrow batches as matrices and hands on one row for each
pair of columns; Spark adds them by pair. The cost in the plan is one operator
whatever the number of columns, and a scan reads at most ``BLOCK`` columns twice
(a pair of blocks), which bounds the matrices a task holds.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprep.functions.exprs import c

BLOCK = 512
SUMS = ("xy", "n", "sx", "sy", "sxx", "syy")


def _matrix(batch: pa.RecordBatch, columns: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Values with 0 for null, and 1 where a value is present."""
    values = np.empty((batch.num_rows, len(columns)))
    for place, k in enumerate(columns):
        values[:, place] = batch.column(k).to_numpy(zero_copy_only=False)
    there = ~np.isnan(values)
    return np.where(there, values, 0.0), there.astype(np.float64)


def _block_sums(df: DataFrame, names: Sequence[str], left: range, right: range, gaps: bool) -> DataFrame:
    same = left == right
    used = list(left) if same else [*left, *right]
    a = range(len(left))
    b = a if same else range(len(left), len(used))
    kinds = SUMS if gaps else SUMS[:1]

    def run(batches):
        total = {k: np.zeros((len(a), len(b))) for k in kinds}
        for batch in batches:
            x, p = _matrix(batch, a)
            y, q = (x, p) if same else _matrix(batch, b)
            total["xy"] += x.T @ y
            if gaps:
                total["n"] += p.T @ q
                total["sx"] += x.T @ q
                total["sy"] += p.T @ y
                total["sxx"] += (x * x).T @ q
                total["syy"] += p.T @ (y * y)
        rows, columns = np.triu_indices(len(a), 1) if same else np.indices((len(a), len(b))).reshape(2, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array((rows + left.start).astype(np.int32)), pa.array((columns + right.start).astype(np.int32)), *(pa.array(total[k][rows, columns]) for k in kinds)],
            names=["i", "j", *kinds],
        )

    schema = ", ".join(["i int", "j int", *(f"{k} double" for k in kinds)])
    return df.select(*[c(names[k]).cast("double") for k in used]).mapInArrow(run, schema)


def pair_sums(df: DataFrame, names: Sequence[str], gaps: bool = True) -> DataFrame:
    """(i, j, xy, n, sx, sy, sxx, syy) for the columns with numbers i < j: sums over the rows where both hold a value.

    Without ``gaps`` no column may hold a null, and only ``xy`` is summed up. NaN counts as null.
    """
    blocks = [range(k, min(k + BLOCK, len(names))) for k in range(0, len(names), BLOCK)]
    found = None
    for left, right in combinations_with_replacement(blocks, 2):
        part = _block_sums(df, names, left, right, gaps)
        found = part if found is None else found.unionByName(part)
    return found.groupBy("i", "j").agg(*[F.sum(k).alias(k) for k in (SUMS if gaps else SUMS[:1])])
