"""Exact top-k inner products with an impact-ordered index, score at a time.

Vectors are turned into integers (``floor(scale * x)``) and kept in blocks. A value's quantised impact is its
binary magnitude (the bit length of its absolute value). In a block every component has one posting segment an impact:
the vectors whose value there has that impact. Segments are stored by descending impact, along with the norm of what
each vector has below it. Queries are worked off in small batches: all segments of an impact are added to the
accumulators together. What a vector can still gain or lose is at most the query's norm times the vector's norm below
the impacts processed, which gives a lower and an upper bound of every score. A query stops when only few vectors have
an upper bound that reaches the k-th lower bound (or the k-th exact score of earlier blocks): all others are proven
out, and the possible members are rescored exactly. A query without such a proof goes on to the last segment.

The index is built once and written. Groups of its blocks meet blocks of queries as a grid, so work is dealt over as
many tasks as there are pairs of both, and a task holds one group and one block. Each pair returns k rows a query.

Cases: vectors that are null, empty or hold null or non-finite components take no part; vectors of different
length count as filled up with zeros; ties go to the smaller id; rows that repeat an id are separate candidates,
except the query's own id; a repeated id asks with each of its different vectors and gets the k best of all answers; an
empty table gives no rows; other columns are ignored; scores are 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colprep.llm.common import written

SCALE = 1024.0
BLOCK = 4096  # vectors a block, fewer where they are longer than 64
BLOCK_VALUES = 4096 * 64
GROUP = 4  # blocks that one task meets with a block of queries
BATCH = 256  # queries that share accumulators
ENOUGH = 96  # possible members a query that are cheaper to rescore than to rule out
ROUND = 0.1  # share of the postings that is processed between two proofs, at least
SLACK = 1e-12  # relative error of a sum of doubles, far above what any dimension gives
PAIRS = 1 << 16  # pairs rescored at a time


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE) -> DataFrame:
    """vec_id, v (array of long) of the vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & finite)
    return kept.select("vec_id", F.transform("x", lambda x: F.floor(x * F.lit(scale))).alias("v"))


def _matrices(batches, size: int, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, values) of at most ``size`` vectors each, filled up with zeros."""
    ids, values, held = [], [], 0
    for batch in batches:
        v = batch.column(1)
        for low in range(0, batch.num_rows, size):
            part = v.slice(low, size)
            lengths = part.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            full = np.zeros((len(part), dim), np.int64)
            full[np.arange(dim) < lengths[:, None]] = part.flatten().to_numpy(zero_copy_only=False)
            ids.append(batch.column(0).slice(low, size).to_numpy(zero_copy_only=False))
            values.append(full)
            held += len(part)
            if held >= size:
                all_ids, all_values = np.concatenate(ids), np.concatenate(values)
                yield all_ids[:size], all_values[:size]
                ids, values, held = [all_ids[size:]], [all_values[size:]], held - size
    if held:
        yield np.concatenate(ids), np.concatenate(values)


def segments(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posting segments of a block: places in the flat (vector, component) matrix by descending impact, then component;
    and the end of every (impact, component) segment, 64 impacts times the number of components. Zeros have no posting."""
    n, dim = values.shape
    size = np.abs(values).astype(np.uint64)
    impact = np.zeros((n, dim), np.int64)
    for shift in (32, 16, 8, 4, 2, 1):
        large = size >= np.uint64(1 << shift)
        impact[large] += shift
        size[large] >>= np.uint64(shift)
    key = (63 - impact) * dim + np.arange(dim)
    place = np.flatnonzero(values.ravel())
    order = place[np.argsort(key.ravel()[place], kind="stable")]
    return order.astype(np.int32), np.cumsum(np.bincount(key.ravel()[place], minlength=64 * dim))


class Index:
    """Blocks of vectors with their posting segments."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, postings: np.ndarray, ends: np.ndarray):
        self.ids, self.values = ids, values
        n, dim = values.shape
        flat = values.astype(np.float64).ravel()
        ends = ends.reshape(64, dim)[:, -1]  # of all components' segments of an impact
        self.rounds: list[tuple[np.ndarray, np.ndarray]] = []  # (values of the segments, norm below them)
        left = np.einsum("ij,ij->i", values.astype(np.float64), values.astype(np.float64))
        self.norm = np.sqrt(left)
        low = 0
        for impact, high in enumerate(ends.tolist()):
            if high > low and (high - low >= ROUND * len(postings) or high == len(postings)):
                part = np.zeros(n * dim)
                part[postings[low:high]] = flat[postings[low:high]]
                part = part.reshape(n, dim)
                left = left - np.einsum("ij,ij->i", part, part)
                # rounding of the squares is covered by the slack below; nothing is left behind the last segment
                rest = np.zeros(n) if high == len(postings) else np.sqrt(np.maximum(left, 0) + SLACK * self.norm**2)
                self.rounds.append((part, rest))
                low = high

    def search(self, numbers: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query places, ids, scores) of all vectors that can belong to the k best of each query.

        ``floor`` holds the k-th best exact score of every query so far, or minus infinity."""
        at = np.arange(len(numbers))
        asked = queries.astype(np.float64)
        length = np.sqrt(np.einsum("ij,ij->i", asked, asked))
        best = floor.copy()
        gathered = np.zeros((len(numbers), len(self.ids)))
        gathered[numbers[:, None] == self.ids] = -np.inf  # a query is no candidate of its own
        for step, (part, rest) in enumerate(self.rounds or [(np.zeros(self.values.shape), np.zeros(len(self.ids)))], 1):
            gathered += asked @ part.T
            doubt = length[:, None] * (rest + SLACK * self.norm)
            if len(self.ids) >= k:
                lower = np.partition(gathered - doubt, len(self.ids) - k, axis=1)[:, len(self.ids) - k]
                best = np.maximum(best, lower)
            # own entries are minus infinity and stay out; so are all where no bound is known and nothing else is held
            possible = (gathered + doubt >= best[:, None]) & (gathered > -np.inf)
            done = possible.sum(1) <= ENOUGH
            if step >= len(self.rounds):
                done[:] = True
            if done.any():
                q, x = np.nonzero(possible[done])
                where = at[done][q]
                for first in range(0, len(x), PAIRS):
                    some = slice(first, first + PAIRS)
                    yield where[some], self.ids[x[some]], np.einsum("ij,ij->i", queries[where[some]], self.values[x[some]])
            if done.all():
                return
            keep = ~done
            at, asked, length, best, gathered = at[keep], asked[keep], length[keep], best[keep], gathered[keep]


def _merged(k: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query place, id, score) of every query, ties to the smaller id, by query and rank."""
    where, ids, scores = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((ids, -scores, where))
    where = where[order]
    rank = np.arange(len(where)) - np.searchsorted(where, where)
    order = order[rank < k]
    return where[rank < k], ids[order], scores[order]


def _best_of(blocks: list[Index], numbers: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of every query over some blocks."""
    found = (np.zeros(0, np.int64),) * 3
    floor = np.full(len(numbers), -np.inf)
    for block in blocks:
        for part in block.search(numbers, queries, k, floor):
            found = _merged(k, [found, part])
        where, _, scores = found
        last = np.searchsorted(where, np.arange(len(numbers)), "right") - 1
        full = np.bincount(where, minlength=len(numbers)) >= k
        # the score as a double, less what its rounding can hide
        floor[full] = scores[last[full]] - SLACK * np.abs(scores[last[full]].astype(np.float64))
    return found


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE) -> DataFrame:
    """Queries are the vectors whose id is divisible by ``every``: query_id, rank, vec_id, score."""
    rows = written(quantised(vectors, id_col, vector_col, scale), "vectors")
    asked = F.pmod(F.col("vec_id"), F.lit(every)) == 0
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    n, dim = shape["n"], shape["dim"] or 1
    questions = rows.where(asked).dropDuplicates(["vec_id", "v"])
    q = questions.count()
    size = max(16, min(BLOCK, BLOCK_VALUES // dim))
    groups, query_blocks = max(1, -(-n // (size * GROUP))), max(1, -(-q // (size)))

    # Rows are dealt evenly, whatever their ids: the number of the task is the number of the group or query block.
    def build(batches):
        group = TaskContext.get().partitionId() % groups
        for ids, values in _matrices(batches, size, dim):
            postings, ends = segments(values)
            cells = [pa.array([x], t) for x, t in ((group, pa.int32()), *((a.tobytes(), pa.binary()) for a in (ids, values, postings, ends)))]
            yield pa.RecordBatch.from_arrays(cells, names=["grp", "ids", "vals", "postings", "ends"])

    def ask(batches):
        block = TaskContext.get().partitionId() % query_blocks
        for ids, values in _matrices(batches, size, dim):
            cells = [pa.array([block], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cells, names=["blk", "ids", "vals"])

    index = written(rows.repartition(groups).mapInArrow(build, "grp int, ids binary, vals binary, postings binary, ends binary"), "index")
    queries = written(questions.repartition(query_blocks).mapInArrow(ask, "blk int, ids binary, vals binary"), "queries")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        def array(cell, kind=np.int64):
            return np.frombuffer(cell.as_buffer(), kind)

        blocks = [
            Index(array(left["ids"][r]), array(left["vals"][r]).reshape(-1, dim), array(left["postings"][r], np.int32), array(left["ends"][r])) for r in range(left.num_rows)
        ]
        out = [(np.zeros(0, np.int64),) * 3]
        for r in range(right.num_rows):
            numbers, asked_values = array(right["ids"][r]), array(right["vals"][r]).reshape(-1, dim)
            for first in range(0, len(numbers) if blocks else 0, BATCH):
                some = slice(first, first + BATCH)
                where, ids, scores = _best_of(blocks, numbers[some], asked_values[some], k)
                out.append((numbers[some][where], ids, scores))
        return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    pairs = index.withColumn("blk", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).groupBy("grp", "blk")
    with_queries = queries.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).groupBy("grp", "blk")
    best = pairs.cogroup(with_queries).applyInArrow(meet, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
