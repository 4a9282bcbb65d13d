"""Vector code compression: product codes with integer codebooks, assigned through memoised grid cells.

Components become integers floor(256 x). Vectors are cut into 16 equal parts, each coded by the nearest of up to 64
entries. To assign a part, its coarse cell (a box of side 2 ** ``cell_bits``) is looked up by hash. For a new cell the
smallest and largest squared distance from its box to every entry are computed; an entry whose smallest distance is
beyond some entry's largest one is dominated and can be nearest to no point of the box. The other entries are kept in
the memo, and only these are evaluated exactly for the points of the cell. The memo outlives batches and tasks of one
Python worker; where it is full, cells are worked out and not kept. Codes are exact either way. Cells are told apart by
their coordinates, not by the hash alone.

A round sends one row for each part, entry and component from each batch group to the sums, at most 64 x the
components for a task, and the codebooks (as many integers) to the driver; nothing else leaves the tasks.

Cases: a vector that is null, or holds a null or non-finite component, is dropped; an empty one has sixteen empty
parts (code 0 throughout, error 0); vectors whose lengths differ, or are no multiple of 16, are filled up with zeros to
the longest one's next multiple; components saturate at +-2 ** 24 so that sums of squares are exact in 64 bits; fewer
than 64 vectors give fewer entries; repeated ids are ordered by their vectors, a null id is the largest; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
LIMIT = 1 << 24
CELL_BITS = 4
MEMO_CELLS = 1 << 18  # for each worker, all parts together: 64 bits of candidates and the box of each cell
SLICE_ROWS = 4096

_HEX = np.frombuffer("".join(f"{k:02x}" for k in range(256)).encode(), "S2")
_MULTIPLIER = np.int64(-7046029254386353131)
_MEMO: dict = {}


def finite(vector: Column) -> Column:
    """Not null, no null component, none infinite or not a number."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    vector = F.col(vector_col).cast("array<double>")
    return vectors.where(F.coalesce(finite(vector), F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"), F.col(label_col).alias("label"))


def part_matrix(column: pa.Array, width: int) -> np.ndarray:
    """Integers of a list column, vectors x parts x width; short vectors are filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(column.offsets.to_numpy())
    values = np.clip(np.floor(flat * SCALE), -LIMIT, LIMIT).astype(np.int64)
    out = np.zeros((len(column), PARTS * width), np.int64)
    rows = np.repeat(np.arange(len(column)), lengths)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out.reshape(len(column), PARTS, width)


class CellMemo:
    """Undominated entries of the boxes met so far, for the codebook of one part."""

    def __init__(self, entries: np.ndarray, cell_bits: int, room: int):
        self.entries, self.bits, self.room = entries, cell_bits, room
        self.keys = np.zeros(0, np.int64)
        self.boxes = np.zeros((0, entries.shape[1]), np.int64)
        self.members = np.zeros((0, len(entries)), bool)
        self.evaluated = 0

    def undominated(self, boxes: np.ndarray) -> np.ndarray:
        """Boxes x entries: may the entry be nearest to a point of the box?"""
        low = (boxes << self.bits)[:, None, :]
        below, above = low - self.entries, self.entries - (low + (1 << self.bits) - 1)
        least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(2)
        most = (np.maximum(-below, -above) ** 2).sum(2)
        return least <= most.min(1)[:, None]

    def candidates(self, boxes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Undominated entries of distinct boxes whose hashes, ascending, are given."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = (self.keys[at] == keys) & (self.boxes[at] == boxes).all(1) if len(self.keys) else np.zeros(len(keys), bool)
        out = np.empty((len(keys), len(self.entries)), bool)
        out[known] = self.members[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = self.undominated(boxes[new])
            clear = new[~np.isin(keys[new], self.keys)]  # a hash has one box in the memo
            clear = clear[np.r_[True, keys[clear][1:] != keys[clear][:-1]]] if len(clear) else clear
            clear = clear[: max(0, self.room - len(self.keys))]
            if len(clear):
                order = np.argsort(merged := np.concatenate([self.keys, keys[clear]]), kind="stable")
                self.keys, self.boxes, self.members = merged[order], np.concatenate([self.boxes, boxes[clear]])[order], np.concatenate([self.members, out[clear]])[order]
        return out

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry, the lower index on ties."""
        if not points.shape[1]:
            return np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        boxes = points >> self.bits
        keys = np.zeros(len(points), np.int64)
        for k in range(boxes.shape[1]):
            keys = (keys ^ boxes[:, k]) * _MULTIPLIER
            keys ^= (keys >> 29) & np.int64((1 << 35) - 1)
        order = np.lexsort((*boxes.T, keys))
        starts = np.ones(len(order), bool)
        starts[1:] = (boxes[order[1:]] != boxes[order[:-1]]).any(1)
        first = order[starts]
        of_point = np.empty(len(order), np.int64)
        of_point[order] = np.cumsum(starts) - 1
        row, entry = np.nonzero(self.candidates(boxes[first], keys[first])[of_point])  # by point, then ascending entry
        distance = ((points[row] - self.entries[entry]) ** 2).sum(1)
        self.evaluated += len(row)
        begin = np.searchsorted(row, np.arange(len(points)))
        best = np.minimum.reduceat(distance, begin)
        hit = np.flatnonzero(distance == best[row])
        return entry[hit[np.searchsorted(row[hit], np.arange(len(points)))]], best


def memos(codebooks: np.ndarray, cell_bits: int) -> list[CellMemo]:
    """One memo for each part; those of the last codebooks stay in the worker."""
    key = (hashlib.sha256(codebooks.tobytes()).digest(), codebooks.shape, cell_bits)
    if key not in _MEMO:
        _MEMO.clear()
        _MEMO[key] = [CellMemo(part, cell_bits, MEMO_CELLS // PARTS) for part in codebooks]
    return _MEMO[key]


def assign(column: pa.Array, codebooks: np.ndarray, cell_bits: int = CELL_BITS):
    """(first row, integers, entries, squared distances) for slices of a list column."""
    cells = memos(codebooks, cell_bits)
    for first in range(0, len(column), SLICE_ROWS):
        points = part_matrix(column.slice(first, SLICE_ROWS), codebooks.shape[2])
        found = [memo.nearest(points[:, p]) for p, memo in enumerate(cells)]
        yield first, points, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def seeds(kept: DataFrame, width: int) -> np.ndarray:
    """Codebooks of the vectors with the smallest ids: parts x entries x width."""
    rows = kept.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).collect()
    return np.ascontiguousarray(part_matrix(pa.array([r["vector"] for r in rows], pa.list_(pa.float64())), width).transpose(1, 0, 2))


def improved(kept: DataFrame, codebooks: np.ndarray, cell_bits: int = CELL_BITS) -> np.ndarray:
    """Every used entry replaced by the floor of the mean of its parts."""
    parts, entries, width = codebooks.shape

    def sums(batches):
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            for _, points, codes, _ in assign(batch.column(0), codebooks, cell_bits):
                slot = (codes + np.arange(parts) * entries).ravel()
                count += np.bincount(slot, minlength=len(count))
                flat = points.reshape(len(slot), width)
                order = np.argsort(slot, kind="stable")
                used, begin = np.unique(slot[order], return_index=True)
                total[used] += np.add.reduceat(flat[order], begin)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used * width, width) + np.tile(np.arange(width), len(used))), pa.array(total[used].ravel()), pa.array(np.repeat(count[used], width))],
            names=["place", "total", "n"],
        )

    found = kept.select("vector").mapInArrow(sums, "place long, total long, n long").groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    out = codebooks.copy()
    flat = out.reshape(-1)
    for row in found:  # one number for each component of the codebooks at most
        flat[row["place"]] = row["total"] // row["n"]
    return out


def codes_of(kept: DataFrame, codebooks: np.ndarray, cell_bits: int = CELL_BITS) -> DataFrame:
    """vec_id, label, code and error of every vector."""
    def run(batches):
        for batch in batches:
            texts, errors = [], []
            for _, _, codes, distances in assign(batch.column(1), codebooks, cell_bits):
                texts.append(_HEX[codes].view(f"S{2 * PARTS}").ravel())
                errors.append(distances.sum(1))
            if texts:
                code = pa.array(np.concatenate(texts)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), code, pa.array(np.concatenate(errors))], names=["vec_id", "label", "code", "error"])

    label = kept.schema["label"].dataType.simpleString()
    return kept.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def fit(kept: DataFrame, rounds: int = ROUNDS, cell_bits: int = CELL_BITS) -> np.ndarray | None:
    """Codebooks, parts x entries x width; None without vectors."""
    longest = kept.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return None
    codebooks = seeds(kept, -(-longest // PARTS))
    for _ in range(rounds):
        codebooks = improved(kept, codebooks, cell_bits)
    return codebooks


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of the decimal components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cell_bits: int = CELL_BITS) -> DataFrame:
    """vec_id, code, error, the error summed over the vector's label, and the digest of the codebooks."""
    kept = kept_vectors(vectors, id_col, vector_col, label_col)
    codebooks = fit(kept, cell_bits=cell_bits)
    if codebooks is None:
        codebooks = np.zeros((PARTS, 1, 0), np.int64)
    coded = codes_of(kept, codebooks, cell_bits)
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    by_label = F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit("="), F.col("label").cast("string")))  # nulls are equal
    joined = coded.withColumn("__by", by_label).join(sums.select(by_label.alias("__by"), "label_error"), "__by")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))
