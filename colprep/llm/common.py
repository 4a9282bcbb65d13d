"""Helpers shared by the operators: texts as byte arrays, word hashes, tables written between steps.

Texts reach the tasks as Arrow columns. They are worked on as one byte array and row offsets, in slices of
a few megabytes, so memory depends on the slice (or the longest single text), not on the partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colprep.session import configure, scratch_dir

SLICE_BYTES = 1 << 21
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[str, np.ndarray] = {}

# Byte classes of UTF-8 text: 0 white space, 1 letter, 2 ASCII punctuation, 3 anything else.
SPACE, LETTER, PUNCT, OTHER = 0, 1, 2, 3
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
for _c in range(33, 127):
    if chr(_c).isalpha():
        _CLASS[_c] = LETTER
    elif not chr(_c).isdigit() and _c != 39:
        _CLASS[_c] = PUNCT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """A given table, with the package's session settings."""
    configure(spark)
    return spark.read.parquet(f"{sf}/{table}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Cut lineage: write below the shared folder and read again."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8), offsets


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) in pieces of about ``limit`` bytes; a row is never cut."""
    if not len(column):
        return
    data, offsets = texts_as_bytes(column)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters in UTF-8 bytes; lengths stay."""
    out = _LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = out[lead]
    out[lead] = np.where((second >= 0x80) & (second <= 0x9E) & (second != 0x97), second + 32, second)
    return out


def classes(data: np.ndarray) -> np.ndarray:
    """Byte classes; both bytes of a Latin-1 letter count as letters."""
    out = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    out[lead] = LETTER
    out[lead + 1] = LETTER
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space, and the number of them before each row (rows + 1)."""
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = _CLASS[data] != SPACE
    starts = solid[1:] > solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    starts[:-1][inner] |= solid[1:-1][inner] > 0  # a text ends its word
    ends = np.zeros(len(data) + 1, bool)
    ends[:] = solid[1:] < solid[:-1]
    ends[inner] |= solid[1:-1][inner - 1] > 0
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends), np.searchsorted(first, offsets)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, int(n).bit_length())
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        for name, base in (("up", _ODD), ("down", inverse)):
            powers = np.full(size, base, np.uint64)
            powers[0] = 1
            _POWERS[name] = np.cumprod(powers, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: polynomial prefix sums, so the cost is per byte whatever the spans."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, before: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``size``-word shingle hashes of each row, ascending, and the offsets of the rows.

    A text of fewer words, but at least one, has one shingle: all of its words.
    """
    counts = np.diff(before)
    per_row = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    rows = np.repeat(np.arange(len(counts)), per_row)
    if not len(rows):
        return np.zeros(0, np.uint64), np.zeros(len(counts) + 1, np.int64)
    first = np.repeat(before[:-1], per_row) + np.arange(len(rows)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    length = np.minimum(counts, size)[rows]
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    value = np.zeros(len(rows), np.uint64)
    for k in range(size):
        value = value * _ODD + np.where(k < length, padded[first + k], np.uint64(0))
    value = mixed(value + length.astype(np.uint64))
    order = np.lexsort((value, rows))
    value, rows = value[order], rows[order]
    keep = np.ones(len(rows), bool)
    keep[1:] = (value[1:] != value[:-1]) | (rows[1:] != rows[:-1])
    value, rows = value[keep], rows[keep]
    return value, np.searchsorted(rows, np.arange(len(counts) + 1))


def row_number_of(name: str, seed: int = 0) -> int:
    """A stable number for a name, the same in every process."""
    return int.from_bytes(hashlib.blake2b(f"{seed}:{name}".encode(), digest_size=8).digest(), "little")


def range_bounds(df: DataFrame, key: str, parts: int) -> list:
    """At most ``parts - 1`` ascending cut points of a key, from approximate quantiles of that column alone."""
    if parts < 2:
        return []
    probabilities = [k / parts for k in range(1, parts)]
    found = df.select(F.percentile_approx(key, probabilities, max(10_000, 20 * parts)).alias("q")).first()["q"]
    return sorted(set(found or []))


def range_number(key, bounds: list):
    """Number of the range that a key falls into; null goes first. The search is a binary tree of comparisons."""
    def search(low: int, high: int):
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key > F.lit(bounds[middle]), search(middle + 1, high)).otherwise(search(low, middle))

    return search(0, len(bounds)) if bounds else F.lit(0)


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a shared folder, whatever its scheme."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def put_file(store: pafs.FileSystem, path: str, attempt: str, blocks) -> None:
    """Write under an attempt's own name, then rename: a lost or repeated task leaves one whole file."""
    part = f"{path}.{attempt}.part"
    with store.open_output_stream(part) as out:
        for block in blocks:
            out.write(block)
    store.move(part, path)
