"""Token-id files in Simple-8b coding.

Format of a file (little-endian). Header: 8 bytes magic ``CPS8B\\0\\0\\1``. Blocks: each holds ``BLOCK_IDS`` ids (the
last one fewer) as 64-bit words; the top 4 bits of a word are its selector, the rest holds as many ids of one width
as the selector says, low bits first. An id that fits no other selector is an escape: selector 15, its 60 bits are
the id itself (60 bits are the most an id may have). Footer: per block (byte offset of its words, number of words,
number of ids), then per document (doc_id, valid flag, ids before it in the file, number of ids), then the two
counts, the number of ids and the magic again. Offsets make every block decodable alone; decoding is vectorised by
selector.

Files hold ascending, disjoint ranges of doc_id and are named by range number. A task writes under its
attempt's name and renames, so a repeated task leaves one whole file.

Cases: a null or empty text is the end id alone; null doc_ids come first; equal doc_ids keep together in one
file, ordered by text; an empty table writes no file and reads back as no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colprep.llm.common import open_store, put_file, range_bounds, range_number, slices
from colprep.llm.tokens import encoder, vocabulary_path
from colprep.session import scratch_dir

MAGIC = b"CPS8B\0\0\1"
BLOCK_IDS = 65_536
END_ID = 1
FILE_CHARS = 24_000_000  # text per file, so that a file stays a few tens of megabytes
ESCAPE = 15
# ids in a word by selector; the width is 60 // count bits
COUNTS = (0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = tuple(60 // n if n else 0 for n in COUNTS)


def encode_block(ids: np.ndarray) -> np.ndarray:
    """Greedy words: each takes the longest run of ids that fits one selector.

    How many ids a word can take at every position follows from window maxima of the bit widths, for all
    positions at once; only the walk from word to word is a loop.
    """
    ids = ids.astype(np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    if int(ids.max()) >> 60:
        raise ValueError("an id has more than 60 bits")
    bits = np.zeros(n, np.int64)
    rest = ids.copy()
    while rest.any():
        bits[rest > 0] += 1
        rest >>= np.uint64(1)
    bits = np.maximum(bits, 1)
    best = np.full(n, ESCAPE, np.int64)
    take = np.ones(n, np.int64)
    for selector in range(14, 0, -1):  # from few ids to many, the last that fits wins
        count, width = COUNTS[selector], WIDTHS[selector]
        wide = np.concatenate([[0], np.cumsum(bits > width)])
        fits = wide[count:] == wide[:-count] if count <= n else np.zeros(0, bool)
        at = np.flatnonzero(fits)
        best[at], take[at] = selector, count
    starts, place = [], 0
    step = take.tolist()
    while place < n:
        starts.append(place)
        place += step[place]
    starts = np.array(starts)
    selectors = best[starts]
    out = selectors.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(selectors).tolist():
        at = np.flatnonzero(selectors == selector)
        if selector == ESCAPE:
            out[at] |= ids[starts[at]]
            continue
        count, width = COUNTS[selector], WIDTHS[selector]
        values = ids[starts[at][:, None] + np.arange(count)]
        shifts = (np.arange(count) * width).astype(np.uint64)
        out[at] |= np.bitwise_or.reduce(values << shifts, axis=1)
    return out


def decode_block(words: np.ndarray) -> np.ndarray:
    """Ids of a block's words."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([*COUNTS, 1])[selectors]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    body = words & np.uint64((1 << 60) - 1)
    for selector in np.unique(selectors).tolist():
        at = np.flatnonzero(selectors == selector)
        first = ends[at] - counts[at]
        if selector == ESCAPE:
            out[first] = body[at]
            continue
        count, width = COUNTS[selector], WIDTHS[selector]
        shifts = (np.arange(count) * width).astype(np.uint64)
        out[(first[:, None] + np.arange(count)).ravel()] = ((body[at][:, None] >> shifts) & np.uint64((1 << width) - 1)).ravel()
    return out


class FileBuilder:
    """Collects ids of documents and yields a file's bytes block by block."""

    def __init__(self):
        self.open, self.waiting = [], 0
        self.blocks, self.documents = [], []
        self.ids = 0
        self.place = len(MAGIC)
        self.parts: list[bytes] = [MAGIC]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.documents.append((doc_id or 0, doc_id is not None, self.ids, len(ids)))
        self.ids += len(ids)
        self.open.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK_IDS:
            joined = np.concatenate(self.open)
            whole = len(joined) // BLOCK_IDS * BLOCK_IDS
            for k in range(0, whole, BLOCK_IDS):
                self._block(joined[k : k + BLOCK_IDS])
            self.open, self.waiting = [joined[whole:]], len(joined) - whole

    def _block(self, ids: np.ndarray) -> None:
        coded = encode_block(ids)
        self.blocks.append((self.place, len(coded), len(ids)))
        self.parts.append(coded.astype("<u8").tobytes())
        self.place += 8 * len(coded)

    def finish(self) -> list[bytes]:
        if self.waiting:
            self._block(np.concatenate(self.open))
        footer = np.array(self.blocks, "<i8").reshape(-1, 3).tobytes() + np.array(self.documents, "<i8").reshape(-1, 4).tobytes()
        return [*self.parts, footer, struct.pack("<qqq", len(self.blocks), len(self.documents), self.ids), MAGIC]


def read_file(content: bytes):
    """Yields (doc_id, ids before it in the file, ids) of a file, block by block."""
    if content[:8] != MAGIC or content[-8:] != MAGIC:
        raise ValueError("not a whole token file")
    n_blocks, n_documents, _ = struct.unpack("<qqq", content[-32:-8])
    at = len(content) - 32 - 24 * n_blocks - 32 * n_documents
    blocks = np.frombuffer(content, "<i8", 3 * n_blocks, at).reshape(-1, 3)
    documents = np.frombuffer(content, "<i8", 4 * n_documents, at + 24 * n_blocks).reshape(-1, 4)
    held, first, block = np.zeros(0, np.uint64), 0, 0  # decoded ids and the number of the first of them
    for doc_id, valid, start, n in documents.tolist():
        parts = [held[start - first :]]
        have = first + len(held)
        while have < start + n:
            place, words, ids = blocks[block].tolist()
            held = decode_block(np.frombuffer(content, "<u8", words, place))
            if len(held) != ids:
                raise ValueError("a block does not hold its number of ids")
            parts.append(held)
            first, have, block = have, have + ids, block + 1
        yield (doc_id if valid else None), start, np.concatenate(parts)[:n].astype(np.uint32)


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, file_chars: int = FILE_CHARS, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Write all documents in ascending doc_id order; returns the number of ranges."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.length("text") + 8)).first()[0] or 0
    bounds = range_bounds(rows, "doc_id", -(-int(chars) // file_chars))
    n = len(bounds) + 1

    def run(batches):
        coder, (store, inner) = encoder(path), open_store(folder)
        attempt = str(TaskContext.get().taskAttemptId())
        builder, current = None, None

        def close():
            put_file(store, f"{inner}/{current:09d}.s8b", attempt, builder.finish())
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([builder.ids], pa.int64())], names=["file", "ids"])

        for batch in batches:
            files = batch.column(0).to_pylist()
            keys = batch.column(1).to_pylist()
            for low, high, data, offsets in slices(batch.column(2)):
                ids, at = coder.encode(data, offsets)
                for row in range(high - low):
                    if files[low + row] != current:
                        if builder is not None:
                            yield close()
                        builder, current = FileBuilder(), files[low + row]
                    builder.add(keys[low + row], np.append(ids[at[row] : at[row + 1]], np.uint32(end_id)))
        if builder is not None:
            yield close()

    placed = rows.select(range_number(F.col("doc_id"), bounds).alias("file"), "doc_id", "text")
    store, inner = open_store(folder)
    store.create_dir(inner, recursive=True)
    done = placed.repartition(n, "file").sortWithinPartitions("file", F.col("doc_id").asc_nulls_first(), "text").mapInArrow(run, "file long, ids long")
    done.agg(F.count("*")).first()
    return n


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the files: doc_id, file, local_start, n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc_id, start, ids in read_file(content.as_py())]
                number = int(path.rsplit("/", 1)[-1].split(".")[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(rows), pa.int64()), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(4))],
                    names=["file", "doc_id", "local_start", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.s8b").load(folder)
    return files.select("path", "content").mapInArrow(run, "file long, doc_id long, local_start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, path: str | None = None, end_id: int = END_ID, file_chars: int = FILE_CHARS) -> DataFrame:
    """Write all documents and read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = scratch_dir(spark, "tokens")
    write_token_files(docs, folder, path or vocabulary_path(), end_id, file_chars)
    rows = read_token_files(spark, folder)
    # One row per file (a few longs per tens of megabytes of text): a running sum over them is small.
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("ids"))
    before = totals.select("file", F.coalesce(F.sum("ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return rows.join(before, "file").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
