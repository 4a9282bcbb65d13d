"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of all benchmark words over the half passages of the whole corpus.
2. Passages: windows of two halves, moving by one half; a half is as long as the longest benchmark piece (items of
   more than ``PIECE`` words are cut into pieces), so every piece that was copied lies whole in some window.
   A passage keeps its words as benchmark word numbers. Words that no item holds cannot add to a cosine with one.
3. TF-IDF over the informative words: those in at most ``MAX_SHARE`` of the halves, and the ``RAREST`` rarest of every
   piece however frequent. The inverse document frequency is 1 / sqrt(df), which gives every word the same total
   energy, so words that occur together stand out against words that are merely frequent.
4. Distributed randomised SVD of the passage matrix: a Gaussian start block is multiplied by A'A in passes over
   the passages with a QR step on the driver in between; only (benchmark words x rank) numbers leave the tasks.
5. Candidates: cosine of at least ``COSINE`` in the latent space, of an item's piece and windows of its own size. The
   pieces of a group fall into length classes (the longest, half of it, a quarter, ... down to ``SHORTEST`` words). In
   every passage each class has windows of two spans that move by one span, so a short item beside long ones is not
   held against a window many times its length.
6. Check: longest common subsequence of words. A share of ``VERBATIM`` of the item's words is a leak; from
   ``PARAPHRASE`` on, it is one if all informative words of the answer (the item's last sentence) are there.

Benchmarks are worked on in groups of ``ITEMS`` items, so what is broadcast has a fixed bound.

Cases: null and empty texts hold no passage; null and empty items match nothing; repeated rows are reported as
often as they occur; a null doc_id stays null; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprep.llm.common import lower_bytes, partitions, slices, span_hashes, texts_as_bytes, words, written

PIECE = 128
ITEMS = 1000
MAX_SHARE = 0.001
RAREST = 8
SHORTEST = 8  # words of the least length class
OVERSAMPLE = 56
PASSES = 2
COSINE = 0.3
VERBATIM = 0.75
PARAPHRASE = 0.6
_FILTER = 1 << 20


class Benchmark:
    """Pieces of a group of items as word numbers, and the table from word hashes to numbers."""

    def __init__(self, items: list[tuple[int, str]]):
        data, offsets = texts_as_bytes(pa.array([text for _, text in items], pa.string()))
        data = lower_bytes(data)
        starts, ends, before = words(data, offsets)
        hashes = span_hashes(data, starts, ends)
        self.hashes = np.unique(hashes)
        numbers = np.searchsorted(self.hashes, hashes).astype(np.int32)
        stops = np.array([data[e - 1] in b".!?" for e in ends], bool)
        self.items, self.pieces, self.answers = [], [], []
        for k, (item_id, _) in enumerate(items):
            own, stop = numbers[before[k] : before[k + 1]], stops[before[k] : before[k + 1]]
            last = np.flatnonzero(stop[:-1])
            answer = own[last[-1] + 1 :] if len(last) else own
            count = -(-len(own) // PIECE)
            cuts = [len(own) * k // count for k in range(count + 1)] if count else []  # pieces of even length
            for low, high in zip(cuts, cuts[1:]):
                part = own[low:high]
                self.items.append(item_id)
                self.pieces.append(part)
                self.answers.append(answer if high == len(own) else part)
        self.half = max((len(p) for p in self.pieces), default=1)
        spans = [self.half]
        while -(-spans[-1] // 2) >= SHORTEST:
            spans.append(-(-spans[-1] // 2))
        own = np.array([min((s for s in spans if s >= len(p)), default=self.half) for p in self.pieces], np.int64)
        self.classes = [(int(span), np.flatnonzero(own == span)) for span in np.unique(own)]  # (span, pieces)
        self.filter = np.zeros(_FILTER, bool)
        self.filter[(self.hashes & np.uint64(_FILTER - 1)).astype(np.int64)] = True
        self.column = np.zeros(0, np.int32)  # word number -> informative column or -1
        self.weight = np.zeros(0, np.float32)  # by column

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word number, or -1 for words outside the benchmark."""
        out = np.full(len(hashes), -1, np.int32)
        maybe = np.flatnonzero(self.filter[(hashes & np.uint64(_FILTER - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        hit = self.hashes[place] == hashes[maybe]
        out[maybe[hit]] = place[hit]
        return out

    def halves(self, column: pa.Array):
        """Per slice: (first row, word numbers, row of every half, first word of every half, its length)."""
        for low, _, data, offsets in slices(column):
            data = lower_bytes(data)
            starts, ends, before = words(data, offsets)
            numbers = self.numbers(span_hashes(data, starts, ends))
            count = np.diff(before)
            per_row = -(-count // self.half)
            row = np.repeat(np.arange(len(count)), per_row)
            number = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
            first = before[:-1][row] + number * self.half
            yield low, numbers, row, first, np.minimum(self.half, before[1:][row] - first)

    def choose(self, frequency: np.ndarray, total: int) -> None:
        """Informative words and their weights."""
        keep = frequency <= max(MAX_SHARE * total, 1)
        for piece in self.pieces:
            own = np.unique(piece)
            keep[own[np.argsort(frequency[own], kind="stable")[:RAREST]]] = True
        self.column = np.where(keep, np.cumsum(keep) - 1, -1).astype(np.int32)
        self.weight = (1 / np.sqrt(np.maximum(frequency[keep], 1))).astype(np.float32)
        self.needed = min(2, min((len(np.unique(p[keep[p]])) for p in self.pieces), default=1))

    def sparse(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(row, informative column) of the distinct informative words of word sequences."""
        size = np.array([len(s) for s in sequences], np.int64)
        flat = np.concatenate(sequences) if len(sequences) else np.zeros(0, np.int32)
        row = np.repeat(np.arange(len(sequences)), size)
        found = np.where(flat >= 0, self.column[flat], -1)
        code = np.unique(row[found >= 0] * len(self.weight) + found[found >= 0])
        return code // max(1, len(self.weight)), code % max(1, len(self.weight))

    def windows(self, sequences: list[np.ndarray], own: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows of two spans that begin within the first ``own`` words of a passage and hold enough informative words:
        (passage, first word) of each window, and (window, informative column) of its distinct ones, ascending."""
        size = np.array([len(s) for s in sequences], np.int64)
        flat = np.concatenate(sequences)
        found = np.where(flat >= 0, self.column[flat], -1)
        at = np.flatnonzero(found >= 0)
        passage = np.repeat(np.arange(len(sequences)), size)[at]
        number = (at - (np.cumsum(size) - size)[passage]) // span
        passage, column = np.tile(passage, 2), np.tile(found[at], 2).astype(np.int64)
        number = np.concatenate([number, number - 1])  # a word stands in the window of its span and in the one before
        keep = (number >= 0) & (number * span < own[passage])
        if span >= self.half:
            keep &= number == 0  # the passage itself
        most = int(number.max(initial=0)) + 1
        code = np.unique((passage[keep] * most + number[keep]) * len(self.weight) + column[keep])
        window, column = code // max(1, len(self.weight)), code % max(1, len(self.weight))
        window, row, count = np.unique(window, return_inverse=True, return_counts=True)
        enough = count >= self.needed
        keep = enough[row]
        row = (np.cumsum(enough) - 1)[row[keep]]
        return window[enough] // most, window[enough] % most * span, row, column[keep]

    def project(self, row: np.ndarray, column: np.ndarray, rows: int, basis: np.ndarray) -> np.ndarray:
        """A basis, for the rows given sparsely (ascending)."""
        out = np.zeros((rows, basis.shape[1]), np.float32)
        if len(row):
            at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            out[row[at]] = np.add.reduceat(basis[column] * self.weight[column][:, None], at, axis=0)
        return out


def frequencies(docs: DataFrame, benchmark: Benchmark) -> tuple[np.ndarray, int]:
    """Number of half passages that hold each benchmark word, and of all half passages."""

    def run(batches):
        count, total = np.zeros(len(benchmark.hashes), np.int64), 0
        for batch in batches:
            for _, numbers, row, first, _ in benchmark.halves(batch.column(1)):
                total += len(row)
                at = np.flatnonzero(numbers >= 0)
                half = np.searchsorted(first, at, "right") - 1
                code = np.unique(half * len(count) + numbers[at])
                count += np.bincount(code % len(count), minlength=len(count))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(count[some], total), pa.int64())], names=["word", "n"])

    out, total = np.zeros(len(benchmark.hashes), np.int64), 0
    for r in docs.mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():  # a row per benchmark word
        if r["word"] < 0:
            total = r["n"]
        else:
            out[r["word"]] = r["n"]
    return out, total


def passages(docs: DataFrame, benchmark: Benchmark) -> DataFrame:
    """doc_id, start (word), sequence (word numbers, -1 for others) of the passages that can be near an item, and own: the
    number of its first words that no later passage begins with (all of them in a text's last passage)."""

    def run(batches):
        for batch in batches:
            for low, numbers, row, first, length in benchmark.halves(batch.column(1)):
                if not len(row):
                    continue
                found = np.where(numbers >= 0, benchmark.column[numbers], -1)
                at = np.flatnonzero(found >= 0)
                per_half = np.bincount(np.searchsorted(first, at, "right") - 1, minlength=len(row))
                follows = np.append(row[1:] == row[:-1], False)
                both = per_half + np.where(follows, np.append(per_half[1:], 0), 0)
                last = ~follows & (np.append(False, row[1:] == row[:-1]))  # the window before covers a last half
                chosen = np.flatnonzero((both >= benchmark.needed) & ~last)
                size = length + np.where(follows, np.append(length[1:], 0), 0)
                own = np.where(follows & np.append(follows[1:], False), length, size)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(low + row[chosen])), pa.array(first[chosen] - first[np.searchsorted(row, row[chosen])], pa.int64()),
                        pa.array([numbers[first[k] : first[k] + size[k]].tobytes() for k in chosen.tolist()], pa.binary()),
                        pa.array(own[chosen], pa.int32()),
                    ],
                    names=["doc_id", "start", "sequence", "own"],
                )

    return docs.mapInArrow(run, "doc_id long, start long, sequence binary, own int")


def _sequences(batch) -> list[np.ndarray]:
    return [np.frombuffer(s, np.int32) for s in batch.column("sequence").to_pylist()]


def gram_times(table: DataFrame, benchmark: Benchmark, basis: np.ndarray, strip: int = 64) -> np.ndarray:
    """A'A basis: a pass over the passages. Tasks add up strips of words; strips are summed apart and collected."""
    width = basis.shape[1]

    def run(batches):
        total = np.zeros(basis.shape, np.float32)
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                row, column = benchmark.sparse(_sequences(part))
                x = benchmark.project(row, column, part.num_rows, basis)
                order = np.argsort(column, kind="stable")
                row, column = row[order], column[order]
                if len(row):
                    at = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
                    total[column[at]] += np.add.reduceat(x[row], at, axis=0) * benchmark.weight[column[at]][:, None]
        pieces = [total[k : k + strip].tobytes() for k in range(0, len(total), strip)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())], names=["strip", "data"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                value = np.frombuffer(data, np.float32)
                sums[number] = sums[number] + value if number in sums else value
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["strip", "data"])

    out = np.zeros(basis.shape, np.float32)
    parts = table.mapInArrow(run, "strip int, data binary").repartition(partitions(table.sparkSession), "strip").mapInArrow(add, "strip int, data binary")
    for r in parts.collect():  # benchmark words x rank numbers
        piece = np.frombuffer(r["data"], np.float32).reshape(-1, width)
        out[r["strip"] * strip : r["strip"] * strip + len(piece)] = piece
    return out


def latent_basis(table: DataFrame, benchmark: Benchmark, passes: int = PASSES) -> np.ndarray:
    """Leading right singular vectors of the passage matrix, the items themselves included."""
    words_, rank = len(benchmark.weight), min(len(benchmark.weight), len(benchmark.pieces) + OVERSAMPLE)
    row, column = benchmark.sparse(benchmark.pieces)

    def times(basis):
        own = benchmark.project(row, column, len(benchmark.pieces), basis)
        total = gram_times(table, benchmark, basis)
        np.add.at(total, column, own[row] * benchmark.weight[column][:, None])
        return total

    start = np.random.default_rng(7).standard_normal((words_, rank)).astype(np.float32)
    basis = np.linalg.qr(times(start))[0].astype(np.float32)
    for _ in range(passes - 1):
        basis = np.linalg.qr(times(basis))[0].astype(np.float32)
    values, vectors = np.linalg.eigh(basis.T @ times(basis))
    return (basis @ vectors[:, ::-1]).astype(np.float32)


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, rows of the table as bits of one integer."""
    places: dict[int, int] = {}
    for k, word in enumerate(b):
        places[word] = places.get(word, 0) | 1 << k
    full = (1 << len(b)) - 1
    row = full
    for word in a:
        match = row & places.get(word, 0)
        row = ((row + match) | (row - match)) & full
    return len(b) - row.bit_count()


def matches(table: DataFrame, benchmark: Benchmark, basis: np.ndarray) -> DataFrame:
    """doc_id, item_id, start, cosine, common (share of the piece's words in order), answer (all of its words found)."""
    row, column = benchmark.sparse(benchmark.pieces)
    latent = benchmark.project(row, column, len(benchmark.pieces), basis)
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    answers = [set(a[benchmark.column[a] >= 0].tolist()) or set(a.tolist()) for a in benchmark.answers]

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            starts = batch.column("start").to_pylist()
            out = []
            for k in range(0, batch.num_rows, 4096):
                sequences = _sequences(batch.slice(k, 4096))
                own = batch.column("own").slice(k, 4096).to_numpy(zero_copy_only=False)
                for span, pieces in benchmark.classes:
                    passage, first, row, column = benchmark.windows(sequences, own, span)
                    x = benchmark.project(row, column, len(passage), basis)
                    cosine = (x @ latent[pieces].T) / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                    for window, place in zip(*(c.tolist() for c in np.nonzero(cosine >= COSINE)), strict=True):
                        piece, here, begin = pieces[place], passage[window], int(first[window])
                        sequence, wanted = sequences[here][begin : begin + 2 * span], benchmark.pieces[piece]
                        mine = sequence[sequence >= 0].tolist()
                        common = common_subsequence(mine, wanted.tolist()) / len(wanted)
                        if common >= PARAPHRASE:
                            answer = answers[piece] <= set(mine)
                            if answer or common >= VERBATIM:
                                out.append((ids[k + here], benchmark.items[piece], starts[k + here] + begin, float(cosine[window, place]), common, answer))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "start", "cosine", "common", "answer"])

    return table.mapInArrow(run, "doc_id long, item_id long, start long, cosine double, common double, answer boolean")


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id with the best passage's start, cosine, common share and answer check, one row per document and item."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text IS NOT NULL AND trim(text) <> ''")
    groups = -(-asked.count() // ITEMS)
    found = []
    for number in range(groups):
        part = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == number)
        benchmark = Benchmark([(r["item_id"], r["text"]) for r in part.collect()])  # about ITEMS rows
        if not benchmark.pieces:
            continue
        benchmark.choose(*frequencies(rows, benchmark))
        table = written(passages(rows, benchmark), "passages")
        found.append(matches(table, benchmark, latent_basis(table, benchmark)))
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start long, cosine double, common double, answer boolean")
    best = F.max(F.struct("common", "cosine", F.col("start"), "answer")).alias("best")
    return reduce(DataFrame.unionAll, found).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.start", "best.cosine", "best.common", "best.answer")


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents without a benchmark passage, with all their columns. Rows are told apart by a hash of id and text."""
    row = F.xxhash64("doc_id", F.col("text").cast("string"))
    bad = leaks(docs.select(row.alias("doc_id"), "text"), items).select(F.col("doc_id").alias("leaked_row")).distinct()
    return docs.join(bad, F.xxhash64(docs["doc_id"], docs["text"].cast("string")) == bad["leaked_row"], "left_anti").select(*docs.columns)
