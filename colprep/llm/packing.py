"""Best-fit packing of token pieces into sequences of a fixed length.

Only the histogram of piece lengths (at most ``capacity`` rows, whatever the corpus) reaches the driver. A
configuration is a multiset of lengths that fit one sequence. The configuration linear program

    minimise the number of sequences  so that every length is covered as often as it occurs

is solved by multiplicative weights: every length carries a weight (dual value); an unbounded knapsack over the
capacity prices configurations; those near the best are used for a step, and the weights of the lengths that they
cover shrink. It ends when every length is covered and the solution is within ``GAP`` of a dual bound. The solution
is rounded to whole sequences; the lengths that rounding leaves over are solved again, until rounding places nothing
more. The few pieces left then go best-fit decreasing into gaps and new sequences, counting equal bins together.

The plan is a short table of (length, ranks, sequence, place). Pieces are ranked within their length by a
two-step count over hash buckets of the rows, so a length that holds a third of all pieces is no single task.

Cases: a null or empty text has one piece, the end id alone; repeated rows are packed as often as they occur; a null doc_id
stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colprep.llm.common import partitions, slices, written
from colprep.llm.tokens import encoder, vocabulary_path

CAPACITY = 2048
END_ID = 0
BUCKET_ROWS = 50_000
RATE = 1.0  # how fast the weight of a covered length falls
NEAR = 0.2  # configurations this near the best one are used too, at first
GAP = 0.1  # between the fractional solution and its lower bound
ROUNDS = 48  # knapsacks a program, at most
PASSES = 32  # programs, at most; each holds what rounding the one before left over
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids of every text followed by ``end_id``."""

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            keys = batch.column(0)
            for low, high, data, offsets in slices(batch.column(1)):
                ids, at = coder.encode(data, offsets)
                at = at.tolist()
                rows, pieces, starts, lengths, sums = [], [], [], [], []
                for row in range(high - low):
                    text_ids = np.append(ids[at[row] : at[row + 1]], np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(text_ids), capacity)):
                        part = text_ids[start : start + capacity]
                        rows.append(low + row)
                        pieces.append(piece)
                        starts.append(start)
                        lengths.append(len(part))
                        sums.append(zlib.crc32(part.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


def knapsack(weights: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack over 1..capacity: most weight for every room, and the length taken first there (0: none).

    ``weights[l]`` is the weight of length l."""
    values = np.where(weights[1 : capacity + 1] > 0, weights[1 : capacity + 1], -np.inf)
    behind = np.zeros(capacity + 1)  # most weight by falling room, so that every step reads one slice
    choice = np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        at = capacity - room
        behind[at] = behind[at + 1]
        gain = (behind[at + 1 :] + values[:room])[::-1]  # by falling length
        k = int(gain.argmax())  # of equal configurations, that with the longest pieces
        if gain[k] > behind[at]:
            behind[at], choice[room] = gain[k], room - k
    return behind[::-1].copy(), choice


def filled(choice: list[int], room: int, first: int, wanted: list[int]) -> dict[int, int]:
    """The configuration of most weight for a room, besides a length that it must hold; no length more often than wanted."""
    made = Counter({first: 1})
    while room > 0:
        taken = choice[room]
        if taken and made[taken] < wanted[taken]:
            made[taken] += 1
            room -= taken
        else:
            room -= 1
    return {length: k for length, k in made.items() if k}


def fractional(demand: dict[int, int], capacity: int, gap: float = GAP, rate: float = RATE, near: float = NEAR, rounds: int = ROUNDS) -> list[tuple[dict[int, int], float]]:
    """Configurations and their (fractional) numbers by multiplicative weights; together they cover every length.

    Coverage counts in shares of a length's own demand, so scale does not matter. A knapsack prices, for every
    length, the best configuration that holds it; those within ``near`` of the best of all are used, each as often
    as covers its scarcest length once (the width of the program). A length's weight falls by ``exp(-rate * share)``.
    All weighed demand over the best configuration's weight is a lower bound of the program (a dual solution);
    the numbers used, over the smallest coverage, are a solution. Ends when the two are ``gap`` apart. The rate
    and ``near`` are halved whenever the gap is not reached in ``8 / rate`` coverages, as the error left is of their size.

    The time is bounded: after ``rounds`` knapsacks the lengths covered less than the median are brought up to it by the
    best configurations that hold them, whatever their price, so a solution is whole then too, only farther from the bound.
    """
    lengths = sorted(demand)
    if not lengths:
        return []
    held = np.array(lengths)
    wanted = [demand.get(length, 0) for length in range(capacity + 1)]
    needed = np.array(wanted, float)
    covered = [0.0] * (capacity + 1)
    used: dict[tuple, float] = defaultdict(float)
    bound = spent = since = 0.0

    def use(made: dict[int, int], times: float) -> None:
        nonlocal spent
        used[tuple(sorted(made.items()))] += times
        spent += times
        for x, k in made.items():
            share = times * k / wanted[x]
            covered[x] += share
            weights[x] *= math.exp(-rate * share)

    for spent_rounds in range(1, rounds + 1):
        low = min(covered[length] for length in lengths)
        if low - since > 8 / rate:
            rate, near, since = rate / 2, near / 2, low
        start = np.zeros(capacity + 1)
        start[held] = held / capacity * np.exp(np.maximum(-rate * (np.array(covered)[held] - low), -500))
        best, choice = knapsack(start, capacity)
        most = float(best[capacity])
        bound = max(bound, float(needed @ start) / most)
        if low > 0 and spent / low <= (1 + gap) * bound:
            break
        choice, weights = choice.tolist(), start.tolist()
        last = spent_rounds == rounds
        target = float(np.median([covered[length] for length in lengths])) if last else 0.0
        target = target or 1.0
        priced = held if last else held[start[held] + best[capacity - held] >= (1 - near) * most]
        for length in sorted(priced.tolist(), key=lambda x: (covered[x], -x)):
            if last and covered[length] >= target:
                continue
            made = filled(choice, capacity - length, length, wanted)
            if last:
                use(made, wanted[length] * (target - covered[length]) / made[length])
            elif sum(weights[x] * k for x, k in made.items()) >= (1 - near) * most:  # else its lengths were covered meanwhile
                use(made, min(wanted[x] / k for x, k in made.items()))
    low = min(covered[length] for length in lengths)
    return [(dict(c), x / low) for c, x in used.items()]


def refilled(made: dict[int, int], left: Counter, alive: list[int], capacity: int) -> dict[int, int]:
    """What is left of a configuration's lengths, its room filled with the longest lengths left that fit."""
    out = Counter({length: min(k, left[length]) for length, k in made.items() if left[length] > 0})
    room = capacity - sum(length * k for length, k in out.items())
    at = bisect_right(alive, room) - 1
    while at >= 0:
        length = alive[at]
        k = min(room // length, left[length] - out[length])
        out[length] += k
        room -= k * length
        at = min(at, bisect_right(alive, room)) - 1
    return {length: k for length, k in out.items() if k}


def rounded(solution: list[tuple[dict[int, int], float]], left: Counter, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole numbers of configurations, as the solution's running sum passes whole numbers; what they hold leaves ``left``.

    Where lengths of a configuration are used up, the rest of it is refilled, and kept if it wastes no more room than
    the solution does on average. Equal sequences are made together: every step ends a configuration or a length.
    """
    total = sum(x for _, x in solution)
    waste = sum(x * (capacity - sum(length * k for length, k in made.items())) for made, x in solution) / total if total else 0.0
    alive = sorted(length for length, n in left.items() if n > 0)
    bins, running = [], 0.0
    for made, x in sorted(solution, key=lambda s: (-s[1], sorted(s[0].items()))):
        times = int(running + x) - int(running)
        running += x
        while times > 0 and alive:
            now = made if all(left[length] >= k for length, k in made.items()) else refilled(made, left, alive, capacity)
            if now is not made and capacity - sum(length * k for length, k in now.items()) > waste:
                break
            n = min([times, *(left[length] // k for length, k in now.items())])
            bins.append((now, n))
            times -= n
            for length, k in now.items():
                left[length] -= n * k
                if not left[length]:
                    alive.remove(length)
    return bins


def program(left: Counter, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Solve, round and solve again for what is left, until rounding places nothing more or ``PASSES`` are made."""
    bins = []
    for _ in range(PASSES):
        more = rounded(fractional({k: n for k, n in left.items() if n > 0}, capacity), left, capacity)
        if not more:
            break
        bins += more
    return bins


def pack_lengths(demand: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Whole configurations with their multiplicities; together they hold every length exactly as often as demanded."""
    demand = {int(k): int(v) for k, v in demand.items() if k > 0 and v > 0}
    if any(length > capacity for length in demand):
        raise ValueError("a piece is longer than a sequence")
    left = Counter(demand)
    bins: list[tuple[dict[int, int], int]] = []
    if left[capacity]:
        bins.append(({capacity: 1}, left.pop(capacity)))
    bins += program(left, capacity)
    # Bins by free room, then the remainder best-fit decreasing, whole groups of equal bins at a time.
    rooms: dict[int, list[list]] = defaultdict(list)
    for made, times in bins:
        rooms[capacity - sum(length * k for length, k in made.items())].append([made, times])
    for length in sorted((x for x in left if left[x] > 0), reverse=True):
        n = left[length]
        while n > 0:
            room = min((r for r in rooms if r >= length and rooms[r]), default=None)
            group = rooms[room].pop() if room is not None else [{}, n]
            room = capacity if room is None else room
            fit = room // length
            made, times = group
            full = min(times, n // fit)
            extra = n - full * fit if full < times else 0
            if full:
                more = Counter(made)
                more[length] += fit
                rooms[room - fit * length].append([dict(more), full])
                n -= full * fit
            if extra:
                more = Counter(made)
                more[length] += extra
                rooms[room - extra * length].append([dict(more), 1])
                n -= extra
            if times - full - (1 if extra else 0) > 0 and made:
                rooms[room].append([made, times - full - (1 if extra else 0)])
    return [(made, times) for room in sorted(rooms) for made, times in rooms[room] if made]


def placements(bins: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, items a sequence, first sequence, offset), ascending by rank."""
    table: dict[int, list] = defaultdict(list)
    ranks: Counter = Counter()
    sequence = 0
    for made, times in bins:
        offset = 0
        for length, k in sorted(made.items(), reverse=True):
            table[length].append((ranks[length], k, sequence, offset))
            ranks[length] += k * times
            offset += k * length
        sequence += times
    return {length: np.array(rows, np.int64) for length, rows in table.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (doc_id, piece, start, length, ids_crc32)."""
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity + 1 rows
    table = placements(pack_lengths(histogram, capacity))
    total = sum(histogram.values())
    buckets = max(1, -(-total // bucket_rows))
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy("length", "bucket").count()
    before = counts.withColumn("base", F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    local = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = keyed.withColumn("local", local).join(before.drop("count"), ["length", "bucket"]).withColumn("rank", F.col("local") + F.coalesce("base", F.lit(0)))

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.full(len(length), -1, np.int64), np.zeros(len(length), np.int64)
            for value in np.unique(length):
                at = np.flatnonzero(length == value)
                runs = table[int(value)]
                run = runs[np.searchsorted(runs[:, 0], rank[at], "right") - 1]
                k = rank[at] - run[:, 0]
                sequence[at] = run[:, 2] + k // run[:, 1]
                offset[at] = run[:, 3] + k % run[:, 1] * value
            keep = [batch.column(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.drop("local", "base", "bucket").mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack all documents. The pieces are written once, as both passes need them."""
    pieces = written(token_pieces(docs, path or vocabulary_path(), capacity, end_id, id_col, text_col), "pieces")
    return pack(pieces, capacity)
