"""N-gram Jaccard self-join by chosen paths.

Texts become sets of distinct five-word shingles (lower case of ASCII and Latin-1, words between ASCII white space); texts
with the same words are one class from the start. Every set is embedded in ``COORDINATES`` minimum values.

* Chosen paths. A run starts with one node. Every node samples coordinates with probability 1 / (similarity *
  COORDINATES) and at least one; a set moves into the child named by its value there. Nodes of at most
  ``SMALL_NODE`` sets are compared by brute force on the embedded values, with a bound well below the similarity
  asked for. A larger one is dealt into chunks of about that size, compared alike; there a set that is ``SETTLED``
  near one that goes on stays behind with an edge to it, and all others are split again, so near copies leave at
  the first level and texts that share no more than a passage part at the next. Nodes that are still large after
  ``DEPTH`` splits agree in so many coordinates that they are kept together. Nothing is dropped. Pairs are never
  written: a chunk returns, for each of its sets, one edge of a spanning forest.
* Runs repeat in rounds. The ``SAMPLE`` sets of smallest hash (all, if fewer) are compared with every set by their
  embedded values; the share of their partners of the similarity asked for that stand in their cluster, as a
  mean over the sampled sets that have any, is the recall. Rounds go on until it reaches ``RECALL``; if
  ``MAX_ROUNDS`` do not, the join raises.
* Exact check. Edges are contracted to clusters; the whole shingle sets of a cluster's texts are compared exactly,
  in pairs of blocks of at most ``BLOCK`` sets, so a cluster of any size is spread over tasks. Each block returns
  per set the number of documents it is linked to and an edge to its block's smallest linked set.

Result per document: class_id (smallest doc_id of its connected group) and n_links (other documents with a
similarity of at least the bound, copies included).

Cases: texts of less than five words have one shingle of all their words; null, empty and blank texts form one class
without further links; repeated rows count as copies; a null doc_id takes part but cannot name a class (a class
of such rows alone has a null class_id); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from colprep.llm.common import lower_bytes, mixed, partitions, shingles, slices, span_hashes, words, written

SIMILARITY = 0.8
SHINGLE = 5
COORDINATES = 128
RUNS = 8  # of a round
RECALL = 0.99
SAMPLE = 2048
MAX_ROUNDS = 8
SMALL_NODE = 1024
DEPTH = 6
SETTLED = 0.75  # what is 0.8 alike such a set is 0.55 alike, by the metric, the one that it settles with
CANDIDATE = 0.5  # share of equal coordinates from which two sets are checked exactly
HEAD, HEAD_EQUAL = 32, 8  # pairs with fewer equal among their first coordinates are below CANDIDATE
MAX_STARS = 50
BLOCK = 512
CHUNK = 1 << 18  # edges that a task contracts together
TASKS = 4  # a core, for splitting nodes and contracting edges
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SHARE = np.uint64(int(2**64 / (SIMILARITY * COORDINATES)))


def shingle_sets(column: pa.Array, size: int = SHINGLE):
    """Per slice: (first row, word sequence digests, number of words, shingles, offsets)."""
    for low, _, data, offsets in slices(column):
        lowered = lower_bytes(data)
        starts, ends, before = words(lowered, offsets)
        hashes = span_hashes(lowered, starts, ends)
        values, at = shingles(hashes, before, size)
        digests = [hashlib.blake2b(hashes[before[k] : before[k + 1]].tobytes(), digest_size=16).digest() for k in range(len(before) - 1)]
        yield low, digests, values, at


def _fill_order() -> np.ndarray:
    """For every bin the other bins in an order of its own."""
    lots = mixed(np.arange(1, COORDINATES * COORDINATES + 1, dtype=np.uint64) * _ODD).reshape(COORDINATES, COORDINATES)
    return np.argsort(lots, axis=1)


_FILL = _fill_order()
_FOLD = mixed(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).astype(np.uint32).reshape(2, COORDINATES) | np.uint32(1)


def embed(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, COORDINATES) minimum values: one permutation, cut into bins.

    An empty bin takes the value of the first filled bin in its own order of bins. Two sets agree there if that bin
    of their union does, so coordinates of short sets are drawn one by one, and sets of any two sizes compare.
    """
    rows = len(at) - 1
    row = np.repeat(np.arange(rows), np.diff(at))
    place = row * COORDINATES + (values >> np.uint64(57)).astype(np.int64)
    first = np.ones(len(place), bool)
    first[1:] = place[1:] != place[:-1]
    out = np.zeros(rows * COORDINATES, np.uint32)
    filled = np.zeros(rows * COORDINATES, bool)
    out[place[first]] = mixed(values[first]).astype(np.uint32)
    filled[place[first]] = True
    empty = np.flatnonzero(~filled & np.repeat(np.diff(at) > 0, COORDINATES))
    for step in range(COORDINATES):
        if not len(empty):
            break
        source = empty // COORDINATES * COORDINATES + _FILL[empty % COORDINATES, step]
        known = filled[source]
        out[empty[known]] = out[source[known]]
        empty = empty[~known]
    return out.reshape(rows, COORDINATES)


def low_bytes(sketch: np.ndarray) -> np.ndarray:
    """One byte a coordinate. Every coordinate has a hash of its own: a short set repeats its few values, and two
    values that share a byte in one coordinate must not do so in all."""
    return (((sketch ^ _FOLD[0]) * _FOLD[1]) >> np.uint32(24)).astype(np.uint8)


def sketch_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (digest of the word sequence), n (shingles), sketch."""

    def run(batches):
        for batch in batches:
            for low, digests, values, at in shingle_sets(batch.column(1)):
                sketch = embed(values, at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, len(digests)), pa.array(digests, pa.binary()), pa.array(np.diff(at), pa.int64()), pa.array([s.tobytes() for s in sketch], pa.binary())],
                    names=["doc_id", "key", "n", "sketch"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, key binary, n long, sketch binary")


def set_table(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """key (digest of the word sequence), set (shingles) of every row, once per batch."""

    def run(batches):
        for batch in batches:
            for _, digests, values, at in shingle_sets(batch.column(0)):
                once = list({d: k for k, d in enumerate(digests)}.values())
                yield pa.RecordBatch.from_arrays([pa.array([digests[k] for k in once], pa.binary()), pa.array([values[at[k] : at[k + 1]].tobytes() for k in once], pa.binary())], names=["key", "set"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "key binary, set binary")


def _lots(node: np.ndarray) -> np.ndarray:
    """(nodes, COORDINATES) draws; a node samples the coordinates whose draw is below ``_SHARE``."""
    return mixed(node[:, None] * _ODD + np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def root_children(root: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) where all sets stand in one node, so its coordinates are drawn once."""
    lots = _lots(root)[0]
    chosen = np.union1d(np.flatnonzero(lots < _SHARE), lots.argmin())
    child = mixed(lots[chosen] ^ mixed(sketch[:, chosen].astype(np.uint64) + root))
    return np.repeat(np.arange(len(sketch)), len(chosen)), child.ravel()


def children(node: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) for every coordinate that a row's node samples."""
    lots = _lots(node)
    chosen = lots < _SHARE
    chosen[np.arange(len(node)), lots.argmin(1)] = True
    row, coordinate = np.nonzero(chosen)
    return row, mixed(lots[row, coordinate] ^ mixed(sketch[row, coordinate].astype(np.uint64) + node[row]))


def _paths(rows: DataFrame, runs: list[int] | None = None) -> DataFrame:
    """Children (key, node, low: one byte a coordinate) of sets (key, sketch) at the root of some runs, or of their column node."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, COORDINATES)
            low = pa.FixedSizeBinaryArray.from_buffers(pa.binary(COORDINATES), len(sketch), [None, pa.py_buffer(low_bytes(sketch).tobytes())]).cast(pa.binary())
            for number in [None] if runs is None else runs:
                if number is None:
                    row, child = children(batch.column("node").to_numpy(zero_copy_only=False).astype(np.uint64), sketch)
                else:
                    row, child = root_children(mixed(np.array([number + 1], np.uint64)), sketch)
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row)), pa.array(child.astype(np.int64)), low.take(pa.array(row))], names=["key", "node", "low"])

    return rows.mapInArrow(run, "key binary, node long, low binary")


def _spanning(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row that every row is connected to."""
    label = np.arange(count)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _groups(batches, key: str):
    """Record batches cut at the borders of runs of equal keys, whole runs only."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(key).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(column[1:] != column[:-1])
        if held and held[-1].column(key)[-1].as_py() != column[0]:
            yield pa.Table.from_batches(held)
            held = []
        if len(edges):
            last = int(edges[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def equal_coordinates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal bytes of each pair of rows; a row holds a multiple of eight."""
    return np.bitwise_count((a == b).view(np.uint64)).sum(1)


def near_pairs(low: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, equal coordinates) of the pairs within the chunks between cuts that reach ``CANDIDATE``."""
    end = np.repeat(cuts[1:], np.diff(cuts))
    head = np.ascontiguousarray(low[:, :HEAD])
    lefts, rights, equals = [], [], []
    left, shift = np.arange(len(low)), 0
    while True:  # pairs at one distance at a time
        shift += 1
        left = left[left + shift < end[left]]
        if not len(left):
            break
        for k in range(0, len(left), 8192):
            part = left[k : k + 8192]
            part = part[equal_coordinates(head[part], head[part + shift]) >= HEAD_EQUAL]
            equal = equal_coordinates(low[part], low[part + shift])
            near = equal >= CANDIDATE * COORDINATES
            lefts.append(part[near])
            rights.append(part[near] + shift)
            equals.append(equal[near])
    if not lefts:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(lefts), np.concatenate(rights), np.concatenate(equals)


def settled_rows(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows that stay behind: those with an edge (a, b), a < b, from a row that does not."""
    out = np.zeros(count, bool)
    order = np.argsort(b, kind="stable")
    a, b = a[order], b[order]
    later, first = np.unique(b, return_index=True)
    cuts = [*first.tolist(), len(b)]  # without edges one cut and no row
    for row, low, high in zip(later.tolist(), cuts[:-1], cuts[1:], strict=True):
        out[row] = not out[a[low:high]].all()
    return out


def _compare(rows: DataFrame, large: DataFrame | None) -> DataFrame:
    """Spanning edges (a, b) of the pairs in chunks of nodes that may be similar; (a, node) of the sets that go on from large nodes."""

    def run(batches):
        names = ["a", "b", "node"]
        for table in _groups(batches, "chunk"):
            chunk = table.column("chunk").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(chunk[1:] != chunk[:-1]) + 1, [len(chunk)]])
            keys = table.column("key").combine_chunks()
            low = np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            big = table.column("big").to_numpy()
            a, b, equal = near_pairs(low, cuts)
            label = _spanning(len(chunk), a, b)
            told = np.flatnonzero(label != np.arange(len(chunk)))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(told)), keys.take(pa.array(label[told])), pa.nulls(len(told), pa.int64())], names=names)
            if big.any():
                near = big[a] & (equal >= SETTLED * COORDINATES)
                on = np.flatnonzero(big & ~settled_rows(len(chunk), a[near], b[near]))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(on)), pa.nulls(len(on), pa.binary()), pa.array(table.column("node").to_numpy()[on])], names=names)

    if large is None:
        dealt = rows.select("node", "key", "low", F.col("node").alias("chunk"), F.lit(False).alias("big"))
    else:
        number = F.pmod(F.xxhash64("key", "node"), F.ceil(F.col("count") / SMALL_NODE))
        big = F.col("count").isNotNull()
        dealt = rows.join(large, "node", "left").select("node", "key", "low", F.when(big, F.xxhash64("node", number)).otherwise(F.col("node")).alias("chunk"), big.alias("big"))
    return dealt.repartition(partitions(rows.sparkSession), "chunk").sortWithinPartitions("chunk", "key").mapInArrow(run, "a binary, b binary, node long")


def run_edges(sets: DataFrame, runs: list[int]) -> DataFrame:
    """Spanning edges found by some runs."""
    found, rows = [], _paths(sets, runs)
    for depth in range(1, DEPTH + 1):
        large = written(rows.groupBy("node").count().where(F.col("count") > SMALL_NODE), "large")
        last = large.isEmpty()
        step = written(_compare(rows, None if last else large), "step")
        found.append(step.where("b IS NOT NULL").select("a", "b"))
        if last:
            break
        on = step.where("node IS NOT NULL").select(F.col("a").alias("key"), "node")
        if depth == DEPTH:
            together = on.groupBy("node").agg(F.min("key").alias("b"))
            found.append(on.join(together, "node").where("key != b").select(F.col("key").alias("a"), "b"))
            break
        rows = written(_paths(on.join(sets, "key").select("key", "node", "sketch")), "paths")
    return reduce(DataFrame.unionAll, found)


def _contracted(edges: DataFrame) -> DataFrame:
    """The same components by fewer edges (a, b): each task replaces up to ``CHUNK`` edges at a time by a spanning star."""

    def star(held):
        both = pa.chunked_array([b.column(c) for c in ("a", "b") for b in held]).combine_chunks().dictionary_encode()
        at = both.indices.to_numpy()
        label = _spanning(len(both.dictionary), at[: len(at) // 2], at[len(at) // 2 :])
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([both.dictionary.take(pa.array(moved)), both.dictionary.take(pa.array(label[moved]))], names=["a", "b"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                yield star(held)
                held, rows = [], 0
        if rows:
            yield star(held)

    return edges.select("a", "b").coalesce(TASKS * edges.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(key, root) of every key in an edge, root the smallest key of its component: large-star and small-star rounds."""
    current = written(_contracted(edges).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v"), "components")
    for _ in range(MAX_STARS):
        both = current.unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        current = written(small.where("u != v").distinct(), "components")
        # done when every key has one edge down, to a key without one
        ends = current.select(F.col("u").alias("key"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(current.select(F.col("v").alias("key"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        if ends.groupBy("key").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR (down = 1 AND up = 1)").isEmpty():
            break
    else:
        raise RuntimeError(f"components are not done after {MAX_STARS} rounds")
    roots = current.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct()
    return written(current.select(F.col("u").alias("key"), F.col("v").alias("root")).unionAll(roots), "clusters")


def recall_of(sets: DataFrame, found: DataFrame, similarity: float = SIMILARITY, sample: int = SAMPLE) -> float:
    """Mean share, over the sampled sets with partners of the similarity, of those that stand in the set's cluster."""
    rooted = sets.join(found, "key", "left").select(F.xxhash64("key").alias("name"), F.when(F.col("root").isNull(), 0).otherwise(F.xxhash64("root")).alias("root"), "sketch")
    # only hashes that can be among the smallest reach the sort, so its size does not grow with the number of tasks
    bound = int(-(2**63) + 2**64 * min(1.0, 2 * sample / max(1, sets.count()))) - 1
    asked = rooted.where(F.col("name") <= bound).orderBy("name").limit(sample).toArrow()
    names, roots = asked.column("name").to_numpy(), asked.column("root").to_numpy()
    want = low_bytes(np.frombuffer(b"".join(asked.column("sketch").to_pylist()), np.uint32).reshape(-1, COORDINATES))
    enough = similarity * COORDINATES

    def run(batches):
        links, hits = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, held = batch.column("name").to_numpy(zero_copy_only=False), batch.column("root").to_numpy(zero_copy_only=False)
            low = low_bytes(np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, COORDINATES))
            head = np.ascontiguousarray(low[:, :HEAD])
            for k in range(len(names)):
                maybe = np.flatnonzero(equal_coordinates(head, want[k : k + 1, :HEAD]) >= HEAD_EQUAL)
                near = maybe[(equal_coordinates(low[maybe], want[k : k + 1]) >= enough) & (keys[maybe] != names[k])]
                links[k] += len(near)
                hits[k] += (held[near] == roots[k]).sum() if roots[k] else 0
        at = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(links[at]), pa.array(hits[at])], names=["asked", "links", "hits"])

    told = rooted.mapInArrow(run, "asked long, links long, hits long").groupBy("asked").agg(F.sum("links").alias("links"), F.sum("hits").alias("hits"))
    return told.agg(F.avg(F.col("hits") / F.col("links"))).first()[0] or float(not told.limit(1).count())


def clusters(sets: DataFrame, recall: float = RECALL) -> DataFrame:
    """(key, root) of the sets that may have a similar one; rounds of runs until the recall is reached."""
    edges, share = None, 0.0
    for number in range(MAX_ROUNDS):
        more = run_edges(sets, list(range(number * RUNS, (number + 1) * RUNS)))
        edges = more if edges is None else edges.unionAll(more)
        found = components(edges)
        share = recall_of(sets, found)
        if share >= recall:
            return found
    raise RuntimeError(f"the join found {share:.3f} of the sampled links in {MAX_ROUNDS} rounds, {recall} were asked for")


def exact_counts(sizes: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of intersection sizes: bit rows over the shingles that occur more than once."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    value, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    shared = count[inverse] > 1
    owner, column = owner[shared], number[inverse[shared]]
    width = int((count > 1).sum())
    out = np.zeros((len(sets), len(sets)), np.int64)
    for low in range(0, width, 1 << 15):  # columns in strips, so the bit rows stay small
        here = (column >= low) & (column < low + (1 << 15))
        bits = np.zeros((len(sets), min(1 << 15, width - low)), bool)
        bits[owner[here], column[here] - low] = True
        packed = np.packbits(bits, axis=1)
        packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)
        for k in range(len(sets)):
            out[k, k:] += np.bitwise_count(packed[k] & packed[k:]).sum(1, dtype=np.int64)
    return out


def _check_blocks(rows: DataFrame, similarity: float) -> DataFrame:
    """rows: task, left, right, block, key, weight, set. Per set and block: linked documents and the smallest linked set."""

    def run(batches):
        for table in _groups(batches, "task"):
            task = table.column("task").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(task[1:] != task[:-1]) + 1, [len(task)]])
            keys, weight = table.column("key").to_pylist(), table.column("weight").to_numpy()
            block, left, right = (table.column(c).to_numpy() for c in ("block", "left", "right"))
            raw = table.column("set").to_pylist()
            names, links, roots = [], [], []
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                sets = [np.frombuffer(x, np.uint64) for x in raw[s:e]]
                sizes = np.array([len(x) for x in sets])
                common = exact_counts(sizes, sets)
                linked = np.triu(common * (1 + similarity) >= similarity * (sizes[:, None] + sizes[None, :]) - 1e-9, 1)
                if left[s] != right[s]:  # pairs within a block belong to that block's own task
                    linked &= block[s:e][:, None] != block[s:e][None, :]
                a, b = np.nonzero(linked)
                label = _spanning(e - s, a, b)
                total = np.bincount(a, weight[s:e][b], e - s) + np.bincount(b, weight[s:e][a], e - s)
                names += keys[s:e]
                links += total.astype(np.int64).tolist()
                roots += [keys[s + k] for k in label.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(links, pa.int64()), pa.array(roots, pa.binary())], names=["key", "links", "root"])

    return rows.repartition(partitions(rows.sparkSession), "task").sortWithinPartitions("task", "key").mapInArrow(run, "key binary, links long, root binary")


def _rooted(docs: DataFrame, similarity: float, recall: float, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows, and per class of equal texts: key, first (smallest doc_id), n_links, root of its group."""
    sketches = written(sketch_table(docs, id_col, text_col), "sketches")
    classes = written(sketches.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("weight"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    sets = classes.where("n > 0").select("key", "sketch")
    found = clusters(sets, recall)
    # Whole sets of the texts in clusters, one text per class.
    sizes = found.groupBy("root").agg(F.count("*").alias("size"))
    member = found.join(sizes, "root").join(classes.select("key", "weight"), "key")
    whole = set_table(docs, text_col).join(member, "key").dropDuplicates(["key"]).select("key", "root", "size", "weight", "set")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    whole = written(whole.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")), "sets")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = whole.withColumn("other", other).withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")})
    dealt = dealt.select(F.xxhash64("root", "left", "right").alias("task"), "left", "right", "block", "key", "weight", "set")
    checked = written(_check_blocks(dealt, similarity), "checked")
    links = checked.groupBy("key").agg(F.sum("links").alias("links"))
    split = whole.where("blocks > 1").select("key")
    root = checked.groupBy("key").agg(F.min("root").alias("root"))
    if not split.isEmpty():  # only clusters of several blocks still need their edges put together
        apart = checked.join(split.distinct(), "key", "left_semi").select(F.col("key").alias("a"), F.col("root").alias("b"))
        merged = components(apart).select("key", F.col("root").alias("whole"))
        root = root.join(merged, "key", "left").select("key", F.coalesce("whole", "root").alias("root"))
    rooted = classes.select("key", "first", "weight").join(root, "key", "left").join(links, "key", "left")
    rooted = written(rooted.select("key", "first", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "key").alias("root")), "rooted")
    return sketches, rooted


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, n_links for every row of docs."""
    sketches, rooted = _rooted(docs, similarity, recall, id_col, text_col)
    # groups of one class need no second look
    grouped = rooted.where("n_links > 0").groupBy("root").agg(F.min("first").alias("class_id"))
    named = rooted.join(grouped, "root", "left").select("key", F.coalesce("class_id", "first").alias("class_id"), "n_links")
    return sketches.select("doc_id", "key").join(named, "key").select("doc_id", "class_id", "n_links")


def drop_similar(docs: DataFrame) -> DataFrame:
    """One row of each group stays: of the class with the smallest doc_id, that with this id; all columns stay.

    A class whose ids are all null comes last in its group, by digest, and one of its rows stays if it is alone.
    Rows are told apart by the digest of their words, so different texts that share a doc_id are no copies.
    """
    _, rooted = _rooted(docs, SIMILARITY, RECALL)
    chosen = rooted.groupBy("root").agg(F.min(F.struct(F.col("first").isNull(), "first", "key")).alias("c")).select(F.col("c.key").alias("kept_key"), F.col("c.first").alias("kept_id"))
    digest = "digest"
    while digest in docs.columns:
        digest += "_"

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            digests = [d for _, found, _, _ in shingle_sets(batch.column(at)) for d in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], names=[*batch.schema.names, digest])

    keyed = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(digest, BinaryType())]))
    kept = keyed.join(chosen, (keyed[digest] == chosen["kept_key"]) & keyed["doc_id"].cast("long").eqNullSafe(chosen["kept_id"]))
    return kept.dropDuplicates([digest]).select(*docs.columns)
