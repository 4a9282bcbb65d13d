"""Order-sensitive operators without a single-partition window.

A window without ``partitionBy`` moves every row to one task. Here the total
order is cut into buckets of at most a target number of rows; rows of a bucket
are windowed locally, and what a bucket must know about its predecessors (row
offset, last value seen, running total) is carried over a table with one row
per bucket.

Buckets come from a range index over the whole key. A node is an interval of
keys: every row has the same values in the leading key columns, the same first
bytes in the current one, and an integer code of what follows. One aggregate
counts the rows of aligned code ranges of all open nodes; a range above the
target becomes a node of the next round, with its own finer ranges, further
bytes or next key column. So a hot leading value, or thousands of texts that
begin alike, are split as long as anything in the key tells their rows apart.
Only rows with equal keys stay together. Neighbouring small ranges are merged.

The index has some eight lines for each target number of rows. It is applied by
hash joins, round by round, with no rank or partition number that depends on
task placement: a lost executor recomputes the same buckets.
"""

from __future__ import annotations

import math
import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colprep.functions.exprs import DATETIME_TYPES, FLOAT_TYPES, INTEGER_TYPES, c, is_text, literal_rows
from colprep.functions.quantiles import with_code

ROWS_PER_BUCKET = 2_000_000
BUCKET = "__bucket"
GROUP = 1024  # buckets whose carries are worked out in one task
BROADCAST_ROWS = 1 << 20  # a longer index or summary is left to the planner's own choice of join
ROUND_RANGES = 1 << 20  # ranges of all open nodes of a round, beyond eight for each target number of rows
MOST_RANGES = 1 << 16  # of one node
LOOKUP_SLOTS = 1 << 14  # slots that an array in the plan maps to buckets; more are joined
CHUNK = 7  # bytes of text in a code
_NULL, _NULL_TEXT = -(1 << 63), -1


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table whose row count is known to be small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _coded(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Add ``__k<j>``: a long of the same order for fixed-width keys, the bytes of texts. NULL comes first, NaN last."""
    for j, name in enumerate(order_by):
        dtype, col, out = df.schema[name].dataType, c(name), f"__k{j}"
        if is_text(dtype):
            df = df.withColumn(out, F.encode(col.cast("string"), "UTF-8"))
            continue
        if isinstance(dtype, (*FLOAT_TYPES, T.DecimalType)):
            df = with_code(df.withColumn("__x", col.cast("double")), "__x", out).drop("__x")
            code = F.col(out)
        elif isinstance(dtype, T.TimestampNTZType):
            code = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01'"), col)
        elif isinstance(dtype, T.TimestampType):
            code = F.unix_micros(col)
        elif isinstance(dtype, T.DateType):
            code = F.unix_date(col).cast("long")
        elif isinstance(dtype, T.BooleanType):
            code = col.cast("int").cast("long")
        else:
            code = col.cast("long")
        df = df.withColumn(out, F.coalesce(code, F.lit(_NULL)))
    return df


def _chunk_code(text: bytes | None, offset: int) -> int:
    """The next bytes, and behind them how many there are: a text comes before the same one with zero bytes added."""
    if text is None:
        return _NULL_TEXT
    rest = text[offset : offset + CHUNK]
    return int.from_bytes(rest.ljust(CHUNK, b"\0"), "big") * 8 + len(rest)


@dataclass
class _Node:
    """Interval of codes of one key column, from ``offset`` bytes on where it is a text."""

    path: tuple[int, ...]  # slots from the first round on; their order is the order of the keys
    level: int
    lo: int
    hi: int
    rows: int
    offset: int = 0
    shift: int = 0
    slot: int = 0

    def cut(self, ranges: int) -> int:
        while (self.hi >> self.shift) - (self.lo >> self.shift) >= ranges:
            self.shift += 1
        return (self.hi >> self.shift) - (self.lo >> self.shift) + 1


@dataclass
class RangeIndex:
    """Rounds of nodes, and the bucket of every range that was not split."""

    order_by: list[str]
    texts: list[bool]
    rounds: list[list[_Node]] = field(default_factory=list)
    leaves: list[tuple[int, int]] = field(default_factory=list)  # (slot, bucket)
    buckets: int = 1
    slots: int = 0

    def _code(self, nodes: list[_Node]) -> Column:
        """Code of a row in its node; only the columns that the nodes use are looked at."""
        out = None
        for level in sorted({n.level for n in nodes}):
            key = F.col(f"__k{level}")
            if self.texts[level]:
                chunk = F.rpad(F.hex(F.substring(key, F.col("__offset") + 1, F.lit(CHUNK))), 2 * CHUNK, "0")
                there = F.least(F.greatest(F.octet_length(key) - F.col("__offset"), F.lit(0)), F.lit(CHUNK))
                key = F.coalesce(F.conv(chunk, 16, 10).cast("long") * 8 + there, F.lit(_NULL_TEXT))
            out = F.when(F.col("__level") == level, key) if out is None else out.when(F.col("__level") == level, key)
        return out

    def first_step(self, rows: DataFrame) -> DataFrame:
        """Slots of the first round, whose one node holds all rows."""
        node = self.rounds[0][0]
        level, offset = F.lit(node.level), F.lit(node.offset)
        code = rows.withColumns({"__level": level, "__offset": offset}).withColumn("__code", self._code([node])).drop("__level", "__offset")
        return code.withColumn("__slot", F.shiftright("__code", node.shift) - F.lit(node.lo >> node.shift))

    def step(self, rows: DataFrame, nodes: list[_Node], inner: bool) -> DataFrame:
        """Move rows that stand in a node's slot on to the slot of their range."""
        table = literal_rows(rows.sparkSession, [(n.path[-1], n.level, n.offset, n.shift, n.lo >> n.shift, n.slot) for n in nodes],
                             "__at long, __level int, __offset int, __shift int, __first long, __base long")
        joined = rows.join(small(table, len(nodes)), F.col("__slot") == F.col("__at"), "inner" if inner else "left")
        code = joined.withColumn("__code", self._code(nodes))
        slot = F.col("__base") + F.expr("shiftright(__code, __shift)") - F.col("__first")
        return code.withColumn("__slot", slot if inner else F.coalesce(slot, F.col("__slot"))).drop("__at", "__level", "__offset", "__shift", "__first", "__base")

    def assign(self, df: DataFrame) -> DataFrame:
        if not self.rounds:
            return df.withColumn(BUCKET, F.lit(0).cast("long"))
        rows = self.first_step(_coded(df, self.order_by)).drop("__code")
        for nodes in self.rounds[1:]:
            rows = self.step(rows, nodes, inner=False).drop("__code")
        keep = [c(x) for x in df.columns]
        if self.slots <= LOOKUP_SLOTS:
            bucket_of = [0] * self.slots
            for slot, bucket in self.leaves:
                bucket_of[slot] = bucket
            lookup = F.split(F.lit(",".join(map(str, bucket_of))), ",").cast("array<bigint>")  # folded into one literal
            return rows.select(*keep, F.element_at(lookup, (F.col("__slot") + 1).cast("int")).alias(BUCKET))
        table = literal_rows(df.sparkSession, self.leaves, f"__leaf long, {BUCKET} long")
        return rows.join(small(table, len(self.leaves)), F.col("__slot") == F.col("__leaf")).select(*keep, BUCKET)


def build_index(df: DataFrame, order_by: Sequence[str], buckets: int | None = None) -> RangeIndex:
    """Cut the order into buckets of at most rows / ``buckets`` rows (by default one for each shuffle partition, or for two million rows)."""
    if not order_by:
        raise ValueError("an order-sensitive operator needs order_by, a total order of the rows")
    texts = [is_text(df.schema[x].dataType) for x in order_by]
    index = RangeIndex(list(order_by), texts)
    keys = _coded(df.select(*[c(x) for x in order_by]), order_by)
    rows, lo, hi = keys.agg(F.count(F.lit(1)), F.min("__k0"), F.max("__k0")).first()
    if buckets is None:
        buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), math.ceil(rows / ROWS_PER_BUCKET))
    target = max(1, math.ceil(rows / max(1, int(buckets))))
    if rows <= target:
        return index

    leaves: dict[tuple[int, ...], int] = {}
    open_, slots = [_node(texts, (-1,), 0, rows, lo, hi, nulls=True)], 0
    current = keys
    while open_:
        room = max(16, min(1024, ROUND_RANGES // len(open_)))
        for node in open_:
            node.slot = slots
            slots += node.cut(min(MOST_RANGES, max(room, 8 * math.ceil(node.rows / target))))
        index.rounds.append(open_)
        current = index.first_step(current) if len(index.rounds) == 1 else index.step(current, open_, inner=True)
        counted = current.groupBy("__slot").agg(F.count(F.lit(1)).alias("n"), F.min("__code").alias("lo"), F.max("__code").alias("hi")).toArrow().sort_by("__slot").to_pydict()
        open_ = _split(open_, counted, leaves, target)
        alike = [n for n in open_ if n.lo == n.hi]  # one code: go on behind it
        if alike:
            open_ = [n for n in open_ if n.lo != n.hi] + _further(index, current, alike, leaves)
        open_.sort(key=lambda n: n.path)
        current = current.drop("__code")
    total, number = 0, 0
    for path, n in sorted(leaves.items()):
        if total and total + n > target:
            total, number = 0, number + 1
        total += n
        index.leaves.append((path[-1], number))
    index.slots = slots
    index.buckets = number + 1
    return index


def _node(texts: list[bool], path: tuple[int, ...], level: int, rows: int, lo, hi, nulls: bool = False) -> _Node:
    """Node over the values of a column between ``lo`` and ``hi``; texts go on behind the bytes they share."""
    if not texts[level]:
        return _Node(path, level, lo, hi, rows)
    if lo is None or hi is None:
        return _Node(path, level, _NULL_TEXT, _NULL_TEXT, rows)
    # min() and max() see no null; the first byte range must take them in
    lo, hi = bytes(lo), bytes(hi)
    offset = 0 if nulls else len(os.path.commonprefix([lo, hi]))
    return _Node(path, level, _NULL_TEXT if nulls else _chunk_code(lo, offset), _chunk_code(hi, offset), rows, offset)


def _split(nodes: list[_Node], counted: Mapping[str, list], leaves: dict, target: int) -> list[_Node]:
    """Ranges above the target as nodes of the same column; the others are leaves."""
    out, k = [], 0
    ends = [n.slot for n in nodes[1:]] + [math.inf]
    for node, end in zip(nodes, ends):
        while k < len(counted["n"]) and counted["__slot"][k] < end:
            path = (*node.path, counted["__slot"][k])
            if counted["n"][k] > target:
                out.append(_Node(path, node.level, counted["lo"][k], counted["hi"][k], counted["n"][k], node.offset))
            else:
                leaves[path] = counted["n"][k]
            k += 1
    return out


def _further(index: RangeIndex, rows: DataFrame, nodes: list[_Node], leaves: dict) -> list[_Node]:
    """Nodes behind ranges of a single code: the rest of the text where it differs, else the next column that does."""
    table = literal_rows(rows.sparkSession, [(n.path[-1],) for n in nodes], "__at long")
    found = rows.join(small(table, len(nodes)), F.col("__slot") == F.col("__at"))
    count = len(index.order_by)
    ends = found.groupBy("__slot").agg(*[f(f"__k{j}").alias(f"{k}{j}") for j in range(count) for k, f in (("lo", F.min), ("hi", F.max), ("n", F.count))])
    ends = {r["__slot"]: r for r in ends.collect()}  # one row for each range above the target
    out = []
    for n in nodes:
        r, nxt = ends[n.path[-1]], None
        for level in range(n.level, count):
            lo, hi, nulls = r[f"lo{level}"], r[f"hi{level}"], r[f"n{level}"] < n.rows
            if level == n.level and not index.texts[level]:
                continue
            if lo != hi or (nulls and lo is not None):
                nxt = _node(index.texts, n.path, level, n.rows, lo, hi, nulls)
                break
        if nxt is None:
            leaves[n.path] = n.rows  # equal keys
        else:
            out.append(nxt)
    return out


def assign_buckets(df: DataFrame, order_by: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Add the bucket number; bucket order equals the order of ``order_by``."""
    return build_index(df, order_by, buckets).assign(df)


_FIXED_WIDTH = (*INTEGER_TYPES, *FLOAT_TYPES, *DATETIME_TYPES)


def order_key(df: DataFrame, order_by: Sequence[str]) -> Column:
    """The order key as one comparable value.

    A single fixed-width key stays a plain column: minima and maxima of it run
    in a hash aggregate, while those of a struct or text need a sort first.
    """
    if len(order_by) == 1 and isinstance(df.schema[order_by[0]].dataType, _FIXED_WIDTH):
        return c(order_by[0])
    return F.struct(*[c(k) for k in order_by])


class OrderedFrame:
    """A DataFrame cut into range buckets, ready for local windows."""

    def __init__(self, df: DataFrame, order_by: Sequence[str], buckets: int | None = None):
        self.order_by = [order_by] if isinstance(order_by, str) else list(order_by)
        index = build_index(df, self.order_by, buckets)
        self.df, self.buckets = index.assign(df), index.buckets
        self.key = order_key(df, self.order_by)

    def window(self, reverse: bool = False):
        keys = [c(k).desc() if reverse else c(k).asc() for k in self.order_by]
        return Window.partitionBy(BUCKET).orderBy(*keys)

    def running(self, reverse: bool = False):
        """Rows up to and including the current one.

        The reverse direction uses a descending sort: an unbounded-following
        frame would re-read the rest of the bucket for every row.
        """
        return self.window(reverse).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def summary(self, **aggs: Column) -> DataFrame:
        """One row per bucket, by a map-side combined aggregate."""
        return self.df.groupBy(BUCKET).agg(*[a.alias(k) for k, a in aggs.items()])

    def edge_value(self, x: Column, name: str, last: bool = True, text: bool = False) -> DataFrame:
        """Last (or first) non-null value of each bucket.

        Text cannot be held in a hash aggregate buffer. With a fixed-width key
        the keys are found first and their rows looked up by a join with one
        key per bucket.
        """
        present = F.when(x.isNotNull(), self.key)
        pick, extreme = (F.max_by, F.max) if last else (F.min_by, F.min)
        if not text or len(self.order_by) > 1 or not isinstance(self.df.schema[self.order_by[0]].dataType, _FIXED_WIDTH):
            return self.summary(**{name: pick(x, present)})
        keys = self.summary(__at=extreme(present))
        found = (
            self.df.join(small(keys.withColumnRenamed(BUCKET, "__b"), self.buckets), (F.col(BUCKET) == F.col("__b")) & (self.key == F.col("__at")))
            .groupBy(BUCKET).agg(F.min(x).alias(name))  # one row per bucket even if a key repeats
        )
        return keys.select(BUCKET).join(small(found, self.buckets), BUCKET, "left")

    def carried(self, summary: DataFrame, sums: Mapping[str, str] | None = None, lasts: Mapping[str, str] | None = None, nexts: Mapping[str, str] | None = None) -> DataFrame:
        """What the other buckets bring to each: sums and last values of those before it, first values of those behind it.

        Each mapping gives the output's name and the summary column. Beyond ``GROUP``
        buckets they are worked out in groups, and the groups' own totals once more, so
        no task sees more than ``GROUP`` buckets or the groups.
        """
        sums, lasts, nexts = sums or {}, lasts or {}, nexts or {}
        grouped = summary.withColumn("__group", F.expr(f"{BUCKET} div {GROUP}"))

        def along(place: str, group: str | None, reverse: bool):
            window = Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))
            return window.orderBy(F.col(place).desc() if reverse else F.col(place).asc()).rowsBetween(Window.unboundedPreceding, -1)

        def brought(df: DataFrame, place: str, group: str | None, mark: str) -> DataFrame:
            before, behind = along(place, group, False), along(place, group, True)
            return df.select(
                "*", *[F.sum(v).over(before).alias(f"{mark}{k}") for k, v in sums.items()], *[F.last(v, ignorenulls=True).over(before).alias(f"{mark}{k}") for k, v in lasts.items()],
                *[F.last(v, ignorenulls=True).over(behind).alias(f"{mark}{k}") for k, v in nexts.items()],
            )

        def held(pick, v: str) -> Column:
            return pick(F.col(v), F.when(F.col(v).isNotNull(), F.col(BUCKET)))

        if self.buckets <= GROUP:
            found = brought(summary, BUCKET, None, "")
            return found.select(BUCKET, *[F.coalesce(k, F.lit(0)).alias(k) for k in sums], *lasts, *nexts)
        # totals of a group go by the column's own name
        totals = grouped.groupBy("__group").agg(
            *[F.sum(v).alias(v) for v in dict.fromkeys(sums.values())], *[held(F.max_by, v).alias(v) for v in dict.fromkeys(lasts.values())],
            *[held(F.min_by, v).alias(v) for v in dict.fromkeys(nexts.values())],
        )
        names = (*sums, *lasts, *nexts)
        outer = brought(totals, "__group", None, "__o_").select("__group", *[f"__o_{k}" for k in names])
        inner = brought(grouped, BUCKET, "__group", "__i_").join(small(outer, self.buckets // GROUP + 1), "__group")
        add = [(F.coalesce(f"__i_{k}", F.lit(0)) + F.coalesce(f"__o_{k}", F.lit(0))).alias(k) for k in sums]
        return inner.select(BUCKET, *add, *[F.coalesce(f"__i_{k}", f"__o_{k}").alias(k) for k in (*lasts, *nexts)])

    def attach(self, rows: DataFrame, summary: DataFrame) -> DataFrame:
        """Join the summary back, by broadcast while it is known to be small."""
        return rows.join(small(summary, self.buckets), BUCKET, "left")


def with_position(df: DataFrame, order_by: Sequence[str], name: str = "position", buckets: int | None = None) -> DataFrame:
    """Global 0-based row position along a total order."""
    o = OrderedFrame(df, order_by, buckets)
    offsets = o.carried(o.summary(n=F.count(F.lit(1))), sums={"__offset": "n"})
    ranked = o.df.withColumn("__rank", F.row_number().over(o.window()))
    return (
        o.attach(ranked, offsets)
        .withColumn(name, (F.col("__offset") + F.col("__rank") - 1).cast("long"))
        .drop(BUCKET, "__offset", "__rank")
    )
