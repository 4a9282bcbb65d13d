"""WARC archives of pages, read back, with a globally ordered index by external merge.

Every task writes its pages, sorted by URL key, timestamp and page, as gzip members of one archive per run, and
returns the run's index rows (an already sorted run). Runs are written as a table. The merge deals index rows out
by ranges of the full key, so one URL or host may hold any share of the rows, and every range merges the parts of
all runs with a loser tree. The history that results is in global order.

A payload of at least ``MIN_REVISIT`` bytes that several pages share is stored once: by the page with the smallest
page_id; the others are revisit records (identical payload digest) whose HTTP header keeps the payload's length.
The smallest page of each digest is a plain pre-aggregated minimum, joined back on the digest, where Spark splits
skewed partitions.

Cases: a null html counts as empty; a null url gives an empty key; rows without page_id are responses unless
a numbered page has the same payload; if rows share the smallest page_id and the payload, all of them are
responses; an empty table writes no archive and reads back as no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colprep.llm.common import open_store, put_file, written
from colprep.session import scratch_dir

MIN_REVISIT = 100
FILE_BYTES = 16 << 20
INDEX = "url_key string, captured string, page_id long, file string, offset long, length long, record_type string, payload_digest string"
RECORDS = "file string, offset long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url):
    """Host labels in reverse order, then the path: the usual sort key of capture indexes."""
    rest = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(www\.)?", "")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(rest, r"^[^/?#]*", ""))


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages with key, time of capture, payload, digest, type and the page a revisit refers to."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload")
    ).withColumn("payload_digest", F.sha2("payload", 256))
    # The tables hold no time of capture: pages count as taken one second apart in page order.
    time = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce("page_id", F.lit(0))), "yyyyMMddHHmmss")
    rows = rows.select("*", url_key(F.col("url")).alias("url_key"), time.alias("captured"))
    shared = rows.where(F.octet_length("payload") >= MIN_REVISIT).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    return rows.join(shared, "payload_digest", "left").select(
        "url_key", "captured", "page_id", "url", "payload", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to")
    )


def record(page_id, url: str, captured: str, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    when = f"{captured[:4]}-{captured[4:6]}-{captured[6:8]}T{captured[8:10]}:{captured[10:12]}:{captured[12:14]}Z"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    header = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Date: {when}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response",
    ]
    if kind == "revisit":
        header += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    header.append(f"Content-Length: {len(block)}")
    coder = zlib.compressobj(6, zlib.DEFLATED, 31)
    return coder.compress("\r\n".join(header).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + coder.flush()


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one or more archives per task; returns the sorted runs of the index, as a written table."""
    store, inner = open_store(f"{folder}/archives")
    store.create_dir(inner, recursive=True)

    def run(batches):
        task = TaskContext.get()
        store, inner = open_store(f"{folder}/archives")
        blocks, rows, size, number = [], [], 0, 0

        def close():
            name = f"run-{task.partitionId():06d}-{number:04d}.warc.gz"
            put_file(store, f"{inner}/{name}", str(task.taskAttemptId()), blocks)
            columns = list(zip(*[(*r[:3], name, *r[3:]) for r in rows], strict=True))
            types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])

        for batch in batches:
            for k in range(batch.num_rows):
                key, captured, page_id, url, payload, digest, kind, refers_to = (batch.column(c)[k].as_py() for c in range(8))
                block = record(page_id, url, captured, payload.encode(), digest, kind, refers_to)
                rows.append((key, captured, page_id, size, len(block), kind, digest))
                blocks.append(block)
                size += len(block)
                if size >= file_bytes:
                    yield close()
                    blocks, rows, size, number = [], [], 0, number + 1
        if rows:
            yield close()

    sorted_runs = captures(pages).sortWithinPartitions("url_key", "captured", "page_id", "payload_digest")
    sorted_runs.mapInArrow(run, INDEX).write.parquet(f"{folder}/runs")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/runs")


class LoserTree:
    """k-way merge of sorted lists: every inner node keeps the loser of its match, the winner goes up."""

    def __init__(self, runs: list[list]):
        self.runs = runs
        self.k = max(1, len(runs))
        self.places = [0] * self.k
        self.nodes = [-1] * self.k
        for leaf in range(self.k):
            self._replay(leaf)

    def _head(self, run: int):
        if run < 0:
            return (0,)  # an empty seat wins while the tree is filled
        place = self.places[run]
        done = run >= len(self.runs) or place >= len(self.runs[run])
        return (2,) if done else (1, self.runs[run][place][0], run)

    def _replay(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            if self._head(self.nodes[node]) < self._head(winner):
                self.nodes[node], winner = winner, self.nodes[node]
            node //= 2
        self.nodes[0] = winner

    def __iter__(self):
        while True:
            run = self.nodes[0]
            if self._head(run)[0] != 1:
                return
            yield self.runs[run][self.places[run]]
            self.places[run] += 1
            self._replay(run)


def merge_index(runs: DataFrame, rows_per_range: int = 100_000) -> DataFrame:
    """Index rows in global order, which (part, place) numbers: ranges ascend with part, rows of one with place."""
    key = ["url_key", "captured", "page_id", "file", "offset"]
    total = runs.count()
    dealt = runs.repartitionByRange(max(1, -(-total // rows_per_range)), *[F.col(c).asc_nulls_first() for c in key])

    def run(batches):
        columns, parts = None, []
        for batch in batches:
            columns = batch.schema.names
            parts.append(batch)
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        by_run: dict[str, list] = {}
        places = [table.column(c).to_pylist() for c in key]
        for row, (url, captured, page_id, file, offset) in enumerate(zip(*places, strict=True)):
            by_run.setdefault(file, []).append(((url, captured, page_id is not None, page_id or 0, file, offset), row))
        order = [row for _, row in LoserTree(list(by_run.values()))]
        merged = table.take(pa.array(order, pa.int64())).append_column("place", pa.array(range(len(order)), pa.int64()))
        merged = merged.append_column("part", pa.array([TaskContext.get().partitionId()] * len(order), pa.int64()))
        yield from merged.select([*columns, "part", "place"]).to_batches()

    # rows of a run arrive in the run's order
    return dealt.sortWithinPartitions("file", "offset").mapInArrow(run, INDEX + ", part long, place long")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives, from their bytes."""

    def parse(file: str, content: bytes):
        place, view = 0, memoryview(content)
        while place < len(content):
            start, coder, parts = place, zlib.decompressobj(31), []
            while not coder.eof:
                if place >= len(content):
                    raise ValueError(f"{file} ends within a record")
                piece = view[place : place + 16384]
                parts.append(coder.decompress(piece))
                place += len(piece) - len(coder.unused_data)
            head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            block = rest[: int(fields["Content-Length"])]
            http, _, payload = block.partition(b"\r\n\r\n")
            page = fields["WARC-Record-ID"][10:-1]
            kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].split(":")[1]
            if kind == "response":
                if hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{file}: the payload at {start} does not have its digest")
                n, refers = len(payload), None
            else:
                n = int(next(line for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))[16:])
                refers = int(fields["WARC-Refers-To"][10:-1])
            yield file, start, int(page) if page else None, n, digest, kind, refers

    def run(batches):
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = list(parse(path.rsplit("/", 1)[-1], content.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in RECORDS.split(", ")])

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.warc.gz").load(f"{folder}/archives")
    return files.select("path", "content").mapInArrow(run, RECORDS)


def archive(pages: DataFrame) -> DataFrame:
    """Write, merge and read back: a row per record with its number in the global capture history."""
    folder = scratch_dir(pages.sparkSession, "warc")
    merged = written(merge_index(write_archives(pages, folder)).select("file", "offset", "url_key", "captured", "part", "place"), "history")
    # one row per range, so a running sum over the ranges is small
    sizes = merged.groupBy("part").agg(F.count("*").alias("rows"))
    before = sizes.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    history = merged.join(before, "part").select("file", "offset", "url_key", "captured", (F.col("base") + F.col("place")).alias("history"))
    return read_archives(pages.sparkSession, folder).join(history, ["file", "offset"]).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "history"
    )
