"""WARC archives with payload revisits, and one index of all captures by external merging.

Writing: payload digests are pre-aggregated to each payload's smallest page_id, so only ids and digests
travel for deduplication; every task then writes its own archive of gzip members (warcinfo, response and revisit
records with HTTP headers) in the shared folder and reports its captures.  Reading streams one archive at a time,
checks every digest, and writes runs of captures sorted by URL key, timestamp and page_id to the shared folder, with a
sparse index of the first and last key of each block of a run.

Merging is external: key ranges are cut from the sparse index (a composite key, so one URL with a third of all captures
is still split), and a task of a range opens the blocks of each run that its range touches and streams them through a
loser tree, one block of each run in memory.  More than ``FAN_IN`` runs are first merged to fewer, longer ones, pass by
pass, each by ranges too.  The output is ordered within and across partitions.

An attempt of a task that is lost or repeated writes under its own name; only files that a finished attempt
reports are ever read.

Defined cases: null html is an empty payload; a null url has no target header and an empty URL key; carriage
returns and line feeds in a url are percent-encoded; of equal payloads of at least ``min_bytes`` bytes the
smallest page_id is the response, all rows with that id are; null ids sort last and never win over others; an empty
table writes no archive and gives no rows; extra and clashing columns have no effect.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import materialize, shared_dir, text_batches

#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURED_AT = "2024-01-01T00:00:00Z"
#: Compressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 1 << 29
LEVEL = 3
#: Captures sorted together in memory to a run, and captures of a run's block.
RUN_ROWS, BLOCK_ROWS = 65_536, 1024
#: Runs merged at once.
FAN_IN = 64
#: Captures of a merging task's range, and ranges of a pass at most (the ranges then are longer, not the memory).
RANGE_ROWS, MOST_RANGES = 500_000, 20_000

_WRITTEN = T.StructType([T.StructField("path", T.StringType()), T.StructField("records", T.LongType())])
CAPTURES = T.StructType(
    [T.StructField(n, t) for n, t in (("url_key", T.StringType()), ("captured_at", T.StringType()), ("page_id", T.LongType()), ("url", T.StringType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("record_type", T.StringType()), ("refers_to", T.LongType()), ("archive", T.StringType()), ("record_offset", T.LongType()))]
)
_ARROW = pa.schema([(f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for f in CAPTURES])
#: A capture's place in the order; page_ids that are null come last.
_KEY = T.StructType([T.StructField(n, t) for n, t in (("url_key", T.StringType()), ("captured_at", T.StringType()), ("no_id", T.BooleanType()), ("page_id", T.LongType()), ("archive", T.StringType()), ("record_offset", T.LongType()))])
#: A block of a sorted run: its file and place there, its place in the run, its rows and the keys at its ends.
BLOCKS = T.StructType([T.StructField("run", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("path", T.StringType()), T.StructField("at", T.IntegerType()), T.StructField("rows", T.LongType()), T.StructField("first", _KEY), T.StructField("last", _KEY)])


def url_key(url: str | None) -> str:
    """A sortable key: host labels from the last, then path and query, lower-cased; empty for null."""
    if not url or "://" not in url:
        return (url or "").lower()
    rest = url.split("://", 1)[1].split("#", 1)[0]
    cut = min((i for i in map(rest.find, "/?") if i >= 0), default=len(rest))
    return (",".join(reversed(rest[:cut].split("."))) + ")" + (rest[cut:] or "/")).lower()


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _id(urn: str) -> int | None:
    name = urn.strip("<>").rsplit(":", 1)[1]
    return None if name == "none" else int(name)


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record."""
    lines = [VERSION, f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in headers], f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, at: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response record of a page, or a revisit record that keeps only the HTTP headers."""
    headers = [("WARC-Record-ID", _urn(page_id)), ("WARC-Date", at), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload))]
    if url is not None:
        headers.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record("revisit" if revisit else "response", headers, http if revisit else http + payload)


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def members(stream: object, size: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member of a file, one in memory at a time."""
    offset, data = 0, b""
    while True:
        unpacker, parts, used = zlib.decompressobj(31), [], 0
        while not unpacker.eof:
            if not data:
                data = stream.read(size)
                if not data:
                    if used:
                        raise ValueError("an archive ends within a record")
                    return
            used += len(data)
            parts.append(unpacker.decompress(data))
            data = unpacker.unused_data
            used -= len(data)
        yield offset, b"".join(parts)
        offset += used


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (with lower-cased names) and block of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    n = int(headers["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, rest[:n]


def _filesystem(uri: str) -> tuple[object, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", at_col: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write every row of ``pages`` into archives in ``folder``: path and records of each."""
    text_batches(pages.sparkSession)
    at = F.lit(CAPTURED_AT) if at_col is None else F.date_format(F.col(at_col).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(at, F.lit(CAPTURED_AT)).alias("at"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    src = src.withColumn("digest", F.unhex(F.sha1("payload")))
    large = src.where(F.octet_length("payload") >= min_bytes).select("page_id", "digest")
    firsts = materialize(large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "warc-firsts")
    revisits = large.join(firsts, "digest").where("NOT page_id <=> refers_to").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to").distinct()
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    joined = src.join(revisits, same, "left").select("page_id", "url", "at", "payload", "refers_to", F.col("_digest").isNotNull().alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        system, path = _filesystem(folder)
        system.create_dir(path, recursive=True)
        out, files, count, size = None, [], 0, 0
        for batch in batches:
            for page_id, url, when, payload, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    file = f"{name}-{len(files):04d}.warc.gz"
                    out, count = system.open_output_stream(f"{path}/{file}", compression=None), 0
                    size = out.write(member(record("warcinfo", [("WARC-Record-ID", f"<urn:x-archive:{file}>"), ("WARC-Date", CAPTURED_AT), ("WARC-Filename", file), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
                size += out.write(member(page_record(page_id, url, when, payload, refers_to, revisit)))
                count += 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    files.append((f"{folder}/{file}", count))
                    out = None
        if out is not None:
            out.close()
            files.append((f"{folder}/{file}", count))
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in files], pa.string()), pa.array([n for _, n in files], pa.int64())], names=_WRITTEN.names)

    return materialize(joined.mapInArrow(run, _WRITTEN), "warc-written")


def sort_key(row: tuple) -> tuple:
    """URL key, time, page_id (nulls last), archive, offset; strings by their UTF-8 bytes, as Spark orders them."""
    return (row[0].encode(), row[1].encode(), row[2] is None, row[2] or 0, row[8].encode(), row[9])


class LoserTree:
    """Merges sorted sequences: each inner node holds the loser of its match, the winner moves on to the top."""

    _END = (b"\xff" * 2,)  # after every UTF-8 text

    def __init__(self, runs: list[Iterable[tuple]]) -> None:
        self._its = [iter(r) for r in runs]
        self._k = len(runs)
        self._heads: list[tuple[tuple, tuple | None]] = [self._next(i) for i in range(self._k)]
        self._tree = [-1] * max(1, self._k)
        for i in range(self._k):
            self._replay(i)

    def _next(self, i: int) -> tuple[tuple, tuple | None]:
        row = next(self._its[i], None)
        return (self._END, None) if row is None else (sort_key(row), row)

    def _replay(self, winner: int) -> None:
        at = (winner + self._k) // 2
        while at > 0:
            other = self._tree[at]
            if other < 0:  # the match waits for its second side, when the tree is built
                self._tree[at] = winner
                return
            if self._heads[other][0] < self._heads[winner][0]:
                self._tree[at], winner = winner, other
            at //= 2
        self._tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self._k:
            winner = self._tree[0]
            row = self._heads[winner][1]
            if row is None:
                return
            yield row
            self._heads[winner] = self._next(winner)
            self._replay(winner)


def captures_of(uri: str) -> Iterator[tuple]:
    """The captures of an archive in its own order, each record checked; one record in memory at a time."""
    system, path = _filesystem(uri)
    with system.open_input_stream(path, compression=None) as stream:
        for offset, content in members(stream):
            headers, block = parse(content)
            kind = headers["warc-type"]
            if kind not in ("response", "revisit"):
                continue
            http, _, payload = block.partition(b"\r\n\r\n")
            digest = headers["warc-payload-digest"].removeprefix("sha1:")
            length = int(http.decode().lower().partition("\r\ncontent-length: ")[2].partition("\r\n")[0])
            if kind == "response" and (len(payload) != length or base32_sha1(payload) != digest):
                raise ValueError(f"{uri} at {offset}: the payload is damaged")
            url = headers.get("warc-target-uri")
            yield url_key(url), headers["warc-date"], _id(headers["warc-record-id"]), url, length, digest, kind, _id(headers["warc-refers-to"]) if kind == "revisit" else None, uri, offset


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(_ARROW), _ARROW, strict=True)], schema=_ARROW)


def _key_struct(key: tuple) -> dict:
    return dict(zip(_KEY.names, (key[0].decode(), key[1].decode(), key[2], key[3], key[4].decode(), key[5]), strict=True))


def _key_tuple(k: dict) -> tuple:
    return (k["url_key"].encode(), k["captured_at"].encode(), k["no_id"], k["page_id"], k["archive"].encode(), k["record_offset"])


def _chunks(rows: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    while part := list(islice(rows, size)):
        yield part


def write_run(uri: str, run: str, rows: Iterator[tuple], first: int = 0, block_rows: int = BLOCK_ROWS) -> list[dict]:
    """Write sorted captures as blocks of a file; the blocks' entries in the sparse index, numbered from ``first``."""
    system, path = _filesystem(uri)
    blocks: list[dict] = []
    with system.open_output_stream(path, compression=None) as out, pa.ipc.new_file(out, _ARROW) as file:
        for part in _chunks(rows, block_rows):
            file.write_batch(_batch(part))
            blocks.append({"run": run, "seq": first + len(blocks), "path": uri, "at": len(blocks), "rows": len(part), "first": _key_struct(sort_key(part[0])), "last": _key_struct(sort_key(part[-1]))})
    return blocks


def read_run(blocks: list[dict], low: tuple, high: tuple | None) -> Iterator[tuple]:
    """The captures of a run's blocks, in order, from ``low`` on and before ``high``; one block in memory at a time."""
    for uri, some in groupby(sorted(blocks, key=lambda b: b["seq"]), key=lambda b: b["path"]):
        system, path = _filesystem(uri)
        with system.open_input_file(path) as source, pa.ipc.open_file(source) as file:
            for b in some:
                for row in zip(*(c.to_pylist() for c in file.get_batch(b["at"]).columns), strict=True):
                    key = sort_key(row)
                    if high is not None and key >= high:
                        return
                    if key >= low:
                        yield row


def _attempt() -> str:
    from pyspark import TaskContext

    context = TaskContext.get()
    return f"{context.partitionId():06d}-{context.taskAttemptId()}"


_BLOCKS_ARROW = pa.schema([("run", pa.string()), ("seq", pa.int64()), ("path", pa.string()), ("at", pa.int32()), ("rows", pa.int64()), *((n, pa.struct([(f.name, {T.StringType: pa.string(), T.BooleanType: pa.bool_(), T.LongType: pa.int64()}[type(f.dataType)]) for f in _KEY])) for n in ("first", "last"))])


def sorted_runs(archives: DataFrame, folder: str, *, run_rows: int = RUN_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Read archives (a DataFrame with their paths) into sorted runs in ``folder``; the runs' sparse index."""
    spark = archives.sparkSession
    text_batches(spark)
    names = archives.select("path").repartition(max(1, archives.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _filesystem(folder)
        system.create_dir(path, recursive=True)
        n = 0
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                for rows in _chunks(captures_of(uri), run_rows):
                    name = f"run-{_attempt()}-{n:05d}"
                    n += 1
                    rows.sort(key=sort_key)
                    yield pa.RecordBatch.from_pylist(write_run(f"{folder}/{name}.arrow", name, iter(rows), block_rows=block_rows), schema=_BLOCKS_ARROW)

    return materialize(names.mapInArrow(run, BLOCKS), "warc-blocks")


_TASKS = T.StructType([T.StructField("grp", T.LongType()), T.StructField("range", T.LongType()), T.StructField("block", BLOCKS), T.StructField("low", _KEY), T.StructField("high", _KEY)])
_TASKS_ARROW = pa.schema([("grp", pa.int64()), ("range", pa.int64()), ("block", pa.struct(list(_BLOCKS_ARROW))), ("low", _BLOCKS_ARROW.field("first").type), ("high", _BLOCKS_ARROW.field("first").type)])


def _ranges(blocks: DataFrame, rows: int, range_rows: int) -> DataFrame:
    """(grp, range, blocks, low, high), a row per range of keys, in order of ranges within and across partitions.

    Bounds are keys of the sparse index, found by a range partitioning of it: ``MOST_RANGES`` and one a group at most.
    A block goes to every range of its group that it touches.
    """
    spark = blocks.sparkSession
    wanted = min(MOST_RANGES, -(-rows // range_rows))
    cut = blocks.select("grp", "first").repartitionByRange(wanted, "grp", "first").withColumn("part", F.spark_partition_id())
    found = cut.groupBy("part").agg(F.min(F.struct("grp", "first")).alias("b")).select("b.grp", "b.first")
    found = materialize(found.union(blocks.groupBy("grp").agg(F.min("first").alias("first"))), "warc-bounds")
    bounds = sorted({(r["grp"], _key_tuple(r["first"].asDict())) for r in found.collect()})
    shared = spark.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value
        for batch in batches:
            out = []
            for b in batch.to_pylist():
                grp = b.pop("grp")
                low, high = (bisect.bisect_right(cuts, (grp, _key_tuple(b[end]))) - 1 for end in ("first", "last"))
                for i in range(low, high + 1):
                    after = cuts[i + 1][1] if i + 1 < len(cuts) and cuts[i + 1][0] == grp else None
                    out.append({"grp": grp, "range": i, "block": b, "low": _key_struct(cuts[i][1]), "high": after and _key_struct(after)})
            yield pa.RecordBatch.from_pylist(out, schema=_TASKS_ARROW)

    met = blocks.select(*BLOCKS.names, "grp").mapInArrow(run, _TASKS)
    packed = met.groupBy("grp", "range").agg(F.collect_list("block").alias("blocks"), F.first("low").alias("low"), F.first("high").alias("high"))
    return materialize(packed, "warc-ranges").repartitionByRange(len(bounds), "range").sortWithinPartitions("range")


def _merged(task: dict) -> Iterator[tuple]:
    """The captures of a range, merged from the runs that it touches."""
    runs: dict[str, list[dict]] = {}
    for b in task["blocks"]:
        runs.setdefault(b["run"], []).append(b)
    low, high = (task[k] and _key_tuple(task[k]) for k in ("low", "high"))
    return iter(LoserTree([read_run(blocks, low, high) for blocks in runs.values()]))


def _longer_runs(blocks: DataFrame, rows: int, groups: int, folder: str, number: int, range_rows: int) -> DataFrame:
    """One pass: the runs of each of so many groups become one run, of a file per range."""
    grouped = blocks.withColumn("grp", F.pmod(F.xxhash64("run", F.lit(number)), F.lit(groups)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.to_pylist():
                file = f"{folder}/merged-{number}-{task['range']:06d}-{_attempt()}.arrow"
                made = write_run(file, f"merged-{number}-{task['grp']}", _merged(task), task["range"] << 32)
                yield pa.RecordBatch.from_pylist(made, schema=_BLOCKS_ARROW)

    return materialize(_ranges(grouped, rows, range_rows).mapInArrow(run, BLOCKS), "warc-blocks")


def merge_runs(blocks: DataFrame, folder: str, *, fan_in: int = FAN_IN, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures of sorted runs in global order of URL key, time and page_id.

    While there are more than ``fan_in`` runs, they are dealt to groups of half that number on average, and a pass
    merges each group.
    """
    spark = blocks.sparkSession
    text_batches(spark)
    number = 0
    while True:
        n = blocks.agg(F.sum("rows").alias("rows"), F.countDistinct("run").alias("runs")).first()
        if not n["runs"]:
            return spark.createDataFrame([], CAPTURES)
        if n["runs"] <= fan_in:
            break
        number += 1
        blocks = _longer_runs(blocks, n["rows"], -(-2 * n["runs"] // fan_in), folder, number, range_rows)
    tasks = _ranges(blocks.withColumn("grp", F.lit(0).cast("long")), n["rows"], range_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.to_pylist():
                for part in _chunks(_merged(task), 8 * BLOCK_ROWS):
                    yield _batch(part)

    return tasks.mapInArrow(run, CAPTURES)


def archive_pages(pages: DataFrame, folder: str | None = None, **columns: object) -> DataFrame:
    """Write archives, read them back, and merge their captures into one ordered index."""
    folder = folder or shared_dir(pages.sparkSession, "warc")
    return merge_runs(sorted_runs(write_archives(pages, folder, **columns), folder), folder)
