"""A log of records: partitions of framed segments with an offset index.

A log is a folder on a file system that the driver and all executors share; each partition is a
folder in it. A segment holds frames (length, checksum, record) of consecutive offsets; beside
it an index has the byte position of every so many offsets, so that any offset, the last one too,
is found without reading what lies before it.

Two kinds of writers: :class:`LogWriter` appends in one process, and a record is durable when
``add`` returns (a receiver's queue); the data source's sink writes a segment for each task and
partition, which readers see once a commit names it (the merge's output).
"""

from __future__ import annotations

import fcntl
import json
import os
import struct
import time
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "seamline_log"
LOG_SCHEMA = "partition int, offset bigint, timestamp bigint, key binary, value binary, headers array<struct<key:string,value:binary>>"
_FIELDS = pa.schema([("partition", pa.int32()), ("offset", pa.int64()), ("timestamp", pa.int64()), ("key", pa.binary()), ("value", pa.binary()), ("headers", pa.list_(pa.struct([("key", pa.string()), ("value", pa.binary())])))])
_FRAME, _ENTRY = struct.Struct("<II"), struct.Struct("<QQ")
INDEX_EVERY = 256
COMMITS = "_commits"
ALL_EVERY = 100  # commits after which one names all segments again


def local(path: str) -> str:
    """The path on a mounted file system; logs lie on no other."""
    if (at := path.find(":")) > 1 and "/" not in path[:at]:
        if path[:at] != "file":
            raise ValueError(f"a log lies on a mounted file system, not on {path[:at]}:")
        path = "/" + path[at + 1 :].lstrip("/")
    return path.rstrip("/")


class Record(NamedTuple):
    timestamp: int
    key: bytes | None
    value: bytes | None
    headers: list[tuple[str, bytes | None]] | None


def _part(data: bytes | None) -> bytes:
    return struct.pack("<i", -1) if data is None else struct.pack("<i", len(data)) + data


def encode(record: Record) -> bytes:
    headers = record.headers
    parts = [struct.pack("<q", record.timestamp), _part(record.key), _part(record.value), struct.pack("<i", -1 if headers is None else len(headers))]
    for name, value in headers or ():
        parts += [_part(name.encode()), _part(value)]
    return b"".join(parts)


def decode(data: bytes) -> Record:
    at = 8

    def number() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from("<i", data, at - 4)[0]

    def part() -> bytes | None:
        nonlocal at
        size = number()
        if size < 0:
            return None
        at += size
        return data[at - size : at]

    key, value, n = part(), part(), number()
    headers = None if n < 0 else [(part().decode(), part()) for _ in range(n)]
    return Record(struct.unpack_from("<q", data)[0], key, value, headers)


def frame(data: bytes) -> bytes:
    return _FRAME.pack(len(data), zlib.crc32(data)) + data


@dataclass(frozen=True)
class Segment:
    """``count``: of a committed segment, None if it may still grow."""

    file: str
    base: int
    count: int | None = None

    def index(self) -> list[tuple[int, int]]:
        """Offsets and byte positions, from the base on; entries that a crash has left behind the
        end of the segment are left out."""
        try:
            raw, size = Path(f"{self.file}.idx").read_bytes(), os.path.getsize(self.file)
        except FileNotFoundError:
            return [(self.base, 0)]
        found = [_ENTRY.unpack_from(raw, k) for k in range(0, len(raw) - _ENTRY.size + 1, _ENTRY.size)]
        return [(self.base, 0), *(x for x in found if x[1] <= size)]

    def frames(self, start: int) -> Iterator[tuple[int, int, bytes]]:
        """Offset, position after it, and record of the frames from an offset on, until the end or a
        torn frame. Frames between the index entry and the offset are jumped over."""
        offset, position = max((x for x in self.index() if x[0] <= start), default=(self.base, 0))
        with open(self.file, "rb") as f:
            f.seek(position)
            while True:
                head = f.read(_FRAME.size)
                if len(head) < _FRAME.size:
                    return
                size, crc = _FRAME.unpack(head)
                if not size:
                    return
                if offset < start:
                    position = f.seek(size, os.SEEK_CUR)
                    offset += 1
                    continue
                data = f.read(size)
                if len(data) < size or zlib.crc32(data) != crc:
                    return
                position = f.tell()
                yield offset, position, data
                offset += 1

    def end(self) -> tuple[int, int]:
        """The offset after the last whole frame, and its position; only frames after the last index
        entry are read."""
        if self.count is not None:
            return self.base + self.count, os.path.getsize(self.file)
        offset, position = self.index()[-1]
        for k, after, _ in self.frames(offset):
            offset, position = k + 1, after
        return offset, position


class LogWriter:
    """Appends records to one partition of a log. When :meth:`add` returns, the record is on disk. A
    writer that was killed has lost nothing it had added; a frame that it was writing is cut off
    when the next one opens. There is one writer for a partition at a time."""

    def __init__(self, path: str, partition: int = 0, *, segment_bytes: int = 64 << 20, index_every: int = INDEX_EVERY, sync: bool = True, clock: Callable[[], int] = lambda: time.time_ns() // 1_000_000):
        self.folder, self.segment_bytes, self.index_every, self.sync, self.clock = Path(path) / str(partition), segment_bytes, index_every, sync, clock
        self.folder.mkdir(parents=True, exist_ok=True)
        self.lock = open(self.folder / ".lock", "w")  # noqa: SIM115
        fcntl.flock(self.lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
        known = own_segments(str(self.folder))
        self.offset = 0
        if known:
            self.offset, position = known[-1].end()
            with open(known[-1].file, "r+b") as f:
                f.truncate(position)
            kept = [x for x in known[-1].index()[1:] if x[1] <= position]
            Path(f"{known[-1].file}.idx").write_bytes(b"".join(_ENTRY.pack(*x) for x in kept))
            self._open(known[-1].base)
        else:
            self._open(0)

    def _open(self, base: int) -> None:
        name = self.folder / f"{base:020d}.log"
        self.base, self.file, self.index = base, open(name, "ab"), open(f"{name}.idx", "ab")  # noqa: SIM115
        if self.sync:  # the names too are to survive
            folder = os.open(self.folder, os.O_RDONLY)
            os.fsync(folder)
            os.close(folder)

    def add_all(self, records: Iterable[Record]) -> int:
        """Append records with one wait for the disk; the offset after them."""
        if self.file.tell() >= self.segment_bytes:
            self._close()
            self._open(self.offset)
        entries = []
        for record in records:
            if self.offset % self.index_every == 0 and self.offset > self.base:
                entries.append((self.offset, self.file.tell()))
            self.file.write(frame(encode(record)))
            self.offset += 1
        self.file.flush()
        if self.sync:
            os.fdatasync(self.file.fileno())
        for entry in entries:  # an entry names only what is on disk
            self.index.write(_ENTRY.pack(*entry))
        self.index.flush()
        return self.offset

    def add(self, payload: bytes, enqueue_time: int | None = None, *, key: bytes | None = None, headers: list[tuple[str, bytes | None]] | None = None) -> int:
        """Append one record; its offset."""
        return self.add_all([Record(self.clock() if enqueue_time is None else enqueue_time, key, bytes(payload), headers)]) - 1

    def roll_if_due(self) -> None:
        """Nothing waits in memory."""

    def _close(self) -> None:
        self.file.close()
        self.index.close()

    def close(self) -> None:
        self._close()
        self.lock.close()


def own_segments(folder: str) -> list[Segment]:
    try:
        names = os.listdir(folder)
    except FileNotFoundError:
        return []
    bases = sorted(int(x[:-4]) for x in names if x.endswith(".log") and x[:-4].isdigit())
    found = [Segment(f"{folder}/{b:020d}.log", b) for b in bases]
    return [Segment(s.file, s.base, n.base - s.base) for s, n in zip(found, found[1:], strict=False)] + found[-1:]


def _commits(path: str) -> list[str]:
    try:
        return sorted(x for x in os.listdir(f"{path}/{COMMITS}") if x.endswith(".json"))
    except FileNotFoundError:
        return []


def _commit(path: str, name: str) -> dict:
    return json.loads(Path(path, COMMITS, name).read_text())


def partitions_of(path: str) -> list[int]:
    committed = _commits(path)
    if committed:
        return sorted(map(int, _commit(path, committed[-1])["last"]))
    return sorted(int(x) for x in (os.listdir(path) if os.path.isdir(path) else ()) if x.isdigit())


def last_segments(path: str) -> dict[int, Segment]:
    """The last segment of each partition; of a committed log from the last commit alone."""
    committed = _commits(path)
    if committed:
        return {int(p): Segment(f"{path}/{file}", base, count) for p, (file, base, count) in _commit(path, committed[-1])["last"].items()}
    return {p: own[-1] for p in partitions_of(path) if (own := own_segments(f"{path}/{p}"))}


def segments(path: str) -> dict[int, list[Segment]]:
    """All segments of each partition by offset. Commits are read from the last that names all."""
    committed = _commits(path)
    if not committed:
        return {p: own_segments(f"{path}/{p}") for p in partitions_of(path)}
    whole = max((k for k, x in enumerate(committed) if x.endswith(".all.json")), default=0)
    out: dict[int, list[Segment]] = {}
    for k, name in enumerate(committed[whole:]):
        commit = _commit(path, name)
        for p, file, base, count in commit["all"] if k == 0 and "all" in commit else commit["added"]:
            out.setdefault(p, []).append(Segment(f"{path}/{file}", base, count))
    return out


def ends(path: str) -> dict[int, int]:
    return {p: s.end()[0] for p, s in last_segments(path).items()}


def read_range(path: str, partition: int, start: int, end: int) -> Iterator[tuple[int, Record]]:
    """Records of one partition, ``end`` not among them. Segments before ``start`` aren't opened."""
    last = last_segments(path).get(partition)
    own = [last] if last is not None and last.base <= start else segments(path).get(partition, [])
    for k, s in enumerate(own):
        if s.base >= end or k + 1 < len(own) and own[k + 1].base <= start:
            continue
        for offset, _, data in s.frames(max(start, s.base)):
            if offset >= end:
                return
            yield offset, decode(data)


def commit_segments(path: str, run: str, batch: int, added: list[tuple[int, int, str, int]]) -> bool:
    """Make segments (order, partition, file, count) part of the log, all at once. Those of a batch
    that is in the log already are deleted: False."""
    committed = _commits(path)
    before = _commit(path, committed[-1]) if committed else {"last": {}, "runs": {}}
    if batch <= before["runs"].get(run, -1):
        for _, _, file, _ in added:
            for x in (f"{path}/{file}", f"{path}/{file}.idx"):
                if os.path.exists(x):
                    os.remove(x)
        return False
    last, placed = dict(before["last"]), []
    for _, partition, file, count in sorted(added):
        base = last[str(partition)][1] + last[str(partition)][2] if str(partition) in last else 0
        last[str(partition)] = [file, base, count]
        placed.append([partition, file, base, count])
    commit: dict[str, Any] = {"run": run, "batch": batch, "added": placed, "last": last, "runs": before["runs"] | {run: batch}}
    number = len(committed)
    if number % ALL_EVERY == ALL_EVERY - 1:
        commit["all"] = [[p, os.path.relpath(s.file, path), s.base, s.count] for p, own in segments(path).items() for s in own] + placed
    folder = Path(path, COMMITS)
    folder.mkdir(parents=True, exist_ok=True)
    draft = folder / f".{uuid.uuid4().hex}"
    with open(draft, "w") as f:
        json.dump(commit, f)
        f.flush()
        os.fsync(f.fileno())
    os.link(draft, folder / f"{number:020d}{'.all' if 'all' in commit else ''}.json")  # fails if another writer was first
    os.remove(draft)
    return True


@dataclass
class Written(WriterCommitMessage):
    order: int
    files: list[tuple[int, str, int]]


def frames_of(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    """The rows of a batch, each with its partition and as a frame."""
    now, names = time.time_ns() // 1_000_000, batch.schema.names
    times = batch.column("timestamp").to_pylist() if "timestamp" in names else [None] * len(batch)
    headers = batch.column("headers")
    valid, ends = headers.is_valid().to_pylist(), headers.offsets.to_pylist()
    known: dict[str, bytes] = {}
    flat = []  # of each header, its name and value
    for name, value in zip(*(headers.values.field(k).to_pylist() for k in (0, 1)), strict=True):
        if name not in known:
            known[name] = _part(name.encode())
        flat.append(known[name] + _part(value))
    for k, (partition, at, key, value) in enumerate(zip(batch.column("partition").to_pylist(), times, batch.column("key").to_pylist(), batch.column("value").to_pylist(), strict=True)):
        own = flat[ends[k] : ends[k + 1]] if valid[k] else []
        yield partition, frame(b"".join([struct.pack("<q", at or now), _part(key), _part(value), struct.pack("<i", len(own) if valid[k] else -1), *own]))


def _frames(rows: Iterator[Any]) -> Iterator[tuple[int, bytes]]:
    for row in rows:
        headers = row["headers"]
        yield row["partition"], frame(encode(Record(getattr(row, "timestamp", None) or time.time_ns() // 1_000_000, row["key"], row["value"], None if headers is None else [(h["key"], h["value"]) for h in headers])))


def write_segments(path: str, rows: Iterator[Any]) -> Written:
    """Write a task's rows as segments, one for each partition, on disk when this returns."""
    return write_frames(path, _frames(rows))


def write_frames(path: str, frames: Iterable[tuple[int, bytes]]) -> Written:
    files: dict[int, tuple[str, Any, list[tuple[int, int]], list[int]]] = {}
    for partition, data in frames:
        if partition not in files:
            name = f"{partition}/{uuid.uuid4().hex}.log"
            os.makedirs(f"{path}/{partition}", exist_ok=True)
            files[partition] = name, open(f"{path}/{name}", "wb"), [], [0]  # noqa: SIM115
        _, file, index, count = files[partition]
        if count[0] and count[0] % INDEX_EVERY == 0:
            index.append((count[0], file.tell()))
        file.write(data)
        count[0] += 1
    for name, file, index, _ in files.values():
        file.flush()
        os.fsync(file.fileno())
        file.close()
        Path(f"{path}/{name}.idx").write_bytes(b"".join(_ENTRY.pack(*x) for x in index))
    context = TaskContext.get()
    return Written(context.partitionId() if context else 0, [(p, name, count[0]) for p, (name, _, _, count) in files.items()])


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.run, self.batch = local(options["path"]), options.get("run", "batch"), options.get("batch")

    def write(self, iterator: Iterator[Any]) -> Written:
        return write_segments(self.path, iterator)

    def _added(self, messages: list[Written | None]) -> list[tuple[int, int, str, int]]:
        return [(m.order, p, name, count) for m in messages if m is not None for p, name, count in m.files]

    def commit(self, messages: list[Written | None]) -> None:
        batch = int(self.batch) if self.batch is not None else time.time_ns()
        commit_segments(self.path, self.run, batch, self._added(messages))

    def abort(self, messages: list[Written | None]) -> None:
        for _, _, name, _ in self._added(messages):
            for x in (f"{self.path}/{name}", f"{self.path}/{name}.idx"):
                if os.path.exists(x):
                    os.remove(x)


class _BatchWriter(_Writer, DataSourceArrowWriter):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return write_frames(self.path, (x for batch in iterator for x in frames_of(batch)))


class _StreamWriter(_Writer, DataSourceStreamWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        commit_segments(self.path, self.run, batchId, self._added(messages))

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        super().abort(messages)


@dataclass
class _Range(InputPartition):
    partition: int
    start: int
    end: int


def _start(given: str, end: dict[int, int]) -> dict[int, int]:
    """Offsets to begin at: ``earliest``, ``latest``, ``tail:N`` (the last N of each partition) or JSON
    of offsets by partition; partitions that it lacks begin at 0."""
    if given == "latest":
        return dict(end)
    if given.startswith("tail:"):
        return {p: max(0, e - int(given[5:])) for p, e in end.items()}
    known = {} if given == "earliest" else {int(p): max(0, o) for p, o in json.loads(given).items()}
    return {p: known.get(p, 0) for p in end}


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.begin, self.split = local(options["path"]), options.get("start", "earliest"), int(options.get("split", 1_000_000))

    def partitions(self) -> list[_Range]:
        end = ends(self.path)
        start = _start(self.begin, end)
        return [_Range(p, a, min(e, a + self.split)) for p, e in end.items() for a in range(start[p], e, self.split)] or [_Range(0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for offset, r in read_range(self.path, partition.partition, partition.start, partition.end):
            rows.append({"partition": partition.partition, "offset": offset, "timestamp": r.timestamp, "key": r.key, "value": r.value, "headers": None if r.headers is None else [{"key": k, "value": v} for k, v in r.headers]})
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_pylist(rows, schema=_FIELDS)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_FIELDS)


class _StreamReader(DataSourceStreamReader):
    """``limit``: how many records of a partition a micro-batch takes at most; the first one after a
    restart from a checkpoint takes what there is."""

    def __init__(self, options: dict):
        self.path, self.begin, self.limit = local(options["path"]), options.get("start", "earliest"), int(options.get("limit", 100_000))
        self.reader = _Reader(options)
        self.told: dict[str, int] | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        self.told = {str(p): o for p, o in _start(self.begin, ends(self.path)).items()}
        return self.told

    def latestOffset(self) -> dict:  # noqa: N802
        before = self.told or {}
        self.told = {str(p): min(e, before.get(str(p), e) + self.limit) for p, e in ends(self.path).items()}
        return self.told

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        return [_Range(int(p), start.get(p, 0), e) for p, e in end.items() if e > start.get(p, 0)] or [_Range(0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        return self.reader.read(partition)

    def commit(self, end: dict) -> None:
        pass


class LogDataSource(DataSource):
    """``spark.read`` and ``spark.readStream`` with ``format("seamline_log")``: options path, start, and
    split (batch) or limit (stream). Reads are planned from index and commits alone: an input
    partition is a range of offsets. ``write`` and ``writeStream``: rows of partition, key, value and
    headers, option ``run``, the name of the query that writes, and, for a batch, ``batch``, its
    number in that run; a batch that is there already is left out."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return LOG_SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options)

    def streamReader(self, schema: StructType) -> _StreamReader:  # noqa: N802
        return _StreamReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("a log is only appended to")
        return _BatchWriter(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> _StreamWriter:  # noqa: N802
        return _StreamWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogDataSource)


def read_log(spark: SparkSession, path: str, start: str = "earliest") -> DataFrame:
    register(spark)
    return spark.read.format(NAME).option("start", start).load(path)


def tail_of(spark: SparkSession, path: str, n: int = 1) -> DataFrame:
    """The last ``n`` records of each partition; nothing else is read."""
    return read_log(spark, path, f"tail:{n}")


def read_topics(spark: SparkSession, topics: dict[str, str], start: dict[str, dict[str, int]] | str = "earliest", limit: int = 100_000) -> DataFrame:
    """Logs of capture topics as one Kafka-shaped stream. ``topics``: name to path; ``start``: as for a
    Kafka source, offsets by topic and partition, or one word for all."""
    register(spark)
    out = None
    for topic, path in topics.items():
        begin = start if isinstance(start, str) else json.dumps(start.get(topic, {}))
        rows = spark.readStream.format(NAME).option("start", begin).option("limit", limit).load(path)
        rows = rows.select("key", "value", F.lit(topic).alias("topic"), "partition", "offset", F.timestamp_millis("timestamp").alias("timestamp"), F.lit(0).alias("timestampType"), "headers")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no topics")
    return out


def log_sink(path: str, run: str) -> Callable[[DataFrame, int], None]:
    """What writes the outbound rows of a micro-batch to a log, once even if the batch is repeated. A
    partition's rows keep their order within a task and from task to task."""

    def put(rows: DataFrame, batch: int) -> None:
        register(rows.sparkSession)
        rows.write.format(NAME).option("run", run).option("batch", batch).mode("append").save(path)

    return put
