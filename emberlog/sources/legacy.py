"""Binary snapshots of earlier stores: import and export of both of their layouts.

Little-endian: eight bytes that name the format (six letters, which the caller gives, and a version, 04 or
05), shards with their entries, then source offsets. Bytes after the end are ignored.

A snapshot is one file without an index, so one task finds where entries begin (it reads lengths only, in a
window of SPLIT bytes), and one task puts the file together (it copies parts); entries are decoded and encoded
by many tasks. The driver gets positions and sizes: a row for each SPLIT bytes or PART entries. Executors
open the files by pyarrow, so they must be in a folder that executors share and pyarrow knows.
"""

from __future__ import annotations

import io
import json
import os
import shutil
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import split_capacity
from ..errors import SnapshotError
from ..operators.store import LogStore, Offsets, Shard, Version
from ..schema import ARRIVALS_SCHEMA, LOG_COLUMNS
from ..storage import Folder
from ..workers import import_here

#: Bytes of a snapshot that a task decodes.
SPLIT = 16 << 20
#: Entries of a shard that are encoded as one part.
PART = 250_000

_ARROW = pa.schema([("local_offset", pa.int64()), ("timestamp", pa.int64()), *((c, pa.string()) for c in LOG_COLUMNS[1:]), ("shard", pa.int32())])
_SPANS = "task int, shard int, first bigint, at bigint, size bigint, entries bigint"
_PARTS = "shard int, first bigint, entries bigint, file string"

_u32, _i64 = struct.Struct("<I").unpack_from, struct.Struct("<q").unpack_from


class _Reader:
    """Reads a file in windows of ``split`` bytes, of which at least half are ahead, or all to the end."""

    def __init__(self, file: io.BufferedIOBase | pa.NativeFile, split: int):
        self.file, self.split, self.at = file, split, 0
        self.size = file.seek(0, io.SEEK_END)
        self.window, self.base = b"", 0

    def ahead(self) -> tuple[bytes, int]:
        """The window, and where in it the reader is."""
        end = self.base + len(self.window)
        if not self.base <= self.at <= end or end < min(self.at + self.split // 2, self.size):
            self.file.seek(self.at)
            self.window, self.base = self.file.read(min(self.split, self.size - self.at)), self.at
        return self.window, self.at - self.base

    def take(self, count: int) -> bytes:
        if self.at + count > self.size:
            raise SnapshotError("the snapshot ends too early")
        if count > self.split // 2:
            self.file.seek(self.at)
            part = self.file.read(count)
        else:
            window, p = self.ahead()
            part = window[p : p + count]
        self.at += count
        return part

    def number(self, kind: str) -> int:
        return struct.unpack("<" + kind, self.take(struct.calcsize(kind)))[0]

    def text(self) -> str:
        try:
            return self.take(self.number("I")).decode()
        except UnicodeDecodeError as e:
            raise SnapshotError("a text of the snapshot isn't UTF-8") from e

    def _pass(self, count: int) -> None:
        if self.at + count > self.size:
            raise SnapshotError("the snapshot ends too early")
        self.at += count

    def spans(self, count: int) -> Iterator[tuple[int, int, int]]:
        """Passes ``count`` entries; position, bytes and entries of what lies in one window."""
        while count:
            begin, (window, start) = self.at, self.ahead()
            p, done = start, 0
            try:
                while done < count:
                    q = p + 12 + _u32(window, p + 8)[0]
                    q += 4 + _u32(window, q)[0]
                    q += 4 + _u32(window, q)[0]
                    if q > len(window):
                        break
                    p, done = q, done + 1
            except struct.error:
                pass  # a length beyond the window
            self.at += p - start
            if not done:  # an entry beyond the window
                self._pass(8)
                for _ in range(3):
                    self._pass(self.number("I"))
                done = 1
            yield begin, self.at - begin, done
            count -= done


def _laid_out(file: io.BufferedIOBase | pa.NativeFile, name: bytes, split: int) -> tuple[list[Shard], list[tuple], Offsets]:
    """Shards, rows of _SPANS (tasks are numbered by position), and offsets."""
    r = _Reader(file, split)
    magic = r.take(8)
    if magic not in (name + b"04", name + b"05"):
        raise SnapshotError("these bytes don't begin like a snapshot")
    total = r.number("Q") if magic[6:] == b"04" else None
    count = r.number("I")
    if not count:
        raise SnapshotError("a snapshot must contain at least one shard")
    shares = split_capacity(total, count) if total is not None else None
    shards, spans = [], []
    for k in range(count):
        number = r.number("I")
        if number >= count:
            raise SnapshotError("shard ids must run from 0 without gaps")
        capacity = shares[k] if shares else r.number("Q")
        end, size = r.number("Q"), r.number("Q")
        if end < size:
            raise SnapshotError("a shard's next offset must be at least its number of live entries")
        first = end - size
        for at, length, entries in r.spans(size):
            spans.append((at // split, number, first, at, length, entries))
            first += entries
        shards.append(Shard(number, capacity, end - size, end))
    offsets = Offsets()
    for _ in range(r.number("I")):
        topic = r.text()
        for _ in range(r.number("I")):
            partition = r.number("I")
            offsets.set(topic, partition, r.number("Q"))
    return shards, spans, offsets


def _decoded(data: bytes, shard: int, first: int, entries: int) -> pa.RecordBatch:
    """Entries as rows of ARRIVALS_SCHEMA."""
    times, services, hosts, messages, p = [], [], [], [], 0
    for _ in range(entries):
        a = p + 12 + _u32(data, p + 8)[0]
        b = a + 4 + _u32(data, a)[0]
        c = b + 4 + _u32(data, b)[0]
        times.append(_i64(data, p)[0])
        services.append(data[p + 12 : a])
        hosts.append(data[a + 4 : b])
        messages.append(data[b + 4 : c])
        p = c
    try:
        texts = [pa.array(x, pa.binary()).cast(pa.string()) for x in (services, hosts, messages)]
    except pa.ArrowInvalid as e:
        raise SnapshotError("a text of the snapshot isn't UTF-8") from e
    numbers = pa.array(np.arange(entries, dtype=np.int64) + first)
    return pa.RecordBatch.from_arrays([numbers, pa.array(times, pa.int64()), *texts, pa.array(np.full(entries, shard, np.int32))], schema=_ARROW)


def _read(file: io.BufferedIOBase | pa.NativeFile, at: int, size: int) -> bytes:
    file.seek(at)
    return file.read(size)


def parsed(data: bytes, name: bytes) -> tuple[list[Shard], list[tuple], Offsets]:
    """Shards, rows of ARRIVALS_SCHEMA, and offsets. ``name``: the format's letters, exactly."""
    file = io.BytesIO(data)
    shards, spans, offsets = _laid_out(file, name, SPLIT)
    batches = [_decoded(_read(file, at, size), shard, first, entries) for _, shard, first, at, size, entries in spans]
    return shards, [row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))], offsets


def import_snapshot(spark: SparkSession, data: bytes, root: str, name: bytes, router: str = "sip13") -> tuple[LogStore, Offsets]:
    """A store at ``root`` with the state of a binary snapshot that the driver holds: see ``import_file``
    for those of any size."""
    shards, rows, offsets = parsed(data, name)
    return _restored(spark, root, router, shards, spark.createDataFrame(rows, ARRIVALS_SCHEMA) if rows else None, offsets), offsets


def _restored(spark: SparkSession, root: str, router: str, shards: list[Shard], rows: DataFrame | None, offsets: Offsets) -> LogStore:
    return LogStore.restored(spark, root, Version(0, router, tuple(sorted(shards, key=lambda s: s.shard)), offsets=offsets), rows)


Batches = Iterator[pa.RecordBatch]


def _surveyed(uri: str, name: bytes, split: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            if not batch.num_rows:
                continue
            system, path = fs.FileSystem.from_uri(uri)
            try:
                with system.open_input_file(path) as file:
                    shards, spans, offsets = _laid_out(file, name, split)
                found = {"shards": [(s.shard, s.capacity, s.oldest_offset, s.next_offset) for s in shards], "spans": spans, "offsets": offsets.inner()}
            except SnapshotError as e:
                found = {"error": str(e)}
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(found)])], ["found"])

    return run


def _spans_decoded(uri: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as file:
            for batch in batches:
                for x in batch.to_pylist():
                    yield _decoded(_read(file, x["at"], x["size"]), x["shard"], x["first"], x["entries"])

    return run


def import_file(spark: SparkSession, path: str, root: str, name: bytes, router: str = "sip13") -> tuple[LogStore, Offsets]:
    """A store at ``root`` with the state of a binary snapshot of any size, which executors read."""
    import_here(spark)
    folder, _, file = path.rpartition("/")
    source, target, staged = Folder(spark, folder), Folder(spark, root), f"import-{uuid.uuid4().hex}"
    if file not in source.names():
        raise SnapshotError(f"there is no snapshot at {path}")
    uri = source.uri(file)
    found = json.loads(spark.range(0, 1, 1, 1).mapInArrow(_surveyed(uri, name, SPLIT), "found string").first().found)
    if "error" in found:
        raise SnapshotError(found["error"])
    shards, offsets, rows = [Shard(*s) for s in found["shards"]], Offsets(found["offsets"]), None
    try:
        if found["spans"]:
            tasks = found["spans"][-1][0] + 1
            spans = spark.createDataFrame([tuple(x) for x in found["spans"]], _SPANS).repartitionById(tasks, F.col("task"))
            # the checks and the store's layout read the rows several times
            try:
                spans.mapInArrow(_spans_decoded(uri), ARRIVALS_SCHEMA).write.parquet(target.path(staged))
            except Exception as e:
                if "SnapshotError: " in str(e):
                    raise SnapshotError("a text of the snapshot isn't UTF-8") from e
                raise
            rows = spark.read.schema(ARRIVALS_SCHEMA).parquet(target.path(staged))
        return _restored(spark, root, router, shards, rows, offsets), offsets
    finally:
        target.delete(staged)


def _text(value: str) -> bytes:
    data = value.encode()
    return struct.pack("<I", len(data)) + data


def _framed(version: Version, entries: dict[int, tuple[int, list]], name: bytes, offsets: Offsets | None, layout: bytes) -> list:
    """A snapshot's pieces in order. ``entries``: of each shard their number and pieces."""
    old = layout == b"04"
    out = [name + layout, struct.pack("<Q", sum(s.capacity for s in version.shards)) if old else b"", struct.pack("<I", len(version.shards))]
    for s in version.shards:
        count, pieces = entries.get(s.shard, (0, []))
        capacity = b"" if old else struct.pack("<Q", s.capacity)
        out += [struct.pack("<I", s.shard), capacity, struct.pack("<QQ", s.next_offset, count), *pieces]
    topics = (offsets or version.offsets).inner()
    out.append(struct.pack("<I", len(topics)))
    for topic, partitions in topics.items():
        out += [_text(topic), struct.pack("<I", len(partitions)), *(struct.pack("<IQ", p, o) for p, o in sorted(partitions.items()))]
    return out


def exported(store: LogStore, name: bytes, offsets: Offsets | None = None, layout: bytes = b"05") -> bytes:
    """A store's live rows, shards and offsets as a binary snapshot, for earlier stores (``layout`` 04
    has one capacity for all shards together). It is put together on the driver, whose memory must hold
    it: see ``export_snapshot`` for stores of any size."""
    version, rows = store.pinned()
    entries: dict[int, list[bytes]] = {}
    for r in rows.orderBy("shard", "local_offset").toLocalIterator():
        entries.setdefault(r.shard, []).append(struct.pack("<q", r.timestamp) + _text(r.service_name) + _text(r.host_id) + _text(r.message))
    return b"".join(_framed(version, {k: (len(x), x) for k, x in entries.items()}, name, offsets, layout))


def _as_bytes(values: np.ndarray) -> pa.Array:
    """The bytes of each number."""
    bounds = np.arange(len(values) + 1, dtype=np.int64) * values.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(values), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(values))])


def _encoded(rows: pa.RecordBatch) -> pa.Array:
    """Each row as an entry."""
    if any(rows.column(c).null_count for c in LOG_COLUMNS):
        raise SnapshotError("binary snapshots have no nulls")
    pieces = [_as_bytes(rows.column("timestamp").to_numpy().astype("<i8"))]
    for c in LOG_COLUMNS[1:]:
        text = rows.column(c)
        pieces += [_as_bytes(pc.binary_length(text).to_numpy().astype("<u4")), text.cast(pa.large_binary())]
    return pc.binary_join_element_wise(*pieces, pa.scalar(b"", pa.large_binary()))


def _parted(uri: str) -> Callable[[Batches], Batches]:
    """Writes the entries of each (shard, part) of sorted rows to a file; yields rows of _PARTS."""

    def run(batches: Batches) -> Batches:
        system, folder = fs.FileSystem.from_uri(uri)
        out, key, part = None, None, []

        def ended() -> Batches:
            if out:
                out.close()
                yield pa.RecordBatch.from_arrays([pa.array([part[0]], pa.int32()), *(pa.array([x], pa.int64()) for x in part[1:3]), pa.array([part[3]])], ["shard", "first", "entries", "file"])

        for batch in batches:
            if not batch.num_rows:
                continue
            entries, shard, number, first = _encoded(batch), *(batch.column(c).to_numpy() for c in ("shard", "part", "local_offset"))
            begins = np.flatnonzero(np.concatenate(([True], (shard[1:] != shard[:-1]) | (number[1:] != number[:-1]))))
            for i, j in zip(begins.tolist(), [*begins[1:].tolist(), batch.num_rows]):
                if key != (shard[i], number[i]):
                    yield from ended()
                    key, part = (shard[i], number[i]), [int(shard[i]), int(first[i]), 0, uuid.uuid4().hex]
                    out = system.open_output_stream(f"{folder}/{part[3]}")
                bounds = np.frombuffer(entries.buffers()[1], np.int64)[entries.offset :]
                out.write(entries.buffers()[2].slice(bounds[i], bounds[j] - bounds[i]))
                part[2] += j - i
        yield from ended()

    return run


def _assembled(uri: str, pieces: list, file: str) -> Callable[[Batches], Batches]:
    """Writes bytes and the files that are named, one after the other; yields the name of the new file,
    which each attempt chooses."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            if not batch.num_rows:
                continue
            system, folder = fs.FileSystem.from_uri(uri)
            name = f"{folder}/{file}-{uuid.uuid4().hex}"
            with system.open_output_stream(name) as out:
                for piece in pieces:
                    if isinstance(piece, bytes):
                        out.write(piece)
                    else:
                        with system.open_input_stream(f"{folder}/{piece}") as part:
                            shutil.copyfileobj(part, out, 1 << 20)
            if isinstance(system, fs.LocalFileSystem):
                with open(name, "rb+") as written:
                    os.fsync(written.fileno())
            yield pa.RecordBatch.from_arrays([pa.array([name.rpartition("/")[2]])], ["file"])

    return run


def export_snapshot(store: LogStore, path: str, name: bytes, offsets: Offsets | None = None, layout: bytes = b"05") -> None:
    """Writes what ``exported`` returns to a file, whole or not at all; a file that is there is replaced.
    Executors encode the entries and put them together, beside the file."""
    import_here(store.spark)
    at, _, file = path.rpartition("/")
    folder, parts = Folder(store.spark, at), f".{file}.{uuid.uuid4().hex}"
    folder.make(parts)
    uri = folder.uri(parts)
    try:
        version, rows = store.pinned()
        rows = rows.withColumn("part", F.expr(f"local_offset div {PART}")).repartition("shard", "part").sortWithinPartitions("shard", "local_offset")
        entries: dict[int, tuple[int, list]] = {}
        for r in sorted(rows.mapInArrow(_parted(uri), _PARTS).collect(), key=lambda r: (r.shard, r.first)):
            count, pieces = entries.get(r.shard, (0, []))
            entries[r.shard] = count + r.entries, [*pieces, r.file]
        whole = _assembled(uri, _framed(version, entries, name, offsets, layout), "whole")
        folder.replace(f"{parts}/{store.spark.range(0, 1, 1, 1).mapInArrow(whole, 'file string').first().file}", file)
    finally:
        folder.delete(parts)
