"""Repeated token windows of a corpus, found in one packed exchange.

Every window of ``n`` words of every text is hashed (64-bit Rabin-Karp) and sent to the task that its
hash selects: one row for each bundle of texts and task, with 8 bytes of hash and one to three of
position a window. There, equal hashes meet; each bundle gets back the positions of its windows that
occur elsewhere. Tasks grow in number with the corpus and are placed one by one, so each keeps its
size. What a task holds is sorted into parts of about PART_BYTES by Spark, which spills, and looked
at part by part, so memory depends neither on the corpus nor on a task's share of it. A bundle's
name is a hash of what it holds and of its place in the scan, so a task that runs again sends the
same rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binaries, decode_ascending, encode_ascending, group_bounds, joined, parts_for, pick
from .textarrays import STEP, U, Words, mix, places, slices, window_hashes

#: Bytes of text whose windows are sent together.
BUNDLE_BYTES = 8 << 20
#: Bytes of hashes in a batch that a worker hands over.
HANDED = 2 << 20
#: Estimated bytes of compressed text per part: about a million windows.
PART_BYTES = 4 << 20
#: Tasks of the exchange for each split of the scan (spark.sql.files.maxPartitionBytes).
TASKS_PER_SPLIT = 4
#: Windows that a task sorts into parts at once.
SORTED = 2_000_000
SENT = "task int, bundle bigint, hashes binary, at binary"
PARTED = "part int, bundles binary, hashes binary, at array<binary>"
FOUND = "bundle bigint, at binary, sums binary, texts binary"
_FOUND = pa.schema([("bundle", pa.int64()), ("at", pa.binary()), ("sums", pa.binary()), ("texts", pa.binary())])


def _texts(doc: np.ndarray, valid: np.ndarray, first: np.ndarray) -> bytes:
    return np.int64(len(doc)).tobytes() + doc.tobytes() + first.tobytes() + valid.tobytes()


def pieces(bounds: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of cuts with about ``most`` values each; a longer cut is a range of its own."""
    at, n = 0, len(bounds) - 1
    while at < n:
        to = min(max(int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1, at + 1), n)
        yield at, to
        at = to


def _sent(words: int, tasks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["task", "bundle", "hashes", "at"]

    def bundle(held: list[tuple], serial: int) -> Iterator[pa.RecordBatch]:
        ids, counts, hashes, starts, sums = zip(*held)
        ends = np.cumsum([0, *(int(c.sum()) for c in counts)])
        # word numbers of a bundle fit in 32 bits, unless one text alone has more
        kind = np.int32 if ends[-1] < 1 << 31 else np.int64
        hashes, at = np.concatenate(hashes), np.concatenate([(a + e).astype(kind) for a, e in zip(starts, ends)])
        if not len(at):
            return
        ids = pa.chunked_array(ids, pa.int64())
        doc, valid = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy().astype(np.uint8)
        first = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
        salt = np.concatenate((doc.astype(U), valid.astype(U), first.astype(U), [*sums, U(TaskContext.get().partitionId()), U(serial)]))
        name = mix(salt * (np.arange(1, len(salt) + 1, dtype=U) * U(2) + U(1))).sum(dtype=U).view(np.int64)
        task = ((hashes >> U(32)) % U(tasks)).astype(np.uint16 if tasks <= 65536 else np.int32)
        order = np.argsort(task, kind="stable")
        to, bounds = group_bounds(task[order])
        to, hashes, at = to.astype(np.int32), hashes[order], at[order]
        for a, b in pieces(bounds, HANDED // 8):
            mine = slice(bounds[a], bounds[b])
            cuts = bounds[a : b + 1] - bounds[a]
            yield pa.RecordBatch.from_arrays([pa.array(to[a:b]), pa.array(np.full(b - a, name)), binaries(hashes[mine], cuts), encode_ascending(at[mine], cuts)], names)
        home = [pa.array([int(name % tasks)], pa.int32()), pa.array([name]), pa.nulls(1, pa.binary()), pa.array([_texts(doc, valid, first)], pa.binary())]
        yield pa.RecordBatch.from_arrays(home, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, serial = [], 0, 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts):
                found = Words.of(texts.slice(a, b - a))
                hashes, at = window_hashes(h := found.hashes(), found.first, words)
                held.append((ids.slice(a, b - a), found.counts, hashes, at, h.sum(dtype=U)))
                size += len(found.raw)
                if size >= BUNDLE_BYTES:
                    yield from bundle(held, serial)
                    held, size, serial = [], 0, serial + 1
        if held:
            yield from bundle(held, serial)

    return run


def _parted(parts: int):
    """Sorts what a task receives into parts; rows that describe a bundle's texts pass, in part -1."""

    def rows(held: list[tuple]) -> pa.RecordBatch:
        bundle, hashes, at = zip(*held)
        at, counts = decode_ascending([*at])
        hashes = np.concatenate(hashes)
        part = ((hashes >> U(12)) % U(parts)).astype(np.int32)
        source = np.repeat(np.arange(len(bundle)), counts)
        order = np.argsort(part, kind="stable")
        to, bounds = group_bounds(part[order])
        names, lists = [], []
        for a, b in zip(bounds, bounds[1:]):
            mine, cuts = group_bounds(source[order[a:b]])
            names.append(np.array(bundle, np.int64)[mine].tobytes())
            lists.append(encode_ascending(at[order[a:b]], cuts).to_pylist())
        return pa.RecordBatch.from_arrays([pa.array(to), pa.array(names, pa.binary()), binaries(hashes[order], bounds), pa.array(lists, pa.list_(pa.binary()))], ["part", "bundles", "hashes", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, bundle, hashes, at in zip(*(c.to_pylist() for c in batch.columns)):
                if hashes is None:
                    texts = [pa.array([-1], pa.int32()), pa.array([np.int64(bundle).tobytes()], pa.binary()), pa.nulls(1, pa.binary()), pa.array([[at]], pa.list_(pa.binary()))]
                    yield pa.RecordBatch.from_arrays(texts, ["part", "bundles", "hashes", "at"])
                    continue
                held.append((bundle, np.frombuffer(hashes, U), at))
                size += len(hashes) // 8
                if size >= SORTED:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    return run


def _repeated(bundles: np.ndarray, hashes: np.ndarray, at: np.ndarray, counts: np.ndarray, sums: bool) -> pa.Table:
    """The windows of one part that occur more than once, by bundle. ``counts``: windows of each of ``bundles``."""
    order = np.argsort(hashes)
    _, bounds = group_bounds(hashes[order])
    sizes = np.diff(bounds)
    repeated = np.zeros(len(hashes), bool)
    repeated[order] = np.repeat(sizes > 1, sizes)
    keep = np.flatnonzero(repeated)
    cuts = np.searchsorted(keep, np.concatenate(([0], np.cumsum(counts))))
    none = pa.nulls(len(bundles), pa.binary())
    totals = none
    if sums:
        # a place is worth its bundle's number times a power of STEP: the sum over the places
        # that follow is STEP times the sum
        up, _ = places.get(int(at.max(initial=0)) + 1)
        worth = mix(np.repeat(bundles.view(U), counts)) | U(1)
        worth *= up[at]
        total = np.zeros(len(hashes), U)
        if len(order):
            total[order] = np.repeat(np.add.reduceat(worth[order], bounds[:-1]), sizes)
        totals = binaries(total[keep], cuts)
    return pa.table([pa.array(bundles), encode_ascending(at[keep], cuts), totals, none], schema=_FOUND).filter(pa.array(np.diff(cuts) > 0))


def _described(bundles: list[int], texts: list[bytes]) -> pa.Table:
    none = pa.nulls(len(bundles), pa.binary())
    return pa.table([pa.array(bundles, pa.int64()), none, none, pa.array(texts, pa.binary())], schema=_FOUND)


def _found(sums: bool):
    """Over all rows of a task, which is one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            is_text = batch.column("hashes").is_null()
            texts = batch.filter(is_text)
            if texts.num_rows:
                yield from _described(texts.column("bundle").to_pylist(), texts.column("at").to_pylist()).to_batches()
            held.append(batch.filter(pa.compute.invert(is_text)))
        if held:
            sent = pa.Table.from_batches(held)
            at, counts = decode_ascending(sent["at"].to_pylist())
            yield from _repeated(sent["bundle"].to_numpy(), joined(sent["hashes"], U), at, counts, sums).to_batches()

    return run


def _found_by_part(sums: bool):
    """Over rows of _parted, sorted by part."""

    def part_of(rows: list[dict]) -> pa.Table:
        at, counts = decode_ascending([x for r in rows for x in r["at"]])
        bundles = np.frombuffer(b"".join(r["bundles"] for r in rows), np.int64)
        return _repeated(bundles, np.frombuffer(b"".join(r["hashes"] for r in rows), U), at, counts, sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                if r["hashes"] is None:
                    yield from _described([int(np.frombuffer(r["bundles"], np.int64)[0])], r["at"]).to_batches()
                    continue
                if held and r["part"] != held[-1]["part"]:
                    yield from part_of(held).to_batches()
                    held = []
                held.append(r)
        if held:
            yield from part_of(held).to_batches()

    return run


def shares(spark: SparkSession) -> tuple[int, int]:
    """Compressed bytes of a task's share, and the parts that it is sorted into: both follow the
    session's spark.sql.files.maxPartitionBytes, not the input."""
    jvm = spark._jvm.org.apache.spark.network.util.JavaUtils
    split = jvm.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes", "128m"))
    share = max(1, split // TASKS_PER_SPLIT)
    return share, max(1, math.ceil(share / PART_BYTES))


def repeated_windows(docs: DataFrame, words: int, sums: bool = False) -> DataFrame:
    """The windows of ``words`` words that occur more than once in ``docs``, by bundle of texts (FOUND).

    ``sums`` adds for each window the sum, over all its occurrences, of what their places are worth:
    it names the window, and STEP times it is the next window's name exactly if the two always
    occur together (else with a chance of about 2**-60).
    """
    docs = pick(docs, "doc_id", "text").where(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    share, parts = shares(docs.sparkSession)
    tasks = parts_for(docs, share)
    sent = docs.mapInArrow(_sent(words, tasks), SENT).repartitionById(tasks, F.col("task"))
    if parts == 1:
        return sent.mapInArrow(_found(sums), FOUND)
    return sent.mapInArrow(_parted(parts), PARTED).sortWithinPartitions("part").mapInArrow(_found_by_part(sums), FOUND)


class Bundle:
    """What one bundle of texts got back: its repeated windows, by ascending word index ``at``."""

    def __init__(self, group: pa.Table):
        rows = group.to_pylist()
        texts = next(r["texts"] for r in rows if r["texts"] is not None)
        n = int(np.frombuffer(texts, np.int64, 1)[0])
        self.name = np.int64(rows[0]["bundle"])
        self.ids, self.first = np.frombuffer(texts, np.int64, n, 8), np.frombuffer(texts, np.int64, n + 1, 8 + 8 * n)
        self.valid = np.frombuffer(texts, np.uint8, n, 16 + 16 * n).astype(bool)
        rows = [r for r in rows if r["at"] is not None]
        at, _ = decode_ascending([r["at"] for r in rows])
        self.at, keep = np.unique(at, return_index=True)
        self.doc = np.searchsorted(self.first, self.at, "right") - 1
        self.pos = self.at - self.first[self.doc]
        some = bool(rows) and rows[0]["sums"] is not None
        self.sums = np.frombuffer(b"".join(r["sums"] for r in rows), U)[keep] if some else None
