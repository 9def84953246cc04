"""A bounded log store as a versioned table.

``arrivals`` are Parquet files partitioned by shard, sorted by host and time within a file. A
version is a small JSON manifest, written last and atomically: it names the files and holds each
shard's capacity and offset bounds, the source's offsets and the last batch of each stream. Readers
pin one version, so all shards are seen at one cut. Writers that lose a race for a version fail.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import LogError, RoutingError, SnapshotError
from ..functions.routing import ROUTERS, Md5Router, SipRouter
from ..plans import lookup
from ..schema import ARRIVALS_SCHEMA, LOG_COLUMNS
from ..storage import Folder
from . import offsets as offsets_
from .offsets import live, local_offsets, postings

MIN, MAX = -(1 << 63), (1 << 63) - 1
#: Commits of one level that ``ingest`` merges into one of the next: a row is written again a number of
#: times that grows with the logarithm of the commits, and their number stays as small.
MERGED = 16


class Offsets:
    """Source offsets by topic and partition."""

    def __init__(self, found: dict[str, dict[int, int]] | None = None):
        self._found = {t: {int(p): o for p, o in ps.items()} for t, ps in (found or {}).items()}

    def set(self, topic: str, partition: int, offset: int) -> None:
        self._found.setdefault(topic, {})[partition] = offset

    def get(self, topic: str, partition: int) -> int | None:
        return self._found.get(topic, {}).get(partition)

    def inner(self) -> dict[str, dict[int, int]]:
        return self._found

    def starting(self) -> dict[str, dict[str, int]]:
        """As the ``startingOffsets`` of a Kafka source."""
        return {t: {str(p): o for p, o in sorted(ps.items())} for t, ps in sorted(self._found.items())}

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Offsets) and self._found == other._found

    def __repr__(self) -> str:
        return f"Offsets({self._found})"


@dataclass(frozen=True)
class Shard:
    shard: int
    capacity: int
    oldest_offset: int = 0
    next_offset: int = 0

    @property
    def live(self) -> int:
        return self.next_offset - self.oldest_offset

    def grown(self, count: int) -> Shard:
        """After ``count`` arrivals. A shard that was restored over its capacity is trimmed at its next write, as here."""
        if not count:
            return self
        end = self.next_offset + count
        return replace(self, next_offset=end, oldest_offset=max(self.oldest_offset, end - self.capacity))


@dataclass(frozen=True)
class Version:
    number: int
    router: str
    shards: tuple[Shard, ...]
    commits: tuple[str, ...] = ()
    offsets: Offsets = field(default_factory=Offsets)
    batches: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> dict:
        return {
            "number": self.number, "router": self.router, "commits": list(self.commits), "offsets": self.offsets.starting(), "batches": self.batches,
            "shards": [[s.shard, s.capacity, s.oldest_offset, s.next_offset] for s in self.shards],
        }

    @classmethod
    def from_json(cls, found: dict) -> Version:
        shards = tuple(sorted((Shard(*s) for s in found["shards"]), key=lambda s: s.shard))
        return cls(found["number"], found["router"], shards, tuple(found["commits"]), Offsets(found["offsets"]), dict(found["batches"]))


def _arrivals(folder: Folder, commits: tuple[str, ...]) -> DataFrame:
    """The rows of all commits, in one scan."""
    read = folder.spark.read.option("basePath", folder.path("arrivals")).schema(T.StructType([*ARRIVALS_SCHEMA, T.StructField("commit", T.StringType())]))
    return read.parquet(*(folder.path("arrivals", f"commit={c}") for c in commits)).drop("commit")


def _level(commit: str) -> int:
    return int(commit.partition("-")[0])


def _laid(rows: DataFrame) -> DataFrame:
    """Rows as they are written: a shard's chunks of offsets are each a task's work and a file, sorted by host and time."""
    chunk = F.expr(f"local_offset div {offsets_.CHUNK}")
    return rows.select(*(f.name for f in ARRIVALS_SCHEMA)).repartition("shard", chunk).sortWithinPartitions("shard", "host_id", "timestamp")


class LogStore:
    def __init__(self, spark: SparkSession, root: str):
        """Opens the store at ``root``."""
        self.spark, self.folder = spark, Folder(spark, root)
        if not self.folder.names("versions"):
            raise LogError(f"there is no store at {root}")

    # -- life cycle

    @classmethod
    def with_shards(cls, spark: SparkSession, root: str, capacity: int, shards: int = 1, router: str = "md5") -> LogStore:
        """A new store whose ``capacity`` is shared evenly by ``shards``."""
        if capacity <= 0 or shards <= 0:
            raise ValueError("capacity and shards must be positive")
        if capacity % shards:
            raise ValueError("capacity must be a multiple of the number of shards")
        first = Version(0, router, tuple(Shard(k, capacity // shards) for k in range(shards)))
        return cls._created(spark, root, first)

    @classmethod
    def _created(cls, spark: SparkSession, root: str, first: Version) -> LogStore:
        if not Folder(spark, root).write_json(first.to_json(), "versions", f"{first.number:012d}.json"):
            raise LogError(f"there is a store at {root} already")
        return cls(spark, root)

    def version(self) -> Version:
        return Version.from_json(self.folder.read_json("versions", [n for n in self.folder.names("versions") if not n.startswith(".")][-1]))

    def _commit(self, new: Version) -> None:
        if not self.folder.write_json(new.to_json(), "versions", f"{new.number:012d}.json"):
            raise LogError("another writer committed first")

    def _router(self, version: Version) -> Md5Router | SipRouter:
        return ROUTERS[version.router]

    # -- ingest

    def ingest(
        self, rows: DataFrame, order: tuple[str, ...] = ("arrival_seq",), offsets: Offsets | None = None, stream: str | None = None, batch: int | None = None, counts: dict[int, int] | None = None
    ) -> int:
        """Appends ``rows`` in ``order``, each to the shard that owns its host, and returns their number.

        With a ``stream`` and its ``batch`` number, a batch that was applied before is passed over
        (0), so a replay changes nothing. Rows that wouldn't survive their own batch aren't written.
        ``counts`` (rows by shard) saves a pass if the caller knows them.
        """
        version = self.version()
        if stream is not None and version.batches.get(stream, -1) >= batch:
            return 0
        routed = self._router(version).routed(rows.select(*LOG_COLUMNS, *(c for c in order if c not in LOG_COLUMNS)), len(version.shards))
        return self._append(version, routed, order, offsets, stream, batch, counts)

    def ingest_one(self, timestamp: int, service_name: str, host_id: str, message: str) -> int:
        """Appends one record and returns its local offset."""
        version = self.version()
        shard = version.shards[self._router(version).shard(host_id, len(version.shards))]
        row = self.spark.createDataFrame([(timestamp, service_name, host_id, message, 0)], "timestamp bigint, service_name string, host_id string, message string, arrival_seq bigint")
        self.ingest(row)
        return shard.next_offset

    def ingest_partition(self, shard: int, rows: DataFrame, order: tuple[str, ...] = ("arrival_seq",)) -> int:
        """Appends rows that all belong to ``shard``; if one doesn't, nothing is written. No rows are
        0, whatever the shard."""
        if rows.isEmpty():
            return 0
        version = self.version()
        if shard not in {s.shard for s in version.shards}:
            raise RoutingError(f"there is no shard {shard}")
        routed = self._router(version).routed(rows.select(*LOG_COLUMNS, *(c for c in order if c not in LOG_COLUMNS)), len(version.shards))
        wrong = routed.where(F.col("shard") != shard).select("host_id", "shard").first()
        if wrong:
            raise RoutingError(f"host {wrong.host_id!r} belongs to shard {wrong.shard}, not {shard}")
        return self._append(version, routed, order)

    def _append(self, version: Version, routed: DataFrame, order: tuple[str, ...], offsets: Offsets | None = None, stream: str | None = None, batch: int | None = None, counts: dict[int, int] | None = None) -> int:
        if counts is None:
            counts = {r.shard: r.n for r in routed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        total = sum(counts.values())
        shards = tuple(s.grown(counts.get(s.shard, 0)) for s in version.shards)
        commits = version.commits
        if total:
            numbered = local_offsets(routed, order, {s.shard: s.next_offset for s in version.shards})
            # all of a batch that is in bounds survives it
            kept = numbered if all(counts.get(s.shard, 0) <= s.capacity for s in shards) else live(numbered, {s.shard: s.oldest_offset for s in shards})
            commits += (self._written(kept),)
        merged = Offsets(version.offsets.inner())
        for topic, partitions in (offsets.inner() if offsets else {}).items():
            for partition, offset in partitions.items():
                merged.set(topic, partition, offset)
        batches = version.batches | ({stream: batch} if stream is not None else {})
        if total or stream is not None or offsets:
            self._commit(replace(version, number=version.number + 1, shards=shards, commits=commits, offsets=merged, batches=batches))
        self._merge()
        return total

    def _written(self, rows: DataFrame, level: int = 0) -> str:
        name = f"{level}-{uuid.uuid4().hex}"
        _laid(rows).write.partitionBy("shard").parquet(self.folder.path("arrivals", f"commit={name}"))
        return name

    def _merge(self) -> None:
        """Merges the newest MERGED commits, while they have one level, into one of the next."""
        version = self.version()
        levels = [_level(c) for c in version.commits]
        keep, level = len(levels), 0
        while levels[keep - MERGED : keep].count(level) == MERGED:
            keep, level = keep - MERGED + 1, level + 1
            levels[keep - 1 :] = [level]
        if level:
            newest = replace(version, commits=version.commits[keep - 1 :])
            self._commit(replace(version, number=version.number + 1, commits=(*version.commits[: keep - 1], self._written(self._live(newest), level))))

    def compact(self) -> None:
        """Rewrites what is live as one commit. Files of earlier versions stay until ``vacuum``."""
        version = self.version()
        if version.commits:
            level = max(map(_level, version.commits))
            self._commit(replace(version, number=version.number + 1, commits=(self._written(self._live(version), level),)))

    def vacuum(self) -> None:
        """Deletes versions and files that the newest version doesn't need. No reader may use them."""
        version = self.version()
        for name in self.folder.names("versions"):
            if name != f"{version.number:012d}.json":
                self.folder.delete("versions", name)
        for name in self.folder.names("arrivals"):
            if name.removeprefix("commit=") not in version.commits:
                self.folder.delete("arrivals", name)

    # -- reading

    def _live(self, version: Version, shard: int | None = None) -> DataFrame:
        """What is live of all shards, or of one: its bound is then the only one in the plan."""
        if not version.commits:
            return self.spark.createDataFrame([], ARRIVALS_SCHEMA)
        rows = _arrivals(self.folder, version.commits)
        return live(rows, {s.shard: s.oldest_offset for s in version.shards if s.live and shard in (None, s.shard)})

    def live(self) -> DataFrame:
        """All rows that are retained, at one version."""
        return self._live(self.version())

    def pinned(self) -> tuple[Version, DataFrame]:
        """A version, and what is retained at it."""
        version = self.version()
        return version, self._live(version)

    def shard_for_host(self, host: str) -> Shard:
        version = self.version()
        return version.shards[self._router(version).shard(host, len(version.shards))]

    def shard_by_id(self, shard: int) -> Shard:
        found = {s.shard: s for s in self.version().shards}
        if shard not in found:
            raise RoutingError(f"there is no shard {shard}")
        return found[shard]

    def shards(self) -> tuple[Shard, ...]:
        return self.version().shards

    def _records(self, rows: DataFrame) -> DataFrame:
        return rows.select(*LOG_COLUMNS)

    def query_by_host(self, host: str, first: int = MIN, last: int = MAX) -> DataFrame:
        version = self.version()
        shard = self._router(version).shard(host, len(version.shards))
        return self._records(lookup.by_host(self._live(version, shard), shard, host, first, last))

    def query_by_service(self, service: str, first: int = MIN, last: int = MAX) -> DataFrame:
        return self._records(lookup.by_service(self.live(), service, first, last))

    def query_by_service_and_host(self, service: str, host: str, first: int = MIN, last: int = MAX) -> DataFrame:
        version = self.version()
        shard = self._router(version).shard(host, len(version.shards))
        return self._records(lookup.by_service_and_host(self._live(version, shard), shard, service, host, first, last))

    def get(self, shard: int, local_offset: int) -> DataFrame:
        """The record at an offset of a shard: no row if it is evicted or hasn't arrived."""
        return self._records(self._live(self.version(), shard).where((F.col("shard") == shard) & (F.col("local_offset") == local_offset)))

    def postings(self, key: str) -> DataFrame:
        return postings(self.live(), key)

    # -- introspection

    def len(self) -> int:
        return sum(s.live for s in self.version().shards)

    def is_empty(self) -> bool:
        return self.len() == 0

    def capacity(self) -> int:
        return sum(s.capacity for s in self.version().shards)

    def shard_count(self) -> int:
        return len(self.version().shards)

    def shard_lens(self) -> dict[int, int]:
        """Live rows of each shard, those without any included."""
        return {s.shard: s.live for s in self.version().shards}

    def shard_meta(self) -> DataFrame:
        rows = [(s.shard, s.capacity, s.oldest_offset, s.next_offset, s.live) for s in self.version().shards]
        return self.spark.createDataFrame(rows, "shard int, capacity bigint, oldest_offset bigint, next_offset bigint, live bigint")

    def flush_indexer(self, shard: int | None = None) -> None:
        """Nothing to do: rows can be queried as soon as their batch is committed."""

    def indexer_lag(self) -> int:
        return 0

    def offsets(self) -> Offsets:
        return self.version().offsets

    # -- snapshots

    def save_snapshot(self, path: str, offsets: Offsets | None = None) -> None:
        """Writes what is live, with all offsets, at one version. A snapshot at ``path`` is replaced
        by a new version there; readers see the old or the new one whole."""
        version = self.version()
        target = Folder(self.spark, path)
        name = f"0-{uuid.uuid4().hex}"
        if version.commits:
            _laid(self._live(version)).write.partitionBy("shard").parquet(target.path("arrivals", f"commit={name}"))
        found = replace(version, commits=(name,) if version.commits else (), offsets=offsets or version.offsets)
        while True:
            taken = [int(n[:12]) for n in target.names("versions") if not n.startswith(".")]
            number = max(taken, default=-1) + 1
            if target.write_json(replace(found, number=number).to_json(), "versions", f"{number:012d}.json"):
                return

    @classmethod
    def from_snapshot(cls, spark: SparkSession, path: str, root: str) -> tuple[LogStore, Offsets]:
        """A store at ``root`` with a snapshot's state, and the source offsets to resume from."""
        source = Folder(spark, path)
        names = [n for n in source.names("versions") if not n.startswith(".")]
        if not names:
            raise SnapshotError(f"there is no snapshot at {path}")
        try:
            version = Version.from_json(source.read_json("versions", names[-1]))
        except (KeyError, TypeError, ValueError) as e:
            raise SnapshotError(f"the snapshot's manifest can't be read: {e}") from e
        rows = None
        if version.commits:
            rows = _arrivals(source, version.commits)
        return cls.restored(spark, root, version, rows), version.offsets

    @classmethod
    def restored(cls, spark: SparkSession, root: str, version: Version, rows: DataFrame | None) -> LogStore:
        """A store at ``root`` from shards and their live rows, which are checked first."""
        if not version.shards:
            raise SnapshotError("a snapshot must contain at least one shard")
        if sorted(s.shard for s in version.shards) != list(range(len(version.shards))):
            raise SnapshotError("shard ids must run from 0 without gaps")
        counts: dict[int, int] = {}
        if rows is not None:
            counts = {r.shard: r.n for r in rows.groupBy("shard").agg(F.count("*").alias("n")).collect()}
            router = ROUTERS[version.router]
            wrong = router.routed(rows.withColumnRenamed("shard", "_given"), len(version.shards)).where("shard <> _given").first()
            if wrong:
                raise SnapshotError(f"host {wrong.host_id!r} is in shard {wrong._given} but belongs to shard {wrong.shard}")
        for s in version.shards:
            if s.next_offset < counts.get(s.shard, 0):
                raise SnapshotError("a shard's next offset must be at least its number of live entries")
        shards = tuple(replace(s, oldest_offset=s.next_offset - counts.get(s.shard, 0)) for s in version.shards)
        store = cls._created(spark, root, replace(version, number=0, shards=shards, commits=()))
        if rows is not None and counts:
            store._commit(replace(store.version(), number=1, commits=(store._written(rows),)))
        return store
