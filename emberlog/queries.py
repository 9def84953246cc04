"""Registered queries of the log engine over the ``events`` table, and the SQL that checks them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import PipelineConfig, split_capacity
from .errors import RoutingError, SnapshotError
from .functions.records import decoded, encoded
from .functions.routing import ROUTERS, violations
from .functions.statistics import permilles
from .operators import offsets
from .operators.offsets import CHUNK, local_offsets, postings
from .operators.store import LogStore, Offsets, Shard, Version
from .plans import lookup
from .schema import ARRIVALS_SCHEMA, LOG_COLUMNS
from .sources.events import event_log
from .sources.legacy import export_snapshot, exported, import_file, import_snapshot
from .sources.topics import FileTopic
from .streaming.ingest import run_pipeline
from .workload import now_micros

#: Shards of the stores, which retain half of the events: a shard's capacity is one part in PARTS of them.
SHARDS, PARTS = 4, 8
DAY = 86_400_000_000

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_L = """L AS (SELECT event_id AS arrival_seq, epoch_us(ts) AS timestamp, event_type AS service_name, 'host-' || user_id AS host_id, props AS message,
  (('0x' || substr(md5('host-' || user_id), 1, 8))::BIGINT % 4)::INTEGER AS shard FROM events)"""
_N = "N AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY arrival_seq) - 1 AS local_offset FROM L)"
_C = f"C AS (SELECT (count(*) // {PARTS})::BIGINT AS cap FROM events)"
_R = "R AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY arrival_seq DESC) AS age FROM N) WHERE age <= (SELECT cap FROM C))"
_P = "P AS (SELECT arg_max(host_id, arrival_seq) AS h, arg_max(service_name, arrival_seq) AS s, arg_max(timestamp, arrival_seq) AS t FROM L)"
_WITH = f"WITH {_L}, {_N}, {_C}, {_R}, {_P} "
_ROW = "timestamp, service_name, host_id, message"


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, _WITH + sql
        return f

    return add


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of the session; a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='emberlog-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


_kept: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, what: str, make: Callable[[], object]) -> object:
    """What ``make`` returns, made once for a session and table."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def per_shard(spark: SparkSession, sf_dir: str) -> int:
    return _once(spark, sf_dir, "capacity", lambda: event_log(spark, sf_dir).count() // PARTS)


def event_store(spark: SparkSession, sf_dir: str) -> LogStore:
    """The events in a store."""

    def make() -> LogStore:
        store = LogStore.with_shards(spark, scratch(spark, "store"), SHARDS * per_shard(spark, sf_dir), SHARDS)
        store.ingest(event_log(spark, sf_dir))
        _last(spark, sf_dir)
        return store

    return _once(spark, sf_dir, "store", make)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ROUTERS["md5"].routed(event_log(spark, sf_dir), SHARDS)


def _last(spark: SparkSession, sf_dir: str) -> tuple[str, str, int]:
    """Host, service and timestamp of the newest arrival: the look-ups' parameters."""

    def make() -> tuple[str, str, int]:
        r = event_log(spark, sf_dir).agg(F.max_by(F.struct("host_id", "service_name", "timestamp"), "arrival_seq").alias("r")).first().r
        return r.host_id, r.service_name, r.timestamp

    return _once(spark, sf_dir, "last", make)


# -- ingest, routing, retention


@query(f"SELECT arrival_seq, {_ROW}, shard FROM L")
def log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir)


@query("SELECT DISTINCT host_id, shard FROM L")
def route_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).select("host_id", "shard").distinct()


@query("SELECT arrival_seq, host_id, (arrival_seq % 4)::INTEGER AS partition, shard FROM L WHERE arrival_seq % 4 <> shard")
def route_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = event_log(spark, sf_dir).withColumn("partition", (F.col("arrival_seq") % 4).cast("int"))
    return violations(given, SHARDS).select("arrival_seq", "host_id", "partition", "shard")


@query("SELECT arrival_seq, shard, local_offset FROM N")
def dense_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return local_offsets(_log(spark, sf_dir), ("arrival_seq",)).select("arrival_seq", "shard", "local_offset")


@query(f"SELECT shard, local_offset, {_ROW} FROM R")
def retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_store(spark, sf_dir).live()


@query("SELECT arrival_seq, shard, local_offset FROM N WHERE arrival_seq NOT IN (SELECT arrival_seq FROM R)")
def evicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    numbered = local_offsets(log.select("arrival_seq", "shard"), ("arrival_seq",))
    return offsets.evicted(numbered, per_shard(spark, sf_dir), log).select("arrival_seq", "shard", "local_offset")


@query(f"SELECT {_ROW} FROM R WHERE shard = 1 AND local_offset = (SELECT max(local_offset) - 10 FROM N WHERE shard = 1)")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = event_store(spark, sf_dir)
    return store.get(1, store.version().shards[1].next_offset - 11)


# -- look-ups


@query(f"SELECT {_ROW} FROM R, P WHERE host_id = h")
def by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_store(spark, sf_dir).query_by_host(_last(spark, sf_dir)[0])


@query(f"SELECT {_ROW} FROM R, P WHERE service_name = s")
def by_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_store(spark, sf_dir).query_by_service(_last(spark, sf_dir)[1])


@query(f"SELECT {_ROW} FROM R, P WHERE service_name = s AND host_id = h")
def by_service_and_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, service, _ = _last(spark, sf_dir)
    return event_store(spark, sf_dir).query_by_service_and_host(service, host)


@query(f"SELECT {_ROW} FROM R, P WHERE host_id = h AND timestamp BETWEEN t - {DAY} AND t")
def by_host_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, _, t = _last(spark, sf_dir)
    return event_store(spark, sf_dir).query_by_host(host, t - DAY, t)


@query(f"SELECT {_ROW} FROM R, P WHERE service_name = s AND timestamp BETWEEN t - {DAY} AND t")
def by_service_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, service, t = _last(spark, sf_dir)
    return event_store(spark, sf_dir).query_by_service(service, t - DAY, t)


@query(f"SELECT {_ROW} FROM R, P WHERE service_name = s AND host_id = h AND timestamp BETWEEN t - {DAY} AND t")
def by_service_and_host_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, service, t = _last(spark, sf_dir)
    return event_store(spark, sf_dir).query_by_service_and_host(service, host, t - DAY, t)


@query(f"SELECT {_ROW} FROM R, P WHERE host_id = h AND timestamp = t")
def by_host_point_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, _, t = _last(spark, sf_dir)
    return event_store(spark, sf_dir).query_by_host(host, t, t)


@query(f"SELECT {_ROW} FROM R WHERE false")
def by_host_inverted_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, _, t = _last(spark, sf_dir)
    return event_store(spark, sf_dir).query_by_host(host, t, t - DAY)


@query(f"SELECT {_ROW} FROM R WHERE host_id = 'no such host'")
def by_host_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_store(spark, sf_dir).query_by_host("no such host")


@query(
    f"""SELECT {_ROW} FROM R JOIN (SELECT shard, local_offset FROM R, P WHERE service_name = s) AS a USING (shard, local_offset)
    JOIN (SELECT shard, local_offset FROM R, P WHERE host_id = h) AS b USING (shard, local_offset)"""
)
def by_service_and_host_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, service, _ = _last(spark, sf_dir)
    return lookup.by_posting_intersection(event_store(spark, sf_dir).live(), service, host).select(*LOG_COLUMNS)


@query("SELECT (SELECT count(*) FROM L, P WHERE host_id = h) AS arrived, (SELECT count(*) FROM R, P WHERE host_id = h) AS found")
def evict_then_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = _last(spark, sf_dir)[0]
    arrived = event_log(spark, sf_dir).where(F.col("host_id") == host).agg(F.count("*").alias("arrived"))
    return arrived.crossJoin(event_store(spark, sf_dir).query_by_host(host).agg(F.count("*").alias("found")))


@query(
    """SELECT 'host' AS kind, 60 AS share, count(*) AS n FROM R, P WHERE host_id = h
    UNION ALL SELECT 'service+host', 30, count(*) FROM R, P WHERE host_id = h AND service_name = s
    UNION ALL SELECT 'service', 10, count(*) FROM R, P WHERE service_name = s"""
)
def query_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three look-ups in the shares of the mixed workload."""
    store, (host, service, _) = event_store(spark, sf_dir), _last(spark, sf_dir)
    parts = (("host", 60, store.query_by_host(host)), ("service+host", 30, store.query_by_service_and_host(service, host)), ("service", 10, store.query_by_service(service)))
    found = [rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit(share).alias("share"), "n") for kind, share, rows in parts]
    return found[0].unionByName(found[1]).unionByName(found[2])


# -- index, introspection


def _postings_sql(key: str, rows: str) -> str:
    return f"""SELECT shard, {key}, local_offset // {CHUNK} AS chunk, string_agg(local_offset::VARCHAR, ',' ORDER BY local_offset) AS offsets
    FROM {rows} GROUP BY shard, {key}, chunk"""


def _as_text(found: DataFrame) -> DataFrame:
    return found.withColumn("offsets", F.array_join(F.col("offsets").cast("array<string>"), ","))


@query(_postings_sql("service_name", "R"))
def posting_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_text(event_store(spark, sf_dir).postings("service_name"))


@query(_postings_sql("host_id", "R"))
def posting_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_text(event_store(spark, sf_dir).postings("host_id"))


@query(_postings_sql("host_id", "(SELECT * FROM N WHERE arrival_seq NOT IN (SELECT arrival_seq FROM R))"))
def posting_purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    numbered = local_offsets(log.select("arrival_seq", "host_id", "shard"), ("arrival_seq",))
    return _as_text(postings(offsets.evicted(numbered, per_shard(spark, sf_dir), log), "host_id"))


@query(f"SELECT count(*) AS live, (SELECT {SHARDS} * cap FROM C)::BIGINT AS capacity, {SHARDS} AS shards, 0 AS lag FROM R")
def store_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = event_store(spark, sf_dir)
    return store.live().agg(F.count("*").alias("live")).select("live", F.lit(store.capacity()).cast("bigint").alias("capacity"), F.lit(store.shard_count()).alias("shards"), F.lit(store.indexer_lag()).alias("lag"))


@query(
    """SELECT k::INTEGER AS shard, coalesce(n, 0) AS live FROM range(16) AS g(k) LEFT JOIN (SELECT ('0x' || substr(md5(host_id), 1, 8))::BIGINT % 16 AS k, count(*) AS n
    FROM L WHERE host_id IN ('host-1', 'host-2', 'host-3', 'host-4', 'host-5') GROUP BY 1) USING (k)"""
)
def shard_lens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live rows of each shard of a store that has few hosts: those without rows count 0."""

    def make() -> LogStore:
        store = LogStore.with_shards(spark, scratch(spark, "few-hosts"), 16 << 30, 16)
        store.ingest(event_log(spark, sf_dir).where("host_id IN ('host-1', 'host-2', 'host-3', 'host-4', 'host-5')"))
        return store

    store: LogStore = _once(spark, sf_dir, "few-hosts", make)
    return spark.createDataFrame(list(store.shard_lens().items()), "shard int, live bigint")


@query(
    """SELECT shard, (SELECT cap FROM C) AS capacity, greatest(count(*) - (SELECT cap FROM C), 0)::BIGINT AS oldest_offset, count(*) AS next_offset,
    least(count(*), (SELECT cap FROM C))::BIGINT AS live FROM L GROUP BY shard"""
)
def shard_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_store(spark, sf_dir).shard_meta()


@query("SELECT shard, n, sorted[((n - 1) * 500 // 1000 + 1)::INTEGER] AS p50, sorted[((n - 1) * 999 // 1000 + 1)::INTEGER] AS p999 FROM (SELECT shard, list(timestamp ORDER BY timestamp) AS sorted, count(*) AS n FROM R GROUP BY shard)")
def timestamp_permilles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permilles(event_store(spark, sf_dir).live(), ["shard"], "timestamp", {"p50": 500, "p999": 999})


@query("SELECT * FROM (VALUES (0, 4), (1, 3), (2, 3)) AS v(shard, capacity)")
def capacity_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(split_capacity(10, 3))), "shard int, capacity int")


@query(
    """SELECT host_id, shard, (SELECT count(*) FROM L AS x WHERE x.shard = h.shard) AS next_offset, (SELECT count(*) FROM R AS x WHERE x.shard = h.shard) AS live
    FROM (SELECT DISTINCT host_id, shard FROM L WHERE host_id IN ('host-1', 'host-2', 'host-3', 'host-4', 'host-5')) AS h"""
)
def shard_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of some hosts, by host and by number."""
    store = event_store(spark, sf_dir)
    hosts = [r.host_id for r in event_log(spark, sf_dir).select("host_id").where("host_id IN ('host-1', 'host-2', 'host-3', 'host-4', 'host-5')").distinct().collect()]
    found = [(h, store.shard_by_id(store.shard_for_host(h).shard)) for h in hosts]
    return spark.createDataFrame([(h, s.shard, s.next_offset, s.live) for h, s in found], "host_id string, shard int, next_offset bigint, live bigint")


@query("SELECT * FROM (VALUES ('new', true, 0::BIGINT, 12::BIGINT, 3, 0), ('filled', false, 2::BIGINT, 12::BIGINT, 3, 0)) AS v(store, empty, live, capacity, shards, lag)")
def introspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, rows = LogStore.with_shards(spark, scratch(spark, "new"), 12, 3), []
    for name in ("new", "filled"):
        if name == "filled":
            store.ingest_one(1, "svc", "h", "m")
            store.ingest_one(2, "svc", "h", "m")
        store.flush_indexer()
        store.flush_indexer(99)
        rows.append((name, store.is_empty(), store.len(), store.capacity(), store.shard_count(), store.indexer_lag()))
    return spark.createDataFrame(rows, "store string, empty boolean, live bigint, capacity bigint, shards int, lag int")


# -- routing of existing topics, ingest of one partition

#: Hosts and their shards of 2, 3, 4 and 8 in the layout of existing topics.
_GOLDEN = (
    ("h0", 1, 1, 3, 7), ("h1", 0, 0, 0, 0), ("h2", 1, 2, 3, 3), ("h3", 1, 2, 3, 3), ("host-0", 0, 2, 2, 2), ("host-1", 1, 1, 1, 1), ("hot-host", 0, 2, 2, 6),
    ("host-00", 1, 1, 1, 1), ("host-01", 1, 0, 1, 5), ("host-02", 0, 1, 0, 0), ("host-03", 1, 2, 3, 3), ("host-04", 1, 1, 3, 3), ("host-05", 1, 0, 3, 7), ("host-06", 0, 0, 2, 2),
    ("host-07", 1, 2, 3, 7), ("host-08", 1, 0, 1, 1), ("host-09", 1, 0, 1, 1), ("host.with.dots", 1, 0, 3, 7), ("MiXeD", 1, 2, 1, 1), ("日本語ホスト", 1, 1, 3, 3), ("", 1, 1, 3, 7),
)


@query(f"SELECT * FROM (VALUES {', '.join(map(str, _GOLDEN))}) AS v(host_id, of_2, of_3, of_4, of_8)")
def route_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = spark.createDataFrame([(g[0],) for g in _GOLDEN], "host_id string")
    for n in (2, 3, 4, 8):
        hosts = ROUTERS["sip13"].routed(hosts, n).withColumnRenamed("shard", f"of_{n}")
    return hosts


@query(f"SELECT shard, local_offset, {_ROW} FROM R WHERE shard = 2")
def partition_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one partition, appended as such in two batches."""
    store = LogStore.with_shards(spark, scratch(spark, "one-partition"), SHARDS * per_shard(spark, sf_dir), SHARDS)
    rows = _log(spark, sf_dir).where("shard = 2").drop("shard")
    for part in ("arrival_seq < 100", "arrival_seq >= 100"):
        store.ingest_partition(2, rows.where(part))
    return store.live()


def _refused(does: Callable[[], object], kind: type[Exception]) -> bool:
    try:
        does()
    except kind:
        return True
    return False


@query("SELECT * FROM (VALUES ('foreign host', true, 0::BIGINT), ('no such shard', true, 0::BIGINT), ('no rows, no such shard', false, 0::BIGINT), ('own host', false, 1::BIGINT)) AS v(given, refused, live)")
def partition_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch for a partition is appended whole or, if a host belongs elsewhere, not at all."""
    store = LogStore.with_shards(spark, scratch(spark, "one-partition"), 100, SHARDS, "sip13")
    rows = lambda *hosts: spark.createDataFrame([(i, "svc", h, "m", i) for i, h in enumerate(hosts)], "timestamp bigint, service_name string, host_id string, message string, arrival_seq bigint")
    cases = (("foreign host", 0, ("h1", "h0")), ("no such shard", 99, ("h1",)), ("no rows, no such shard", 99, ()), ("own host", 0, ("h1",)))
    found = [(name, _refused(lambda s=shard, h=hosts: store.ingest_partition(s, rows(*h)), RoutingError), store.len()) for name, shard, hosts in cases]
    return spark.createDataFrame(found, "given string, refused boolean, live bigint")


_RECORDS = ((0, "svc", "", 'a,b;"c"'), ((1 << 63) - 1, "svc", "日本語ホスト", "héllo ✓"), (-1, "", "h", "🚀"), (42, "svc", "MiXeD", ""), (42, "svc", "MiXeD", ""))


@query(f"SELECT * FROM (VALUES {', '.join(str((i, *r)) for i, r in enumerate(_RECORDS))}) AS v(local_offset, timestamp, service_name, host_id, message)")
def single_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records appended one by one: each call returns the record's offset."""
    store = LogStore.with_shards(spark, scratch(spark, "single"), 100)
    taken = [store.ingest_one(*r) for r in _RECORDS]
    return store.live().where(F.col("local_offset").isin(taken)).select(F.col("local_offset").cast("int"), *LOG_COLUMNS)


@query("SELECT epoch_us(now()::TIMESTAMP) BETWEEN 1577836800000000 AND 4102444800000000 AS sane")
def wall_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(now_micros().between(1577836800000000, 4102444800000000).alias("sane"))


# -- snapshots, streams, JSON


@query(f"SELECT shard, local_offset, {_ROW} FROM R")
def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "snapshot")
    event_store(spark, sf_dir).save_snapshot(path)
    return LogStore.from_snapshot(spark, path, scratch(spark, "restored"))[0].live()


@query(f"SELECT shard, local_offset, {_ROW} FROM R")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events sent to a topic as JSON messages and drained into a store by micro-batches."""
    topic = FileTopic(scratch(spark, "topic"), files_per_trigger=SHARDS)
    log = event_log(spark, sf_dir)
    middle = log.agg(F.expr("max(arrival_seq) div 2").alias("m")).first().m
    topic.send(log.where(F.col("arrival_seq") <= middle), SHARDS)
    topic.send(log.where(F.col("arrival_seq") > middle), SHARDS)
    config = PipelineConfig(topic=topic.name, partitions=SHARDS, capacity=SHARDS * per_shard(spark, sf_dir))
    return run_pipeline(spark, topic, scratch(spark, "drained"), scratch(spark, "checkpoint"), config)[0].live()


@query("SELECT 'logs' AS topic, shard AS partition, count(*) AS committed FROM L WHERE arrival_seq < 500 GROUP BY shard")
def committed_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source offsets that a drained store holds, after a restart of it from a snapshot."""
    topic = FileTopic(scratch(spark, "topic"))
    topic.send(event_log(spark, sf_dir).where("arrival_seq < 500"), SHARDS)
    config = PipelineConfig(topic=topic.name, partitions=SHARDS, capacity=400)
    store, _ = run_pipeline(spark, topic, scratch(spark, "drained"), scratch(spark, "checkpoint"), config)
    store.save_snapshot(path := scratch(spark, "snapshot"))
    found = LogStore.from_snapshot(spark, path, scratch(spark, "restored"))[1].inner()
    return spark.createDataFrame([(t, p, o) for t, ps in found.items() for p, o in ps.items()], "topic string, partition int, committed bigint")


def _binary(spark: SparkSession, sf_dir: str, layout: bytes) -> DataFrame:
    path = f"{scratch(spark, 'binary')}/events.snap"
    export_snapshot(event_store(spark, sf_dir), path, b"EXPORT", layout=layout)
    return import_file(spark, path, scratch(spark, "imported"), b"EXPORT", "md5")[0].live()


@query(f"SELECT shard, local_offset, {_ROW} FROM R")
def binary_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _binary(spark, sf_dir, b"05")


@query(f"SELECT shard, local_offset, {_ROW} FROM R")
def binary_roundtrip_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _binary(spark, sf_dir, b"04")


_BAD_SNAPSHOTS = ("no snapshot", "no shards", "fewer offsets than rows", "misplaced host", "shard numbers with gaps", "another format", "cut off")


@query(f"SELECT * FROM (VALUES {', '.join(f"('{x}', true)" for x in _BAD_SNAPSHOTS)}, ('sound', false)) AS v(given, refused)")
def restore_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots that break an invariant aren't restored."""
    row = lambda host, shard, at=0: (at, 1, "a", host, "m", shard)
    rows = lambda *found: spark.createDataFrame(list(found), ARRIVALS_SCHEMA)
    restored = lambda shards, found=None: LogStore.restored(spark, scratch(spark, "restored"), Version(0, "sip13", shards), found)
    store = LogStore.with_shards(spark, scratch(spark, "small"), 4, 2, "sip13")
    store.ingest_one(1, "a", "h1", "m")
    held = Offsets()
    held.set("logs", 0, 7)
    data = exported(store, b"EXPORT", held)
    imported = lambda d: import_snapshot(spark, d, scratch(spark, "imported"), b"EXPORT")
    cases = (
        lambda: LogStore.from_snapshot(spark, scratch(spark, "nothing"), scratch(spark, "restored")),
        lambda: restored(()),
        lambda: restored((Shard(0, 5, 0, 1),), rows(row("h1", 0), row("h1", 0, 1))),
        lambda: restored((Shard(0, 5), Shard(1, 5, 0, 1)), rows(row("h1", 1))),
        lambda: restored((Shard(1, 5), Shard(2, 5))),
        lambda: imported(b"another format"),
        lambda: imported(data[:-3]),
        lambda: imported(data + b"and more"),
    )
    found = [(name, _refused(does, SnapshotError)) for name, does in zip((*_BAD_SNAPSHOTS, "sound"), cases)]
    return spark.createDataFrame(found, "given string, refused boolean")


@query(f"SELECT arrival_seq, {_ROW} FROM L")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = event_log(spark, sf_dir).select("arrival_seq", encoded().alias("value"))
    return decoded(sent).where("reason IS NULL").select("arrival_seq", *(f"record.{c}" for c in LOG_COLUMNS))


_ODD = [
    ('{"timestamp":1,"service_name":"a","host_id":"h","message":"m"}', True),
    (' {"timestamp":-5,"service_name":"","host_id":"h","message":"m","more":[1]} ', True),
    ('[1,"a","h","m"]', True),
    ('{"timestamp":1,"service_name":"a","host_id":"h"}', False),
    ('{"timestamp":1,"service_name":null,"host_id":"h","message":"m"}', False),
    ('{"timestamp":1,"service_name":5,"host_id":"h","message":"m"}', False),
    ('{"timestamp":1.0,"service_name":"a","host_id":"h","message":"m"}', False),
    ('{"timestamp":"1","service_name":"a","host_id":"h","message":"m"}', False),
    ('{"timestamp":9223372036854775808,"service_name":"a","host_id":"h","message":"m"}', False),
    ('{"timestamp":1e0,"service_name":"a","host_id":"h","message":"m"}', False),
    ('{"timestamp":01,"service_name":"a","host_id":"h","message":"m"}', False),
    ('{"timestamp":-0,"service_name":"a","host_id":"h","message":"m"}', False),
    ('{"timestamp":1,"timestamp":1,"service_name":"a","host_id":"h","message":"m"}', False),
    ("{'timestamp':1,'service_name':'a','host_id':'h','message':'m'}", False),
    ('{"timestamp":1,"service_name":"a","host_id":"h","message":"m"} x', False),
    ('{"timestamp":1,"service_name":"a","host_id":"h","message":"\\ud800"}', False),
    ('[1,"a","h"]', False),
    ('[1,"a","h","m",2]', False),
    ("", False),
]


@query(f"SELECT * FROM (VALUES {', '.join(f'({i}, {str(ok).lower()})' for i, (_, ok) in enumerate(_ODD))}) AS v(number, valid)")
def json_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(_ODD)], "number int, value string")
    return decoded(rows).select("number", F.col("reason").isNull().alias("valid"))


_BYTES = (
    ('"é✓🚀"'.encode(), True), (b'"\xff"', False), (b'"\xc3"', False), (b'"\xc0\xaf"', False), (b'"\xed\xa0\x80"', False), (b'"\xf4\x90\x80\x80"', False),
    (b'"\xe2\x82"', False), (b'"\xef\xbf\xbd"', True), (b'"\xf0\x9f\x9a\x80"', True),
)


@query(f"SELECT * FROM (VALUES {', '.join(f'({i}, {str(ok).lower()})' for i, (_, ok) in enumerate(_BYTES))}) AS v(number, valid)")
def utf8_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads whose bytes aren't UTF-8 are no records."""
    payload = lambda b: bytearray(b'{"timestamp":1,"service_name":' + b + b',"host_id":"h","message":"m"}')
    rows = spark.createDataFrame([(i, payload(b)) for i, (b, _) in enumerate(_BYTES)], "number int, value binary")
    return decoded(rows).select("number", F.col("reason").isNull().alias("valid"))
