from __future__ import annotations

import itertools
import random
from collections import deque

import pytest

from emberlog.errors import LogError, RoutingError, SnapshotError
from emberlog.functions.routing import ROUTERS
from emberlog.operators import store as store_module
from emberlog.operators.offsets import evicted, live, local_offsets, newest, postings
from emberlog.operators.store import LogStore, Offsets, Shard, Version

LOG = "timestamp bigint, service_name string, host_id string, message string, arrival_seq bigint"
MAX = (1 << 63) - 1


def rows(spark, entries):
    return spark.createDataFrame([(t, s, h, f"log@{t}", i) for i, (t, s, h) in enumerate(entries)], LOG)


@pytest.fixture
def make(spark, tmp_path):
    count = itertools.count()

    def new(capacity, shards=1, entries=(), router="sip13"):
        store = LogStore.with_shards(spark, f"file://{tmp_path}/store{next(count)}", capacity, shards, router)
        if entries:
            assert store.ingest(rows(spark, entries)) == len(entries)
        return store

    return new


def times(df):
    return [r.timestamp for r in df.collect()]


def test_queries_by_host_service_and_both(make):
    s = make(1000, 1, [(10, "auth", "h1"), (20, "auth", "h2"), (30, "payment", "h1")])
    assert times(s.query_by_host("h1")) == [10, 30]
    assert times(s.query_by_service("auth")) == [10, 20]
    assert times(s.query_by_service_and_host("auth", "h1")) == [10]
    assert not times(s.query_by_service("Auth"))
    assert not times(s.query_by_service_and_host("payment", "h2"))


def test_time_range_is_inclusive(make):
    s = make(1000, 1, [(t, "svc", "h1") for t in (5, 10, 15, 20, 25)])
    assert times(s.query_by_service("svc", 10, 20)) == [10, 15, 20]
    assert times(s.query_by_service("svc", 10, 10)) == [10]
    assert times(s.query_by_service("svc", 20, 10)) == []
    assert times(s.query_by_host("h1", 30, 40)) == []


def test_sharded_queries_route_by_host(make):
    s = make(100, 4, [(10, "auth", "h0"), (20, "auth", "h1"), (30, "payments", "h2"), (40, "auth", "h1")])
    assert times(s.query_by_host("h1")) == [20, 40]
    assert times(s.query_by_service("auth")) == [10, 20, 40]
    assert times(s.query_by_service_and_host("auth", "h1")) == [20, 40]
    assert s.shard_lens() == {0: 2, 1: 0, 2: 0, 3: 2}


def test_eviction_is_by_arrival_and_by_shard(make, spark):
    s = make(4, 2)
    for t, h in ((30, "h0"), (10, "h1"), (40, "h0"), (20, "h1"), (50, "h0")):
        s.ingest(rows(spark, [(t, "svc", h)]))
    assert times(s.query_by_service("svc")) == [10, 20, 40, 50]
    late = make(2, 1, [(100, "svc", "h"), (1, "svc", "h"), (50, "svc", "h")])
    assert times(late.query_by_service("svc")) == [1, 50]


def test_hot_shard_evicts_its_own_entries(make):
    s = make(12, 4, [(t, "svc", "hot-host") for t in range(4)])
    assert (s.len(), s.capacity()) == (3, 12)
    assert times(s.query_by_host("hot-host")) == [1, 2, 3]


def test_batch_over_capacity_counts_all_and_keeps_the_last(make):
    s = make(2, 1, [(t, "svc", "h") for t in range(5)])
    assert (s.len(), s.version().shards[0]) == (2, Shard(0, 2, 3, 5))
    assert times(s.get(0, 4)) == [4] and times(s.get(0, 2)) == [] and times(s.get(0, 5)) == []


def test_ties_and_repeated_rows_are_kept(make):
    s = make(100, 4, [(10, "svc", "h1"), (10, "svc", "h2"), (11, "svc", "h3"), (10, "svc", "h1")])
    assert times(s.query_by_service("svc")) == [10, 10, 10, 11]


def test_partition_ingest_is_all_or_nothing(make, spark):
    s = make(100, 4)
    shard = ROUTERS["sip13"].shard("h1", 4)
    assert s.ingest_partition(99, rows(spark, [])) == 0
    with pytest.raises(RoutingError):
        s.ingest_partition(99, rows(spark, [(1, "a", "h1")]))
    with pytest.raises(RoutingError):
        s.ingest_partition(shard, rows(spark, [(1, "a", "h1"), (2, "a", "h0")]))
    assert s.is_empty()
    assert s.ingest_partition(shard, rows(spark, [(1, "a", "h1"), (2, "b", "h1")])) == 2
    assert times(s.query_by_host("h1")) == [1, 2] == times(s.query_by_service("a")) + times(s.query_by_service("b"))


def test_extremes_unicode_and_empty_keys(make, spark):
    found = [(0, "svc", "", "a,b;\"c\"\n"), (MAX, "svc", "日本語ホスト", "héllo ✓"), (-1, "", "h", "🚀"), (42, "svc", "MiXeD", "")]
    s = make(100)
    for i, r in enumerate(found):
        assert s.ingest_one(*r) == i
    assert sorted(tuple(r) for r in s.live().select("timestamp", "service_name", "host_id", "message").collect()) == sorted(found)
    assert times(s.query_by_host("")) == [0] and times(s.query_by_host("日本語ホスト")) == [MAX] and times(s.query_by_service("")) == [-1]


def test_introspection_and_bad_arguments(make, spark):
    s = make(12, 3)
    s.flush_indexer()
    s.flush_indexer(99)
    assert s.shard_for_host("h0") == s.shards()[ROUTERS["sip13"].shard("h0", 3)] and s.shard_by_id(2) == Shard(2, 4)
    with pytest.raises(RoutingError):
        s.shard_by_id(3)
    assert (s.is_empty(), s.indexer_lag(), s.shard_count(), s.capacity(), s.shard_lens()) == (True, 0, 3, 12, {0: 0, 1: 0, 2: 0})
    assert s.live().count() == 0 and times(s.query_by_host("h")) == []
    for capacity, shards in ((10, 3), (0, 1), (3, 0)):
        with pytest.raises(ValueError):
            make(capacity, shards)
    with pytest.raises(LogError):
        LogStore(spark, s.folder.path("nothing"))


def test_postings(make):
    s = make(3, 1, [(1, "a", "h"), (2, "b", "h"), (3, "a", "h"), (4, "a", "h")])
    assert {r.service_name: r.offsets for r in s.postings("service_name").collect()} == {"a": [2, 3], "b": [1]}


def test_batches_of_a_stream_apply_once(make, spark):
    s = make(10)
    batch = rows(spark, [(1, "a", "h"), (2, "a", "h")])
    assert s.ingest(batch, stream="q", batch=0) == 2
    assert s.ingest(batch, stream="q", batch=0) == 0
    assert s.ingest(batch, stream="q", batch=1) == 2
    assert s.len() == 4


def test_a_writer_that_lost_the_race_fails(make, spark):
    s = make(10)
    stale = s.version()
    s.ingest(rows(spark, [(1, "a", "h")]))
    with pytest.raises(LogError):
        s._append(stale, ROUTERS["sip13"].routed(rows(spark, [(2, "a", "h")]), 1), ("arrival_seq",))
    assert times(s.query_by_host("h")) == [1]


def test_compaction_changes_no_answer(make, spark, monkeypatch):
    monkeypatch.setattr(store_module, "MERGED", 3)
    s, kept = make(4, 2), []
    for k in range(11):
        s.ingest(rows(spark, [(k, "svc", "h0"), (k + 100, "svc", "h1")]))
        kept.append([c[0] for c in s.version().commits])
    # three of a level become one of the next
    assert kept[:4] == [["0"], ["0", "0"], ["1"], ["1", "0"]] and kept[8] == ["2"] and kept[10] == ["2", "0", "0"]
    before, meta = sorted(map(tuple, s.live().collect())), s.version().shards
    assert times(s.query_by_service("svc")) == [7, 8, 9, 10] or s.len() == 4
    s.compact()
    s.vacuum()
    assert sorted(map(tuple, s.live().collect())) == before and s.version().shards == meta and len(s.version().commits) == 1
    s.ingest(rows(spark, [(9, "svc", "h0")]))
    assert times(s.query_by_host("h0"))[-1:] == [110 if ROUTERS["sip13"].shard("h0", 2) == ROUTERS["sip13"].shard("h1", 2) else 10] or s.len() == 4


def test_snapshot_round_trip(make, spark, tmp_path):
    s = make(12, 3, [(10, "auth", "h1"), (20, "payment", "h2"), (30, "auth", "h1")])
    offsets = Offsets()
    offsets.set("logs", 0, 99999)
    offsets.set("logs", 1, 88888)
    path = f"file://{tmp_path}/snap"
    s.save_snapshot(path, offsets)
    again, found = LogStore.from_snapshot(spark, path, f"file://{tmp_path}/again")
    assert found == offsets and found.get("logs", 0) == 99999 and found.get("logs", 7) is None
    assert again.version().shards == s.version().shards and again.capacity() == 12
    assert sorted(map(tuple, again.live().collect())) == sorted(map(tuple, s.live().collect()))
    s.ingest(rows(spark, [(40, "auth", "h1")]))
    s.save_snapshot(path, offsets)
    assert LogStore.from_snapshot(spark, path, f"file://{tmp_path}/third")[0].len() == 4


def test_snapshot_of_an_empty_store(make, spark, tmp_path):
    s = make(8, 2)
    s.save_snapshot(f"file://{tmp_path}/snap")
    assert LogStore.from_snapshot(spark, f"file://{tmp_path}/snap", f"file://{tmp_path}/again")[0].is_empty()


def test_bad_snapshots_are_refused(make, spark, tmp_path):
    at = itertools.count()
    new = lambda: f"file://{tmp_path}/bad{next(at)}"
    with pytest.raises(SnapshotError):
        LogStore.from_snapshot(spark, new(), new())
    with pytest.raises(SnapshotError):
        LogStore.restored(spark, new(), Version(0, "md5", ()), None)
    live_rows = spark.createDataFrame([(0, 1, "a", "h1", "m", 0), (1, 2, "a", "h1", "m", 0)], store_module.ARRIVALS_SCHEMA)
    with pytest.raises(SnapshotError):
        LogStore.restored(spark, new(), Version(0, "md5", (Shard(0, 5, 0, 1),)), live_rows)
    wrong = (Shard(0, 5, 0, 2), Shard(1, 5))
    host = next(f"h{i}" for i in range(99) if ROUTERS["md5"].shard(f"h{i}", 2) == 1)
    misplaced = spark.createDataFrame([(0, 1, "a", host, "m", 0)], store_module.ARRIVALS_SCHEMA)
    with pytest.raises(SnapshotError):
        LogStore.restored(spark, new(), Version(0, "md5", wrong), misplaced)
    with pytest.raises(SnapshotError):
        LogStore.restored(spark, new(), Version(0, "md5", (Shard(1, 5), Shard(2, 5))), None)


def test_a_restored_shard_over_capacity_is_trimmed_at_its_next_write(spark, tmp_path):
    live_rows = spark.createDataFrame([(k, k, "a", "h", "m", 0) for k in range(3)], store_module.ARRIVALS_SCHEMA)
    s = LogStore.restored(spark, f"file://{tmp_path}/over", Version(0, "md5", (Shard(0, 1, 0, 3),)), live_rows)
    assert s.len() == 3 == s.live().count()
    s.ingest(rows(spark, [(9, "a", "h")]))
    assert s.len() == 1 and times(s.query_by_host("h")) == [9]


def test_ring_model(make, spark):
    """Random batches, against a queue for each shard."""
    rng = random.Random(7)
    for shards, capacity in ((1, 5), (3, 6), (4, 20)):
        s, model = make(capacity, shards, router="md5"), [deque(maxlen=capacity // shards) for _ in range(shards)]
        for _ in range(4):
            batch = [(rng.randint(-5, 5), rng.choice("ab"), f"h{rng.randint(0, 6)}") for _ in range(rng.randint(0, 9))]
            s.ingest(rows(spark, batch)) if batch else None
            for t, svc, h in batch:
                model[ROUTERS["md5"].shard(h, shards)].append((t, svc, h))
        found = sorted((r.timestamp, r.service_name, r.host_id) for r in s.live().collect())
        assert found == sorted(x for q in model for x in q)
        assert list(s.shard_lens().values()) == [len(q) for q in model]
        got = s.query_by_service("a", -2, 3).collect()
        assert sorted((r.timestamp, r.host_id) for r in got) == sorted((t, h) for q in model for t, svc, h in q if svc == "a" and -2 <= t <= 3)
        assert [r.timestamp for r in got] == sorted(r.timestamp for r in got)


def test_look_up_by_host_reads_one_partition(make, spark):
    s = make(100, 4, [(10, "auth", "h0"), (20, "auth", "h1")])
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = s.query_by_host("h1", 0, 50)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [isnotnull(shard" in plan and "(shard#" in plan.split("PartitionFilters")[1]
    pushed = plan.split("PushedFilters")[1]
    assert all(f in pushed for f in ("GreaterThanOrEqual(local_offset,0)", "EqualTo(host_id,h1)", "GreaterThanOrEqual(timestamp,0)"))


def test_offsets_are_dense_over_chunks(spark, monkeypatch):
    from emberlog.operators import offsets

    monkeypatch.setattr(offsets, "CHUNK", 7)
    df = spark.range(100).selectExpr("id AS arrival_seq", "cast(id % 3 AS int) AS shard")
    found = local_offsets(df, ("arrival_seq",), {1: 50})
    by = {k: sorted((r.arrival_seq, r.local_offset) for r in found.collect() if r.shard == k) for k in range(3)}
    assert all([o for _, o in v] == list(range(50 if k == 1 else 0, len(v) + (50 if k == 1 else 0))) for k, v in by.items())
    plain = local_offsets(df, ("arrival_seq",))
    kept, gone = newest(plain, 4, df), evicted(plain, 4, df)
    assert kept.count() == 12 and gone.count() == 88 and kept.intersect(gone).isEmpty()
    assert kept.exceptAll(newest(plain, 4)).isEmpty()
    assert sorted(map(tuple, live(plain, {0: 30, 1: 29, 2: 29}).select("shard", "local_offset").collect())) == sorted(map(tuple, kept.select("shard", "local_offset").collect()))
    assert {r.shard for r in live(plain, {0: 30, 2: 29}).collect()} == {0, 2} and live(plain, {}).isEmpty()
    lists = postings(plain.where("shard = 0"), "shard").orderBy("chunk").collect()
    assert [r.offsets for r in lists] == [list(range(k, min(k + 7, 34))) for k in range(0, 34, 7)]


def test_thousands_of_shards(make, spark):
    """Offsets that don't begin at 0, and bounds, of 4,000 shards."""
    s = make(4000 * 2, 4000, router="md5")
    batch = spark.range(6000).selectExpr("id AS timestamp", "'svc' AS service_name", "concat('host-', id) AS host_id", "'m' AS message", "id AS arrival_seq")
    assert s.ingest(batch) == 6000 == s.ingest(batch)
    counts = [0] * 4000
    for i in range(6000):
        counts[ROUTERS["md5"].shard(f"host-{i}", 4000)] += 2
    assert s.len() == sum(min(2, n) for n in counts) == s.live().count()
    assert [m.next_offset for m in s.shards()] == counts
    host = f"host-{5999}"
    assert len(times(s.query_by_host(host))) == 2 or counts[ROUTERS["md5"].shard(host, 4000)] > 2
    found = s.live().groupBy("shard").agg({"local_offset": "max"}).collect()
    assert all(r[1] == counts[r[0]] - 1 for r in found)


def test_a_hot_shard_is_written_by_several_tasks(make, spark, monkeypatch, tmp_path):
    from emberlog.operators import offsets

    monkeypatch.setattr(offsets, "CHUNK", 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        s = make(1000, 1, [(t, "svc", "hot") for t in range(400)])
        s.save_snapshot(f"file://{tmp_path}/hot")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(s.live().inputFiles()) > 1 and times(s.query_by_host("hot")) == list(range(400))
    assert LogStore.from_snapshot(spark, f"file://{tmp_path}/hot", f"file://{tmp_path}/again")[0].live().count() == 400
