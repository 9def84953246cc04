from __future__ import annotations

import struct

import pytest

from emberlog.config import PipelineConfig
from emberlog.errors import DecodeError, RoutingError, SnapshotError, SourceUnavailable
from emberlog.functions.routing import ROUTERS
from emberlog.operators.store import LogStore, Offsets
from emberlog.queries import QUERIES
from emberlog.schema import TOPIC_SCHEMA
from emberlog.sources import legacy
from emberlog.sources.legacy import export_snapshot, exported, import_file, import_snapshot, parsed
from emberlog.sources.topics import FileTopic, KafkaTopic, ensure_topic, messages
from emberlog.streaming.ingest import apply_batch, run_pipeline

LOG = "timestamp bigint, service_name string, host_id string, message string, arrival_seq bigint"


def log(spark, first, last, hosts=3):
    return spark.createDataFrame([(t, f"svc-{t % 2}", f"h{t % hosts}", f"m{t}", t) for t in range(first, last)], LOG)


@pytest.fixture
def topic(tmp_path):
    return FileTopic(f"file://{tmp_path}/topic", files_per_trigger=1)


def test_drain_resume_and_no_duplicates(spark, tmp_path, topic):
    config = PipelineConfig(partitions=2, capacity=100)
    root, checkpoint = f"file://{tmp_path}/store", f"file://{tmp_path}/checkpoint"
    topic.send(log(spark, 0, 10), 2)
    topic.send(log(spark, 10, 20), 2)
    store, stats = run_pipeline(spark, topic, root, checkpoint, config)
    assert stats.consumed == 20 == store.len() and sum(stats.offsets.inner()["logs"].values()) == 20
    assert stats.report()[0].startswith("consumed 20")
    topic.send(log(spark, 20, 25), 2)
    store, stats = run_pipeline(spark, topic, root, checkpoint, config)
    assert stats.consumed == 5 and store.len() == 25
    assert [r.timestamp for r in store.query_by_host("h1").collect()] == list(range(1, 25, 3))
    assert run_pipeline(spark, topic, root, checkpoint, config)[1].consumed == 0


def test_a_restored_store_resumes_from_its_offsets(spark, tmp_path, topic):
    config = PipelineConfig(partitions=2, capacity=100)
    topic.send(log(spark, 0, 10), 2)
    store, _ = run_pipeline(spark, topic, f"file://{tmp_path}/store", f"file://{tmp_path}/c1", config)
    store.save_snapshot(f"file://{tmp_path}/snap")
    topic.send(log(spark, 10, 14), 2)
    LogStore.from_snapshot(spark, f"file://{tmp_path}/snap", f"file://{tmp_path}/again")
    again, stats = run_pipeline(spark, topic, f"file://{tmp_path}/again", f"file://{tmp_path}/c2", config)
    assert stats.consumed == 4 and again.len() == 14


def bad_batch(spark, partition=0):
    good = bytearray(b'{"timestamp":1,"service_name":"s","host_id":"h1","message":"m"}')
    return spark.createDataFrame([(None, good, "logs", partition, 0), (None, bytearray(b"{}"), "logs", partition, 1)], TOPIC_SCHEMA)


@pytest.mark.parametrize("router", ["md5", "sip13"])
def test_poison_fails_the_batch_or_goes_aside(spark, tmp_path, router):
    store = LogStore.with_shards(spark, f"file://{tmp_path}/store", 10, 1, router)
    with pytest.raises(DecodeError, match="offset 1"):
        apply_batch(store, bad_batch(spark), 0, "q", "logs")
    assert store.is_empty() and store.offsets().get("logs", 0) is None
    assert apply_batch(store, bad_batch(spark), 0, "q", "logs", rejected=f"file://{tmp_path}/rejected") == 1
    assert store.len() == 1 and store.offsets().get("logs", 0) == 2
    assert spark.read.parquet(f"file://{tmp_path}/rejected").select("reason").first().reason == "not a log record"
    assert apply_batch(store, bad_batch(spark), 0, "q", "logs") == 0


def test_a_foreign_partition_is_refused(spark, tmp_path):
    store = LogStore.with_shards(spark, f"file://{tmp_path}/store", 10, 2)
    wrong = 1 - ROUTERS["md5"].shard("h1", 2)
    with pytest.raises(RoutingError):
        apply_batch(store, bad_batch(spark, wrong).where("offset = 0"), 0, "q", "logs")
    assert store.is_empty()


def test_a_poisoned_topic_stops_the_pipeline(spark, tmp_path, topic):
    bad_batch(spark).coalesce(1).write.mode("append").parquet(topic.path)
    with pytest.raises(DecodeError):
        run_pipeline(spark, topic, f"file://{tmp_path}/store", f"file://{tmp_path}/c", PipelineConfig(partitions=1, capacity=10))


def test_a_poisoned_topic_drains_with_a_place_for_rejects(spark, tmp_path, topic):
    topic.send(log(spark, 0, 6), 3, ROUTERS["sip13"])
    bad_batch(spark).where("offset = 1").coalesce(1).write.mode("append").parquet(topic.path)
    rejected = f"file://{tmp_path}/rejected"
    store, stats = run_pipeline(spark, topic, f"file://{tmp_path}/store", f"file://{tmp_path}/c", PipelineConfig(partitions=3, capacity=30), "sip13", rejected)
    assert stats.consumed == 6 == store.len() and spark.read.parquet(rejected).count() == 1


def test_messages_and_missing_connectors(spark):
    rows = messages(log(spark, 0, 6), 4).collect()
    assert all(ROUTERS["md5"].shard(bytes(r.key).decode(), 4) == r.partition for r in rows)
    with pytest.raises(SourceUnavailable):
        KafkaTopic("localhost:9092", "logs").stream(spark)
    with pytest.raises(SourceUnavailable):
        KafkaTopic("localhost:9092", "logs").send(log(spark, 0, 1), 1)
    with pytest.raises(SourceUnavailable):
        ensure_topic("localhost:9092", "logs", 1)


def test_until_idle(spark, tmp_path, topic):
    """The stream waits for more, and stops when nothing comes."""
    import threading
    import time

    topic.send(log(spark, 0, 10), 2)
    late = threading.Timer(2, lambda: topic.send(log(spark, 10, 14), 2))
    late.start()
    begun = time.monotonic()
    config = PipelineConfig(partitions=2, capacity=100, poll_ms=100, idle_ms=6000)
    store, stats = run_pipeline(spark, topic, f"file://{tmp_path}/store", f"file://{tmp_path}/c", config, until_idle=True)
    late.join()
    assert stats.consumed == 14 == store.len() and time.monotonic() - begun > 6


def test_options_of_the_source():
    from emberlog.operators.store import Offsets

    found = KafkaTopic("b:1", "logs", 500, 8, 200).options()
    assert found == {"kafka.bootstrap.servers": "b:1", "subscribe": "logs", "startingOffsets": "earliest", "maxOffsetsPerTrigger": "500", "minPartitions": "8", "kafkaConsumer.pollTimeoutMs": "200"}
    held = Offsets({"logs": {0: 7, 1: 0}})
    assert KafkaTopic("b:1", "logs").options(held)["startingOffsets"] == '{"logs": {"0": 7, "1": 0}}'
    assert KafkaTopic("b:1", "other").options(held)["startingOffsets"] == "earliest"


def text(s):
    return struct.pack("<I", len(s.encode())) + s.encode()


def binary(version, shards, capacity):
    out = b"FORMAT" + version
    out += struct.pack("<QI", capacity, len(shards)) if version == b"04" else struct.pack("<I", len(shards))
    for number, end, entries in shards:
        out += struct.pack("<I", number) + (struct.pack("<Q", capacity) if version == b"05" else b"") + struct.pack("<QQ", end, len(entries))
        for t, s, h in entries:
            out += struct.pack("<q", t) + text(s) + text(h) + text(f"m{t}")
    return out + struct.pack("<I", 1) + text("logs") + struct.pack("<IIQIQ", 2, 0, 45230, 1, 38901)


def test_legacy_snapshots(spark, tmp_path):
    by = {k: next(h for h in (f"h{i}" for i in range(99)) if ROUTERS["sip13"].shard(h, 2) == k) for k in (0, 1)}
    shards = [(0, 3, [(1, "a", by[0]), (2, "b", by[0])]), (1, 2, [(-5, "a", by[1])])]
    for version, capacities in ((b"05", [5, 5]), (b"04", [3, 2])):
        data = binary(version, shards, 5) + b"trailing"
        store, offsets = import_snapshot(spark, data, f"file://{tmp_path}/store{version.decode()}", b"FORMAT")
        assert [s.capacity for s in store.version().shards] == capacities and store.len() == 3
        assert [r.timestamp for r in store.get(0, 2).collect()] == [2] and offsets.get("logs", 1) == 38901
        assert [r.timestamp for r in store.query_by_service("a").collect()] == [-5, 1]
    for broken in (b"", b"nothing!", binary(b"05", shards, 5)[:-3], binary(b"05", [], 5), binary(b"05", [(0, 0, [(1, "a", "h")])], 5)):
        with pytest.raises(SnapshotError):
            parsed(broken, b"FORMAT")
    with pytest.raises(SnapshotError):
        parsed(binary(b"05", shards, 5), b"FORMAL")


def test_export_of_binary_snapshots(spark, tmp_path):
    by = {k: next(h for h in (f"h{i}" for i in range(99)) if ROUTERS["sip13"].shard(h, 2) == k) for k in (0, 1)}
    shards = [(0, 3, [(1, "a", by[0]), (2, "b", by[0])]), (1, 2, [(-5, "a", by[1])])]
    for version in (b"05", b"04"):
        data = binary(version, shards, 6)
        store, _ = import_snapshot(spark, data, f"file://{tmp_path}/from{version.decode()}", b"FORMAT")
        assert exported(store, b"FORMAT", layout=version) == data
    path = f"file://{tmp_path}/out.snap"
    for _ in range(2):  # the second replaces the first
        export_snapshot(store, path, b"FORMAT")
    assert (tmp_path / "out.snap").read_bytes() == exported(store, b"FORMAT")


ODD = [(i - 20, ("", "a", "svc", "日本語", "x" * 150)[i % 5], f"h{i % 9}", ("", "m", "héllo ✓🚀", "\0\1\2", "y" * 700)[i % 3 + i % 2]) for i in range(60)]


def is_as_exported_and_imported(spark, tmp_path, monkeypatch, version):
    """Parts of 3 entries and windows of 64 bytes: shards, entries and texts cross their bounds."""
    monkeypatch.setattr(legacy, "SPLIT", 64)
    monkeypatch.setattr(legacy, "PART", 3)
    # one shard loses its oldest rows, some have none
    store = LogStore.with_shards(spark, f"file://{tmp_path}/store", 60, 12, "sip13")
    rows = spark.createDataFrame([(*r, i) for i, r in enumerate(ODD)], "timestamp bigint, service_name string, host_id string, message string, arrival_seq bigint")
    store.ingest(rows, offsets=Offsets({"logs": {0: 7, 3: 9}, "日本": {1: 1}}))
    assert {0, 5} <= set(store.shard_lens().values()) and max(s.oldest_offset for s in store.shards()) > 0
    path, where = f"file://{tmp_path}/snapshots/a.snap", tmp_path / "snapshots"
    for _ in range(2):  # the second replaces the first
        export_snapshot(store, path, b"FORMAT", layout=version)
    data = (where / "a.snap").read_bytes()
    assert data == exported(store, b"FORMAT", layout=version) and [p.name for p in where.iterdir()] == ["a.snap"]
    (where / "more.snap").write_bytes(data + b"trailing")
    for name in ("a", "more"):
        copy, offsets = import_file(spark, f"file://{where}/{name}.snap", f"file://{tmp_path}/from-{name}", b"FORMAT")
        assert sorted(copy.live().collect()) == sorted(store.live().collect()) and offsets == store.offsets()
        assert [(s.oldest_offset, s.next_offset) for s in copy.shards()] == [(s.oldest_offset, s.next_offset) for s in store.shards()]
        assert sorted(p.name for p in (tmp_path / f"from-{name}").iterdir()) == ["arrivals", "versions"]
    broken = [b"", b"nothing!", data[:-3], data[: len(data) // 2], data[:12], data.replace("é".encode(), b"\xc3\xc3")]
    for i, wrong in enumerate(broken):
        (where / f"{i}.snap").write_bytes(wrong)
        with pytest.raises(SnapshotError):
            import_file(spark, f"file://{where}/{i}.snap", f"file://{tmp_path}/broken{i}", b"FORMAT")
        with pytest.raises(SnapshotError):
            parsed(wrong, b"FORMAT")
    with pytest.raises(SnapshotError):
        import_file(spark, f"file://{where}/nothing.snap", f"file://{tmp_path}/broken", b"FORMAT")


def sent_to_driver(spark, does):
    """Bytes of task results of the jobs that ``does`` runs."""

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        no_quantiles = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, no_quantiles, None)
        return {stages.apply(i).stageId(): stages.apply(i).resultSize() for i in range(stages.size())}

    before = total()
    does()
    return sum(size for stage, size in total().items() if stage not in before)


def rows_stay_on_executors(spark, tmp_path, name):
    """More events send no more to the driver: positions and sizes only."""
    sent = []
    for n in (2_000, 42_000):
        events = spark.range(n).selectExpr("id AS event_id", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts", "id % 50 AS user_id", "'view' AS event_type", "repeat(md5(cast(id AS string)), 3) AS props")
        events.write.parquet(f"{tmp_path}/{n}/events.parquet")
        QUERIES["store_len"](spark, f"{tmp_path}/{n}").collect()  # makes the store
        sent.append(sent_to_driver(spark, lambda n=n: QUERIES[name](spark, f"{tmp_path}/{n}")))
    # 20,000 more rows of 96 bytes and more are live
    assert sent[1] - sent[0] < 200_000


def test_binary_files_of_the_older_layout(spark, tmp_path, monkeypatch):
    is_as_exported_and_imported(spark, tmp_path, monkeypatch, b"04")


def test_rows_of_the_older_layout_stay_on_executors(spark, tmp_path):
    rows_stay_on_executors(spark, tmp_path, "binary_roundtrip_old")


def test_binary_files_of_the_newer_layout(spark, tmp_path, monkeypatch):
    is_as_exported_and_imported(spark, tmp_path, monkeypatch, b"05")


def test_rows_of_the_newer_layout_stay_on_executors(spark, tmp_path):
    rows_stay_on_executors(spark, tmp_path, "binary_roundtrip")
