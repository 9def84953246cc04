from __future__ import annotations

import pyarrow as pa
import pytest

from emberlog.config import PipelineConfig, split_capacity
from emberlog.functions.records import decoded, decoded_or_raise, encoded
from emberlog.functions.routing import ROUTERS, siphash13, siphash13_all, violations
from emberlog.functions.statistics import permilles

GOLDEN = {
    "h0": 0xB71F974712FFB43F, "h1": 0x726BE5979AFF09A0, "h2": 0x026EF8C724510DDB, "h3": 0x61638D0FE86C373B, "host-0": 0xA1BEDA4E46434D92,
    "host-1": 0x954FE0DF44371651, "hot-host": 0xDD654A75B1208A1E, "host-00": 0x7E16312D5BCEA139, "host-04": 0x7688BD45069D41E3,
    "host.with.dots": 0xB402652A4DC3D1DF, "MiXeD": 0xA9446265D2E8F249, "日本語ホスト": 0x7D5D4411C670607B, "": 0x30406EA523C53DEF,
}


def test_siphash_golden_values():
    assert {h: siphash13(h.encode() + b"\xff") for h in GOLDEN} == GOLDEN


def test_many_hosts_are_hashed_at_once():
    hosts = list(GOLDEN) + ["x" * n for n in range(40)] + ["é" * n for n in range(9)]
    assert siphash13_all(pa.array(hosts)).tolist() == [siphash13(h.encode() + b"\xff") for h in hosts]
    assert len(siphash13_all(pa.array([], pa.string()))) == 0


@pytest.mark.parametrize("name", ["md5", "sip13"])
def test_columns_route_like_the_driver(spark, name):
    router = ROUTERS[name]
    hosts = spark.createDataFrame([(h,) for h in GOLDEN], "host_id string")
    for shards in (1, 2, 3, 8):
        assert all(r.shard == router.shard(r.host_id, shards) for r in router.routed(hosts, shards).collect())
    none = spark.createDataFrame([(None, 1), ("h0", 2)], "host_id string, n int")
    assert {(r.n, r.shard) for r in router.routed(none, 4).collect()} == {(1, None), (2, router.shard("h0", 4))}
    given = spark.createDataFrame([("h0", 3), ("h1", 1)], "host_id string, partition int")
    assert [r.host_id for r in violations(given, 4, ROUTERS["sip13"]).collect()] == ["h1"]


def test_records(spark):
    from emberlog.queries import _ODD

    df = spark.createDataFrame([(v, ok) for v, ok in _ODD] + [(None, False)], "value string, ok boolean")
    assert [r for r in decoded(df).selectExpr("value", "ok", "reason IS NULL AS found").collect() if r.ok != r.found] == []
    bad = spark.createDataFrame([(bytearray(b'{"timestamp":1,"service_name":"\xff","host_id":"h","message":"m"}'),)], "value binary")
    assert decoded(bad).first().reason == "not UTF-8"
    pair = spark.createDataFrame([('{"timestamp":1,"service_name":"\\ud83d\\ude80","host_id":"\\\\ud800","message":"m"}',)], "value string")
    assert decoded(pair).first().record.service_name == "🚀"


def test_encoding_keeps_the_declared_order(spark):
    df = spark.createDataFrame([("m", "h", "s", -1)], "message string, host_id string, service_name string, timestamp bigint")
    value = df.select(encoded().alias("value"))
    assert value.first().value == '{"timestamp":-1,"service_name":"s","host_id":"h","message":"m"}'
    assert tuple(decoded_or_raise(value).select("timestamp", "message").first()) == (-1, "m")
    with pytest.raises(Exception, match="DecodeError"):
        decoded_or_raise(spark.createDataFrame([("{}",)], "value string")).collect()


def test_permilles(spark):
    df = spark.createDataFrame([(1, v) for v in range(10)] + [(2, 7), (2, None), (3, 5), (3, 5), (3, 1)], "k int, v int")
    found = {r.k: (r.n, r.a, r.b) for r in permilles(df, ["k"], "v", {"a": 500, "b": 999}).collect()}
    assert found == {1: (10, 4, 8), 2: (1, 7, 7), 3: (3, 5, 5)}
    assert tuple(permilles(df.where("false"), [], "v", {"a": 500}).first()) == (0, 0)
    assert tuple(permilles(df.where("k = 1"), [], "v", {"a": 500, "c": 1000}).first()) == (10, 4, 9)


def test_config(capsys):
    assert split_capacity(10, 3) == [4, 3, 3]
    with pytest.raises(ValueError):
        split_capacity(1, 0)
    assert PipelineConfig.from_env({}) == PipelineConfig()
    c = PipelineConfig.from_env({"EMBERLOG_NUM_PARTITIONS": "8", "EMBERLOG_RING_BUFFER_CAPACITY": "64", "EMBERLOG_CONSUMER_BATCH_SIZE": "0", "EMBERLOG_CONSUMER_POLL_MS": "x"})
    assert (c.partitions, c.threads, c.capacity, c.batch_size, c.poll_ms) == (8, 8, 64, 1, 200)
    assert c.rows_per_trigger() == 1_000_000 and PipelineConfig(trigger_rows=1, batch_size=300, threads=2).rows_per_trigger() == 600
    assert "EMBERLOG_CONSUMER_POLL_MS" in capsys.readouterr().err
    assert PipelineConfig.from_env({"EMBERLOG_PARTITIONS": "2", "EMBERLOG_NUM_PARTITIONS": "8"}).partitions == 2
