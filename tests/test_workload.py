from __future__ import annotations

from emberlog.operators.store import LogStore
from emberlog.workload import PERMILLES, generated, look_ups, mixed


def test_mixed_workload(spark, tmp_path):
    store = LogStore.with_shards(spark, f"file://{tmp_path}/store", 4000, 4, "sip13")
    assert store.ingest(generated(spark, 1000, 5, 4, 0)) == 1000
    row = store.query_by_service_and_host("svc-00", "host-00").first()
    assert (row.timestamp, row.message) == (0, "svc-00 on host-00 event 0")
    assert store.query_by_service_and_host("svc-04", "host-03").count() == 50
    report = look_ups(store, 12, [f"svc-0{k}" for k in range(5)], ["host-00", "host-09"], 0, 999)
    assert report.done == 12 and 0 < report.hits == len(report.latencies) <= 12
    found = report.table(spark).collect()
    assert sum(r.hits for r in found) == report.hits and all(r.p50 <= r.p999 if "p999" in r else r.p50 <= r.p99_9 for r in found)
    assert set(PERMILLES) <= set(found[0].asDict())


def test_look_ups_while_records_come_in(spark, tmp_path):
    store = LogStore.with_shards(spark, f"file://{tmp_path}/store", 4000, 4, "sip13")
    batches = [generated(spark, 200, 5, 4, 200 * k) for k in range(3)]
    report = mixed(store, batches, [f"svc-0{k}" for k in range(5)], ["host-00", "host-01"], 0, 1 << 60)
    assert report.failed == [] and report.ingested == 600 == store.len() and report.done >= 2
    assert all(x > 0 for x in report.rates().values())
    clock = generated(spark, 1).first()
    assert abs(clock.timestamp / 1e6 - __import__("time").time()) < 600
