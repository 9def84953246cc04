"""A mixed workload: generated records, and look-ups in fixed shares with their latencies, one after
the other or while records come in."""

from __future__ import annotations

import random
import threading
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.statistics import permilles
from .operators.store import LogStore

#: Look-ups of each kind in a hundred.
MIX = (("host", 60), ("service+host", 30), ("service", 10))
PERMILLES = {"p50": 500, "p95": 950, "p99": 990, "p99_9": 999}


def now_micros() -> Column:
    """The wall clock in microseconds since 1970, one value for a query."""
    return F.unix_micros(F.current_timestamp())


def generated(spark: SparkSession, count: int, services: int = 10, hosts: int = 10, start_micros: int | None = None) -> DataFrame:
    """``count`` records a microsecond apart from ``start_micros`` (or the wall clock) on, that go round
    the hosts and, slower, the services."""
    n = F.col("id")
    start = now_micros() if start_micros is None else F.lit(start_micros)
    service = F.format_string("svc-%02d", ((n / hosts).cast("bigint") % services))
    host = F.format_string("host-%02d", n % hosts)
    rows = spark.range(count).select(n.alias("arrival_seq"), (n + start).alias("timestamp"), service.alias("service_name"), host.alias("host_id"))
    return rows.withColumn("message", F.concat_ws(" ", "service_name", F.lit("on"), "host_id", F.lit("event"), "timestamp"))


@dataclass
class Report:
    """Look-ups done, those with rows, and the latencies of the latter in microseconds."""

    done: int
    hits: int
    latencies: list[tuple[str, int]]
    seconds: float
    ingested: int = 0
    failed: list[str] = field(default_factory=list)

    def rates(self) -> dict[str, float]:
        """Records and look-ups a second."""
        return {"records": self.ingested / self.seconds, "look_ups": self.done / self.seconds}

    def table(self, spark: SparkSession) -> DataFrame:
        """Permilles of the latencies for each kind."""
        rows = spark.createDataFrame(self.latencies, "kind string, micros bigint")
        return permilles(rows, ["kind"], "micros", PERMILLES).withColumnRenamed("n", "hits")


def look_ups(store: LogStore, count: int, services: list[str], hosts: list[str], first: int, last: int, seed: int = 1) -> Report:
    """``count`` look-ups with random keys, each run to its rows."""
    rng, latencies, begun = random.Random(seed), [], time.perf_counter()
    kinds = [kind for kind, share in MIX for _ in range(share)]
    for _ in range(count):
        kind, service, host = rng.choice(kinds), rng.choice(services), rng.choice(hosts)
        at = time.perf_counter()
        if kind == "host":
            found = store.query_by_host(host, first, last)
        elif kind == "service":
            found = store.query_by_service(service, first, last)
        else:
            found = store.query_by_service_and_host(service, host, first, last)
        if found.toArrow().num_rows:
            latencies.append((kind, round((time.perf_counter() - at) * 1e6)))
    return Report(count, len(latencies), latencies, time.perf_counter() - begun)


def mixed(store: LogStore, batches: list[DataFrame], services: list[str], hosts: list[str], first: int, last: int, readers: int = 2, seed: int = 1) -> Report:
    """``batches`` are ingested one after the other while ``readers`` do look-ups, each at the newest
    version when it begins; readers stop after the last batch, and do one look-up each at least."""
    begun, over, reports, failed = time.perf_counter(), threading.Event(), [], []

    def read(number: int) -> None:
        rng = random.Random(seed + number)
        while True:
            try:
                reports.append(look_ups(store, 1, services, hosts, first, last, rng.randrange(1 << 30)))
            except Exception as e:  # a reader that fails is reported, and doesn't stop the others
                failed.append(f"reader {number}: {e}")
                return
            if over.is_set():
                return

    with ThreadPoolExecutor(readers) as pool:
        for k in range(readers):
            pool.submit(read, k)
        try:
            ingested = sum(store.ingest(b) for b in batches)
        finally:
            over.set()
    latencies = [x for r in reports for x in r.latencies]
    return Report(len(reports), len(latencies), latencies, time.perf_counter() - begun, ingested, failed)
