"""Topic to store: micro-batches that are applied once each.

A batch is decoded, checked and appended in one commit of the store, together with its number and
the source offsets after it; only then does the stream's checkpoint move on. A batch that is run
again after a failure finds its number and changes nothing. Rows can be queried when their batch is
committed.
"""

from __future__ import annotations

import hashlib
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PipelineConfig
from ..errors import DecodeError, RoutingError
from ..functions.records import decoded
from ..functions.routing import ROUTERS
from ..operators.store import LogStore, Offsets
from ..schema import LOG_COLUMNS
from ..sources.topics import Topic


@dataclass
class PipelineStats:
    consumed: int
    seconds: float
    offsets: Offsets

    def report(self) -> list[str]:
        lines = [f"consumed {self.consumed} records in {self.seconds:.3f} s"]
        return lines + [f"{t}/{p}: {o}" for t, ps in sorted(self.offsets.inner().items()) for p, o in sorted(ps.items())]


def apply_batch(store: LogStore, batch: DataFrame, number: int, stream: str, topic: str, rejected: str | None = None) -> int:
    """One batch of TOPIC_SCHEMA rows. A record that can't be decoded, or that is in a partition that
    doesn't own its host, fails the whole batch and nothing is written; with ``rejected`` (a folder),
    records that can't be decoded are written there instead."""
    version = store.version()
    if version.batches.get(stream, -1) >= number:
        return 0
    found = ROUTERS[version.router].routed(decoded(batch).withColumn("host_id", F.col("record.host_id")), len(version.shards))
    found = found.persist()  # decoded once; what an executor loses is decoded again
    try:
        return _checked(store, found, number, stream, topic, rejected)
    finally:
        found.unpersist()


def _checked(store: LogStore, found: DataFrame, number: int, stream: str, topic: str, rejected: str | None) -> int:
    # one pass: ends, counts, and the first row that is wrong
    bad, wrong = F.col("reason").isNotNull(), F.col("shard") != F.col("partition")
    ends = found.groupBy("partition").agg(
        (F.max("offset") + 1).alias("end"),
        F.count_if(~bad).alias("n"),
        F.min(F.when(bad, F.struct("offset", "reason"))).alias("bad"),
        F.min(F.when(wrong, F.struct("offset", "host_id", "shard"))).alias("wrong"),
    )
    offsets, counts = Offsets(), {}
    for r in ends.collect():
        if r.bad and not rejected:
            raise DecodeError(f"{r.bad.reason} at partition {r.partition}, offset {r.bad.offset}")
        if r.wrong:
            raise RoutingError(f"host {r.wrong.host_id!r} came in partition {r.partition} but belongs to shard {r.wrong.shard}")
        offsets.set(topic, r.partition, r.end)
        if r.n:
            counts[r.partition] = r.n
    if rejected:
        found.where(bad).select("topic", "partition", "offset", "value", "reason").write.mode("overwrite").parquet(f"{rejected}/stream={hashlib.md5(stream.encode()).hexdigest()}/batch={number}")
    records = found.where(~bad).select("partition", "offset", *(f"record.{c}" for c in LOG_COLUMNS))
    return store.ingest(records, ("offset",), offsets, stream, number, counts)


def run_pipeline(
    spark: SparkSession, topic: Topic, root: str, checkpoint: str, config: PipelineConfig, router: str = "md5", rejected: str | None = None, until_idle: bool = False
) -> tuple[LogStore, PipelineStats]:
    """Drains ``topic`` into the store at ``root`` (made if there is none) and stops.

    By default it stops when it has applied what was there at its start. With ``until_idle`` it polls
    every ``config.poll_ms`` and stops when nothing has come for ``config.idle_ms``. The stream
    resumes from its checkpoint; without one, from the offsets that the store holds, as after a restore.
    """
    from ..errors import LogError

    try:
        store = LogStore(spark, root)
    except LogError:
        store = LogStore.with_shards(spark, root, config.capacity, config.partitions, router)
    begun, stream = time.monotonic(), f"{config.group}:{topic.name}:{checkpoint}"
    consumed, busy = 0, begun
    failed: list[Exception] = []

    def one(batch: DataFrame, number: int) -> None:
        nonlocal consumed, busy
        try:
            consumed += apply_batch(store, batch, number, stream, topic.name, rejected)
            busy = time.monotonic()
        except (DecodeError, RoutingError) as e:
            failed.append(e)
            raise

    writer = topic.stream(spark, store.offsets()).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    query = (writer.trigger(processingTime=f"{config.poll_ms} milliseconds") if until_idle else writer.trigger(availableNow=True)).start()
    try:
        while until_idle and not query.awaitTermination(config.poll_ms / 1000):
            busy = max(busy, time.monotonic()) if query.status["isDataAvailable"] else busy
            if not query.status["isTriggerActive"] and time.monotonic() - busy > config.idle_ms / 1000:
                query.stop()
        query.awaitTermination()
    except Exception:
        if failed:
            raise failed[0] from None
        raise
    return store, PipelineStats(consumed, time.monotonic() - begun, store.offsets())
