"""Configuration of the ingest pipeline, from the environment."""

from __future__ import annotations

import os
import sys
from collections.abc import Mapping
from dataclasses import dataclass


def env_int(env: Mapping[str, str], default: int, *names: str) -> int:
    """The first of ``names`` that is set and a non-negative number; bad values are reported and passed over."""
    for name in names:
        raw = env.get(name)
        if raw is None:
            continue
        if raw.isascii() and raw.isdigit():
            return int(raw)
        print(f"{name}={raw!r} is no non-negative number: using the default", file=sys.stderr)
    return default


@dataclass(frozen=True)
class PipelineConfig:
    """``threads``: tasks that read at the same time, at least; ``trigger_rows``: rows of a micro-batch at
    most, which is at least ``batch_size`` for each of them (a micro-batch costs several jobs and a commit,
    so it should be large); ``poll_ms``: longest wait for a poll, and time between micro-batches where the
    pipeline runs until the topic is idle for ``idle_ms``."""

    brokers: str = "localhost:9092"
    topic: str = "ember-logs"
    partitions: int = 4
    capacity: int = 100_000
    group: str = "ember-pipeline"
    threads: int = 4
    batch_size: int = 256
    trigger_rows: int = 1_000_000
    poll_ms: int = 200
    idle_ms: int = 5_000

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> PipelineConfig:
        env = os.environ if env is None else env
        partitions = env_int(env, cls.partitions, "EMBERLOG_PARTITIONS", "EMBERLOG_NUM_PARTITIONS")
        return cls(
            brokers=env.get("EMBERLOG_BROKERS", cls.brokers),
            topic=env.get("EMBERLOG_TOPIC", cls.topic),
            partitions=partitions,
            capacity=env_int(env, cls.capacity, "EMBERLOG_CAPACITY", "EMBERLOG_RING_BUFFER_CAPACITY"),
            group=env.get("EMBERLOG_CONSUMER_GROUP", cls.group),
            threads=max(1, env_int(env, partitions, "EMBERLOG_CONSUMER_THREADS")),
            batch_size=max(1, env_int(env, cls.batch_size, "EMBERLOG_CONSUMER_BATCH_SIZE")),
            trigger_rows=max(1, env_int(env, cls.trigger_rows, "EMBERLOG_TRIGGER_ROWS")),
            poll_ms=max(1, env_int(env, cls.poll_ms, "EMBERLOG_CONSUMER_POLL_MS")),
            idle_ms=max(1, env_int(env, cls.idle_ms, "EMBERLOG_CONSUMER_IDLE_MS")),
        )

    def rows_per_trigger(self) -> int:
        return max(self.trigger_rows, self.batch_size * self.threads)


def split_capacity(total: int, shards: int) -> list[int]:
    """``total`` in ``shards`` parts that differ by 1 at most, the larger ones first."""
    if shards <= 0:
        raise ValueError("there must be at least one shard")
    small, more = divmod(total, shards)
    return [small + (k < more) for k in range(shards)]
