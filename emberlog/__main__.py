"""Drains a Kafka topic into a store until it is idle, as the environment says, and prints a report.

    python -m emberlog STORE CHECKPOINT
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .config import PipelineConfig
from .errors import LogError
from .sources.topics import KafkaTopic
from .streaming.ingest import run_pipeline


def main(args: list[str]) -> int:
    if len(args) != 2:
        print(__doc__, file=sys.stderr)
        return 2
    config = PipelineConfig.from_env()
    spark = SparkSession.builder.appName("emberlog").getOrCreate()
    try:
        topic = KafkaTopic(config.brokers, config.topic, config.rows_per_trigger(), config.threads, config.poll_ms)
        store, stats = run_pipeline(spark, topic, args[0], args[1], config, router="sip13", until_idle=True)
    except LogError as e:
        print(f"failed: {e}", file=sys.stderr)
        return 1
    print(*stats.report(), f"{store.len()} of {store.capacity()} records are live", sep="\n")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
