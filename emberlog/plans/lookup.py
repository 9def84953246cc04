"""The three look-ups. Catalyst can't infer a shard from a host, so the plan names it: a look-up
by host reads one partition, and host and time reach the Parquet reader."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def between(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Timestamps from ``first`` to ``last``, both included; none if they are the wrong way round."""
    return rows.where((F.col("timestamp") >= first) & (F.col("timestamp") <= last))


def by_host(live: DataFrame, shard: int, host: str, first: int, last: int) -> DataFrame:
    return between(live.where((F.col("shard") == shard) & (F.col("host_id") == host)), first, last).orderBy("timestamp")


def by_service(live: DataFrame, service: str, first: int, last: int) -> DataFrame:
    return between(live.where(F.col("service_name") == service), first, last).orderBy("timestamp")


def by_service_and_host(live: DataFrame, shard: int, service: str, host: str, first: int, last: int) -> DataFrame:
    one = live.where((F.col("shard") == shard) & (F.col("service_name") == service) & (F.col("host_id") == host))
    return between(one, first, last).orderBy("timestamp")


def by_posting_intersection(live: DataFrame, service: str, host: str) -> DataFrame:
    """The same rows as a join of two sets of places: the literal form of the conjunction."""
    key = ["shard", "local_offset"]
    return live.join(live.where(F.col("service_name") == service).select(*key), key, "left_semi").join(live.where(F.col("host_id") == host).select(*key), key, "left_semi")
