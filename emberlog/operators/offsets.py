"""Dense local offsets, retention and postings, as operators on DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Arrivals that one task numbers, writes or lists.
CHUNK = 1_000_000
_NEVER = (1 << 63) - 1


def by_shard(values: Mapping[int, int], default: int, shard: str = "shard") -> Column:
    """The value of the row's shard: a literal array, looked up by position, for any number of shards."""
    listed = ", ".join(f"{values.get(k, default)}L" for k in range(max(values, default=-1) + 1))
    return F.coalesce(F.expr(f"get(array({listed}), {shard})"), F.lit(default).cast("bigint")) if listed else F.lit(default).cast("bigint")


def local_offsets(routed: DataFrame, order: Sequence[str], base: Mapping[int, int] | None = None) -> DataFrame:
    """Adds ``local_offset``: arrivals of each shard counted in ``order`` from ``base`` (0), without gaps.

    Rows are numbered in chunks of the first order column (an integer), and each chunk starts where
    the counts of those before it end, so a large shard isn't one task's work.
    """
    chunked = routed.withColumn("_chunk", F.expr(f"{order[0]} div {CHUNK}"))
    counts = chunked.groupBy("shard", "_chunk").agg(F.count("*").alias("_n"))
    before = counts.select("shard", "_chunk", (F.sum("_n").over(W.partitionBy("shard").orderBy("_chunk")) - F.col("_n")).alias("_before"))
    before = before.withColumn("_before", F.col("_before") + by_shard({k: v for k, v in (base or {}).items() if v}, 0))
    rank = F.row_number().over(W.partitionBy("shard", "_chunk").orderBy(*order)) - 1
    numbered = chunked.withColumn("_rank", rank).join(before, ["shard", "_chunk"])
    return numbered.withColumn("local_offset", F.col("_before") + F.col("_rank")).drop("_chunk", "_rank", "_before")


def _bounded(numbered: DataFrame, routed: DataFrame, capacity: int) -> DataFrame:
    # as offsets are dense, a count says where a shard's live rows begin: no window, no sort
    bounds = routed.groupBy("shard").agg((F.count("*") - capacity).alias("_bound"))
    return numbered.join(bounds, "shard")


def newest(numbered: DataFrame, capacity: int, routed: DataFrame | None = None) -> DataFrame:
    """The last ``capacity`` arrivals of each shard of rows numbered from 0. ``routed``: the same rows
    before they were numbered, where counting them is cheaper."""
    return _bounded(numbered, routed or numbered, capacity).where("local_offset >= _bound").drop("_bound")


def evicted(numbered: DataFrame, capacity: int, routed: DataFrame | None = None) -> DataFrame:
    """The rows that ``newest`` leaves out."""
    return _bounded(numbered, routed or numbered, capacity).where("local_offset < _bound").drop("_bound")


def live_predicate(bounds: Mapping[int, int]) -> Column:
    """``local_offset`` at or above the bound of the row's shard; shards without a bound have no live
    rows. The least bound is a literal that reaches the Parquet reader."""
    if not bounds:
        return F.lit(False)
    least = F.col("local_offset") >= min(bounds.values())
    if len(bounds) == 1:
        return (F.col("shard") == next(iter(bounds))) & least
    return least & (F.col("local_offset") >= by_shard(bounds, _NEVER))


def live(arrivals: DataFrame, bounds: Mapping[int, int]) -> DataFrame:
    return arrivals.where(live_predicate(bounds))


def postings(live_rows: DataFrame, key: str) -> DataFrame:
    """For each value of ``key``, shard and chunk of CHUNK offsets, the local offsets in ascending
    order: shard, key, chunk, offsets. The lists of a frequent key are bounded by the chunk."""
    chunk = F.expr(f"local_offset div {CHUNK}").alias("chunk")
    return live_rows.groupBy("shard", key, chunk).agg(F.array_sort(F.collect_list("local_offset")).alias("offsets"))
