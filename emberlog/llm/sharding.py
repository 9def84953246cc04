"""Operator 4, sharding: minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table

SHARDS = 64
#: Atomic groups that a source is cut into: their number grows with the sources, not with their documents.
BUCKETS = 512


def greedy(prefix: np.ndarray, capacity: int, shards: int) -> np.ndarray | None:
    """Ends of shards filled in order up to ``capacity``, or None if they would be more than ``shards``.
    ``prefix``: sums of the sizes so far, beginning with 0."""
    at, ends, last = 0, [], len(prefix) - 1
    while at < last:
        to = int(np.searchsorted(prefix, prefix[at] + capacity, "right")) - 1
        if to == at or len(ends) == shards:
            return None
        ends.append(at := to)
    return np.array(ends, np.int64)


def minimax_cuts(sizes: np.ndarray, shards: int) -> tuple[int, np.ndarray]:
    """The least capacity with which ordered ``sizes`` fit in ``shards`` contiguous shards, and the
    shards' ends (exclusive), by binary search over the capacity."""
    prefix = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    if len(prefix) == 1:
        return 0, np.zeros(0, np.int64)
    low = max(int(np.max(sizes)), -(-int(prefix[-1]) // shards))
    high = low + int(np.max(sizes))
    while low < high:
        mid = (low + high) // 2
        if greedy(prefix, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low, greedy(prefix, low, shards)


def _assigned(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = pa.Table.from_batches(list(batches))
        if groups.num_rows:
            capacity, ends = minimax_cuts(groups["bytes"].to_numpy(), shards)
            shard = np.searchsorted(ends, np.arange(groups.num_rows), "right").astype(np.int32)
            full = np.full(groups.num_rows, capacity, np.int64)
            yield from groups.select(["source", "bucket"]).append_column("shard", pa.array(shard)).append_column("capacity", pa.array(full)).to_batches()

    return run


def _bucket(buckets: int) -> Column:
    """From the text's MD5, which any SQL engine has; null texts share bucket 0."""
    return F.coalesce((F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("bigint") % buckets).cast("int"), F.lit(0))


def shard(docs: DataFrame, shards: int = SHARDS, buckets: int = BUCKETS) -> DataFrame:
    """Assigns every document to one of ``shards`` contiguous shards whose largest has the least
    possible bytes of text: doc_id, source, bucket, shard, capacity.

    The atomic groups are ordered by (source, bucket), where a text's hash selects one of
    ``buckets``, so copies of a text stay together. Their sizes (UTF-8 bytes) are summed over all
    documents in Spark; one task searches over those sums, at most sources x ``buckets`` of them (about
    30 bytes each: a million sources with 512 buckets would be 15 GB; give fewer buckets then).
    Null texts count 0 bytes and share a bucket; empty ones too count 0; a very long text counts
    whole, and the capacity is at least its group's. Null sources come first as a group of their own;
    null doc_ids stay. Repeated rows are each assigned, alike. Of several cuts with the least capacity,
    shards are filled from the first on. Fewer groups than shards leave shards empty; an empty table
    gives an empty result. Other columns are ignored.
    """
    docs = pick(docs, "doc_id", "text", "source").withColumn("source", F.col("source").cast("string"))
    docs = docs.select("doc_id", "source", F.octet_length("text").alias("_bytes"), _bucket(buckets).alias("bucket"))
    sizes = docs.groupBy("source", "bucket").agg(F.coalesce(F.sum("_bytes"), F.lit(0)).cast("bigint").alias("bytes"))
    ordered = sizes.repartition(1).sortWithinPartitions(F.asc_nulls_first("source"), "bucket")
    assigned = ordered.mapInArrow(_assigned(shards), "source string, bucket int, shard int, capacity bigint").toDF("_source", "_bucket", "shard", "capacity")
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket"))
    return docs.join(assigned, same).select("doc_id", "source", "bucket", "shard", "capacity")


def op4_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


# One row walks through the search: at a capacity (low + high) // 2, it fills one shard a step, and
# starts again with a smaller or larger capacity, until low = high; then it fills the shards for good.
ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce((('0x' || substr(md5(text), 1, 8))::BIGINT % {BUCKETS})::INTEGER, 0) AS bucket, coalesce(strlen(text), 0) AS b FROM documents),
g AS (SELECT source, bucket, sum(b)::BIGINT AS b FROM d GROUP BY ALL),
o AS (SELECT source, bucket, b, row_number() OVER w AS i, (sum(b) OVER w)::BIGINT AS upto FROM g WINDOW w AS (ORDER BY source NULLS FIRST, bucket)),
p AS (SELECT list(upto ORDER BY i) AS upto, max(b) AS most, max(upto) AS total, count(*) AS n FROM o),
s(low, high, pos, used, done) AS (
  SELECT greatest(most, (total + {SHARDS - 1}) // {SHARDS}), greatest(most, (total + {SHARDS - 1}) // {SHARDS}) + most, 0::BIGINT, 0, false FROM p
  UNION ALL
  SELECT CASE WHEN done OR low >= high OR pos = n OR used < {SHARDS} THEN low ELSE (low + high) // 2 + 1 END,
    CASE WHEN NOT done AND low < high AND pos = n THEN (low + high) // 2 ELSE high END,
    CASE WHEN NOT done AND (low >= high OR pos = n OR used = {SHARDS}) THEN 0
      ELSE len(list_filter(upto, lambda x: x <= (CASE WHEN pos = 0 THEN 0 ELSE upto[pos] END) + (CASE WHEN done THEN low ELSE (low + high) // 2 END))) END,
    CASE WHEN NOT done AND (low >= high OR pos = n OR used = {SHARDS}) THEN 0 ELSE used + 1 END,
    done OR low >= high
  FROM s, p WHERE NOT (done AND pos = n)),
e AS (SELECT used - 1 AS shard, pos, low FROM s WHERE done AND used > 0)
SELECT doc_id, d.source, d.bucket, (SELECT min(shard) FROM e WHERE e.pos >= o.i)::INTEGER AS shard, (SELECT max(low) FROM e)::BIGINT AS capacity
FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source AND d.bucket = o.bucket
"""
