from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from emberlog.llm.sharding import minimax_cuts, shard


def least_capacity(sizes, shards):
    """By dynamic programming over all cuts."""
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        best = [0] + [min(max(best[i], sum(sizes[i:j])) for i in range(j)) for j in range(1, len(sizes) + 1)]
    return best[-1]


def test_capacity_is_least():
    rng = random.Random(1)
    for _ in range(300):
        sizes, shards = [rng.choice([0, 1, 2, 3, 9, 50]) for _ in range(rng.randint(1, 9))], rng.randint(1, 5)
        capacity, ends = minimax_cuts(np.array(sizes), shards)
        cuts = [0, *ends.tolist()]
        assert capacity == least_capacity(sizes, shards), (sizes, shards)
        assert len(ends) <= shards and cuts[-1] == len(sizes) and cuts == sorted(set(cuts))
        assert max(sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:])) == capacity or capacity == max(sizes)
    assert minimax_cuts(np.array([], np.int64), 3)[0] == 0


def test_shards_are_contiguous_and_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = shard(docs, 8, 32).join(docs.select("doc_id", F.octet_length("text").alias("b")), "doc_id").collect()
    assert len(rows) == docs.count()
    groups = {}
    for r in rows:
        assert groups.setdefault((r.source, r.bucket), r.shard) == r.shard
    order = [groups[k] for k in sorted(groups)]
    assert order == sorted(order)
    sizes = {}
    for r in rows:
        sizes[(r.source, r.bucket)] = sizes.get((r.source, r.bucket), 0) + r.b
    by = [sum(n for k, n in sizes.items() if groups[k] == s) for s in range(8)]
    want, _ = minimax_cuts(np.array([sizes[k] for k in sorted(sizes)]), 8)
    assert max(by) == want == rows[0].capacity


def test_odd_tables(odd, empty, odd_rows):
    found = shard(odd, 3, 16).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, _ in odd_rows)
    assert len({r.shard for r in found if r.doc_id == 5}) == 1 and {r.shard for r in found} <= {0, 1, 2}
    assert shard(odd.withColumn("source", F.lit(None).cast("string")), 3, 16).count() == len(odd_rows)
    assert shard(empty).collect() == []
