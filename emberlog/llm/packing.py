"""Operator 9, packing: optimal length buckets from the global histogram, and token-budget batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import pick, table, written
from .tokens import VOCABULARY, counted

#: Tokens of the longest sequence (longer documents are cut into pieces), buckets, tokens of a padded batch.
MAX_TOKENS, BUCKETS, BUDGET = 4096, 16, 65536
#: Sequences that one task numbers.
ROWS_PER_PART = 200_000


def best_boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """The lengths (at most ``buckets``) to pad to that add the fewest padding tokens in all.

    Exact dynamic programming over the distinct lengths; for each number of buckets, the best last
    cut is found on the lower hull of lines, as the costs are linear in the boundary.
    """
    lengths = sorted(x for x, n in histogram.items() if n > 0)
    n = len(lengths)
    if n <= buckets:
        return lengths
    count, total = [0], [0]
    for x in lengths:
        count.append(count[-1] + histogram[x])
        total.append(total[-1] + histogram[x] * x)
    best = [0] + [None] * n
    cuts = []
    for _ in range(buckets):
        hull, at, now, cut = [], 0, [None] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            i = j - 1
            if best[i] is not None:
                line = (-count[i], best[i] + total[i], i)
                while len(hull) >= 2 and (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]) >= (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]):
                    hull.pop()
                hull.append(line)
            if not hull:
                continue
            x, at = lengths[j - 1], min(at, len(hull) - 1)
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            now[j], cut[j] = hull[at][0] * x + hull[at][1] + x * count[j] - total[j], hull[at][2]
        best = now
        cuts.append(cut)
    found, j = [], n
    for cut in reversed(cuts):
        found.append(lengths[j - 1])
        j = cut[j]
        if not j:
            break
    return found[::-1]


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Sequences with their bucket and batch: doc_id, piece, n_tokens, bucket_tokens, batch.

    Token counts of whole texts are taken once and written; their histogram over the corpus (at
    most ``max_tokens`` rows) gives the boundaries with the least padding. A batch of a bucket
    holds ``budget // bucket_tokens`` sequences, and only a bucket's last one is not full.
    Documents of more than ``max_tokens`` tokens, however long, become pieces of that size and a
    rest. Null and empty texts have no tokens and no sequence; null doc_ids stay; repeated rows are
    sequences each, and rows with the same doc_id (or none) are spread over tasks like others. Of
    equally good boundaries the dynamic programming's first is taken. An empty table gives an empty
    result. Other columns are ignored.
    """
    if budget < max_tokens:
        raise ValueError("a batch must hold a sequence of max_tokens")
    docs = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    counts = written(docs.mapInArrow(counted(vocabulary), "doc_id bigint, row bigint, n_tokens bigint").where("n_tokens > 0"), "token-counts")
    pieces = counts.select("doc_id", "row", "n_tokens", F.explode(F.expr(f"sequence(0, cast((n_tokens - 1) div {max_tokens} as int))")).alias("piece")).select(
        "doc_id", "row", "piece", F.least(F.lit(max_tokens), F.col("n_tokens") - F.col("piece") * max_tokens).cast("int").alias("n_tokens")
    )
    histogram = {r.n_tokens: r.n for r in pieces.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    bounds = best_boundaries(histogram, buckets)
    parts = max(1, sum(histogram.values()) // ROWS_PER_PART)
    bucket = F.lit(None).cast("int")
    for b in reversed(bounds):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(b)).otherwise(bucket)
    keyed = pieces.withColumn("bucket_tokens", bucket).withColumn("_part", F.expr(f"cast(pmod(xxhash64(row, piece), {parts}) as int)"))
    before = keyed.groupBy("bucket_tokens", "_part").agg(F.count("*").alias("_n"))
    before = before.select("bucket_tokens", "_part", (F.sum("_n").over(W.partitionBy("bucket_tokens").orderBy("_part")) - F.col("_n")).alias("_before"))
    ranked = keyed.withColumn("_rank", F.row_number().over(W.partitionBy("bucket_tokens", "_part").orderBy("doc_id", "row", "piece")) - 1)
    batch = F.expr(f"(_before + _rank) div ({budget} div bucket_tokens)")
    return ranked.join(before, ["bucket_tokens", "_part"]).select("doc_id", "piece", "n_tokens", "bucket_tokens", batch.alias("batch"))


def op9_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
